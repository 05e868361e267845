"""Packing indivisible groups into shards by best-fit decreasing.

Groups of equal weight are interchangeable, so the algorithm needs only how many groups have each
weight: in falling order of weight, the tightest bin that still has room takes as many groups of that
weight as fit, then the next tightest. That is best-fit decreasing to the letter, in one step for each
(weight, bin) that meet. The histogram comes from an aggregation; k distinct weights add up to at least
k*k/2 bytes, so the driver holds at most sqrt(2 * total bytes) of them, far less than there are groups.
The bins stand in a balanced tree ordered by remaining capacity.

Rows find their bin by their rank among groups of the same weight. Ranks and slots are row numbers
inside hash buckets of bounded size plus the buckets' running totals, so no weight, group or shard is
sorted in one task. A group with more than a ``PARTS``-th of all rows meets its shard in several parts.

Defined results: a null text weighs 1 byte, has crc 0 and groups with other nulls, not with empty
texts. Repeated rows are members of one group. An empty table gives no rows. A group heavier than an
equal share gets a shard of its own, and the rest is packed into the other shards.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import cut, table

#: Rows of a hash bucket that one task numbers.
BUCKET_ROWS = 20_000
#: A part of a group that is joined to its shard has at most this share of all rows; so there are fewer groups in parts than that.
PARTS = 1000


class Bins:
    """A treap of (remaining capacity, bin): the tightest bin with room is found and moved in logarithmic time."""

    def __init__(self):
        self._root = None
        self._chance = random.Random(11)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room: int, number: int) -> None:
        low, high = self._split(self._root, (room, number))
        self._root = self._merge(self._merge(low, [(room, number), self._chance.random(), None, None]), high)

    def take_tightest(self, weight: int) -> tuple[int, int] | None:
        """Remove and return the (room, bin) with the least room that is at least ``weight``."""
        low, high = self._split(self._root, (weight, -1))
        if high is None:
            self._root = low
            return None
        path, node = [], high
        while node[2] is not None:
            path.append(node)
            node = node[2]
        if path:
            path[-1][2] = node[3]
        else:
            high = node[3]
        self._root = self._merge(low, high)
        return node[0]


Run = tuple[int, int, int, int]


def best_fit_decreasing(histogram: Iterable[tuple[int, int]], capacity: int, first: int = 0) -> tuple[list[Run], int]:
    """Runs (weight, from rank, to rank, bin) and the number of bins. histogram: (weight, groups), weights up to ``capacity``."""
    bins, runs, opened = Bins(), [], 0
    for weight, count in sorted(histogram, reverse=True):
        done = 0
        while done < count:
            found = bins.take_tightest(weight)
            if found is None:
                found = (capacity, first + opened)
                opened += 1
            room, number = found
            n = min(count - done, room // weight)
            runs.append((weight, done, done + n, number))
            bins.add(room - n * weight, number)
            done += n
    return runs, opened


def pack_equal(histogram: list[tuple[int, int]], shards: int) -> list[Run]:
    """Runs into exactly ``shards`` bins of near-equal weight: the least capacity for which best fit needs no more bins."""
    rest = dict(histogram)
    runs: list[Run] = []
    taken: dict[int, int] = {}
    first = 0
    while rest and shards - first > 1:  # a group above an equal share of what is left fills a shard alone
        total, heaviest = sum(w * n for w, n in rest.items()), max(rest)
        if heaviest * (shards - first) <= total:
            break
        rank = taken.get(heaviest, 0)
        runs.append((heaviest, rank, rank + 1, first))
        taken[heaviest] = rank + 1
        rest[heaviest] -= 1
        if not rest[heaviest]:
            del rest[heaviest]
        first += 1
    if rest:
        items = list(rest.items())
        total, left = sum(w * n for w, n in items), shards - first
        low, high = max(-(-total // left), max(rest)), total
        best = best_fit_decreasing(items, high, first)[0]
        while low <= high:
            middle = (low + high) // 2
            tried, used = best_fit_decreasing(items, middle, first)
            if used <= left:
                best, high = tried, middle - 1
            else:
                low = middle + 1
        runs += [(w, a + taken.get(w, 0), b + taken.get(w, 0), s) for w, a, b, s in best]
    return runs


def _numbered(rows: DataFrame, key: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with a gapless ``name`` from 0 in each ``key``: buckets in turn, ``order`` inside a bucket."""
    sizes = rows.groupBy(*key, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*key, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*key, bucket).orderBy(*order)).cast("long") - 1
    return rows.withColumn("_inside", inside).join(offsets, [*key, bucket]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def _buckets(column, rows):
    return F.pmod(F.xxhash64(column), F.ceil(rows / F.lit(float(BUCKET_ROWS))))


def assign(members: DataFrame, plan) -> DataFrame:
    """``members(row, group, size, ...)`` with ``shard`` and ``slot``.

    plan: gives the runs for a histogram [(weight, groups)] of the groups' total sizes.
    """
    spark = members.sparkSession
    rows = members.count()
    parts = F.ceil(F.count("*") * PARTS / F.lit(max(1, rows)))
    groups = cut(members.groupBy("group").agg(F.sum("size").alias("weight"), parts.alias("parts")))
    counted = groups.groupBy("weight").agg(F.count("*").alias("groups"))
    histogram = [(r.weight, r.groups) for r in counted.toLocalIterator()]
    runs = spark.createDataFrame(plan(histogram), "weight long, low long, high long, shard int")
    split = groups.join(counted, "weight").withColumn("bucket", _buckets("group", F.col("groups"))).drop("groups")
    ranked = _numbered(split, ["weight"], "bucket", ["group"], "rank")
    where = (ranked.weight == runs.weight) & (ranked["rank"] >= runs.low) & (ranked["rank"] < runs.high)
    homes = ranked.join(runs, where).select("group", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    large = F.broadcast(groups.where("parts > 1").select("group", "parts"))  # fewer than PARTS groups
    dealt = members.join(large, "group", "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))).drop("parts")
    placed = dealt.join(homes, ["group", "part"]).drop("part").withColumn("bucket", _buckets("row", F.lit(max(1.0, rows / 8))))
    return _numbered(cut(placed), ["shard"], "bucket", ["row"], "slot").drop("bucket")


def pack_fixed(members: DataFrame, capacity: int) -> DataFrame:
    """Groups into as few shards of ``capacity`` as best fit needs; a group above it gets a shard that it fills alone."""

    def plan(histogram: list[tuple[int, int]]) -> list[Run]:
        runs, at = [], 0
        for weight, n in sorted(histogram, reverse=True):
            if weight > capacity:
                runs += [(weight, k, k + 1, at + k) for k in range(n)]
                at += n
        return runs + best_fit_decreasing([h for h in histogram if h[0] <= capacity], capacity, at)[0]

    return assign(members, plan)


def members_of(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, group (equal texts) and a row number that is fixed once and for all."""
    raw = F.col("text").cast("binary")
    return cut(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.md5(raw)), F.lit(b"null")).alias("group"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def op2_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    members = members_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    placed = assign(members, lambda histogram: pack_equal(histogram, shards))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def lower_bound(histogram: list[tuple[int, int]], capacity: int) -> int:
    """No packing can use fewer shards than this."""
    return math.ceil(sum(w * n for w, n in histogram) / capacity)
