"""Mixing sources to target weights by min-cost flow.

Documents that belong to the same set of sources form a pattern. Words flow from each pattern, which
can be taken several times at a cost that rises with every pass (convex, so early passes fill first),
to the sources of its pattern, each of which wants its quota. Only patterns and sources are in the
network; their sizes come from one aggregation. What a pattern sends then becomes documents: whole
passes over all of them, and for the remainder a seeded choice in hash order that skips what doesn't fit
any more.

A document is never taken more than ``PASSES`` times. Defined results: null texts have size 0 and are
never taken; a null source is a source, the last; an empty table gives no rows. Rows that repeat doc_id, source and size
are a unit, of which the last pass may take some; the result has so many of them, however the input is partitioned (if their
texts differ, which of them depends on where they lie).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import WORD, cut, table

PASSES = 3
#: Cost of a word in its first, second and third pass.
PASS_COSTS = (0, 1, 3)
#: Words that a source lacks cost more than any pass.
SHORTFALL_COST = 1000
WEIGHTS = (5, 2, 1)
SEED = 2024
#: Documents of a hash bucket, on average.
BUCKET_ROWS = 4000


class FlowNetwork:
    """Min-cost flow by successive shortest paths with potentials."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = []  # to, capacity left, cost; an edge's reverse is its neighbour in the list
        self.leaving: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, capacity: int, cost: int) -> int:
        number = len(self.edges)
        self.edges += [[b, capacity, cost], [a, 0, -cost]]
        self.leaving[a].append(number)
        self.leaving[b].append(number + 1)
        return number

    def sent(self, number: int) -> int:
        return self.edges[number ^ 1][1]

    def run(self, source: int, sink: int) -> int:
        """Send as much as goes, as cheaply as possible; costs must not be negative. Returns the amount."""
        n, total = len(self.leaving), 0
        potential = [0] * n
        while True:
            far = [math.inf] * n
            came: list[int | None] = [None] * n
            far[source] = 0
            waiting = [(0, source)]
            while waiting:
                d, a = heapq.heappop(waiting)
                if d > far[a]:
                    continue
                for number in self.leaving[a]:
                    b, left, cost = self.edges[number]
                    if left and (e := d + cost + potential[a] - potential[b]) < far[b]:
                        far[b], came[b] = e, number
                        heapq.heappush(waiting, (e, b))
            if far[sink] == math.inf:
                return total
            potential = [p + (f if f < math.inf else 0) for p, f in zip(potential, far)]
            amount, at = math.inf, sink
            while at != source:
                amount = min(amount, self.edges[came[at]][1])
                at = self.edges[came[at] ^ 1][0]
            at = sink
            while at != source:
                self.edges[came[at]][1] -= amount
                self.edges[came[at] ^ 1][1] += amount
                at = self.edges[came[at] ^ 1][0]
            total += amount


def route(patterns: dict[tuple, int], quotas: dict, costs: Sequence[int] = PASS_COSTS) -> dict[tuple, dict]:
    """Words that each pattern sends to each of its sources. patterns: {(sources): words}; quotas: {source: words}."""
    names, kinds = list(quotas), list(patterns)
    start, sink = 0, 1
    of_pattern = {p: 2 + k for k, p in enumerate(kinds)}
    of_source = {s: 2 + len(kinds) + k for k, s in enumerate(names)}
    net = FlowNetwork(2 + len(kinds) + len(names))
    arcs = {}
    for p in kinds:
        for cost in costs:
            net.edge(start, of_pattern[p], patterns[p], cost)
        for s in p:
            arcs[p, s] = net.edge(of_pattern[p], of_source[s], len(costs) * patterns[p], 0)
    for s in names:
        net.edge(of_source[s], sink, quotas[s], 0)
        net.edge(start, of_source[s], quotas[s], SHORTFALL_COST)
    net.run(start, sink)
    return {p: {s: net.sent(arcs[p, s]) for s in p} for p in kinds}


def targets(sizes: dict, weights: Sequence[float] = WEIGHTS, most: float = PASSES) -> dict:
    """Each source's share of all words. Sources stand in code-point order, null last, and weigh ``weights`` in turn.

    A target stops at ``most`` times its source's size; what is cut off is shared again by weight among
    the others until no target is above.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    fixed: dict = {}
    total = sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in fixed]
        left, heft = total - sum(fixed.values()), sum(weight[s] for s in open_)
        wanted = {s: left * weight[s] / heft for s in open_}
        above = [s for s in open_ if wanted[s] > most * sizes[s]]
        if not above:
            return {s: float(fixed[s]) if s in fixed else wanted[s] for s in order}
        fixed |= {s: most * sizes[s] for s in above}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Patterns whose plan is broadcast, at most.
BROADCAST_PATTERNS = 100_000


def _edge_cut(group: pd.DataFrame) -> pd.DataFrame:
    """What an edge bucket gives: in hash order, all units that still fit, as runs of hashes that are taken whole.

    Runs end where a unit is skipped, so there are few of them unless many long units stand between short
    ones. Of a unit that doesn't fit whole as many rows are taken as do. Those units, and units that share their hash and fit in
    part only, are listed as fills with their number of rows; one more row is taken if going over by it comes nearer than
    staying short. A bucket has about BUCKET_ROWS units.
    """
    left = int(group["left"].iloc[0])
    order = group.sort_values(["h", "doc_id", "size"], kind="stable")
    words, hashes, sizes = order["words"].tolist(), order["h"].tolist(), order["size"].tolist()
    runs: list[list[int]] = []
    fills: dict[int, int] = {}
    some: list[int] = []  # units with rows left over
    open_run, at = False, 0
    while at < len(words):
        end = at + 1
        while end < len(words) and hashes[end] == hashes[at]:  # a hash lies on one side
            end += 1
        if sum(words[at:end]) <= left:
            left -= sum(words[at:end])
            if open_run:
                runs[-1][1] = hashes[at]
            else:
                runs.append([hashes[at], hashes[at]])
            open_run = True
        else:
            open_run = False
            for k in range(at, end):
                rows = min(words[k], left) // sizes[k] if sizes[k] else 0
                if rows:
                    left -= rows * sizes[k]
                    fills[k] = rows
                if rows * sizes[k] < words[k]:
                    some.append(k)
        at = end
    over = [(sizes[k] - left, k) for k in some if 0 < sizes[k] - left < left]
    if over:
        fills[min(over)[1]] = fills.get(min(over)[1], 0) + 1
    which = list(fills)
    ids = [None if pd.isna(i) else int(i) for i in order["doc_id"].iloc[which]]
    counts = [-1 if fills[k] * sizes[k] == words[k] else fills[k] for k in which]  # -1: all rows
    found = {"pattern": group["pattern"].iloc[0], "firsts": [r[0] for r in runs], "lasts": [r[1] for r in runs], "fill_ids": ids, "fill_sizes": order["size"].iloc[which].tolist(), "fill_rows": counts}
    return pd.DataFrame({k: pd.Series([v], dtype=object) for k, v in found.items()})


class Mix:
    """The plan for documents with columns doc_id, size and pattern (a string that may be null)."""

    def __init__(self, docs: DataFrame, members, seed: int = SEED, weights: Sequence[float] = WEIGHTS, quotas: dict | None = None):
        """members: the sources of a pattern, as a tuple. quotas: words for each source, else ``targets``."""
        spark = docs.sparkSession
        self.seed = seed
        docs = cut(docs.select("doc_id", "size", "pattern"))
        self.units = docs.groupBy("doc_id", "size", "pattern").agg((F.count("*") * F.col("size")).alias("words"))
        stats = {r.pattern: (int(r.words), r.n) for r in self.units.groupBy("pattern").agg(F.sum("words").alias("words"), F.count("*").alias("n")).toLocalIterator()}
        self.n_patterns = len(stats)
        self.sizes: dict = {}
        for pattern, (words, _) in stats.items():
            for source in members(pattern):
                self.sizes[source] = self.sizes.get(source, 0) + words
        self.targets = (quotas or targets(self.sizes, weights)) if stats else {}
        sent = route({members(p): w for p, (w, _) in stats.items()}, {s: round(t) for s, t in self.targets.items()}) if stats else {}
        rows = []
        for pattern, (words, n) in stats.items():
            whole, rest = divmod(sum(sent[members(pattern)].values()), words) if words else (0, 0)
            rows.append((pattern, int(whole), int(rest), math.ceil(n / BUCKET_ROWS)))
        first = spark.createDataFrame(rows, "pattern string, whole int, rest long, buckets int")
        bucketed = self._placed(self.units, first)
        sums = bucketed.groupBy("pattern", "rest", "bucket").agg(F.sum("words").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket"))
        cuts = sums.withColumn("upto", upto).groupBy("pattern").agg(
            F.max(F.when(F.col("upto") <= F.col("rest"), F.col("bucket"))).alias("full"),
            F.max(F.when((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")), F.struct(F.col("bucket"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left")))).alias("edge"),
        )
        found = {r.pattern: (-1 if r.full is None else r.full, r.edge.bucket if r.edge else -1, int(r.edge.left) if r.edge else 0) for r in cuts.toLocalIterator()}
        kind = "pattern string, whole int, rest long, buckets int, full long, edge long, left long"
        plan = [(*r, *found.get(r[0], (-1, -1, 0))) for r in rows]
        at_edge = self._placed(self.units, spark.createDataFrame(plan, kind)).where("bucket = edge").select("doc_id", "size", "pattern", "words", "left", self._hash().alias("h"))
        cut_at = {r.pattern: r for r in at_edge.groupBy("pattern").applyInPandas(_edge_cut, "pattern string, firsts array<long>, lasts array<long>, fill_ids array<long>, fill_sizes array<long>, fill_rows array<long>").toLocalIterator()} if rows else {}
        edges = [(list(zip(e.firsts, e.lasts)), list(zip(e.fill_ids, e.fill_sizes, e.fill_rows))) if (e := cut_at.get(r[0])) else ([], []) for r in plan]
        self.plan = spark.createDataFrame([(*r[:2], r[3], r[4], r[5], *e) for r, e in zip(plan, edges)], "pattern string, whole int, buckets int, full long, edge long, runs array<struct<first:long,last:long>>, fills array<struct<doc_id:long,size:long,rows:long>>")
        self.in_part = any(rows > 0 for e in cut_at.values() for rows in e.fill_rows)

    def _hash(self) -> Column:
        return F.xxhash64(F.col("doc_id"), F.lit(self.seed))

    def _placed(self, docs: DataFrame, plan: DataFrame) -> DataFrame:
        """``docs`` with its pattern's row of ``plan`` and its hash bucket.

        The plan has a row for each pattern. It is broadcast if those are few, so that the texts stay where
        they are; beyond that the rows are joined by a shuffle.
        """
        plan = plan.withColumnRenamed("pattern", "_pattern")
        plan = F.broadcast(plan) if self.n_patterns <= BROADCAST_PATTERNS else plan
        share = F.pmod(self._hash(), F.lit(1 << 40)) / float(1 << 40)
        return docs.join(plan, F.col("pattern").eqNullSafe(F.col("_pattern"))).drop("_pattern").withColumn("bucket", F.floor(share * F.col("buckets")))

    def times(self, docs: DataFrame) -> DataFrame:
        """``docs`` (with doc_id, size and pattern) and how often each row is taken; a row's own columns and its pattern's plan tell.

        Only rows of units that are taken in part are numbered: by the partition of ``docs`` that they lie in, after a sum over
        partitions, so that no task gets more of them than one partition has.
        """
        fill = F.get(F.filter("fills", lambda f: f["doc_id"].eqNullSafe(F.col("doc_id")) & (f["size"] == F.col("size"))), F.lit(0))["rows"]
        inside = F.exists("runs", lambda r: self._hash().between(r["first"], r["last"]))
        at_edge = F.col("bucket") == F.col("edge")
        told = ("whole", "buckets", "full", "edge", "runs", "fills", "bucket", "_fill", "_part")
        placed = self._placed(docs.withColumn("_part", F.spark_partition_id()) if self.in_part else docs, self.plan).withColumn("_fill", F.when(at_edge, fill))
        more = (F.col("bucket") <= F.col("full")) | (at_edge & (inside | (F.coalesce("_fill", F.lit(0)) != 0)))
        some = F.coalesce("_fill", F.lit(0)) > 0

        def counted(rows: DataFrame, more: Column) -> DataFrame:
            return rows.withColumn("times", F.when(F.col("size") > 0, F.col("whole") + more.cast("int")).otherwise(0)).drop(*told)

        if not self.in_part:
            return counted(placed, more)
        unit = ("pattern", "doc_id", "size")
        part = placed.where(some)
        upto = F.sum("_n").over(Window.partitionBy(*unit).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        before = part.groupBy(*unit, "_part").agg(F.count("*").alias("_n")).select(*[F.col(c).alias(f"_{c}") for c in unit], F.col("_part").alias("_at"), F.coalesce(upto, F.lit(0)).alias("_before"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in unit]
        place = F.row_number().over(Window.partitionBy(*unit, "_part").orderBy(F.xxhash64(*unit)))
        numbered = part.withColumn("_place", place).join(before, [*same, F.col("_part") == F.col("_at")])
        chosen = counted(numbered, F.col("_place") + F.col("_before") <= F.col("_fill"))
        rest = counted(placed.where(~some), more)
        return rest.unionByName(chosen.select(*rest.columns))


def _one(pattern: str | None) -> tuple:
    return (pattern,)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("size"), F.col("source").alias("pattern")))
    mix = Mix(docs, _one)
    facts = spark.createDataFrame([(s, n, mix.targets[s]) for s, n in mix.sizes.items()], "source string, source_size long, target double")
    taken = mix.times(docs).withColumn("taken", F.col("times") * F.col("size"))
    facts = F.broadcast(facts) if mix.n_patterns <= BROADCAST_PATTERNS else facts
    return taken.join(facts, F.col("pattern").eqNullSafe(F.col("source"))).select("doc_id", "size", "source_size", "target", "taken")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document appears as often as the mix takes it; one that isn't taken goes."""
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", word_count(F.col("text")).alias("size"), F.col("source").alias("pattern"))
    mix = Mix(sized, _one)
    repeated = mix.times(sized).where("times > 0")
    return repeated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
