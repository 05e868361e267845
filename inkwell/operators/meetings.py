"""Who met whom when which facts came up, found by blocks of pairs, so that no pair is shuffled.

Agents are dealt to groups. A group is one packed row, its agents and who of them was in which scene, and every two groups meet in a task:
the bits of all their pairs lie in a matrix, a slab of agents at a time. What moves is the presence, once to its group and from there, packed, to
each task of the group; pairs leave the task that finds them as results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StringType

from inkwell.operators.joins import if_small
from inkwell.operators.numbering import numbered
from inkwell.sources.tables import kept

#: Agents and rows of presence of a group, agents of a slab, rows of a batch of pairs, and tasks at most.
GROUP_AGENTS, GROUP_ROWS, SLAB_AGENTS, BATCH_ROWS, TASKS = 4096, 4_000_000, 1024, 50_000, 4096
#: Pairs of agents for each pair that meets, at most: beyond that most of a matrix would be empty.
EMPTY = 64
#: Rows of presence whose packed groups, some four bytes a row, are broadcast.
PACKED_ROWS = 20_000_000
#: In place of a moment that is null, which comes after all others.
LAST = np.iinfo(np.int64).max


def meet_often(presence: DataFrame, scene: Sequence[str], agent: str) -> tuple[int, int] | None:
    """About how many agents there are, and the rows of presence, if so many of all pairs meet that a matrix of them is worth it."""
    if not isinstance(presence.schema[agent].dataType, (IntegralType, StringType, DateType)):
        return None
    here = presence.where(F.col(agent).isNotNull())
    agents = here.agg(F.approx_count_distinct(agent)).first()[0]
    n = F.least(F.col("count"), F.lit(agents)).cast("double")
    rows, pairs = here.groupBy(*scene).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))).first()
    return (agents, rows) if agents <= GROUP_AGENTS or pairs * EMPTY >= agents * agents / 2 else None


def n_groups(agents: int, rows: int, cores: int) -> int:
    """Groups that fit a task, and enough that pairs of groups keep all cores busy."""
    return max(1, -(-agents // GROUP_AGENTS), -(-rows // GROUP_ROWS), min(-(-agents // 64), int(np.ceil(np.sqrt(4 * cores)))))


def met_by_blocks(presence: DataFrame, held: DataFrame, scene: Sequence[str], agent: str, size: tuple[int, int], first: bool = False, counted: bool = False) -> DataFrame:
    """who, target, _block, _bits for both ways of each pair that shares a scene of ``held``.

    ``held``: scene, _block, _bits, and _at_no if ``first``: a pair then has a row for each moment (``LAST`` for null), with the bits
    that are new at it. If
    ``counted``, ``held`` has _secret, a block's bits of sensitive facts, and a pair has one row, of n and n_secret bits. ``size``: of ``meet_often``.
    """
    spark = presence.sparkSession
    groups = n_groups(*size, spark.sparkContext.defaultParallelism)
    kind = presence.schema[agent].dataType.simpleString()
    scenes = numbered(held.select(*scene).distinct(), list(scene), "_scene")
    here = presence.where(F.col(agent).isNotNull()).join(if_small(scenes), list(scene)).select(F.pmod(F.xxhash64(agent), F.lit(groups)).alias("_group"), "_scene", F.col(agent).alias("agent"))
    asked = {"_at_no": F.col("_at_no") if first else F.lit(None).cast("long"), "_secret": F.col("_secret") if counted else F.lit(0).cast("long")}
    facts = held.withColumns(asked).join(if_small(scenes), list(scene)).select("_scene", "_block", "_at_no", "_bits", "_secret")
    told = here.select("_group", "_scene").distinct().join(if_small(facts), "_scene").toDF("_in", "_to", "_block", "_at_no", "_bits", "_secret")
    packed = kept(here.groupBy("_group").cogroup(told.groupBy("_to")).applyInArrow(_pack, f"_group long, agents array<{kind}>, scenes binary, starts binary, members binary, facts binary"))

    n = groups * (groups + 1) // 2
    of = F.floor((F.sqrt(8.0 * F.col("id") + 1) - 1) / 2)
    pairs = spark.range(0, n, 1, min(TASKS, n)).select((F.col("id") - of * (of + 1) / 2).cast("long").alias("_one"), of.alias("_other"))
    one, other = (packed.select(F.col("_group").alias(f"_{x}"), *[F.col(c).alias(f"{x}_{c}") for c in packed.columns[1:]]) for x in ("one", "other"))
    if size[1] <= PACKED_ROWS:
        met = pairs.join(F.broadcast(one), "_one").join(F.broadcast(other.drop("other_facts")), "_other")
    else:
        met = pairs.join(one.hint("merge"), "_one").join(other.drop("other_facts").hint("merge"), "_other").repartition(min(TASKS, n), "_one", "_other")
    columns = "n long, n_secret long" if counted else "_block long, _at_no long, _bits long" if first else "_block long, _bits long"

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _pairs({c: batch.column(c)[k] for c in batch.schema.names}, first, counted)

    return met.mapInArrow(found, f"who {kind}, target {kind}, {columns}")


def _pack(here: pa.Table, told: pa.Table) -> pa.Table:
    """A group's agents, its scenes in order, where each one's members start, the members, and the scenes' facts: scene, block, at, bits, secret."""
    if here.num_rows == 0:
        return pa.table({"_group": pa.array([], pa.int64()), "agents": pa.array([], pa.list_(here.schema.field("agent").type)), **{c: pa.array([], pa.binary()) for c in ("scenes", "starts", "members", "facts")}})
    coded = here["agent"].combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    n = len(coded.dictionary)
    pairs = np.unique(here["_scene"].to_numpy().astype(np.int64) * n + coded.indices.to_numpy())
    scenes, starts = np.unique(pairs // n, return_index=True)
    facts = np.stack([told[c].fill_null(LAST).to_numpy() for c in ("_in", "_block", "_at_no", "_bits", "_secret")]) if told.num_rows else np.zeros((5, 0), np.int64)
    facts = facts[:, np.lexsort((facts[0], facts[2], facts[1]))]
    parts = {"scenes": scenes, "starts": np.append(starts, len(pairs)), "members": (pairs % n).astype(np.int32), "facts": facts}
    return pa.table({
        "_group": pa.array([here["_group"][0].as_py()], pa.int64()), "agents": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), coded.dictionary),
        **{c: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for c, x in parts.items()},
    })


def _numbers(cell: pa.Scalar, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _batches(names: Sequence[str], ways: Sequence[tuple], values: Sequence) -> Iterator[pa.RecordBatch]:
    """Rows of both ways of pairs: agents, and where in them a pair's who and target lie; ``values`` are of each pair."""
    for (whos, i), (targets, j), order in ways:
        for k in range(0, len(i), BATCH_ROWS):
            at = slice(k, k + BATCH_ROWS) if order is None else order[k : k + BATCH_ROWS]
            rest = [pa.array(v[at]) for v in values]
            yield pa.RecordBatch.from_arrays([whos.take(pa.array(i[at])), targets.take(pa.array(j[at])), *rest], names=["who", "target", *names])


def _pairs(row: dict[str, pa.Scalar], first: bool, counted: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of two groups. Of a group with itself the matrix holds both ways."""
    itself = row["_one"].as_py() == row["_other"].as_py()
    ones, others = row["one_agents"].values, row["other_agents"].values
    members, others_members = (_numbers(row[f"{x}_members"], np.int32) for x in ("one", "other"))
    scenes, starts, others_scenes, others_starts = (_numbers(row[f"{x}_{c}"]) for x in ("one", "other") for c in ("scenes", "starts"))
    facts = _numbers(row["one_facts"]).reshape(5, -1)
    facts = facts[:, np.isin(facts[0], others_scenes)]
    here, there = np.searchsorted(scenes, facts[0]), np.searchsorted(others_scenes, facts[0])
    in_scene = np.repeat(np.arange(len(scenes)), np.diff(starts))
    cuts = np.append(np.flatnonzero(np.diff(facts[1], prepend=facts[1][:1] - 1)), facts.shape[1])
    for low in range(0, len(ones), SLAB_AGENTS):
        width = min(SLAB_AGENTS, len(ones) - low)
        inside = (members >= low) & (members < low + width)
        own = members[inside] - low
        own_starts = np.append(0, np.cumsum(np.bincount(in_scene[inside], minlength=len(scenes))))
        n = np.zeros((2, width, len(others)), np.int32) if counted else None
        for begin, end in zip(cuts[:-1], cuts[1:]):
            block = facts[1, begin]
            bits = np.zeros((width, len(others)), np.int64)
            if itself:
                bits[np.arange(width), low + np.arange(width)] = -1
            for k in range(begin, end):
                a = own[own_starts[here[k]] : own_starts[here[k] + 1], None]
                b = others_members[others_starts[there[k]] : others_starts[there[k] + 1]]
                if not len(a):
                    continue
                if not first:
                    bits[a, b] |= facts[3, k]
                    continue
                before = bits[a, b]
                new = facts[3, k] & ~before
                bits[a, b] = before | new
                i, j = np.nonzero(new)
                values = np.full(len(i), block), np.full(len(i), facts[2, k]), new[i, j]
                yield from _both(("_block", "_at_no", "_bits"), ones, low + a[i, 0], others, b[j], values, itself)
            if itself:
                bits[np.arange(width), low + np.arange(width)] = 0
            if counted:
                n[0] += np.bitwise_count(bits.view(np.uint64))
                n[1] += np.bitwise_count((bits & facts[4, begin]).view(np.uint64))
            elif not first:
                i, j = np.nonzero(bits)
                yield from _both(("_block", "_bits"), ones, low + i, others, j, (np.full(len(i), block), bits[i, j]), itself)
        if counted:
            i, j = np.nonzero(n[0])
            yield from _both(("n", "n_secret"), ones, low + i, others, j, (n[0][i, j].astype(np.int64), n[1][i, j].astype(np.int64)), itself)


def _both(names: Sequence[str], ones: pa.Array, i: np.ndarray, others: pa.Array, j: np.ndarray, values: Sequence, itself: bool) -> Iterator[pa.RecordBatch]:
    """Rows with one agent's after another's, each way, so that equal values lie together."""
    yield from _batches(names, [((ones, i), (others, j), None)], values)
    if not itself:
        order = np.argsort(j, kind="stable")
        yield from _batches(names, [((others, j), (ones, i), order)], values)
