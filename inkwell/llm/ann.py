"""Nearest neighbours by a permutation index.

Every vector is represented by its ``PREFIX`` nearest pivots in order. Each pivot's inverted file posts
the vectors that have it among theirs, with its rank. A query accumulates, over its own pivots' files,
what its footrule distance to each posted vector falls below that to a stranger; the ``SHARE`` of a block
with the least footrule distances, and twice as many as are asked for, is reranked by the exact inner product. With
``PREFIX`` squared below ``PIVOTS`` a query's files hold fewer postings than the block has vectors, and the share is
the same for a table of any size.

Pivots (at most ``PIVOTS``) are a hash sample. Vectors are dealt by hash into blocks, each with its own
inverted files, built once; the queries go past every block in batches, and a block returns at most k rows for
each query. So vectors are shuffled once, queries once for each block. Blocks grow with the root of the table
from ``BLOCK`` rows to ``BLOCK_MOST``, whose files take some 150 MB of a worker. Vectors of unequal length are told
apart by one more coordinate (what a vector lacks to the longest one), so that the nearest by angle is
the largest by inner product.

Defined results: vectors that are null, zero, of another dimension than the most common one, or hold
null or non-finite components take no part. Rows that repeat a vec_id are listed once, and never for
the query with that id. Ties go to the smaller vec_id. With fewer than k candidates all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import cut, table, tidy, unsigned_share

PIVOTS, PREFIX, SHARE = 2048, 45, 0.2
#: Rows whose similarities to all pivots are held at once.
CHUNK = 2048
BLOCK, BLOCK_MOST = 4096, 1 << 17


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.col("v")
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & (F.size(v) > 0))
    fine = held.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0))
    common = fine.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return fine.where(F.size(v) == (common.d if common else 0))


def _matrix(values: pa.ListArray) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors of one more dimension; between them and plain queries the angle orders like the inner product."""
    x = x / longest
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))[:, None]])


def prefixes(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's nearest pivots in order."""
    out = np.empty((len(x), min(prefix, len(pivots))), np.int64)
    for start in range(0, len(x), CHUNK):
        far = -(x[start : start + CHUNK] @ pivots.T)
        near = np.sort(np.argpartition(far, out.shape[1] - 1, axis=1)[:, : out.shape[1]], axis=1) if out.shape[1] < len(pivots) else np.broadcast_to(np.arange(len(pivots)), far.shape)
        order = np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable")
        out[start : start + CHUNK] = np.take_along_axis(near, order, axis=1)
    return out


class Block:
    """Inverted files over one block of vectors, which come sorted by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, longest: float, prefix: int):
        self.ids, self.x, self.prefix = ids, x, min(prefix, len(pivots))
        self.names, self.firsts, self.number = np.unique(ids, return_index=True, return_inverse=True)
        order = prefixes(lifted(x, longest), pivots, self.prefix)
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        rows, ranks = np.divmod(by_pivot, self.prefix)
        bounds = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1)).tolist()
        rows, ranks = rows.astype(np.int32), ranks.astype(np.int16)
        self.files = [(rows[a:b], ranks[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]

    def nearness(self, order: np.ndarray) -> np.ndarray:
        """Half of what each vector's footrule distance to a query of pivots ``order`` lies below a stranger's."""
        files = [self.files[pivot] for pivot in order.tolist()]
        rows = np.concatenate([f[0] for f in files])
        worth = np.concatenate([self.prefix - np.maximum(f[1], rank) for rank, f in enumerate(files)])
        return np.bincount(rows, worth, len(self.ids)).astype(np.int64)

    def search(self, own: int, q: np.ndarray, order: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k best ids and their scores; rows that repeat an id count once, by the best of them."""
        n = len(self.names)
        most = min(n, math.ceil(share * n) + 2 * k)
        near = np.maximum.reduceat(self.nearness(order), self.firsts)
        key = near * n + np.arange(n - 1, -1, -1)  # ties: the smaller id first
        chosen = np.argpartition(-key, most - 1)[:most] if most < n else np.arange(n)
        chosen = np.sort(chosen[self.names[chosen] != own])
        if not len(chosen):
            return chosen, np.empty(0)
        if n < len(self.ids):
            wanted = np.zeros(n, bool)
            wanted[chosen] = True
            chosen = np.flatnonzero(wanted[self.number])
        else:
            chosen = self.firsts[chosen]
        rough = self.x[chosen] @ q
        if len(chosen) > k and n == len(self.ids):
            lowest = np.partition(rough, len(rough) - k)[len(rough) - k]
            chosen = chosen[rough >= lowest - 1e-9 * max(1.0, abs(lowest))]
        score = (self.x[chosen] * q).sum(axis=1)
        best = best_of(self.ids[chosen], score, k)
        return chosen[best], score[best]


def best_of(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best ids, each by its best score."""
    order = np.lexsort((ids, -score))
    first = np.unique(ids[order], return_index=True)[1]
    return order[np.sort(first)[:k]]


def block_rows(n: int) -> int:
    return int(min(BLOCK_MOST, max(BLOCK, 16 * math.sqrt(n))))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each vector whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    held = cut(usable(vectors).dropDuplicates())
    n, n_ids, longest = held.agg(F.count("*"), F.countDistinct("vec_id"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    asked = held.where(F.col("vec_id") % every == 0)
    if asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = held.where(unsigned_share(F.col("vec_id"), 7) < 4.0 * pivots / n_ids).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    sample = sample or held.orderBy("vec_id").limit(1).collect()
    shared = spark.sparkContext.broadcast(lifted(np.unique(np.array([r.v for r in sample]), axis=0), longest))
    blocks = -(-n // block_rows(n))
    one = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))
    every_one = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    dealt = held.select(one.alias("block"), F.lit(False).alias("asks"), "vec_id", "v").unionByName(asked.select(every_one.alias("block"), F.lit(True).alias("asks"), "vec_id", "v"))

    def answers(block: Block, ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        unit = q / np.linalg.norm(q, axis=1)[:, None]
        orders = prefixes(np.hstack([unit, np.zeros((len(q), 1))]), shared.value, block.prefix)
        out = [(own, *block.search(own, v, order, k, share)) for own, v, order in zip(ids.tolist(), q, orders)]
        asking = np.repeat(ids, [len(rows) for _, rows, _ in out])
        rows, score = (np.concatenate([o[i] for o in out]) for i in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(asking), pa.array(block.ids[rows.astype(np.int64)]), pa.array(score.astype(np.float64))], names=["query_id", "vec_id", "score"])

    @tidy
    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block: its vectors by id, then all queries."""
        now, waiting, block = None, [], None
        for batch in batches:
            number, asks, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "asks", "vec_id"))
            edges = [0, *(np.flatnonzero((np.diff(number) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), len(ids)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if number[a] != now:
                    now, waiting, block = number[a], [], None
                x = _matrix(batch.column("v").slice(a, b - a))
                if not asks[a]:
                    waiting.append((ids[a:b], x))
                    continue
                if block is None and waiting:
                    block = Block(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), shared.value, longest, prefix)
                if block is not None:
                    yield answers(block, ids[a:b], x)

    found = dealt.repartition("block").sortWithinPartitions("block", "asks", "vec_id").mapInArrow(serve, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
