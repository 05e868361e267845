"""Joins whose strategy follows from a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that is broadcast, at most; rows hold keys and short strings, so that is some 100 MB.
BROADCAST_ROWS = 1_000_000


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows; beyond that the join shuffles, and AQE splits its skewed keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows of one block of ``each_with_all``.
BLOCK_ROWS = 50_000


def each_with_all(left: DataFrame, right: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Every row of ``left`` with every row of ``right``, for results that are all such pairs by their nature.

    Rows of ``right`` lie in arrays of about ``BLOCK_ROWS``, and each row of ``left`` meets each array. The arrays are
    broadcast if ``right`` has at most ``most`` rows; beyond that there are blocks enough for the shuffle to be even.
    """
    n = right.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    held = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    arrays = right.select(held.alias("r")).groupBy(F.pmod(F.xxhash64("r"), F.lit(blocks)).alias("_block")).agg(F.collect_list("r").alias("_rows"))
    dealt = left.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = dealt.join(F.broadcast(arrays) if n <= most else arrays, "_block")
    return met.select(*[F.col(f"`{c}`") for c in left.columns], F.explode("_rows").alias("_r")).select(*[F.col(f"`{c}`") for c in left.columns], "_r.*")
