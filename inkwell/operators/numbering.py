"""Numbers of rows in the order of a whole table, without a task that sees all of it.

Rows are cut into ranges of the order, whose borders are keys of a bounded number of rows taken by chance and are data from then on, so
that a repeated task finds the same ranges; a row finds its range by halving. Rows are counted by range; a row's number is its place in its range after all rows of
earlier ranges: a prefix sum over as many numbers as there are ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import let

RANGE_ROWS = 500_000
#: Borders ride in an expression, so there are no more than so many ranges; rows that are looked at for a border.
MOST_RANGES, ROWS_A_BORDER = 256, 100


def _key(order: Sequence[str], ties: Sequence[str]) -> Column:
    """What rows are ordered by: nulls first, and a hash of all else for those that are equal in ``order``."""
    parts = [p for k, c in enumerate(order) for p in (F.col(c).isNotNull().alias(f"n{k}"), F.col(c).alias(f"v{k}"))]
    return F.struct(*parts, F.xxhash64(*ties).alias("tie"))


def numbered(rows: DataFrame, order: Sequence[str], name: str = "number", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``name``: 1 for the first by ``order`` (nulls first), and so on without gaps.

    Rows that are equal in ``order`` are numbered by a hash of their columns, so runs agree; rows that are equal altogether
    lie in one range. ``rows`` are read three times, or four times where there is more than one range.
    """
    ties = [c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    keyed = rows.withColumn("_key", _key(order, ties))
    total = rows.count()
    ranges = min(MOST_RANGES, max(1, -(-total // range_rows)))
    borders: list = []
    if ranges > 1:
        seen = sorted_keys(keyed, min(1.0, ROWS_A_BORDER * ranges / total))
        borders = [seen[k * len(seen) // ranges] for k in range(1, ranges)] if seen else []
    kind = keyed.schema["_key"].dataType
    passed = let(F.col("_key"), lambda own: _range_of(own, [_literal(b, kind) for b in borders], 0))
    placed = keyed.withColumn("_range", passed).drop("_key")
    counts = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}
    before, offsets = 0, []
    for k in range(max(counts, default=0) + 1):
        offsets.append(before)
        before += counts.get(k, 0)
    at = F.get(F.array(*[F.lit(n).cast("long") for n in offsets]), F.col("_range"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*[F.asc_nulls_first(c) for c in order], F.xxhash64(*ties)))
    return placed.withColumn(name, place + at).select(*rows.columns, name)


def sorted_keys(keyed: DataFrame, share: float) -> list:
    """The ``_key`` of about a ``share`` of the rows, in order."""
    return [r["_key"] for r in keyed.select("_key").sample(share, seed=42).sort("_key").collect()]


def _range_of(key: Column, borders: Sequence[Column], before: int) -> Column:
    """How many of the sorted ``borders``, and ``before``, lie at or below ``key``."""
    if not borders:
        return F.lit(before)
    middle = len(borders) // 2
    return F.when(key < borders[middle], _range_of(key, borders[:middle], before)).otherwise(_range_of(key, borders[middle + 1 :], before + middle + 1))


def _literal(row, kind) -> Column:
    return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])
