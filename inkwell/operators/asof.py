"""The state that held as of a chapter, day or moment, for many novels, agents or keys of any size.

Rows that ask and rows that tell are put into one line per key and the last value is carried along it, so that no
pairs are made. A key may hold most of all rows: the line is cut by moments into spans of about ``SPAN_ROWS``
rows, in each of which values are carried by themselves; a span's last value then goes to those after it, which takes one row
for each key and span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_ROWS = 1_000_000
#: Borders of spans are an array that is searched for each row, so there are no more than so many.
MOST_SPANS = 1000


def _span(at: Column, borders: Sequence) -> Column:
    """How many borders lie at or below ``at``."""
    listed = F.array(*[F.lit(b) for b in borders]) if borders else F.array().cast("array<double>")
    return F.size(F.filter(listed, lambda b: b <= at))


def as_of(asks: DataFrame, states: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], order: Sequence[str] = (), strict: bool = False, span_rows: int = SPAN_ROWS) -> DataFrame:
    """``asks`` with ``values`` and ``as_of`` (its ``at``) of the latest state at or before theirs; null where there is none.

    ``strict`` leaves out states at the very moment. Of states of the same moment that with the largest ``order`` (then
    ``values``) holds. Asks and states without a key or a moment have none and are none; repeated asks are answered alike.
    Columns of ``states`` that aren't named don't matter; ``asks`` may have any but ``values`` and ``as_of``.
    """
    line = [*keys, at]
    whole = F.lit(True)
    for c in line:
        whole = whole & F.col(c).isNotNull()
    told = F.struct(*[F.col(c) for c in values], F.col(at).alias("as_of"))
    newest = F.max(F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], told.alias("told")))["told"]
    held = states.where(whole).groupBy(*line).agg(newest.alias("told"))
    asked = asks.where(whole).select(*line).distinct()
    both = held.select(*line, "told", F.lit(not strict).alias("first")).unionByName(asked.select(*line, F.lit(None).cast(held.schema["told"].dataType).alias("told"), F.lit(strict).alias("first")))
    moment = F.col(at).cast("timestamp").cast("double") if dict(asks.dtypes)[at] == "date" else F.col(at).cast("double")
    spans = min(MOST_SPANS, -(-both.count() // span_rows))
    borders = both.select(moment.alias("m")).approxQuantile("m", [k / spans for k in range(1, spans)], 0.1 / spans) if spans > 1 else []
    cut = both.withColumn("span", _span(moment, sorted(set(borders))))
    inside = Window.partitionBy(*keys, "span").orderBy(at, F.desc("first")).rowsBetween(Window.unboundedPreceding, 0)
    carried = cut.withColumn("own", F.last("told", ignorenulls=True).over(inside))
    ends = cut.groupBy(*keys, "span").agg(F.max_by("told", F.when(F.col("told").isNotNull(), moment)).alias("end"))
    before = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select(*keys, "span", F.last("end", ignorenulls=True).over(before).alias("earlier"))
    answers = carried.where("told IS NULL").join(earlier, [*keys, "span"]).select(*line, F.coalesce("own", "earlier").alias("told"))
    named = answers.toDF(*[f"_{k}" for k in range(len(line))], "_told")
    same = [asks[c] == named[f"_{k}"] for k, c in enumerate(line)]
    out = [F.col(f"_told.{c}").alias(c) for c in values]
    return asks.join(named, same, "left").select(*[asks[c] for c in asks.columns], *out, F.col("_told.as_of").alias("as_of"))


def chapter_states(asks: DataFrame, states: DataFrame, keys: Sequence[str], chapter: str, values: Sequence[str], back: int = 2) -> DataFrame:
    """``asks`` with the newest state of the ``back`` chapters before theirs, and ``n_states``, how many of those chapters have one.

    What an agent starts a chapter from: older states don't count, and neither does the chapter itself.
    """
    told = as_of(asks, states, keys, chapter, values, strict=True)
    recent = F.col("as_of") >= F.col(chapter) - back
    told = told.withColumns({c: F.when(recent, F.col(c)) for c in (*values, "as_of")})
    later = F.explode(F.sequence(F.col(chapter) + 1, F.col(chapter) + back))
    counted = states.select(*keys, chapter).distinct().select(*keys, later.alias(chapter)).groupBy(*keys, chapter).agg(F.count("*").alias("n_states"))
    return told.join(counted, [*keys, chapter], "left").select(*told.columns, F.coalesce("n_states", F.lit(0)).alias("n_states"))
