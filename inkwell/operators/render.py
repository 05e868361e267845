"""Text blocks from rows: what a world, an agent's view or a state looks like in a prompt or note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import env


def titled(title: str, body: Column) -> Column:
    """``## title`` over a body; null for an empty one, so that concat_ws leaves it out."""
    return F.when(F.length(body) > 0, F.concat(F.lit(f"## {title}\n"), body))


def bullet_list(values: Column, most: int | None = None) -> Column:
    held = values if most is None else F.slice(values, 1, most)
    return F.array_join(F.transform(held, lambda v: F.concat(F.lit("- "), v)), "\n")


def world_text(worlds: DataFrame, most: int = 3) -> DataFrame:
    """arc_id, text of (arc_id, media, public_events, traces), at most three items of each list."""
    body = F.concat_ws("\n\n", titled("媒体", F.coalesce("media", F.lit(""))), titled("公众", bullet_list(F.col("public_events"), most)), titled("异常", bullet_list(F.col("traces"), most)))
    return worlds.select("arc_id", body.alias("text"))


def view_text(views: DataFrame) -> DataFrame:
    """agent, text of what it perceives (agent, description)."""
    held = views.groupBy("agent").agg(F.sort_array(F.collect_set("description")).alias("seen"))
    return held.select("agent", F.coalesce(titled("你察觉到的一些异常", bullet_list(F.col("seen"))), F.lit("（无可见信息）")).alias("text"))


def clock_struct(day: Column, hour: Column) -> Column:
    """What later steps are told of the time."""
    return F.struct(day.alias("absolute_day"), env.day_period(hour).alias("period"), hour.alias("hour"), env.is_night(hour).alias("is_night"), env.formatted(day, hour).alias("formatted"))


def places(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """State of every wanted place; one that isn't known is fresh."""
    fresh = env.fresh_place()
    joined = wanted.join(known, "region", "left")
    return joined.select("region", *[F.coalesce(F.col(c), fresh[c]).alias(c) for c in fresh])


def issues_text(issues: DataFrame, key: str) -> DataFrame:
    """key, text: issues as lines, errors first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    line = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("category"), F.lit(" "), F.col("subject"), F.lit(": "), F.col("measure").cast("string"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "category", "subject", line.alias("line")))), lambda r: r["line"])
    return issues.groupBy(key).agg(F.array_join(rows, "\n").alias("text"))


def gaps_block(blocks: DataFrame) -> DataFrame:
    """One text of the characters' blocks (name, block), in order of name."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("name", "block"))), lambda r: r["block"])
    return blocks.agg(F.concat(F.lit("## 本章信息差（引擎标注）\n"), F.array_join(rows, "\n")).alias("text"))
