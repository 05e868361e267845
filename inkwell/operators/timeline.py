"""Timelines, hook ledgers and upserts of chapter states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.numbering import numbered


def timeline_entries(events: DataFrame, source: str) -> DataFrame:
    """day, time, event, source, seq in order of (day, time, seq)."""
    event = F.concat(F.lit("["), F.col("pov"), F.lit("] "), F.coalesce("brief", F.lit("")))
    return events.select("day", F.coalesce("time", F.lit("?")).alias("time"), event.alias("event"), F.lit(source).alias("source"), "seq").orderBy("day", "time", "seq")


def numbered_hooks(hooks: DataFrame, existing: DataFrame, order: str = "seq") -> DataFrame:
    """New ledger entries: hooks whose id isn't there yet; one without an id gets ``hook_%03d``.

    The number counts every given hook, skipped ones too, after the existing ones, however many a ledger has.
    """
    before = existing.count()
    named = numbered(hooks, [order], "_n").withColumn("_id", F.nullif("id", F.lit(""))).withColumn("_n", F.col("_n") + before)
    fresh = named.join(existing.select(F.col("id").alias("_id")).where("_id is not null"), "_id", "left_anti")
    made = F.coalesce("_id", F.format_string("hook_%03d", F.col("_n")))
    touched = F.concat(F.lit("ch"), F.coalesce("created_at_chapter", F.lit(1)).cast("string"))
    return fresh.select(made.alias("id"), "description", touched.alias("created_at"), touched.alias("last_touched"), F.lit("新增").alias("type"), F.lit("open").alias("status"), order)


def numbered_in_groups(rows: DataFrame, group: str, order: Sequence[str], start: int = 0, pattern: str = "hook_%03d") -> DataFrame:
    """``rows`` with an id made of their place in ``group``."""
    return rows.withColumn("id", F.format_string(pattern, F.row_number().over(Window.partitionBy(group).orderBy(*order)) + start))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` rows, and the ``old`` ones whose keys have no new row."""
    return old.join(new, list(keys), "left_anti").unionByName(new)


def timeline_markdown(entries: DataFrame) -> DataFrame:
    """day and its table as Markdown."""
    row = F.concat(F.lit("| "), F.col("time"), F.lit(" | "), F.col("event"), F.lit(" | "), F.col("source"), F.lit(" |"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("time", "seq", row.alias("row")))), lambda r: r["row"])
    head = F.concat(F.lit("## 第"), F.col("day").cast("string"), F.lit("天\n\n| 时间 | 事件 | 来源 |\n|------|------|------|\n"))
    return entries.groupBy("day").agg(F.array_join(rows, "\n").alias("rows")).select("day", F.concat(head, F.col("rows")).alias("markdown"))


def trajectory_markdown(events: DataFrame) -> DataFrame:
    """pov, label and the table of its events; private events are marked by a lock."""
    brief = F.when(F.endswith("pov", F.lit("_private")), F.concat(F.lit("🔒 "), F.col("brief"))).otherwise(F.col("brief"))
    row = F.concat(F.lit("| 第"), F.col("day").cast("string"), F.lit("天 | "), F.col("time"), F.lit(" | "), F.col("location"), F.lit(" | "), brief, F.lit(" |"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("seq", row.alias("row")))), lambda r: r["row"])
    head = F.concat(F.lit("## "), F.col("label"), F.lit(" 的行动线\n\n| 天 | 时间 | 地点 | 事件 |\n|----|------|------|------|\n"))
    return events.groupBy("pov", "label").agg(F.array_join(rows, "\n").alias("rows")).select("pov", F.concat(head, F.col("rows")).alias("markdown"))
