"""Specs and chapters: validation, continuity, chained context, merging, character dimensions, states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell import params
from inkwell.functions.text import blank_to_null, contains_any, strip

#: Phrases that hint at an anomaly, each group one signal.
ANOMALY_SIGNALS = (("回不来", "没有回来"), ("消失了", "不见", "不存在"), ("空无一人", "什么也没有"))
WATCH, HANDS = "手表", ("左手", "右手")


def has_anomaly(text: Column) -> Column:
    found = text.contains(WATCH) & contains_any(text, HANDS)
    for group in ANOMALY_SIGNALS:
        found = found | contains_any(text, group)
    return found


def section_issues(sections: DataFrame, spec: str = "spec_id", negative: Sequence[str] = params.NEGATIVE_MARKERS, short: int = 20) -> DataFrame:
    """spec, section, severity, rule for the rules that look at one section.

    All rules of a section are one array, so the sections are read once.
    """
    description, tension, expanded = (strip(F.coalesce(F.col(c), F.lit(""))) for c in ("description", "tension_direction", "expanded_direction"))
    rules = [
        ("ERROR", "empty_description", description == ""),
        ("WARN", "short_description", (description != "") & (F.length(description) < short)),
        ("WARN", "missing_tension", tension == ""),
        ("WARN", "negative_tension", contains_any(tension, negative)),
        ("WARN", "missing_expanded_direction", (F.col("weight") == "expanded") & (expanded == "")),
    ]
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"), bad.alias("bad")) for s, r, bad in rules])
    return sections.select(spec, "section", F.explode(F.filter(rows, lambda r: r["bad"])).alias("r")).select(spec, "section", "r.severity", "r.rule")


def spec_issues(sections: DataFrame, specs: DataFrame, latest: DataFrame | None = None, spec: str = "spec_id", anomalous: Column | None = None) -> DataFrame:
    """spec, severity, rule for the rules that look at a whole spec.

    ``specs(spec, chapter, target_chars)``; ``latest(chapter)`` is the last chapter that exists, if any.
    """
    both = F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("tension_direction", F.lit("")))
    signal = has_anomaly(both) if anomalous is None else anomalous
    sums = sections.groupBy(spec).agg(F.count("*").alias("n"), F.count_if(signal).alias("n_signals"))
    joined = specs.join(sums, spec, "left").na.fill(0, ["n", "n_signals"])
    last = latest.agg(F.max("chapter").alias("last")) if latest is not None else None
    joined = joined.join(F.broadcast(last)) if last is not None else joined.withColumn("last", F.lit(None).cast("int"))
    some = F.col("n") > 0
    rules = [
        ("ERROR", "no_sections", ~some),
        ("WARN", "tight_sections", some & (F.col("target_chars") > 0) & (F.col("target_chars") < 400 * F.col("n")) & (F.col("n") >= 4)),
        ("ERROR", "chapter_order", some & (F.col("chapter") != F.col("last") + 1)),
        ("WARN", "anomaly_density", some & (F.col("chapter") <= 3) & (F.col("n_signals") > 3)),
    ]
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"), bad.alias("bad")) for s, r, bad in rules])
    return joined.select(spec, F.explode(F.filter(rows, lambda r: r["bad"])).alias("r")).select(spec, "r.severity", "r.rule")


def continuity_warnings(chapters: DataFrame, novel: str = "novel") -> DataFrame:
    """novel, chapter, warning: an earlier chapter is missing, or its day isn't before this one's."""
    w = Window.partitionBy(novel).orderBy("chapter")
    before, day = F.lag("chapter").over(w), F.lag("absolute_day").over(w)
    marked = chapters.withColumn("_before", before).withColumn("_day", day)
    missing = (F.col("chapter") > 1) & (F.col("_before").isNull() | (F.col("_before") != F.col("chapter") - 1))
    late = ~missing & (F.col("absolute_day") != 0) & (F.col("_day") != 0) & (F.col("absolute_day") <= F.col("_day"))
    warning = F.when(missing, "missing_previous").when(late, "day_not_after")
    return marked.select(novel, "chapter", warning.alias("warning")).where("warning is not null")


def chained_context(turns: DataFrame, doc: str, order: str, text: str = "text", window: int = params.CONTEXT_CHARS) -> DataFrame:
    """``turns`` with ``context``: the end of the text before, empty for the first."""
    before = F.lag(F.coalesce(F.col(text), F.lit(""))).over(Window.partitionBy(doc).orderBy(order))
    return turns.withColumn("context", F.coalesce(F.right(before, F.lit(window)), F.lit("")))


def length_hint(target: Column, sections: Column, expanded: Column, words: Column) -> Column:
    """Characters to ask for in a section: an equal share, 150 at least; expanded ones ask for their own or twice that."""
    share = F.floor(target / sections)
    return F.greatest(F.lit(150), F.when(expanded, F.coalesce(words, 2 * share)).otherwise(share)).cast("long")


def merged_texts(parts: DataFrame, doc: str, order: str, text: str = "text", separator: str = "\n\n") -> DataFrame:
    """doc, merged: its parts in order, stripped, blank ones left out."""
    held = F.sort_array(F.collect_list(F.struct(F.col(order), blank_to_null(F.col(text)).alias("t"))))
    kept = F.filter(F.transform(held, lambda p: p["t"]), lambda t: t.isNotNull())
    return parts.groupBy(doc).agg(F.array_join(kept, separator).alias("merged"))


def clamped(impacts: DataFrame, key: Sequence[str], start: Column, low: int = 1, high: int = 5) -> DataFrame:
    """key, value after deltas in order of ``seq``, each step kept between ``low`` and ``high``."""
    steps = F.sort_array(F.collect_list(F.struct("seq", "delta")))
    value = F.aggregate("steps", start.cast("long"), lambda v, s: F.greatest(F.lit(low), F.least(F.lit(high), v + s["delta"])).cast("long"))
    return impacts.groupBy(*key).agg(steps.alias("steps")).select(*key, value.alias("value"), F.size("steps").cast("long").alias("n_changes"))


def chapter_summary(sections: DataFrame, chapter: str, names: Sequence[str], most: int = 120, hints: int = 2) -> DataFrame:
    """chapter, key_events, tension, hints: what a chapter's sections say about its state.

    Events are the first ``most`` characters of each description; tension is the first that isn't empty;
    hints are first sentences of the first sections that name one of ``names``.
    """
    description = F.coalesce("description", F.lit(""))
    sentence = F.when(F.instr(description, "。") > 0, F.substring_index(description, "。", 1)).otherwise(F.left(description, F.lit(60)))
    rows = F.sort_array(F.collect_list(F.struct(
        "ord", F.when(description != "", F.concat(F.lit("- "), F.coalesce("subject", F.lit("")), F.lit("："), F.left(description, F.lit(most)))).alias("event"),
        F.nullif("tension_direction", F.lit("")).alias("tension"), F.when(contains_any(description, names), sentence).alias("hint"),
    )))

    def kept(field: str) -> Column:
        return F.filter(F.transform("rows", lambda r: r[field]), lambda v: v.isNotNull())

    return sections.groupBy(chapter).agg(rows.alias("rows")).select(chapter, F.array_join(kept("event"), "\n").alias("key_events"), F.get(kept("tension"), F.lit(0)).alias("tension"), F.array_join(F.slice(kept("hint"), 1, hints), "\n").alias("hints"))


def profiles(names: DataFrame, chapters: DataFrame, default: str = "") -> DataFrame:
    """name, location of the oldest chapter state (chapter, name, location) that has the name; else the default."""
    first = chapters.groupBy("name").agg(F.min_by("location", "chapter").alias("location"))
    return names.join(first, "name", "left").withColumn("location", F.coalesce("location", F.lit(default)))


def restored(agents: DataFrame, saved: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``agents`` with ``columns`` taken from ``saved`` where those aren't null or empty."""
    marked = saved.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = agents.join(marked, key, "left")
    return out.select(*[F.coalesce(F.when(F.length(F.col(f"_{c}").cast("string")) > 0, F.col(f"_{c}")), F.col(c)).alias(c) if c in columns else F.col(c) for c in agents.columns])


def merge_rows(rows: DataFrame, key: str, line: Column, order: Sequence[str], name: str, separator: str = "\n") -> DataFrame:
    """key and its lines joined in order."""
    held = F.sort_array(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(held, lambda r: r["_line"]), separator).alias(name))


def first_of(rows: DataFrame, key: str, order: Sequence[str], most: int) -> DataFrame:
    """``rows`` with place, the ``most`` first of each key; what a context has room for. Spark cuts them down before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)


def day_spans(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, first_day, last_day, n_events: the days that a chapter covers."""
    return events.groupBy(*keys).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_events"))
