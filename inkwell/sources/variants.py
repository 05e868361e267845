"""JSON files without a fixed schema as rows: tick results, configurations, dimensions of characters.

A file's text is parsed into a VARIANT where the row is. What is missing takes its default, what can't be parsed or lacks a key
that must be there is told as rows; nothing of a file goes through the driver, and any number of files is one plan.
All functions take ``files`` with a ``key`` that names a file and a text column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.sources.config import DEFAULT_TRUTH_TABLE, DIMENSION_START, DIMENSIONS, MODES
from inkwell.sources.store import REQUIRED_TICK


def parsed(files: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key, doc, broken: the text as a VARIANT. A text that is null or no JSON, or no object, is broken; its doc is null."""
    doc = files.select(key, F.try_parse_json(value).alias("doc"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT")), F.lit(False))
    return doc.select(key, F.when(is_object, F.col("doc")).alias("doc"), (~is_object).alias("broken"))


def at(path: str, kind: str, doc: str = "doc") -> Column:
    """What lies at ``path``; null if there is nothing, or nothing of that kind."""
    return F.try_variant_get(F.col(doc), f"$.{path}", kind)


def lacks(name: str) -> Column:
    """Whether an object has no such key; one whose value is null is there."""
    return F.try_variant_get("doc", f"$.{name}", "variant").isNull()


def problems(docs: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """key, problem: ``broken``, or ``lacks <name>`` for each required key that isn't there."""
    missing = F.array_compact(F.array(*[F.when(lacks(name), F.lit(f"lacks {name}")) for name in required]))
    return docs.select(key, F.explode(F.when(F.col("broken"), F.array(F.lit("broken"))).otherwise(missing)).alias("problem"))


def whole(docs: DataFrame, required: Sequence[str]) -> DataFrame:
    """The files that have all that is required."""
    there = ~F.col("broken")
    for name in required:
        there = there & ~lacks(name)
    return docs.where(there)


def entries(docs: DataFrame, key: str, path: str, name: str = "name", keep: Sequence[str] = ()) -> DataFrame:
    """key, keep, pos, name, value of what the object or list at ``path`` holds; ``name`` is null in a list."""
    inside = docs.select(key, *keep, F.try_variant_get("doc", f"$.{path}", "variant").alias("_inside"))
    spark = docs.sparkSession
    found = inside.lateralJoin(spark.tvf.variant_explode(F.col("_inside").outer()))
    return found.select(key, *keep, "pos", F.col("key").alias(name) if name != key else F.col("key"), "value")


# --- tick results --------------------------------------------------------------------------------------------


def tick_problems(files: DataFrame, key: str, value: str = "value") -> DataFrame:
    return problems(parsed(files, key, value), key, REQUIRED_TICK)


def tick_rows(files: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key, arc_id, pov, seq, day, time, location, brief of the trajectories of all tick results that have what they must have."""
    docs = whole(parsed(files, key, value), REQUIRED_TICK).withColumn("arc_id", at("arc_id", "string"))
    lines = entries(docs, key, "character_trajectories", "pov", ["arc_id"]).select(key, "arc_id", "pov", F.col("value").alias("held"))
    spark = files.sparkSession
    events = lines.lateralJoin(spark.tvf.variant_explode(F.col("held").outer())).select(key, "arc_id", "pov", F.col("pos").alias("seq"), F.col("value").alias("doc"))
    return events.select(
        key, "arc_id", "pov", "seq", F.coalesce(at("day", "int"), F.lit(0)).alias("day"), F.coalesce(at("time", "string"), F.lit("")).alias("time"),
        F.coalesce(at("location", "string"), F.lit("?")).alias("location"), F.coalesce(at("brief", "string"), F.lit("")).alias("brief"),
    )


# --- configurations ------------------------------------------------------------------------------------------


def config_rows(files: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key, title, protagonist, pronoun, tom_enabled, truth_table, default_mode, n_cast of each novel's configuration.

    A broken one counts as empty. The protagonist is the name of the cast's member whose key or name is given, else what is given.
    """
    docs = parsed(files, key, value)
    members = F.coalesce(at("cast", "array<struct<key:string,name:string>>"), F.array().cast("array<struct<key:string,name:string>>"))
    wanted = F.coalesce(at("protagonist", "string"), F.lit(""))
    named = docs.select(key, "doc", members.alias("members"), wanted.alias("wanted"))
    own = F.get(F.filter("members", lambda m: (m["key"] == F.col("wanted")) | (m["name"] == F.col("wanted"))), F.lit(0))
    mode = at("pipeline.default_mode", "string")
    return named.select(
        key, F.coalesce(at("title", "string"), F.lit("")).alias("title"), F.coalesce(own["name"], "wanted").alias("protagonist"), F.coalesce(at("protagonist_pronoun", "string"), F.lit("")).alias("pronoun"),
        F.coalesce(at("theory_of_mind.enabled", "boolean"), F.lit(True)).alias("tom_enabled"), F.coalesce(F.nullif(at("theory_of_mind.truth_table", "string"), F.lit("")), F.lit(DEFAULT_TRUTH_TABLE)).alias("truth_table"),
        F.when(mode.isin(*MODES), mode).otherwise("gen").alias("default_mode"), F.size("members").alias("n_cast"),
    )


def cast_rows(files: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key, ord, cast_key, name, tier, state_key of every member of every cast; a member's state key defaults to ``<key>_state``."""
    held = entries(parsed(files, key, value), key, "cast").select(key, F.col("pos").alias("ord"), F.col("value").alias("doc"))
    own = at("key", "string")
    return held.select(key, "ord", own.alias("cast_key"), at("name", "string").alias("name"), at("tier", "int").alias("tier"), F.coalesce(at("state_key", "string"), F.concat(F.coalesce(own, F.lit("?")), F.lit("_state"))).alias("state_key"))


def chapter_modes(asks: DataFrame, files: DataFrame, key: str, chapter: str = "chapter", value: str = "value") -> DataFrame:
    """``asks(key, chapter)`` with ``mode``: the first valid one of the chapter's override, the novel's default and ``gen``."""
    docs = parsed(files, key, value)
    mode = at("pipeline.default_mode", "string")
    usual = docs.select(key, F.when(mode.isin(*MODES), mode).alias("usual"))
    special = entries(docs, key, "pipeline.chapter_overrides", "of").select(key, F.col("of").try_cast("int").alias(chapter), F.try_variant_get("value", "$", "string").alias("special"))
    special = special.where(F.col("special").isin(*MODES)).groupBy(key, chapter).agg(F.min("special").alias("special"))
    out = asks.join(usual, key, "left").join(special, [key, chapter], "left")
    return out.select(*asks.columns, F.coalesce("special", "usual", F.lit("gen")).alias("mode"))


# --- dimensions ----------------------------------------------------------------------------------------------


def dimension_rows(files: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key, dim, value of each character; a broken file, or one without dimensions, gives the defaults, a missing one its own."""
    docs = parsed(files, key, value)
    given = F.map_filter(F.coalesce(at("dimensions", "map<string,int>"), F.create_map().cast("map<string,int>")), lambda k, v: v.isNotNull())
    usual = F.create_map(*[F.lit(x) for d in DIMENSIONS for x in (d, DIMENSION_START)])
    dims = F.map_concat(F.map_filter(usual, lambda k, v: ~F.map_contains_key(given, k)), given)
    return docs.select(key, F.explode(dims).alias("dim", "value"))
