"""Specs of chapters: from a model where it answers, mechanically from events where it doesn't."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators import scenes, world

#: Section numerals, and the least length of a chapter with its share for each section.
NUMERALS = ("一", "二", "三", "四", "五", "六")
LEAST_CHARS, SECTION_CHARS, EXPANDED_WORDS = 2000, 800, 700
SPEC_SCHEMA = "title string, mood string, target_chars int, sections array<struct<id:string,subject:string,scene_anchor:string,description:string,tension_direction:string,weight:string,expanded_direction:string,target_words:int>>"


def chapter_events(scoped: DataFrame, ranged: DataFrame, key: str = "chapter") -> DataFrame:
    """Events that a split gives a chapter; a chapter without any takes those of its range of days. In order of (day, time, seq)."""
    rest = ranged.join(scoped.select(key).distinct(), key, "left_anti")
    order = Window.partitionBy(key).orderBy("day", "time", "pov", "seq")
    return scoped.unionByName(rest).withColumn("seq", F.row_number().over(order))


def target_chars(sections: int) -> int:
    return max(LEAST_CHARS, SECTION_CHARS * sections)


def mechanical_spec(events: DataFrame, chapters: DataFrame, sections: int = 3) -> DataFrame:
    """chapter, ord, id, subject, description, tension_direction, weight, expanded_direction of every chapter.

    ``chapters(chapter, tension_direction, reversal_at)``. A chapter without events gets sections to be filled in.
    """
    made = scenes.mechanical_sections(events, "chapter", sections)
    every = chapters.withColumn("section", F.explode(F.sequence(F.lit(1), F.lit(sections))))
    joined = every.join(made, ["chapter", "section"], "left")
    numeral = F.get(F.array(*[F.lit(n) for n in NUMERALS]), F.col("section") - 1)
    reversal = F.col("reversal_at") == F.col("section")
    subject = F.coalesce("locations", F.concat(F.lit("场景"), F.col("section").cast("string")))
    description = F.when(F.col("briefs").isNull(), "（引擎无具体事件，请手动补充本章内容）").otherwise(F.concat(F.lit("（引擎输出）"), subject, F.lit("。"), F.col("briefs")))
    tension = F.coalesce("tension_direction", F.lit(""))
    return joined.select(
        "chapter", F.col("section").alias("ord"), numeral.alias("id"), subject.alias("subject"), description.alias("description"), tension.alias("tension_direction"),
        F.when(reversal, "expanded").otherwise("normal").alias("weight"), F.when(reversal, tension).alias("expanded_direction"),
    )


def designed_spec(replies: DataFrame, mechanical: DataFrame) -> DataFrame:
    """Sections from replies (chapter, answer JSON); chapters without a usable reply keep the mechanical ones.

    Expanded sections ask for 700 words unless the reply says otherwise.
    """
    parsed = replies.select("chapter", F.from_json("answer", SPEC_SCHEMA)["sections"].alias("sections")).where(F.size("sections") > 0)
    rows = parsed.select("chapter", F.posexplode("sections").alias("at", "s"))
    words = F.when(F.col("s.weight") == "expanded", F.coalesce("s.target_words", F.lit(EXPANDED_WORDS))).otherwise(F.col("s.target_words"))
    designed = rows.select("chapter", (F.col("at") + 1).alias("ord"), "s.id", "s.subject", "s.description", "s.tension_direction", F.coalesce("s.weight", F.lit("normal")).alias("weight"), "s.expanded_direction", words.alias("target_words"))
    rest = mechanical.join(parsed.select("chapter"), "chapter", "left_anti").withColumn("target_words", F.when(F.col("weight") == "expanded", EXPANDED_WORDS))
    return designed.unionByName(rest.select(*designed.columns))


def context_lines(ticks: DataFrame, beliefs: DataFrame, events: DataFrame, key: str = "arc_id", most_beliefs: int = 2) -> DataFrame:
    """key, line of what a spec's designer should know: unusual infrastructure, each agent's first beliefs, public events once each."""
    broken = world.unusual_infrastructure(ticks, key).select(key, F.lit(0).alias("part"), F.concat("kind", F.lit(" "), "region", F.lit(": "), "status").alias("line"))
    place = F.row_number().over(Window.partitionBy(key, "agent").orderBy("seq"))
    held = beliefs.withColumn("place", place).where(F.col("place") <= most_beliefs).select(key, F.lit(1).alias("part"), F.concat(F.col("agent").cast("string"), F.lit(": "), "proposition").alias("line"))
    public = events.groupBy(key, "event").agg(F.min("seq").alias("seq")).select(key, F.lit(2).alias("part"), F.col("event").alias("line"))
    return broken.unionByName(held).unionByName(public)


def best_source(rows: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """The rows of each key's best source (least ``rank``): one shuffle by key, whatever the number of sources."""
    return rows.withColumn("_best", F.min(rank).over(Window.partitionBy(key))).where(F.col(rank) == F.col("_best")).drop("_best")


#: Where a chapter's sections come from, the best first.
SOURCES = ("designed", "scope", "days", "blank")


def planned_sections(replies: DataFrame, scoped: DataFrame, ranged: DataFrame, chapters: DataFrame, sections: int = 3) -> DataFrame:
    """chapter, source, ord, subject, description, weight, n_events of every chapter of ``chapters(chapter)``.

    A chapter's sections are a model's (``replies(chapter, answer)``), else made from the events of its scope, else from those of its
    range of days, else blanks to be filled in. ``scoped`` and ``ranged`` are (chapter, day, time, pov, seq, location, brief). The four sources
    are one ranked union, of which the best of each chapter is kept; all steps after that keep its partitioning by chapter. Of replies that
    repeat a chapter the one with the least answer counts; rows of no given chapter are left out.
    """
    event = F.struct("day", "time", "pov", "seq", "location", "brief")
    kind = scoped.select(event.alias("e")).schema["e"].dataType
    parsed = replies.groupBy("chapter").agg(F.min("answer").alias("answer")).select("chapter", F.from_json("answer", SPEC_SCHEMA)["sections"].alias("held")).where(F.size("held") > 0)
    no_event, no_section = F.lit(None).cast(kind).alias("e"), F.lit(None).cast(parsed.schema["held"].dataType.elementType).alias("s")
    designed = parsed.select("chapter", F.posexplode("held").alias("at", "s")).select("chapter", F.lit(0).alias("rank"), F.col("at") + 1, no_event, "s")
    union = designed.toDF("chapter", "rank", "ord", "e", "s")
    for rank, events in ((1, scoped), (2, ranged)):
        union = union.unionByName(events.select("chapter", F.lit(rank).alias("rank"), F.lit(0).alias("ord"), event.cast(kind).alias("e"), no_section))
    blank = chapters.select("chapter").distinct().select("chapter", F.lit(3).alias("rank"), F.lit(0).alias("ord"), no_event, no_section)
    given = union.unionByName(blank).withColumn("_given", F.max(F.col("rank") == 3).over(Window.partitionBy("chapter"))).where("_given").drop("_given")
    best = best_source(given, "chapter")
    place = F.row_number().over(Window.partitionBy("chapter").orderBy("e.day", "e.time", "e.pov", "e.seq"))
    events = best.where("e IS NOT NULL").select("chapter", "rank", place.alias("seq"), "e.pov", "e.location", "e.brief")
    sources = F.array(*[F.lit(s) for s in SOURCES])
    made = scenes.mechanical_sections(events.drop("rank"), "chapter", sections)
    ranks = events.groupBy("chapter").agg(F.min("rank").alias("rank"))
    by_events = made.join(ranks, "chapter").select("chapter", "rank", F.col("section").alias("ord"), F.col("locations").alias("subject"), F.col("briefs").alias("description"), F.lit("normal").alias("weight"), F.col("n_events").cast("long").alias("n_events"))
    told = best.where("rank = 0").select("chapter", "rank", "ord", "s.subject", "s.description", F.coalesce("s.weight", F.lit("normal")).alias("weight"), F.lit(0).cast("long").alias("n_events"))
    empty = best.where("rank = 3").select("chapter", "rank", F.explode(F.sequence(F.lit(1), F.lit(sections))).alias("ord"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("description"), F.lit("normal").alias("weight"), F.lit(0).cast("long").alias("n_events"))
    every = told.unionByName(by_events).unionByName(empty)
    return every.select("chapter", F.get(sources, F.col("rank")).alias("source"), "ord", "subject", "description", "weight", "n_events")
