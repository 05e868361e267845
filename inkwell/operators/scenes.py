"""Scenes: clustering by day and place, dramatic weight, and distribution over chapters."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell import params
from inkwell.functions.text import contains_any

LATEST = "99"


def brief_of(action: Column, inner: Column, warm: Column) -> Column:
    """One line from an action, what is thought and what is done out of care; empty parts add nothing."""
    return F.concat(
        F.coalesce(action, F.lit("")),
        F.when(F.length(inner) > 0, F.concat(F.lit("　心想："), inner)).otherwise(""),
        F.when(F.length(warm) > 0, F.concat(F.lit("（"), warm, F.lit("）"))).otherwise(""),
    )


def split_by_visibility(actions: DataFrame, agent: str = "agent", visible: str = "visible") -> DataFrame:
    """``actions`` with ``pov``: private where the agent marks visibility anywhere and this action isn't visible."""
    marks = actions.where(F.col(visible).isNotNull()).select(F.col(agent).alias("_marks")).distinct()
    private = F.col("_marks").isNotNull() & ~F.coalesce(F.col(visible), F.lit(True))
    marked = actions.join(marks, F.col(agent).eqNullSafe(F.col("_marks")), "left")
    return marked.withColumn("is_private", private).drop("_marks").withColumn("pov", F.concat(F.col(agent).cast("string"), F.when(F.col("is_private"), "_private").otherwise("")))


def observation_events(observations: DataFrame) -> DataFrame:
    """Private events from (agent, seq, day, location, about, observation, concern)."""
    level = F.when(F.col("concern").isNotNull(), F.concat(F.lit("，担忧程度 "), F.col("concern").cast("string"), F.lit("/10"))).otherwise("")
    brief = F.concat(F.lit("观察"), F.coalesce("about", F.lit("")), F.lit("："), F.col("observation"), level)
    return observations.where(F.length("observation") > 0).select(F.concat("agent", F.lit("_private")).alias("pov"), "seq", "day", F.lit("?").alias("time"), "location", brief.alias("brief"))


def pov_label(pov: Column) -> Column:
    return F.regexp_replace(pov, "_private$", "")


def labelled(events: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``events`` with ``label``: from ``labels(pov, label)`` if given, else the pov without its private ending."""
    if labels is None:
        return events.withColumn("label", pov_label(F.col("pov")))
    return events.join(labels, "pov", "left").withColumn("label", F.coalesce("label", "pov"))


def shared_scenes(actions: DataFrame, agent: str = "agent") -> DataFrame:
    """day, location, n_agents, n_actions of the places where at least two agents are on a day."""
    keyed = actions.select(F.coalesce("day", F.lit(0)).alias("day"), F.coalesce("location", F.lit("?")).alias("location"), agent)
    grouped = keyed.groupBy("day", "location").agg(F.countDistinct(agent).alias("n_agents"), F.count("*").alias("n_actions"))
    return grouped.where("n_agents >= 2")


def scene_agents(actions: DataFrame, agent: str = "agent", order: str = "seq") -> DataFrame:
    """Agents of each shared scene in the order in which they first appear."""
    first = actions.groupBy("day", "location", agent).agg(F.min(order).alias("at"))
    held = first.groupBy("day", "location").agg(F.sort_array(F.collect_list(F.struct("at", agent))).alias("all"))
    return held.where(F.size("all") >= 2).select("day", "location", F.transform("all", lambda a: a[agent]).alias("agents"))


def clustered(events: DataFrame, names: Sequence[str] = (), phone: Sequence[str] = (), anomaly: Sequence[str] = (), labels: dict[str, str] | None = None) -> DataFrame:
    """Scenes by (day, location) of ``events(pov, day, time, location, brief)``.

    first_time, n_events, n_povs, has_private, interactive, anomalous, weight. A scene is interactive if a
    brief without phone words names someone other than one of the scene's povs.
    """
    label = F.col("pov")
    for pov, name in (labels or {}).items():
        label = F.when(F.col("pov") == pov, name).otherwise(label)
    named = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(F.col("brief"), n)) if names else F.array().cast("array<string>")
    scenes = events.groupBy("day", "location").agg(
        F.min(F.coalesce(F.nullif("time", F.lit("")), F.lit(LATEST))).alias("first_time"),
        F.count("*").alias("n_events"),
        F.collect_set("pov").alias("povs"),
        F.collect_set(label).alias("pov_names"),
        F.array_distinct(F.flatten(F.collect_set(F.when(~contains_any(F.col("brief"), phone), named)))).alias("named"),
        F.max(contains_any(F.col("brief"), anomaly)).alias("anomalous"),
    )
    other = F.exists("pov_names", lambda p: F.exists("named", lambda n: n != p))
    private = F.exists("povs", lambda p: F.endswith(p, F.lit("_private")))
    return scenes.select(
        "day", "location", "first_time", "n_events", F.size("povs").cast("long").alias("n_povs"), private.alias("has_private"), other.alias("interactive"), "anomalous",
        (1 + 2 * other.cast("int") + private.cast("int") + 2 * (F.size("povs") > 1).cast("int") + F.col("anomalous").cast("int")).cast("long").alias("weight"),
    )


def spec_scenes(events: DataFrame, meeting: Sequence[str], phone: Sequence[str]) -> DataFrame:
    """Scenes for a spec: interactive if a brief with a meeting verb has no phone word."""
    brief = F.coalesce("brief", F.lit(""))
    return events.groupBy("day", F.coalesce("location", F.lit("")).alias("location")).agg(
        F.count("*").alias("n_events"),
        F.max(contains_any(brief, meeting) & ~contains_any(brief, phone)).alias("interactive"),
        F.max(F.endswith(F.col("pov"), F.lit("_private"))).alias("has_private"),
    )


def strong_days(scenes: DataFrame, least: int = params.STRONG_SCENE) -> DataFrame:
    return scenes.groupBy("day").agg(F.count_if(F.col("weight") >= least).alias("n_strong"))


def days_to_chapters(days: DataFrame, chapters: int) -> DataFrame:
    """day, chapter (from 1): whole days, in order; extra days go to the last chapters. ``days`` has one row a day.

    Days are calendar-bounded, so one window over them is small whatever the events' number.
    """
    order = Window.orderBy("day")
    rank, n = F.row_number().over(order), F.count("*").over(Window.partitionBy())
    early = F.lit(chapters + 1) - F.ntile(chapters).over(Window.orderBy(F.desc("day")))
    return days.select("day", F.when(n <= chapters, rank).otherwise(early).cast("int").alias("chapter"))


def days_by_range(days: DataFrame, chapters: int) -> DataFrame:
    """day, chapter by equal ranges of days; the last chapter takes the remainder."""
    rank, n = F.row_number().over(Window.orderBy("day")), F.count("*").over(Window.partitionBy())
    per = F.greatest(F.lit(1), F.floor(n / chapters))
    return days.select("day", (F.least(F.floor((rank - 1) / per), F.lit(chapters - 1)) + 1).cast("int").alias("chapter"))


def moved_cuts(strong: Sequence[int], cuts: Sequence[int]) -> list[int]:
    """Where chapters end once each chapter without a strong day has been extended.

    strong: number of strong scenes of each day, in order; cuts: days before each chapter's end. A
    chapter without any strong day ends after the first strong day of the first later chapter that has
    two or more; chapters in between may become empty.
    """
    ends = list(cuts)

    def strong_in(k: int) -> list[int]:
        return [d for d in range(ends[k - 1] if k else 0, ends[k]) if strong[d] >= 1]

    for k in range(len(ends) - 1):
        donor = None if strong_in(k) else next((s for s in map(strong_in, range(k + 1, len(ends))) if len(s) >= 2), None)
        if donor:
            ends[k] = donor[0] + 1
    return ends


def repaired_chapters(days: DataFrame, chapters: int, arc: str = "arc") -> DataFrame:
    """arc, day, chapter after the repair of chapters without strong days.

    ``days(arc, day, n_strong)``: one row for each day of an arc, so a group is as long as its calendar.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("day")
        n = len(group)
        if n <= chapters:
            cuts = [min(k + 1, n) for k in range(chapters)]
        else:
            base, extra = divmod(n, chapters)
            sizes = [base + (k >= chapters - extra) for k in range(chapters)]
            cuts = [sum(sizes[: k + 1]) for k in range(chapters)]
        cuts = moved_cuts(group["n_strong"].tolist(), cuts)
        chapter, seen = [], 0
        for k, end in enumerate(cuts):
            chapter += [k + 1] * max(0, end - seen)
            seen = max(seen, end)
        return pd.DataFrame({arc: group[arc].tolist(), "day": group["day"].tolist(), "chapter": chapter[:n]}, dtype=object)

    kinds = dict(days.dtypes)
    return days.groupBy(arc).applyInPandas(one, f"{arc} {kinds[arc]}, day {kinds['day']}, chapter int")


def chapter_scopes(scenes: DataFrame, assigned: DataFrame, chapters: DataFrame, least: int = params.STRONG_SCENE) -> DataFrame:
    """chapter, n_scenes, n_events, has_strong, locations for every row of ``chapters(chapter)``; distinct places in scene order."""
    held = scenes.join(assigned, "day").groupBy("chapter").agg(
        F.count("*").alias("n_scenes"), F.sum("n_events").alias("n_events"), F.max(F.col("weight") >= least).alias("has_strong"),
        F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("day", "first_time", "location"))), lambda s: s["location"])), "、").alias("locations"),
    )
    return chapters.join(held, "chapter", "left").na.fill(0, ["n_scenes", "n_events"]).withColumn("has_strong", F.coalesce("has_strong", F.lit(False)))


def mechanical_sections(events: DataFrame, chapter: str, sections: int = 3, most_briefs: int = 5, brief_chars: int = 60, most_places: int = 3) -> DataFrame:
    """chapter, section, n_events, locations, briefs: each chapter's events in equal runs, the remainder left out.

    ``events(chapter, seq, location, pov, brief)`` has a total order ``seq`` in a chapter. A section beyond
    the events repeats the last run.
    """
    n = F.count("*").over(Window.partitionBy(chapter))
    at = F.row_number().over(Window.partitionBy(chapter).orderBy("seq")) - 1
    placed = events.withColumn("per", F.greatest(F.lit(1), F.floor(n / sections))).withColumn("n", n).withColumn("at", at)
    own = F.floor(F.col("at") / F.col("per"))
    # with fewer events than sections, each empty section takes the last run
    tail = F.when(F.col("at") >= F.col("n") - F.col("per"), F.filter(F.sequence(F.lit(0), F.lit(sections - 1)), lambda s: s * F.col("per") >= F.col("n"))).otherwise(F.array().cast("array<int>"))
    homes = F.concat(F.when(own < sections, F.array(own.cast("int"))).otherwise(F.array().cast("array<int>")), tail)
    dealt = placed.withColumn("section", F.explode(homes))
    place = F.when(F.col("section") * F.col("per") < F.col("n"), F.col("at") - F.col("section") * F.col("per")).otherwise(F.col("at") - F.col("n") + F.col("per"))
    said = F.concat(F.lit("- "), F.col("pov"), F.lit(": "), F.left("brief", F.lit(brief_chars)))
    # no list holds more than what is shown of it
    shown = F.collect_list(F.when(F.col("place") < most_briefs, F.struct("place", said.alias("said"))))
    by_place = dealt.withColumn("place", place).groupBy(chapter, "section", "location").agg(F.min("at").alias("at"), F.count("*").alias("n"), shown.alias("first"))
    ranked = by_place.withColumn("k", F.row_number().over(Window.partitionBy(chapter, "section").orderBy("at")))
    held = ranked.groupBy(chapter, "section").agg(
        F.sum("n").alias("n_events"), F.sort_array(F.flatten(F.collect_list(F.when(F.size("first") > 0, F.col("first"))))).alias("first"),
        F.sort_array(F.collect_list(F.when(F.col("k") <= most_places, F.struct("at", "location")))).alias("few"),
    )
    return held.select(
        chapter, (F.col("section") + 1).alias("section"), "n_events",
        F.array_join(F.transform("few", lambda e: e["location"]), " / ").alias("locations"), F.array_join(F.transform("first", lambda e: e["said"]), "\n").alias("briefs"),
    )


def replaced_actions(actions: DataFrame, scenes: DataFrame, turns: DataFrame, keys: Sequence[str] = ("agent", "day", "location")) -> DataFrame:
    """``actions`` with those of resolved scenes replaced by ``turns`` of the same columns.

    Scenes without any turn keep their actions. New turns are visible if their agent marks visibility.
    """
    resolved = scenes.join(turns.select("day", "location").distinct(), ["day", "location"], "left_semi")
    marks = actions.groupBy("agent").agg(F.max(F.col("visible").isNotNull()).alias("marks"))
    kept = actions.join(resolved.select(*keys).distinct(), list(keys), "left_anti")
    new = turns.join(resolved.select(*keys).distinct(), list(keys), "left_semi").join(marks, "agent", "left")
    new = new.withColumn("visible", F.when(F.col("marks"), F.lit(True))).drop("marks")
    return kept.unionByName(new.select(*actions.columns))
