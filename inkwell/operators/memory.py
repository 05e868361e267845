"""Ranked memory retrieval and belief revision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell import params


def memory_score(chapter: Column, tags: Sequence[str] = (), recent: int = params.RECENT_CHAPTERS) -> Column:
    """Points for importance, recency, shared tags and goals, over columns of a memory."""
    age = chapter - F.col("created_at_chapter")
    points = F.when(F.col("importance") >= 8, 5).when(F.col("importance") >= 5, 2).otherwise(0)
    points = points + F.when(age <= recent, 3).when(age <= 5, 1).otherwise(0)
    if tags:
        points = points + F.when(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])), 2).otherwise(0)
    return points + F.when(F.col("type") == "goal", 1).otherwise(0)


def retrieve(memories: DataFrame, chapter: Column, tags: Sequence[str] = (), limit: int = params.MEMORY_LIMIT, agent: str = "agent", order: str = "seq") -> DataFrame:
    """Each agent's ``limit`` best memories with score and place; equal scores keep the order of ``order``."""
    place = F.row_number().over(Window.partitionBy(agent).orderBy(F.desc("score"), order))
    return memories.withColumn("score", memory_score(chapter, tags)).withColumn("place", place).where(F.col("place") <= limit)


def revised_beliefs(updates: DataFrame, agent: str = "agent") -> DataFrame:
    """Beliefs after updates (agent, seq, subject, proposition, confidence, revises, evidence) in order of seq.

    An update that revises marks the first belief of equal proposition that is still active as revised;
    every update with a proposition adds an active belief. So beliefs of a proposition wait in a queue and
    a revision takes the first of them, or is lost if none waits. A revision is lost where the running balance
    of beliefs and revisions reaches a new low below zero; the k-th of the others takes the k-th belief.
    """
    used = updates.where(F.length("proposition") > 0)
    held = [c for c in ("seq", "subject", "proposition", "confidence")]
    born = used.select(agent, F.col("proposition").alias("_about"), F.lit(1).alias("_step"), F.lit(None).cast("string").alias("_note"), *held)
    note = F.coalesce(F.nullif("evidence", F.lit("")), "proposition")
    hit = used.where(F.length("revises") > 0).select(agent, F.col("revises").alias("_about"), F.lit(-1).alias("_step"), note.alias("_note"), *held)
    # at one step the revision acts before the new belief is added
    order = Window.partitionBy(agent, "_about").orderBy("seq", "_step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    balance = born.unionByName(hit).withColumn("_balance", F.sum("_step").over(order))
    low = F.least(F.lit(0), F.coalesce(F.min("_balance").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counted = balance.withColumn("_lost", (F.col("_step") < 0) & (F.col("_balance") < low))
    turn = F.sum(F.when(F.col("_lost"), 0).otherwise(1)).over(order.partitionBy(agent, "_about", "_step").orderBy("seq"))
    numbered = counted.withColumn("_turn", turn).where(~F.col("_lost"))
    belief = F.when(F.col("_step") > 0, F.struct(*held))
    met = numbered.groupBy(agent, "_about", "_turn").agg(F.max(belief).alias("b"), F.max("_note").alias("revised_evidence"))
    return met.select(
        agent, "b.seq", F.coalesce(F.nullif("b.subject", F.lit("")), F.lit("?")).alias("subject"), "b.proposition", F.coalesce("b.confidence", F.lit(0.5)).alias("confidence"), "revised_evidence",
        F.when(F.col("revised_evidence").isNull(), "active").otherwise("revised").alias("status"),
    )


def superseded(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``events`` with status: revised where a later one of the same keys exists, else active."""
    after = F.lead(F.col(order[0])).over(Window.partitionBy(*keys).orderBy(*order))
    return events.withColumn("status", F.when(after.isNull(), "active").otherwise("revised"))


def source_memories(memories: DataFrame, agent: str = "agent", last: int = 3) -> DataFrame:
    """agent and the ids of its last memories, which support a new belief."""
    place = F.row_number().over(Window.partitionBy(agent).orderBy(F.desc("seq")))
    few = memories.withColumn("place", place).where(F.col("place") <= last)
    return few.groupBy(agent).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "id"))), lambda m: m["id"]).alias("source_memories"))


def memories_text(memories: DataFrame, agent: str = "agent") -> DataFrame:
    """agent and its retrieved memories as lines, in order of place."""
    line = F.concat(F.lit("- [ch"), F.col("created_at_chapter").cast("string"), F.lit("] "), F.col("content"))
    return memories.groupBy(agent).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda m: m["line"]), "\n").alias("memories"))


def latest(states: DataFrame, key: str, order: str) -> DataFrame:
    """The last state of each key."""
    return states.groupBy(key).agg(F.max_by(F.struct(*[c for c in states.columns if c != key]), order).alias("s")).select(key, "s.*")
