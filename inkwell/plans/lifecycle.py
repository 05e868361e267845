"""The three ways through the engine: gate a chapter, coordinate a chapter, run a tick."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell import params
from inkwell.operators import chapters, cognition, memory, scenes, style, world
from inkwell.operators.joins import each_with_all
from inkwell.plans import generate, prompts
from inkwell.sources import config as cf


@dataclass
class Gated:
    """Texts of documents after the gates, and what the gates say; gates report, they don't hold a text back."""

    texts: DataFrame
    violations: DataFrame
    issues: DataFrame
    findings: DataFrame
    fixed: DataFrame | None = None


def write_sections(sections: DataFrame, model: generate.Model = generate.stub, system: str = "", doc: str = "doc") -> DataFrame:
    """Sections (doc, ord, prompt) written one after the other in each document.

    A section's context is the end of the one before, so the rounds are as many as the longest document has
    sections; all documents go through a round together.
    """
    last = sections.agg(F.max("ord")).first()[0]
    done: DataFrame | None = None
    for k in range(0, (last or 0) + 1):
        now = sections.where(F.col("ord") == k)
        if done is not None:
            before = done.where(F.col("ord") == k - 1).select(doc, F.right("text", F.lit(params.CONTEXT_CHARS)).alias("context"))
            now = now.join(before, doc, "left")
        else:
            now = now.withColumn("context", F.lit(None).cast("string"))
        asks = now.withColumn("system", F.lit(system)).withColumn("prompt", F.concat_ws("\n", "context", "prompt"))
        written = generate.answered(asks, model, "text").select(doc, "ord", "text").checkpoint()
        done = written if done is None else done.unionByName(written)
    return done if done is not None else sections.select(doc, "ord", F.lit("").alias("text"))


def gate_chapters(docs: DataFrame, key: str, lexicon: Sequence[tuple[str, str]], limits: Mapping[str, int | None], target: str = "target", model: generate.Model | None = None, rules: str = "", **words) -> Gated:
    """Fix what may be deleted, rewrite at most once for quality, then scan what came out.

    docs: ``key``, ``text`` and a length target.
    """
    by_severity = style.split_lexicon(lexicon)
    fatal, high = by_severity.get("fatal", []), by_severity.get("high", [])
    clean = style.fix_violations(docs, key)
    issues, fixed = style.quality_issues(clean, key, target=target), None
    if model is not None:
        bad = issues.where("fixable").select(key).distinct()
        rewritten = generate.repaired(clean.join(bad, key, "left_semi"), model, rules, key)
        # a model may answer anew each time it is asked: all that follows is about the one answer written here
        clean = clean.join(bad, key, "left_anti").unionByName(rewritten).checkpoint()
        after = style.quality_issues(clean, key, target=target)
        fixed, issues = style.fixed_issues(issues, after, [key, "category", "subject"]), after
    lines = style.line_violations(clean, key, fatal, high).select(key, "line", "word", "severity")
    counts = style.overused(clean, key, dict(limits)).select(key, F.lit(0).alias("line"), "word", F.lit("medium").alias("severity"))
    return Gated(clean, lines.unionByName(counts), issues, style.liveliness(clean, key, **words), fixed)


def gate_verdict(gated: Gated, docs: DataFrame, key: str) -> DataFrame:
    """key, n_fatal, n_high, n_medium, passed, n_errors, n_warnings."""
    by_issue = gated.issues.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warn").alias("n_warnings"))
    return style.gate(docs, gated.violations, key).join(by_issue, key, "left").na.fill(0, ["n_errors", "n_warnings"])


def generate_chapters(sections: DataFrame, specs: DataFrame, model: generate.Model = generate.stub, system: str = "", **gates) -> Gated:
    """From specs to gated texts: sections (doc, ord, subject, scene_anchor, description, ...), specs (doc, target)."""
    counted = sections.join(specs, "doc").join(sections.groupBy("doc").agg(F.count("*").alias("n_sections")), "doc")
    hint = chapters.length_hint(F.col("target"), F.col("n_sections"), F.col("weight") == "expanded", F.col("target_words"))
    written = write_sections(prompts.section_prompts(counted.withColumn("length_hint", hint)).select("doc", "ord", "prompt"), model, system)
    merged = chapters.merged_texts(written, "doc", "ord").withColumnRenamed("merged", "text")
    return gate_chapters(merged.join(specs, "doc"), "doc", **gates)


@dataclass
class Tick:
    """Frames of one simulated arc."""

    events: DataFrame
    scenes: DataFrame
    chapters: DataFrame
    knowledge: DataFrame
    new_knowledge: DataFrame
    tom: DataFrame
    unknown: DataFrame
    confirmed: DataFrame
    hooks: DataFrame | None = None
    beliefs: DataFrame | None = None


def run_tick(actions: DataFrame, belief_updates: DataFrame, facts: DataFrame, knowledge: DataFrame, trust: DataFrame, arc_chapters: Sequence[int], turns: DataFrame | None = None, names: Sequence[str] = (), phone: Sequence[str] = (), anomaly: Sequence[str] = (), **stops) -> Tick:
    """From agents' actions and beliefs to scenes, chapters and who knows what.

    actions: agent, seq, day, time, location, action, inner, warm_action, visible. The order of agents is
    their seq; nothing depends on which one answered first.
    """
    first = min(arc_chapters, default=1)
    if turns is not None:
        shared = actions.join(scenes.shared_scenes(actions).select("day", "location"), ["day", "location"], "left_semi").select("agent", "day", "location").distinct()
        actions = scenes.replaced_actions(actions, shared, turns)
    brief = scenes.brief_of(F.col("action"), F.col("inner"), F.col("warm_action"))
    events = scenes.split_by_visibility(actions).withColumn("brief", brief)
    found = scenes.clustered(events, names, phone, anomaly)
    days = scenes.repaired_chapters(scenes.strong_days(found).withColumn("arc", F.lit("arc")), max(1, len(arc_chapters)))
    numbered = days.select("day", (F.col("chapter") - 1 + first).alias("chapter"))
    numbers = actions.sparkSession.createDataFrame([(c,) for c in arc_chapters], "chapter int")
    scopes = scenes.chapter_scopes(found, numbered, numbers)
    beliefs = memory.revised_beliefs(belief_updates)
    named = beliefs.withColumn("belief_id", F.concat_ws("#", F.col("agent").cast("string"), F.col("seq").cast("string")))
    entries = cognition.belief_entries(named, facts, "agent", first, **stops)
    old = knowledge.select("agent", "fact_id", "confidence", "source", F.col("confirmed_at_chapter").alias("chapter"), F.lit(-1).cast("long").alias("seq"))
    merged = cognition.merged_knowledge(old.unionByName(entries.withColumn("seq", F.col("seq").cast("long"))))
    scene_text = events.groupBy("day", "location").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "brief"))), lambda e: e["brief"]), " ").alias("text"))
    keyed = scene_text.withColumn("scene_id", F.concat_ws("@", F.col("day").cast("string"), "location"))
    hits = cognition.matched_facts(keyed, facts, "scene_id", "text", **stops).join(keyed, "scene_id").select("day", "location", "fact_id", F.struct("day", "location").alias("at"))
    tom = cognition.theory_of_mind(actions, hits, facts, trust, ["day", "location"], first=False)
    agents = actions.select("agent").distinct()
    return Tick(
        events, found, scopes, merged, cognition.new_knowledge(merged, knowledge), tom, cognition.knowledge_gaps(agents, facts, merged),
        cognition.newly_confirmed(merged, knowledge, facts), beliefs=beliefs,
    )


def empty_tick(spark: SparkSession, arc_id: str, arc_chapters: Sequence[int]) -> dict:
    """What stands in for a tick where the engine doesn't run."""
    return {"arc_id": arc_id, "novel": "", "chapters_covered": str(list(arc_chapters)), "character_trajectories": {}, "state_changes": {"characters": {}}, "new_hooks": [], "suggested_chapter_split": [{"chapter_num": c, "sections": 3, "events": []} for c in arc_chapters], "reversal_plan": {}, "type_a_events": []}


@dataclass
class Coordinated:
    mode: str
    tick: object = None
    gated: Gated | None = None
    knowledge: DataFrame | None = None
    notes: list[str] = field(default_factory=list)


def coordinate(config: Mapping, chapter: int, facts: DataFrame | None, knowledge: DataFrame, sections: DataFrame, specs: DataFrame, engine: Callable[[], object] | None = None, model: generate.Model = generate.stub, cli: str | None = None, arc: Mapping | None = None, **gates) -> Coordinated:
    """Run a chapter in its mode. Gaps are annotated before what the sections tell becomes everyone's knowledge."""
    out = Coordinated(cf.pipeline_mode(config, chapter, cli, arc))
    spark = sections.sparkSession
    if out.mode in ("engine", "hybrid"):
        out.tick = engine() if engine else empty_tick(spark, str((arc or {}).get("arc_id", "")), [chapter])
    if out.mode in ("gen", "hybrid"):
        out.gated = generate_chapters(sections, specs, model, **gates)
        if facts is not None and cf.tom_enabled(config):
            cast = cf.cast_frame(spark, config).select(F.col("key").alias("agent"))
            text = sections.select(F.concat_ws("#", F.col("doc").cast("string"), F.col("ord").cast("string")).alias("frag_id"), F.col("ord").cast("long").alias("seq"), F.col("description").alias("text"))
            hits = cognition.matched_facts(text, facts, "frag_id", "text").join(facts.where("truth").select("fact_id"), "fact_id").join(text, "frag_id").select("fact_id", "seq")
            seen = each_with_all(cast, hits).select("agent", "fact_id", "seq", F.lit(params.OBSERVED_CONFIDENCE).alias("confidence"), F.lit("observed").alias("source"), F.lit(chapter).alias("chapter"))
            old = knowledge.select("agent", "fact_id", F.lit(-1).cast("long").alias("seq"), "confidence", "source", F.col("confirmed_at_chapter").alias("chapter"))
            out.knowledge = cognition.merged_knowledge(old.unionByName(seen))
    return out


def world_view(agents: DataFrame, traces: DataFrame, stages: Sequence[str], tier: int) -> DataFrame:
    """Traces that agents of a tier perceive: the first tier through its senses, the second one all of them."""
    return world.perceived(agents, traces, stages) if tier == 1 else world.lite_view(traces)
