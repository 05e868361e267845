"""Operators on small frames whose right answer is plain to see, and against loops over random input."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import env
from inkwell.functions import text as tx
from inkwell.operators import chapters, cognition, joins, memory, scenes, style, timeline, world


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_strip_knows_wide_spaces(spark):
    df = spark.createDataFrame([("　 a b　",), ("",)], "t string")
    assert rows(df.select(tx.strip(F.col("t")).alias("s")), "s") == [("",), ("a b",)]


def test_count_of_does_not_overlap(spark):
    df = spark.createDataFrame([("aaaa", 2), ("", 0), ("xaax", 1)], "t string, n int")
    assert all(r.c == r.n for r in df.select("n", tx.count_of(F.col("t"), F.lit("aa")).alias("c")).collect())


def test_terms(spark):
    df = spark.createDataFrame([("手机坏了，的 发光蘑菇森林",)], "t string")
    found = df.select(tx.terms(F.col("t")).alias("x")).first().x
    assert found.shorts == ["手机坏了"] and found.bigrams == ["发光", "光蘑", "蘑菇", "菇森", "森林"] and found.trigrams == ["发光蘑", "光蘑菇", "蘑菇森", "菇森林"]


def test_typed_scalar(spark):
    df = spark.createDataFrame([(x,) for x in ("3", "-4", "1.5", "true", "'q'", "null", "", "word")], "t string")
    found = {r.t: (r.x.kind, r.x.value) for r in df.select("t", tx.typed_scalar(F.col("t")).alias("x")).collect()}
    assert found["3"] == ("long", "3") and found["-4"][0] == "long" and found["1.5"][0] == "double" and found["true"] == ("boolean", "true")
    assert found["'q'"] == ("string", "q") and found["null"][0] == found[""][0] == "null" and found["word"] == ("string", "word")


def looped_narrative(lines):
    inside, out = False, []
    for k, line in enumerate(lines, 1):
        line = line.strip()
        if line.startswith('"'):
            inside = True
        elif inside and line.endswith('"'):
            inside = False
        elif not inside:
            out.append(k)
    return out


def test_dialogue_state_is_that_of_a_loop(spark):
    r = random.Random(1)
    docs = [(k, "\n".join(r.choice(['"a', 'b"', "c", '"d"', " e ", ""]) for _ in range(r.randint(1, 12)))) for k in range(80)]
    lines = style.document_lines(spark.createDataFrame(docs, "id int, text string"), "id")
    found = {}
    for row in style.with_dialogue(lines, "id").where("narrative").collect():
        found.setdefault(row.id, []).append(row.line)
    assert all(sorted(found.get(k, [])) == looped_narrative(t.split("\n")) for k, t in docs)


def test_violations_list_a_word_once_a_line(spark):
    docs = spark.createDataFrame([(1, "bad bad soft\n\"soft\nsoft\"\nsoft")], "id int, text string")
    found = style.line_violations(docs, "id", ["bad"], ["soft", "bad"])
    assert rows(found, "line", "word", "severity") == [(1, "bad", "fatal"), (1, "soft", "high"), (4, "soft", "high")]
    assert style.gate(docs, found, "id").first().passed is False


def test_fix_deletes_the_first_of_each_line(spark):
    docs = spark.createDataFrame([(1, "a某种b某种c\n某种d"), (2, "x")], "id int, text string")
    assert rows(style.fix_violations(docs, "id"), "id", "text") == [(1, "ab某种c\nd"), (2, "x")]


def test_retrieval_ranks_and_keeps_order(spark):
    held = [("a", k, f"m{k}", i, c, ["x"] if k == 2 else [], "perception") for k, (i, c) in enumerate([(9, 1), (6, 20), (3, 20), (3, 20)])]
    df = spark.createDataFrame(held, "agent string, seq int, id string, importance int, created_at_chapter int, tags array<string>, type string")
    found = memory.retrieve(df, F.lit(20), tags=("x",), limit=3)
    assert [r.id for r in found.orderBy("place").collect()] == ["m0", "m1", "m2"]


def looped_revision(updates):
    beliefs = []
    for seq, prop, revises in updates:
        if not prop:
            continue
        hit = next((b for b in beliefs if revises and b[1] == revises and b[2] == "active"), None)
        if hit:
            hit[2] = "revised"
        beliefs.append([seq, prop, "active"])
    return sorted((b[0], b[2]) for b in beliefs)


def test_revision_is_that_of_a_loop(spark):
    r = random.Random(2)
    cases = {f"a{k}": [(s, r.choice(["p", "q", ""]), r.choice(["p", "q", ""])) for s in range(8)] for k in range(25)}
    data = [(a, s, "x", p, 0.5, rv, "") for a, us in cases.items() for s, p, rv in us]
    found = memory.revised_beliefs(spark.createDataFrame(data, "agent string, seq int, subject string, proposition string, confidence double, revises string, evidence string")).collect()
    for a, us in cases.items():
        assert sorted((x.seq, x.status) for x in found if x.agent == a) == looped_revision(us)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=18), st.integers(1, 6))
def test_moved_cuts_keep_every_day(strong, chapters_):
    n = len(strong)
    base, extra = divmod(n, chapters_)
    sizes = [base + (k >= chapters_ - extra) for k in range(chapters_)] if n > chapters_ else [1] * n + [0] * (chapters_ - n)
    cuts = [sum(sizes[: k + 1]) for k in range(chapters_)]
    moved = scenes.moved_cuts(strong, cuts)
    assert moved[-1] == n and all(a >= b for a, b in zip(moved, cuts))


def test_repair_moves_the_first_strong_day():
    assert scenes.moved_cuts([0, 1, 1, 0, 0], [1, 3, 5]) == [2, 3, 5]


def test_days_to_chapters(spark):
    for n, chapters_ in ((2, 3), (5, 3), (7, 3), (6, 6)):
        days = spark.createDataFrame([(d * 3,) for d in range(n)], "day int")
        found = [r.chapter for r in scenes.days_to_chapters(days, chapters_).orderBy("day").collect()]
        base, extra = divmod(n, chapters_)
        expected = list(range(1, n + 1)) if n <= chapters_ else [k + 1 for k in range(chapters_) for _ in range(base + (k >= chapters_ - extra))]
        assert found == expected


def test_mechanical_sections_repeat_the_last_run(spark):
    events = spark.createDataFrame([(1, k, f"p{k}", "pov", f"b{k}") for k in range(2)] + [(2, k, "p", "pov", f"b{k}") for k in range(7)], "chapter int, seq int, location string, pov string, brief string")
    found = {(r.chapter, r.section): r.n_events for r in scenes.mechanical_sections(events, "chapter").collect()}
    assert found == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (2, 1): 2, (2, 2): 2, (2, 3): 2}


def test_replaced_actions(spark):
    schema = "agent string, seq int, day int, location string, action string, visible boolean"
    acts = spark.createDataFrame([("a", 0, 1, "x", "old", True), ("b", 0, 1, "x", "old", None), ("a", 1, 2, "y", "stays", True)], schema)
    turns = spark.createDataFrame([("a", 5, 1, "x", "new", None), ("c", 6, 1, "x", "stranger", None)], schema)
    shared = acts.where("day = 1").select("agent", "day", "location")
    assert rows(scenes.replaced_actions(acts, shared, turns), "agent", "action", "visible") == [("a", "new", True), ("a", "stays", True)]


FACTS = [(1, "T1", "c", "发光蘑菇会传播孢子", True), (2, "T2", "角色真相", "林默是观察者", True), (3, "T3", "c", "月亮", False)]


def facts_frame(spark):
    return spark.createDataFrame(FACTS, "ord int, fact_id string, category string, proposition string, truth boolean")


def test_matching(spark):
    facts = facts_frame(spark)
    texts = spark.createDataFrame([("t1", "他发现发光蘑菇会动"), ("t2", "月亮"), ("t3", "无关的句子啊"), ("t4", "林默是观察者！")], "id string, p string")
    assert rows(cognition.matched_beliefs(texts, facts, "id", "p"), "id", "fact_id") == [("t1", "T1"), ("t2", "T3"), ("t4", "T2")]
    assert rows(cognition.term_scores(texts, facts, "id", "p"), "id", "fact_id", "score") == [("t1", "T1", 3), ("t2", "T3", 10), ("t4", "T2", 4)]


def test_few_facts_are_matched_where_texts_lie_as_many_are_by_a_join(spark, monkeypatch):
    """Brief facts, stop words and n-grams, a key of several rows, null keys and texts: both ways give the same, and the first shuffles no terms."""
    chance = random.Random(3)
    some = ["of", "the", "ion", "nation", "notion", "moon", "moonlight", "sea", "seaside", "a", "\x85next", "月亮之上的人", "观察者", "\x1cabc"]
    facts = spark.createDataFrame([(k, f"T{k}", chance.choice(["ion", "moon", "the sea"]) if k < 4 else " ".join(chance.choices(some, k=8))) for k in range(12)], "ord int, fact_id string, proposition string")
    given = [(k % 25 if k else None, " ".join(chance.choices(some, k=chance.randrange(6)))) for k in range(40)] + [(None, "moonlight nation"), (99, None)]
    texts = spark.createDataFrame(given, "id int, p string")
    stops = dict(stop_words=("of", "notion"), stop_ngrams=("ion", "mo"))
    direct = [cognition.term_scores(texts, facts, "id", "p", **stops), cognition.matched_facts(texts, facts, "id", "p", **stops), cognition.matched_beliefs(texts, facts, "id", "p", **stops)]
    single = cognition.matched_facts(texts.where("id >= 17 and id < 25"), facts, "id", "p", **stops)
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()
    found = [sorted(map(tuple, d.collect()), key=repr) for d in direct]
    monkeypatch.setattr(cognition.Held, "of", classmethod(lambda *given, **stops: None))
    joined = [cognition.term_scores(texts, facts, "id", "p", **stops), cognition.matched_facts(texts, facts, "id", "p", **stops), cognition.matched_beliefs(texts, facts, "id", "p", **stops)]
    assert found == [sorted(map(tuple, d.collect()), key=repr) for d in joined] and all(found)


def test_knowledge_keeps_the_best_and_the_first(spark):
    df = spark.createDataFrame([("a", "f", 0.5, "x", 1, 0), ("a", "f", 0.9, "y", 2, 1), ("a", "f", 0.9, "z", 3, 2)], "agent string, fact_id string, confidence double, source string, chapter int, seq int")
    assert rows(cognition.merged_knowledge(df), "confidence", "source", "confirmed_at_chapter") == [(0.9, "y", 1)]


def test_tom_doubts_sensitive_facts_without_trust(spark):
    facts = facts_frame(spark)
    presence = spark.createDataFrame([(1, "x", "a"), (1, "x", "b")], "day int, location string, agent string")
    hits = spark.createDataFrame([(1, "x", "T2", 1), (1, "x", "T1", 1)], "day int, location string, fact_id string, at int")
    trust = spark.createDataFrame([("a", "b", 0.2)], "who string, target string, trust double")
    found = cognition.theory_of_mind(presence, hits, facts, trust, ["day", "location"])
    assert rows(found, "who", "target", "fact_id", "verdict") == [("a", "b", "T1", "knows"), ("a", "b", "T2", "uncertain"), ("b", "a", "T1", "knows"), ("b", "a", "T2", "knows")]


def test_perception(spark):
    agents = spark.createDataFrame([("a", "x", 1, "s1", {"f": ("k", 0.3)})], "agent string, location string, mutation_phase int, perception_stage string, relationships map<string,struct<type:string,trust:double>>")
    traces = spark.createDataFrame(
        [("here", ["x"], 0, None, None, 0.0), ("there", ["y"], 0, None, None, 0.0), ("all", [], 0, "s1", None, 0.0), ("stage", [], 0, "s2", None, 0.0), ("odd", [], 0, "??", None, 0.0), ("trust", [], 0, None, "f", 0.5), ("phase", [], 2, None, None, 0.0)],
        "trace_id string, locations array<string>, min_mutation_phase int, min_perception_stage string, requires_relationship_with string, min_trust double",
    )
    assert rows(world.perceived(agents, traces, ("s1", "s2")), "trace_id") == [("all",), ("here",), ("odd",)]


def test_clock_and_regions(spark):
    df = spark.createDataFrame([(1, 8.0, 3.0), (1, 11.0, 15.0)], "d int, h double, add double")
    assert rows(df.select(env.advance(F.col("d"), F.col("h"), F.col("add")).alias("t")).select("t.*"), "absolute_day", "hour", "is_night") == [(1, 11.0, False), (2, 2.0, True)]
    regions = spark.createDataFrame([("r", 5), ("q", 0)], "region string, mutation_level int")
    assert rows(world.region_states(regions), "region", "power", "panic_level") == [("q", "正常", 0), ("r", "中断", 10)]


def test_clamp_is_stepwise(spark):
    df = spark.createDataFrame([("a", 0, 9), ("a", 1, -1)], "k string, seq int, delta int")
    assert rows(chapters.clamped(df, ["k"], F.lit(3)), "value") == [(4,)]


def test_hooks(spark):
    hooks = spark.createDataFrame([(0, "h1", "x", 1), (1, "", "y", 1), (2, None, "z", 2)], "seq int, id string, description string, created_at_chapter int")
    existing = spark.createDataFrame([("h1",), ("h2",)], "id string")
    assert rows(timeline.numbered_hooks(hooks, existing), "seq", "id") == [(1, "hook_004"), (2, "hook_005")]


def test_spec_rules(spark):
    sections = spark.createDataFrame([(1, 1, "", "", "expanded", ""), (1, 2, "x" * 30, "不要这样", "normal", None)], "spec_id int, section int, description string, tension_direction string, weight string, expanded_direction string")
    found = rows(chapters.section_issues(sections), "section", "rule")
    assert found == [(1, "empty_description"), (1, "missing_expanded_direction"), (1, "missing_tension"), (2, "negative_tension")]
    specs = spark.createDataFrame([(1, 5, 100), (2, 5, 0)], "spec_id int, chapter int, target_chars int")
    assert rows(chapters.spec_issues(sections, specs, spark.createDataFrame([(3,)], "chapter int")), "spec_id", "rule") == [(1, "chapter_order"), (2, "no_sections")]


def test_containment_against_brute_force(spark, monkeypatch):
    """Texts and facts of all lengths around the piece's, with repeats, overlaps, punctuation only and stretches shorter than a text."""
    monkeypatch.setattr(cognition, "STRETCH", 16)
    r = random.Random(7)
    facts = ["", "!!", " a ", "ab", "abab", "abababababababab", "a" * 12, "a" * 13, "a" * 30, "月亮", "b c.d"]
    facts += ["".join(r.choice("ab") for _ in range(r.randint(1, 40))) for _ in range(30)]
    texts = [*facts, "!! ", "x" + "ab" * 30, "a" * 100, "他看月 亮", "b,cd"] + ["".join(r.choice("ab ,") for _ in range(r.randint(0, 90))) for _ in range(60)]

    def norm(t):
        return re.sub("[^0-9A-Za-z一-鿿]", "", t)

    def met(t, f):
        return (t.strip() == f.strip() != "") or (norm(t) != "" != norm(f) and (norm(t) in norm(f) or norm(f) in norm(t)))

    expected = sorted((i, j) for i, t in enumerate(texts) for j, f in enumerate(facts) if met(t, f))
    a = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    b = spark.createDataFrame(list(enumerate(facts)), "fact_id int, proposition string")
    assert rows(cognition.contained(a, b, "id", "text"), "id", "fact_id") == expected


def test_revisions_against_a_queue(spark):
    r = random.Random(8)
    updates = [(r.choice("xy"), k, "s", r.choice(["p", "q", ""]), 0.5, r.choice(["p", "q", "", "z"]), r.choice(["", f"e{k}"])) for k in range(120)]
    waiting, notes = {}, {}
    for agent, seq, _, prop, _, revises, evidence in updates:
        if prop:
            if revises and waiting.get((agent, revises)):
                notes[agent, waiting[agent, revises].pop(0)] = evidence or prop
            waiting.setdefault((agent, prop), []).append(seq)
    df = spark.createDataFrame(updates, "agent string, seq int, subject string, proposition string, confidence double, revises string, evidence string")
    found = memory.revised_beliefs(df).collect()
    assert sorted((x.agent, x.seq, x.revised_evidence) for x in found if x.status == "revised") == sorted((*k, v) for k, v in notes.items())
    assert sorted((x.agent, x.seq) for x in found) == sorted((u[0], u[1]) for u in updates if u[3])


def test_each_with_all(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 3)
    a, b = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(k % 4,) for k in range(8)], "y int")
    for most in (0, 100):
        assert rows(joins.each_with_all(a, b, most), "x", "y") == sorted((x, k % 4) for x in (1, 2) for k in range(8))
    assert joins.each_with_all(a, b.limit(0)).count() == 0


def test_deciding_entries_keep_the_merge(spark):
    r = random.Random(9)
    df = spark.createDataFrame([("a", r.choice("fg"), r.randint(1, 4) / 4, f"s{k}", k % 5, k) for k in range(40)], "agent string, fact_id string, confidence double, source string, chapter int, seq int")
    few = cognition.deciding_entries(df)
    assert few.count() <= 4 and few.columns == df.columns
    assert sorted(cognition.merged_knowledge(few).collect()) == sorted(cognition.merged_knowledge(df).collect())


def test_tasks_follow_the_pairs_of_agents_and_traces(spark, monkeypatch):
    agents = spark.createDataFrame([(k, "x" if k % 2 else "y", 1, "s1", None) for k in range(20)], "agent int, location string, mutation_phase int, perception_stage string, relationships map<string,struct<type:string,trust:double>>")
    traces = spark.createDataFrame([(k, ["x"] if k % 3 else [], 0, None, None, 0.0) for k in range(6)], "trace_id int, locations array<string>, min_mutation_phase int, min_perception_stage string, requires_relationship_with string, min_trust double")
    monkeypatch.setattr(world, "PAIRS_A_TASK", 10)
    found = world.perceived(agents, traces, ("s1",))
    assert "Repartition 12" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.agent, r.trace_id) for r in found.collect()} == {(a, t) for a in range(20) for t in range(6) if t % 3 == 0 or a % 2}


def test_agents_alike_perceive_as_one(spark, monkeypatch):
    held = [(k, f"n{k}", "xyz"[k % 3] if k % 7 else None, k % 2, "s1" if k % 2 else "s2", {"f": ("k", k % 2 / 2)} if k % 5 else None) for k in range(120)]
    agents = spark.createDataFrame(held, "agent int, name string, location string, mutation_phase int, perception_stage string, relationships map<string,struct<type:string,trust:double>>")
    traces = spark.createDataFrame([(k, [["x"], [], ["y", "x", "y"], None][k % 4], k % 2, "s1" if k % 3 else "s2", "f" if k % 2 else None, 0.4) for k in range(9)], "trace_id int, locations array<string>, min_mutation_phase int, min_perception_stage string, requires_relationship_with string, min_trust double")
    expected = {(r.agent, r.name, r.trace_id) for r in agents.crossJoin(traces).where(world.perceivable(("s1", "s2"))).collect()}
    monkeypatch.setattr(world, "PAIRS_A_TASK", 10**9)
    classes = world.alike(agents, 1)
    assert classes.count() < 40 and sum(len(r["_agents"]) for r in classes.collect()) == 120
    assert world.alike(agents, 90).count() > 2 * classes.count()
    found = world.perceived(agents, traces, ("s1", "s2"))
    assert sorted((r.agent, r.name, r.trace_id) for r in found.collect()) == sorted(expected) and expected
    assert found.columns == ["location", "agent", "name", "mutation_phase", "perception_stage", "relationships", *traces.columns]
    monkeypatch.setattr(world, "CLASS_AGENTS", 2)
    assert max(len(r["_agents"]) for r in world.alike(agents, 1).collect()) < 8
    tagged = agents.withColumn("tags", F.create_map(F.lit("k"), "agent"))
    assert sorted((r.agent, r.name, r.trace_id) for r in world.perceived(tagged, traces, ("s1", "s2")).collect()) == sorted(expected)
