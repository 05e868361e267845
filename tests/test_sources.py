"""Readers, writers, configuration, replies, and the three ways through the engine."""

import json

import pytest
from pyspark.sql import functions as F

from inkwell.plans import generate, lifecycle, prompts
from inkwell.sources import config as cf
from inkwell.sources import store, vault
from inkwell.sources.frontmatter import parse_frontmatter
from inkwell.sources.model_json import extract_json
from inkwell.streaming import gates

NOTE = """---
title: "A: b"
n: 3
ratio: 1.5
none:
tags: [a, 2, true]
empty: []
text: |
  one
  two
nested:
  deep:
    x: 1
  list:
    - plain
    - key: v
      more: 2
history:
  - chapter: 3
    summary: s
---
body"""


def test_frontmatter():
    found = parse_frontmatter(NOTE)
    assert found["title"] == "A: b" and found["n"] == 3 and found["ratio"] == 1.5 and found["none"] is None
    assert found["tags"] == ["a", 2, True] and found["empty"] == [] and found["text"] == "one\ntwo"
    assert found["nested"] == {"deep": {"x": 1}, "list": ["plain", {"key": "v", "more": 2}]}
    assert found["history"] == [{"chapter": 3, "summary": "s"}]
    assert parse_frontmatter("no head") == {} and parse_frontmatter("") == {}


@pytest.mark.parametrize(
    ("reply", "expected"),
    [
        ('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('so {"a": [1, 2]} done', {"a": [1, 2]}), ('{"a": 1, "b": [1, 2', {"a": 1, "b": [1]}),
        ('{"a": {"b": 1}, "c": "cut', {"a": {"b": 1}}), ("", None), (None, None), ("[1]", None), ("nothing", None),
    ],
)
def test_replies(reply, expected):
    assert extract_json(reply) == expected


def test_vault(spark, tmp_path):
    (tmp_path / "章节状态").mkdir()
    (tmp_path / "章节状态" / "第2章.md").write_text("---\ntime_span:\n  absolute_day: 4\nkey_events:\n  - e1\n---\n", encoding="utf-8")
    (tmp_path / "人物").mkdir()
    (tmp_path / "人物" / "林.md").write_text("---\nrole: x\n---\n", encoding="utf-8")
    states = vault.chapter_states(spark, str(tmp_path)).collect()
    assert [(r.chapter, r.meta.time_span.absolute_day, r.meta.key_events) for r in states] == [(2, 4, ["e1"])]
    assert [(r["name"], r.meta.role) for r in vault.characters(spark, str(tmp_path)).collect()] == [("林", "x")]
    assert vault.notes(spark, str(tmp_path / "missing.md")).count() == 0


def test_tables(spark):
    text = "# t\n## 第3天\n| 时间 | 事件 | 来源 |\n|------|------|----|\n| 08:00 | woke | ch1 |\n## 第4天\n| 09:00 | left | ch2 |"
    df = spark.createDataFrame([("k", text)], "key string, value string")
    assert [(r.day, r.time, r.event, r.source) for r in vault.timeline(df, "key").orderBy("line").collect()] == [(3, "08:00", "woke", "ch1"), (4, "09:00", "left", "ch2")]
    hooks = "## 开放中\n| ID | 伏笔 | 创建章 | 最后接触 | 类型 |\n|----|----|----|----|----|\n| h1 | d | ch1 |  | new |\n## 已回收\n| h2 | d | ch1 | ch2 | old |"
    found = vault.open_hooks(spark.createDataFrame([("k", hooks)], "key string, value string"), "key").collect()
    assert [(r.id, r.last_touched, r.type) for r in found] == [("h1", "ch1", "new")]
    truth = "| id | 类别 | 命题 | 真 |\n|---|---|---|---|\n| T1 | w | a\\|b | |\n| T2 | w | c | 假 |\n| bad | row |"
    found = vault.truth_table(spark.createDataFrame([("k", truth)], "key string, value string"), "key").orderBy("ord").collect()
    assert [(r.id, r.proposition, r.truth) for r in found] == [("T1", "a|b", True), ("T2", "c", False)]


def test_lore_and_bible(spark):
    text = "---\na: 1\n---\n# head\n- first line\n```\ncode line\n```\n> quote\nabc\nsecond line"
    assert vault.distilled_lore(spark.createDataFrame([(1, text)], "k int, text string"), "k").first().lore == "first line\nsecond line"
    bible = "intro\n## Lin（lead）\nbrave\n## Mo\nquiet\n## Lin\nbold"
    found = vault.character_bible(spark.createDataFrame([(1, bible)], "k int, value string"), "k").collect()
    assert {r["name"]: r.body for r in found} == {"Lin": "bold", "Mo": "quiet"}


CONFIG = {"cast": [{"key": "lin", "name": "Lin", "tier": 1}, {"key": "mo", "name": "Mo", "tier": 2}], "pipeline": {"default_mode": "hybrid", "chapter_overrides": {"3": "engine", "4": "nonsense"}}}


def test_config():
    assert cf.pipeline_mode({}, 1) == "gen" and cf.pipeline_mode(CONFIG, 1) == "hybrid" and cf.pipeline_mode(CONFIG, 3) == "engine" and cf.pipeline_mode(CONFIG, 4) == "hybrid"
    assert cf.pipeline_mode(CONFIG, 3, cli="gen") == "gen" and cf.pipeline_mode(CONFIG, 3, arc={"pipeline_mode": "hybrid"}) == "hybrid"
    assert cf.protagonist(CONFIG) == "Lin" and cf.character_name(CONFIG, "mo") == "Mo" and cf.character_name(CONFIG, "who") == "who"
    assert cf.route("agent", {"agent": {"model": "f"}}, {"agent": {"model": "d", "provider": "p"}}, {"AGENT_MODEL": "e"}) == {"provider": "p", "model": "e"}


def test_stored_states(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "a", "memories": [{"id": "m1", "importance": 5}], "knowledge": {"T1": {"confidence": 0.5}}, "tom": {"b": {"T1": "knows"}}}))
    (tmp_path / "broken.json").write_text("{nope")
    states = store.load_states(spark, str(tmp_path))
    assert states.count() == 1 and states.first().emotional_state == "平静"
    assert store.memories_of(states).first().id == "m1" and store.knowledge_of(states).first().fact_id == "T1" and store.tom_of(states).first().verdict == "knows"


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "s")
    store.save_snapshot(spark.createDataFrame([("a", 1), ("b", 2)], "agent string, v int"), folder)
    store.upsert_snapshot(spark.createDataFrame([("a", 9)], "agent string, v int"), folder, ["agent"])
    assert sorted((r.agent, r.v) for r in store.load_snapshot(spark, folder).collect()) == [("a", 9), ("b", 2)]
    store.clear(spark, folder, "a")
    assert [r.agent for r in store.load_snapshot(spark, folder).collect()] == ["b"]


def test_generation_boundary(spark):
    asks = spark.createDataFrame([(1, "s", "p")], "key int, system string, prompt string")
    assert generate.answered(asks).first().answer == generate.stub("s", "p")
    assert generate.answered_objects(asks, lambda s, p: 'x {"reflections": [{"content": "c"}]}').first().answer == '{"reflections": [{"content": "c"}]}'

    def failing(s, p):
        raise OSError("down")

    assert generate.answered(asks, failing).first().answer is None and generate.answered_objects(asks, failing).first().answer == "{}"
    replies = spark.createDataFrame([("a", '{"reflections": [{"content": "c"}, {"content": ""}]}')], "agent string, answer string")
    assert [(r.importance, r.tags) for r in generate.reflections(replies, F.lit(2)).collect()] == [(7, ["reflection"])]
    texts = spark.createDataFrame([(1, "long enough text")], "id int, text string")
    assert generate.repaired(texts, lambda s, p: "no", "", "id").first().text == "long enough text"


def test_chapter_from_spec_to_gate(spark):
    schema = "doc int, ord int, subject string, scene_anchor string, description string, tension_direction string, weight string, expanded_direction string, target_words int"
    sections = spark.createDataFrame([(1, k, "s", "", f"d{k}", "", "normal", None, None) for k in range(2)], schema)
    specs = spark.createDataFrame([(1, 1000)], "doc int, target int")
    gated = lifecycle.generate_chapters(sections, specs, lexicon=[("约", "fatal")], limits={"d": 1})
    assert gated.texts.count() == 1 and gated.violations.where("severity = 'fatal'").count() > 0
    assert gated.issues.where("category = 'length'").count() == 1
    assert lifecycle.gate_verdict(gated, gated.texts, "doc").first().passed is False


def test_tick(spark):
    actions = spark.createDataFrame([("a", 0, 1, "08:00", "x", "发光蘑菇会动", "", "", None), ("b", 0, 1, "09:00", "x", "看", "", "", None), ("a", 1, 2, "08:00", "y", "走", "", "", None)], "agent string, seq int, day int, time string, location string, action string, inner string, warm_action string, visible boolean")
    updates = spark.createDataFrame([("a", 0, "s", "发光蘑菇会传播孢子", 0.8, "", "")], "agent string, seq int, subject string, proposition string, confidence double, revises string, evidence string")
    facts = spark.createDataFrame([(1, "T1", "c", "发光蘑菇会传播孢子", True)], "ord int, fact_id string, category string, proposition string, truth boolean")
    knowledge = spark.createDataFrame([], "agent string, fact_id string, confidence double, source string, confirmed_at_chapter int")
    trust = spark.createDataFrame([], "who string, target string, trust double")
    tick = lifecycle.run_tick(actions, updates, facts, knowledge, trust, [4, 5])
    assert [(r.agent, r.fact_id, r.source) for r in tick.new_knowledge.collect()] == [("a", "T1", "belief")]
    assert sorted((r.who, r.target) for r in tick.tom.collect()) == [("a", "b"), ("b", "a")]
    assert [(r.agent, r.fact_id) for r in tick.unknown.collect()] == [("b", "T1")]
    assert sorted((r.chapter, r.n_events) for r in tick.chapters.collect()) == [(4, 2), (5, 1)]


def test_coordination(spark):
    schema = "doc int, ord int, subject string, scene_anchor string, description string, tension_direction string, weight string, expanded_direction string, target_words int"
    sections = spark.createDataFrame([(1, 0, "s", "", "发光蘑菇会动", "", "normal", None, None)], schema)
    specs = spark.createDataFrame([(1, 1000)], "doc int, target int")
    facts = spark.createDataFrame([(1, "T1", "c", "发光蘑菇会传播孢子", True)], "ord int, fact_id string, category string, proposition string, truth boolean")
    knowledge = spark.createDataFrame([], "agent string, fact_id string, confidence double, source string, confirmed_at_chapter int")
    out = lifecycle.coordinate(CONFIG, 1, facts, knowledge, sections, specs, lexicon=[], limits={"x": 1})
    assert out.mode == "hybrid" and out.tick["suggested_chapter_split"][0]["chapter_num"] == 1
    assert sorted(r.agent for r in out.knowledge.collect()) == ["lin", "mo"]


def test_prompts():
    assert prompts.blocks([("A", "x"), ("B", " "), ("", "y")]) == "## A\nx\n\ny"
    assert prompts.chapter_context({"key_events": ["e"]}, [], {}, None, {}) == ""
    assert "e" in prompts.chapter_context({"key_events": ["e"]}, ["h"], {}, None, {})


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "bad line"), (2, "fine")], "id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = gates.document_stream(spark, str(tmp_path / "in"), docs.schema)
    gates.keep_violations(stream, "id", ["bad"], [], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [(r.id, r.word) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "bad")]
