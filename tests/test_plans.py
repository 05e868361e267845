"""Specs, agents and rendered text."""

import pytest

from inkwell.operators import render
from inkwell.plans import agents, specs

EVENTS = [(1, k, 1, f"0{k}:00", f"p{k}", "a", f"b{k}") for k in range(4)]


def frame(spark):
    return spark.createDataFrame(EVENTS, "chapter int, seq int, day int, time string, location string, pov string, brief string")


def test_mechanical_spec_and_fallback(spark):
    chapters = spark.createDataFrame([(1, "up", 2), (2, "", 0)], "chapter int, tension_direction string, reversal_at int")
    made = specs.mechanical_spec(frame(spark), chapters)
    rows = {(r.chapter, r.ord): r for r in made.collect()}
    assert len(rows) == 6 and rows[1, 2].weight == "expanded" and rows[1, 1].subject == "p0" and rows[2, 1].subject == "场景1"
    replies = spark.createDataFrame([(2, '{"sections": [{"id": "一", "subject": "s", "weight": "expanded"}]}'), (1, "{}")], "chapter int, answer string")
    found = specs.designed_spec(replies, made).collect()
    assert sum(r.chapter == 1 for r in found) == 3 and [(r.subject, r.target_words) for r in found if r.chapter == 2] == [("s", 700)]
    assert specs.target_chars(2) == 2000 and specs.target_chars(4) == 3200


def test_chapter_events_fall_back_to_days(spark):
    events = frame(spark)
    ranged = events.unionByName(events.limit(1).selectExpr("2 as chapter", "seq", "day", "time", "location", "pov", "brief"))
    found = specs.chapter_events(events.where("seq < 2"), ranged).collect()
    assert sorted((r.chapter, r.seq) for r in found) == [(1, 1), (1, 2), (2, 1)]


def test_context_lines(spark):
    ticks = spark.createDataFrame([("x", {"power": {"north": "down", "south": "normal"}})], "arc_id string, infrastructure map<string,map<string,string>>")
    beliefs = spark.createDataFrame([("x", "a", k, f"b{k}") for k in range(3)], "arc_id string, agent string, seq int, proposition string")
    events = spark.createDataFrame([("x", 0, "e"), ("x", 1, "e")], "arc_id string, seq int, event string")
    assert sorted(r.line for r in specs.context_lines(ticks, beliefs, events).collect()) == ["a: b0", "a: b1", "e", "power north: down"]


def test_agents_come_from_the_registry(spark):
    asks = spark.createDataFrame([("lin", "s", "p"), ("mo", "s", "q")], "agent string, system string, prompt string")
    config = {"cast": [{"key": "lin", "tier": 1}, {"key": "mo", "tier": 2}]}
    assert agents.decided(asks, config).count() == 2 and agents.decided(asks, config, tier=2).first().agent == "mo" and agents.decided(asks, {}).count() == 0
    with pytest.raises(KeyError):
        agents.kind_of("os.system")
    with pytest.raises(ValueError):
        agents.register("lite")(lambda a, m: a)


def test_rendered_text(spark):
    worlds = spark.createDataFrame([("x", "", ["a", "b", "c", "d"], [])], "arc_id string, media string, public_events array<string>, traces array<string>")
    assert render.world_text(worlds).first().text == "## 公众\n- a\n- b\n- c"
    views = spark.createDataFrame([("a", "t")], "agent string, description string")
    assert render.view_text(views).first().text == "## 你察觉到的一些异常\n- t"
    known = spark.createDataFrame([("r", "中断", "中断", False, "紧张", 9, 3)], "region string, power string, communication string, accessible boolean, supply_status string, panic_level int, mutation_level int")
    wanted = spark.createDataFrame([("r",), ("q",)], "region string")
    assert {r.region: r.panic_level for r in render.places(known, wanted).collect()} == {"r": 9, "q": 0}
    issues = spark.createDataFrame([(1, "warn", "simile", "density", 7.0), (1, "error", "forbidden", "w", 1.0)], "id int, severity string, category string, subject string, measure double")
    assert render.issues_text(issues, "id").first().text.startswith("[error] forbidden w")


def test_texts_are_not_dealt_by_language(spark):
    """A language holds a large share of all texts: its mean goes to the texts, also where Spark thinks that it's large."""
    from inkwell.plans.bindings import QUERIES

    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = QUERIES["quality_issues"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
