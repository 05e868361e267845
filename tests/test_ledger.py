"""Lexicons, states as of a chapter, keyed streams, JSON without a schema, vaults, sinks and numbers against brute force."""

import datetime
import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.operators import asof, automata, cognition, lexicon, meetings, numbering, style
from inkwell.plans import generate, specs
from inkwell.sources import config, store, variants, vault_source
from inkwell.streaming import knowledge


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns or df.columns).collect()), key=repr)


# --- lexicons ---------------------------------------------------------------------------------------------

WORDS = [("ab", "fatal", None), ("b", "high", None), ("ab", "high", None), ("aa", "medium", 1), ("a b", "high", None), (" c", "high", None), ("x", "medium", None), ("c\nd", "fatal", None), ("", "fatal", None), ("low", "low", None)]


def brute_gate(text, words):
    """Each word by itself, as a reader would look for it."""
    lines, out, inside = text.split("\n"), [], False
    fatal = {w for w, s, _ in words if s == "fatal" and w}
    high = {w for w, s, _ in words if s == "high" and w} - fatal
    for n, line in enumerate(lines, 1):
        own = line.strip()
        out += [(n, w, "fatal", own[:80], None, None) for w in fatal if w in line]
        if own.startswith('"'):
            inside = True
        elif inside:
            inside = not own.endswith('"')
        else:
            out += [(n, w, "high", own[:80], None, None) for w in high if w in own]
    for w, s, allowed in words:
        limit = 3 if allowed is None else allowed
        if s == "medium" and text.count(w) > limit:
            out.append((None, w, "medium", None, text.count(w), limit))
    return sorted(out, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab cdx"\n\t', max_size=60))
def test_gate_is_that_of_a_scan_for_each_word(text):
    held = {}
    for w, s, allowed in WORDS:
        if w and s != "low":
            row = held.setdefault(w, [w, False, False, None])
            row[1] |= s == "fatal"
            row[2] |= s == "high"
            row[3] = (3 if allowed is None else allowed) if s == "medium" else row[3]
    gate = lexicon.Gate([(w, f, h and not f, a) for w, f, h, a in held.values()], ('"',), ('"',))
    assert sorted(gate.violations(text), key=repr) == brute_gate(text, WORDS)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab\n😀é ", min_size=1, max_size=5), max_size=12, unique=True), st.text(alphabet="ab\n😀é ", max_size=80), st.booleans())
def test_index_finds_every_word(words, text, equal_hashes):
    """As a scan for each word does, also where words share a hash."""
    index = lexicon.Index(pa.array(words, pa.large_string()))
    if equal_hashes and words:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(lexicon.Index, "_mixed", staticmethod(lambda hashes, length: hashes * np.uint64(0) + np.uint64(7)))
            index = lexicon.Index(pa.array(words, pa.large_string()))
            found = list(index.iter(text))
    else:
        found = list(index.iter(text))
    assert sorted((place, words[k], n) for place, k, n in found) == sorted((i, w, len(w)) for w in words for i in range(len(text)) if text.startswith(w, i))


def test_index_of_many_words_is_small():
    """Some 30 bytes a word and its characters, so that millions of words are one part."""
    index = lexicon.Index(pa.array([f"word{k:07}" for k in range(100_000)], pa.large_string()))
    held = sum(a.nbytes for a in (index.words, index.order, index.hashes, index.fronts, index.wholes))
    assert held < 60 * 100_000 and lexicon.PART_CHARS >= 60_000_000


@pytest.mark.parametrize("part_chars", [1 << 20, 3])
def test_gate_over_documents(spark, part_chars):
    texts = [(1, 'ab b\n"b\nb"\nb'), (2, None), (3, ""), (4, "aaaaaa x x x x"), (4, "b"), (None, "ab")]
    docs = spark.createDataFrame(texts, "id int, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    words = spark.createDataFrame(WORDS, "word string, severity string, allowed int")
    found = lexicon.lexicon_violations(docs, "id", words, ('"',), ('"',), part_chars=part_chars)
    assert rows(found) == sorted([(i, *v) for i, t in texts if t for v in brute_gate(t, WORDS)], key=repr)
    assert rows(lexicon.lexicon_violations(docs, "id", words.limit(0))) == []


def test_gate_agrees_with_the_line_scan(spark):
    docs = spark.createDataFrame([(k, "\n".join(random.Random(k * 9 + j).choice(["the ab", '"ab b', 'b"', " b c ", "b b"]) for j in range(8))) for k in range(40)], "id int, text string")
    words = spark.createDataFrame([("ab", "fatal", None), ("b", "high", None), ("c", "high", None)], "word string, severity string, allowed int")
    expected = style.line_violations(docs, "id", ["ab"], ["b", "c"], ('"',), ('"',))
    assert rows(lexicon.lexicon_violations(docs, "id", words, ('"',), ('"',)), "id", "line", "word", "severity", "context") == rows(expected, "id", "line", "word", "severity", "context")


def test_lexicon_files_are_rows(spark):
    files = [json.dumps({"anti_ai": {"words": {"c": {"severity": "high", "entries": [{"word": "a"}, {"word": "b", "severity": "fatal", "allowedCount": 2}, {"severity": "x"}]}}}}), json.dumps({"words": {"d": {"entries": [{"word": "e"}]}}}), "{broken", None, "{}"]
    found = config.lexicon_rows(spark.createDataFrame([(f,) for f in files], "value string"))
    assert rows(found) == sorted([("c", "a", "high", None), ("c", "b", "fatal", 2), ("d", "e", None, None)], key=repr)


# --- states as of a chapter -------------------------------------------------------------------------------


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("span_rows", [10**6, 7])
def test_as_of_is_the_last_state_before(spark, strict, span_rows):
    chance = random.Random(2)
    states = [(chance.choice(["a", "b", None]), chance.choice([*range(20), None]), f"v{k}", k) for k in range(60)] + [("hot", k, f"h{k}", k) for k in range(40)]
    asks = [(k, chance.choice(["a", "b", "none", None, "hot"]), chance.choice([*range(-1, 45), None])) for k in range(150)]
    asks += asks[:5]
    found = asof.as_of(spark.createDataFrame(asks, "id int, key string, at int").withColumn("told", F.lit(1)), spark.createDataFrame(states, "key string, at int, value string, ord int").withColumn("id", F.lit("x")), ["key"], "at", ["value"], ["ord"], strict, span_rows)
    expected = []
    for i, key, at in asks:
        before = [(t, o, v) for k, t, v, o in states if k == key and None not in (k, t, at) and (t < at or t == at and not strict)]
        t, _, v = max(before) if before else (None, None, None)
        expected.append((i, key, at, 1, v, t))
    assert rows(found) == sorted(expected, key=repr)


def test_chapter_states_are_of_the_chapters_before(spark):
    states = spark.createDataFrame([("n", 1, "one"), ("n", 2, "two"), ("n", 5, "five"), ("n", 5, "again")], "novel string, chapter int, state string")
    asks = spark.createDataFrame([("n", c) for c in range(1, 9)] + [("m", 2), (None, 2), ("n", None)], "novel string, chapter int")
    found = asof.chapter_states(asks, states, ["novel"], "chapter", ["state"])
    expected = [("n", 1, None, None, 0), ("n", 2, "one", 1, 1), ("n", 3, "two", 2, 2), ("n", 4, "two", 2, 1), ("n", 5, None, None, 0), ("n", 6, "five", 5, 1), ("n", 7, "five", 5, 1), ("n", 8, None, None, 0), ("m", 2, None, None, 0), (None, 2, None, None, 0), ("n", None, None, None, 0)]
    assert rows(found, "novel", "chapter", "state", "as_of", "n_states") == sorted(expected, key=repr)


def test_as_of_over_days_and_empty_tables(spark):
    day = datetime.date
    states = spark.createDataFrame([(1, day(2024, 1, 2), "x")], "k int, at date, v string")
    asks = spark.createDataFrame([(1, day(2024, 1, 1)), (1, day(2024, 1, 3))], "k int, at date")
    assert rows(asof.as_of(asks, states, ["k"], "at", ["v"])) == sorted([(1, day(2024, 1, 1), None, None), (1, day(2024, 1, 3), "x", day(2024, 1, 2))], key=repr)
    assert rows(asof.as_of(asks, states.limit(0), ["k"], "at", ["v"]), "v", "as_of") == [(None, None)] * 2 and rows(asof.as_of(asks.limit(0), states, ["k"], "at", ["v"])) == []


# --- streams ----------------------------------------------------------------------------------------------

ENTRY = "agent string, fact_id string, seq long, confidence double, source string, chapter int"


def brute_knowledge(entries):
    out = {}
    for agent, fact, seq, confidence, source, chapter in entries:
        if confidence is not None:
            out.setdefault((agent, fact), []).append((confidence, -seq, source, seq, chapter))
    return sorted([(*k, max(v)[0], max(v)[2], min((e[3], e[4]) for e in v)[1]) for k, v in out.items()], key=repr)


def test_streamed_knowledge_is_that_of_all_entries(spark, tmp_path):
    chance = random.Random(1)
    entries = [(chance.choice("abc"), chance.choice(["f", "g", None]), k, chance.choice([0.2, 0.5, 0.5, 0.9, None]), f"s{k}", chance.randrange(9)) for k in range(120)]
    found = knowledge.replayed(spark.createDataFrame(entries, ENTRY), str(tmp_path), batches=3)
    assert rows(found) == brute_knowledge(entries)


def test_state_meets_only_what_a_task_s_keys_rest_on(monkeypatch):
    """The best and the first entry of each key are what leaves a task, whatever its batches and however few rows it may hold."""
    chance = random.Random(2)
    entries = [(chance.choice("abc"), chance.choice(["f", "g", None]), k, chance.choice([0.2, 0.5, 0.9]), chance.choice([f"s{k}", None]), chance.randrange(9)) for k in range(400)]
    chance.shuffle(entries)
    names = ["agent", "fact_id", "seq", "confidence", "source", "chapter"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, e)) for e in entries[k : k + 50]], pa.schema([("agent", "string"), ("fact_id", "string"), ("seq", "int64"), ("confidence", "double"), ("source", "string"), ("chapter", "int32")])) for k in range(0, 400, 50)]
    for looked in (10**6, 100, 20):
        monkeypatch.setattr(knowledge, "LOOKED_ROWS", looked)
        found = [tuple(r[n] for n in names) for b in knowledge._deciding_batches(iter(batches)) for r in b.to_pylist()]
        assert brute_knowledge(found) == brute_knowledge(entries) and set(found) <= set(entries) and len(found) == len(set(found))
        assert len(found) <= (18 if looked > 20 else 150)
    assert list(knowledge._deciding_batches(iter([]))) == []


def test_a_batch_tells_only_what_it_changes(spark, tmp_path):
    folders = [str(tmp_path / n) for n in ("in", "out", "state")]
    batches = [[("a", "f", 5, 0.5, "s5", 1), ("a", "g", 6, 0.4, "s6", 1)], [("a", "f", 7, 0.3, "s7", 2), ("b", "f", 8, 0.3, "s8", 2)], [("a", "f", 2, 0.1, "s2", 0), ("a", "g", 9, 0.9, "s9", 3)]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, ENTRY).coalesce(1).write.mode("append").parquet(folders[0])
        stream = spark.readStream.schema(ENTRY).parquet(folders[0])
        knowledge.keep_knowledge(stream, folders[1], folders[2]).awaitTermination()
        told = {0: [("a", "f"), ("a", "g")], 1: [("b", "f")], 2: [("a", "f"), ("a", "g")]}[k]
        assert rows(spark.read.parquet(f"{folders[1]}/batch={k}"), "agent", "fact_id") == told
    assert rows(knowledge.kept_knowledge(spark, folders[1])) == brute_knowledge([e for b in batches for e in b])
    assert knowledge.kept_knowledge(spark, str(tmp_path / "none")) is None


# --- JSON without a schema --------------------------------------------------------------------------------


def test_ticks_tell_what_is_missing_and_the_rest_by_default(spark):
    full = {"arc_id": "x", "suggested_chapter_split": [], "character_trajectories": {"p": [{"day": 2, "brief": "b", "more": [1]}, {}, {"day": "no number"}], "q": [], "r": 5}}
    files = [("full", json.dumps(full)), ("empty", "{}"), ("list", "[1]"), ("cut", json.dumps(full)[:-3]), ("null", None), ("nothing", ""), ("key is null", json.dumps(full | {"arc_id": None}))]
    given_files = spark.createDataFrame(files, "file string, value string")
    assert rows(variants.tick_problems(given_files, "file")) == sorted([("empty", f"lacks {k}") for k in store.REQUIRED_TICK] + [(f, "broken") for f in ("list", "cut", "null", "nothing")], key=repr)
    expected = [(f, arc, "p", 0, 2, "", "?", "b") for f, arc in (("full", "x"), ("key is null", None))] + [(f, arc, "p", k, 0, "", "?", "") for f, arc in (("full", "x"), ("key is null", None)) for k in (1, 2)]
    assert rows(variants.tick_rows(given_files, "file")) == sorted(expected, key=repr)


def test_configurations_and_dimensions_have_defaults(spark):
    files = [("a", json.dumps({"protagonist": "k", "cast": [{"key": "k", "name": "Lin", "tier": 1}, {"name": "Mo"}], "pipeline": {"default_mode": "hybrid", "chapter_overrides": {"3": "engine", "x": "gen", "4": 7}}})), ("b", "no"), ("c", '{"cast": 7, "theory_of_mind": {"enabled": false, "truth_table": ""}}')]
    given_files = spark.createDataFrame(files, "file string, value string")
    assert rows(variants.config_rows(given_files, "file"), "file", "protagonist", "tom_enabled", "truth_table", "default_mode", "n_cast") == [("a", "Lin", True, "truth_table.md", "hybrid", 2), ("b", "", True, "truth_table.md", "gen", 0), ("c", "", False, "truth_table.md", "gen", 0)]
    assert rows(variants.cast_rows(given_files, "file")) == [("a", 0, "k", "Lin", 1, "k_state"), ("a", 1, None, "Mo", None, "?_state")]
    asks = spark.createDataFrame([("a", 3), ("a", 4), ("b", 3), ("z", 1)], "file string, chapter int")
    assert rows(variants.chapter_modes(asks, given_files, "file")) == [("a", 3, "engine"), ("a", 4, "hybrid"), ("b", 3, "gen"), ("z", 1, "gen")]
    dims = spark.createDataFrame([("a", '{"dimensions": {"trust": 5, "caution": null, "odd": 1}}'), ("b", "")], "who string, value string")
    found = {(r.who, r.dim): r.value for r in variants.dimension_rows(dims, "who").collect()}
    assert found == {("a", d): 5 if d == "trust" else 3 for d in config.DIMENSIONS} | {("a", "odd"): 1} | {("b", d): 3 for d in config.DIMENSIONS}


# --- vaults and sinks -------------------------------------------------------------------------------------


def test_vault_lists_only_what_is_asked_for(spark, tmp_path):
    for kind, names in {"章节状态": [f"第{k}章" for k in range(1, 30)], "人物": ["林", "墨"], ".git": ["x"]}.items():
        os.makedirs(tmp_path / kind)
        for name in names:
            (tmp_path / kind / f"{name}.md").write_text(f"{kind} {name}\r\n", encoding="utf-8")
    (tmp_path / "人物" / "other.txt").write_text("x")
    notes = vault_source.read_vault(spark, str(tmp_path))
    assert notes.count() == 31 and notes.where("name = '林'").first().value == "人物 林\n"
    assert rows(notes.where("chapter BETWEEN 27 AND 40"), "name", "chapter") == [(f"第{k}章", k) for k in (27, 28, 29)]
    assert rows(notes.where("kind = '人物' AND length(value) > 1 AND name <> '墨'"), "name") == [("林",)]
    reader = vault_source.VaultReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([vault_source.EqualTo(("kind",), "章节状态"), vault_source.In(("chapter",), (2, 3, 99)), vault_source.EqualTo(("value",), "x")]))
    parts = reader.partitions()
    assert [f[1] for p in parts for f in p.files] == ["第2章", "第3章"] and len(left) == 1
    assert vault_source.read_vault(spark, str(tmp_path / "none")).count() == 0


def test_files_by_key_are_all_there_or_none(spark, tmp_path):
    folder = str(tmp_path / "notes")
    given_rows = spark.createDataFrame([(f"n{k}", f"text {k}") for k in range(40)] + [("none", None)], "name string, value string").repartition(4)
    vault_source.write_files(given_rows, folder, ".md")
    assert sorted(os.listdir(folder)) == sorted(f"n{k}.md" for k in range(40)) and (tmp_path / "notes" / "n7.md").read_text() == "text 7"

    def failing(batches):
        for batch in batches:
            yield batch.assign(value="new " + batch["value"])
            if (batch["name"] == "n33").any():
                raise OSError("lost")

    with pytest.raises(Exception, match="lost"):
        vault_source.write_files(given_rows.where("value IS NOT NULL").mapInPandas(failing, "name string, value string"), folder, ".md")
    with pytest.raises(Exception, match="same name"):
        vault_source.write_files(given_rows.unionByName(given_rows.where("name = 'n1'").withColumn("value", F.lit("new"))), folder, ".md")
    with pytest.raises(Exception, match="can't be a file's name"):
        vault_source.write_files(given_rows.withColumn("name", F.lit("../x")), folder, ".md")
    assert sorted(os.listdir(folder)) == sorted(f"n{k}.md" for k in range(40)) and not any("new" in (tmp_path / "notes" / f).read_text() for f in os.listdir(folder))
    vault_source.write_files(spark.createDataFrame([("n7", "changed")], "name string, value string"), folder, ".md")
    assert (tmp_path / "notes" / "n7.md").read_text() == "changed" and len(os.listdir(folder)) == 40


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    folder = str(tmp_path / "table")
    assert store.bucketed(spark, folder) is None
    old = spark.createDataFrame([("a", k, f"old {k}") for k in range(200)] + [(None, 1, "old null")], "agent string, chapter int, text string")
    store.upsert_buckets(old, folder, ["agent", "chapter"], buckets=8)
    files = {b: sorted(os.listdir(f"{folder}/{b}")) for b in os.listdir(folder) if b.startswith("bucket=")}
    new = spark.createDataFrame([("a", 3, "new"), (None, 1, "new null")], "agent string, chapter int, text string")
    store.upsert_buckets(new, folder, ["agent", "chapter"], buckets=8)
    changed = [b for b in files if sorted(os.listdir(f"{folder}/{b}")) != files[b]]
    assert len(files) == 8 and 1 <= len(changed) <= 2
    expected = [("a", k, "new" if k == 3 else f"old {k}") for k in range(200)] + [(None, 1, "new null")]
    assert rows(store.bucketed(spark, folder)) == sorted(expected, key=repr)


# --- numbers ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("range_rows", [10**6, 40])
def test_numbers_follow_the_order_of_the_whole_table(spark, range_rows):
    chance = random.Random(7)
    data = [(chance.choice([None, *range(30)]), k, chance.choice(["x", "y"])) for k in range(500)]
    table = spark.createDataFrame(data, "a int, b int, c string").repartition(6)
    found = numbering.numbered(table, ["a", "b"], range_rows=range_rows)
    expected = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [tuple(r)[:3] for r in found.orderBy("number").collect()] == expected and [r.number for r in found.orderBy("number").collect()] == list(range(1, 501))
    ties = numbering.numbered(table.select("c"), ["c"], "n", range_rows)
    assert sorted(r.n for r in ties.collect()) == list(range(1, 501)) and max(r.n for r in ties.where("c = 'x'").collect()) == sum(d[2] == "x" for d in data)
    assert numbering.numbered(table.limit(0), ["a"]).count() == 0
    if range_rows == 40:
        assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


# --- answers and specs ------------------------------------------------------------------------------------


def test_answers_are_paid_for_once(spark, tmp_path):
    calls, crash = str(tmp_path / "calls"), str(tmp_path / "crash")

    def model(system, prompt):
        with open(calls, "a") as out:
            out.write(f"{prompt}\n")
        if prompt == "q7" and not os.path.exists(crash):
            open(crash, "w").close()
            os._exit(1)  # the worker is lost with its task
        if prompt == "bad":
            raise ValueError("no")
        return f"{system}:{prompt}"

    asks = spark.createDataFrame([(k, "s", f"q{k % 12}") for k in range(120)] + [(200, "s", "bad"), (201, None, None)], "id int, system string, prompt string").withColumn("asked", F.lit("clash"))
    folder = str(tmp_path / "kept")
    with pytest.raises(Exception):
        generate.paid_once(asks, folder, model, tries=1, at_once=1)
    found = generate.paid_once(asks, folder, model, tries=1, at_once=3)
    expected = [(k, "s", f"q{k % 12}", "clash", f"s:q{k % 12}") for k in range(120)] + [(200, "s", "bad", "clash", None), (201, None, None, "clash", ":")]
    assert rows(found) == sorted(expected, key=repr)
    told = open(calls).read().split("\n")[:-1]
    assert all(told.count(f"q{k}") == (2 if k == 7 else 1) for k in range(12))  # the call under which the worker was lost has no answer
    again = generate.paid_once(asks, folder, model, tries=1)
    later = open(calls).read().split("\n")[:-1]
    assert rows(again) == sorted(expected, key=repr) and set(later[len(told) :]) == {"bad"} and not os.path.exists(f"{folder}/notes")


def test_sections_come_from_the_best_source(spark):
    event = "chapter int, day int, time string, pov string, seq int, location string, brief string"
    scoped = spark.createDataFrame([(2, 2, "08:00", "a", k, f"p{k}", f"s{k}") for k in range(4)] + [(1, 1, "", "a", 1, "p", "x"), (9, 9, "", "a", 1, "p", "x")], event)
    ranged = spark.createDataFrame([(c, c, "08:00", "b", 1, "place", f"r{c}") for c in (1, 2, 3)], event)
    replies = spark.createDataFrame([(1, '{"sections": [{"subject": "own", "description": "d", "weight": "expanded"}]}'), (2, "{}"), (3, None)], "chapter int, answer string")
    chapters = spark.createDataFrame([(c,) for c in (1, 2, 3, 4, 4)], "chapter int")
    found = specs.planned_sections(replies, scoped, ranged, chapters)
    told = rows(found, "chapter", "source", "ord", "description", "weight", "n_events")
    expected = [(1, "designed", 1, "d", "expanded", 0)] + [(2, "scope", k + 1, f"- a: s{k}", "normal", 1) for k in range(3)] + [(3, "days", k, "- b: r3", "normal", 1) for k in (1, 2, 3)] + [(4, "blank", k, None, "normal", 0) for k in (1, 2, 3)]
    assert told == sorted(expected, key=repr)
    assert rows(specs.planned_sections(replies, scoped.limit(0), ranged, chapters.limit(0))) == []


# --- passages in texts ------------------------------------------------------------------------------------


@pytest.mark.parametrize("part_chars", [1 << 20, 4])
def test_words_in_texts(spark, part_chars):
    texts = [(1, "abcabc"), (2, None), (3, ""), (4, "xyz"), (4, "ab"), (None, "bc")]
    words = ["ab", "bc", "abc", "", None, "zz", "ab"]
    found = automata.words_in(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame([(w,) for w in words], "w string"), "w", part_chars)
    assert rows(found) == sorted([(i, w) for i, t in texts if t for w in {"ab", "bc", "abc", "zz"} if w in t], key=repr)


def test_long_texts_are_not_cut_into_pieces(spark):
    """Rows that containment explodes are the short texts' pieces alone, whatever the texts' length."""
    texts = spark.createDataFrame([(k, "word " * 4000) for k in range(20)] + [(99, "a fact of some length")], "id int, text string")
    facts = spark.createDataFrame([(1, "a fact of some length, and more of it"), (2, "word word word")], "fact_id int, proposition string")
    assert rows(cognition.contained(texts, facts, "id", "text")) == sorted([*((k, 2) for k in range(20)), (99, 1)], key=repr)
    given_texts = cognition._prepared(texts, "id", "text")
    assert cognition._pieces(given_texts.where(F.length("norm") <= 40), "id", [], 40).count() == 2


def test_no_update_is_lost_between_writers(spark, tmp_path):
    folder, schema = str(tmp_path / "table"), "k int, v string"
    store.save_snapshot(spark.createDataFrame([(1, "a"), (2, "a")], schema), folder)
    at = store.version(spark, folder)
    store.upsert_snapshot(spark.createDataFrame([(2, "first")], schema), folder, ["k"])
    with pytest.raises(store.Moved):
        store.save_snapshot(spark.createDataFrame([(9, "late")], schema), folder, after=at)
    assert rows(store.load_snapshot(spark, folder)) == [(1, "a"), (2, "first")] and len([f for f in os.listdir(folder) if f.startswith("snapshot-")]) == 2
    for k in range(3):
        store.upsert_snapshot(spark.createDataFrame([(k, "more")], schema), folder, ["k"])
    assert rows(store.load_snapshot(spark, folder)) == [(0, "more"), (1, "more"), (2, "more")] and store.version(spark, folder) == 5
    assert len([f for f in os.listdir(folder) if f.startswith("current-")]) == 2


def test_trust_may_be_a_function_of_both_agents(spark):
    chance = random.Random(3)
    presence = spark.createDataFrame([(chance.randrange(12), chance.randrange(6)) for _ in range(60)], "agent int, place int")
    held = spark.createDataFrame([(p, f"f{k}", k) for p in range(6) for k in range(3)], "place int, fact_id string, at int")
    facts = spark.createDataFrame([("f0", "secret"), ("f1", "open"), ("f2", "secret")], "fact_id string, category string")
    pairs = [(a, b) for a in range(12) for b in range(12) if a != b]
    by_table = spark.createDataFrame([(a, b, 0.2 if (a - b) % 3 == 1 else 0.9) for a, b in pairs if (a - b) % 3], "who int, target int, trust double")

    def by_agents(who, target):
        kind = F.pmod(who - target, F.lit(3))
        return F.when(kind == 1, 0.2).when(kind == 2, 0.9)

    a, b = (rows(cognition.theory_of_mind(presence, held, facts, t, ["place"], sensitive=("secret",))) for t in (by_table, by_agents))
    assert a == b and {r[3] for r in a} == {"knows", "uncertain"}


def test_pairs_hold_bits_of_facts_and_tasks_follow_their_number(spark):
    presence = spark.createDataFrame([(day, f"p{day % 3}", agent) for day in range(4) for agent in range(day, day + 5)], "day int, place string, agent long")
    told = {(day, f"p{day % 3}"): [f for f in range(150) if f % (day + 2) == 0] for day in range(4)}
    scene_facts = spark.createDataFrame([(*s, f, (s[0], s[1])) for s, fs in told.items() for f in fs], "day int, place string, fact_id int, at struct<day: int, place: string>")
    facts = spark.createDataFrame([(f, "secret" if f % 5 == 0 else "world") for f in range(200)], "fact_id int, category string")
    given = presence, scene_facts, facts, lambda who, target: F.when((who + target) % 2 == 0, 0.2), ["day", "place"], "agent", ("secret",)
    first = {}
    for s in sorted(told):
        for a in range(s[0], s[0] + 5):
            for b in range(s[0], s[0] + 5):
                if a != b:
                    for f in told[s]:
                        first.setdefault((a, b, f), ("uncertain" if f % 5 == 0 and (a + b) % 2 == 0 else "knows", s))
    tom = cognition.theory_of_mind(*given)
    assert {(r.who, r.target, r.fact_id): (r.verdict, tuple(r.first_at)) for r in tom.collect()} == first and tom.count() == len(first)
    assert rows(cognition.theory_of_mind(*given, first=False)) == rows(tom.drop("first_at"))
    columns = ["who", "target", "n_knows", "n_uncertain", "n_not_knows"]
    assert rows(cognition.theory_of_mind_counts(*given).select(columns)) == rows(cognition.tom_rollup(tom, facts).select(columns))
    crowd = spark.createDataFrame([(1, "x", k) for k in range(2000)], "day int, place string, agent long")
    assert cognition.pair_tasks(crowd, ["day", "place"]) == 20
    assert cognition.co_presence(crowd, ["day", "place"]).rdd.getNumPartitions() == 20


def test_pairs_that_meet_often_are_not_shuffled(spark, monkeypatch):
    chance = random.Random(8)
    met = [(day, place, f"a{k}") for day in range(6) for place in ("x", "y", None) for k in range(90) if chance.random() < 0.3]
    presence = spark.createDataFrame(met + met[:40] + [(1, "x", None)], "day int, place string, agent string")
    held = [(day, place, f, (day, place) if day != 3 else None) for day in range(6) for place in ("x", "y") for f in range(150) if chance.random() < 0.1]
    scene_facts = spark.createDataFrame(held, "day int, place string, fact_id int, at struct<day: int, place: string>")
    facts = spark.createDataFrame([(f, "secret" if f % 5 == 0 else None) for f in range(200)], "fact_id int, category string")
    trust = spark.createDataFrame([(f"a{i}", f"a{j}", (i + 2 * j) % 10 / 10) for i in range(90) for j in range(90) if (i + j) % 3], "who string, target string, trust double")
    given = presence, scene_facts, facts, trust, ["day", "place"], "agent", ("secret",)

    def found():
        first, tom, counts = cognition.theory_of_mind(*given), cognition.theory_of_mind(*given, first=False), cognition.theory_of_mind_counts(*given)
        plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (first, tom, counts)]
        return plans, [sorted(map(tuple, d.select(*sorted(d.columns)).collect()), key=repr) for d in (first, tom, counts)]

    monkeypatch.setattr(meetings, "SLAB_AGENTS", 13)
    monkeypatch.setattr(meetings, "BATCH_ROWS", 50)
    plans, blocks = found()
    assert not any("Repartition" in p for p in plans) and all("MapInArrow" in p for p in plans)
    monkeypatch.setattr(cognition, "meet_often", lambda *_: None)
    plans, grouped = found()
    assert all("Repartition" in p for p in plans)
    assert blocks == grouped and all(blocks)


def test_groups_follow_the_agents_and_rare_meetings_are_grouped(spark, monkeypatch):
    assert meetings.n_groups(90_000, 6_000_000, 12) == 22 and meetings.n_groups(5, 5, 12) == 1 and meetings.n_groups(1500, 99_000, 8) == 6 and meetings.n_groups(10, 40_000_000, 8) == 10
    rare = spark.range(400).select((F.col("id") / 2).cast("long").alias("place"), F.col("id").alias("agent"))
    assert meetings.meet_often(rare, ["place"], "agent") is not None
    monkeypatch.setattr(meetings, "GROUP_AGENTS", 100)
    assert meetings.meet_often(rare, ["place"], "agent") is None
    assert meetings.meet_often(rare.withColumn("place", F.lit(1)), ["place"], "agent")[1] == 400
    assert meetings.meet_often(rare.select("place", F.struct("agent").alias("agent")), ["place"], "agent") is None


def test_texts_are_normalised_and_marked_in_one_pass(spark):
    texts = [(1, "He said: a-b c, d!"), (2, "b.c"), (3, " 　**\n"), (4, None), (5, ""), (6, "B.C"), (7, "longer than any of the facts, b.c not")]
    facts = spark.createDataFrame([(10, "a b c d"), (11, "**"), (12, "...")], "fact_id int, proposition string")
    given = spark.createDataFrame([((k, f"s{k}"), t) for k, t in texts], "doc struct<id: int, source: string>, text string")
    found = cognition.contained(given, facts, "doc", "text")
    assert sorted((r.doc.id, r.doc.source, r.fact_id) for r in found.collect()) == [(1, "s1", 10), (2, "s2", 10), (3, "s3", 11)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_a_row_finds_its_range_by_halving(spark, monkeypatch):
    chance = random.Random(5)
    pairs = [(chance.choice([None, *range(40)]), k) for k in range(3000)]
    df = spark.createDataFrame(pairs, "v int, k int")
    found = numbering.numbered(df, ["v", "k"], range_rows=50)
    assert [r.k for r in found.orderBy("number").collect()] == [k for _, k in sorted(pairs, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    assert sorted(r.number for r in found.collect()) == list(range(1, 3001))
    assert "filter(" not in found._jdf.queryExecution().optimizedPlan().toString()
