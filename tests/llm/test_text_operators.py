"""Collocations, lexical search and toxicity against brute force, SQL and held-out accuracy."""

import itertools
import math
import random
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from inkwell.llm import collocations, lexical, toxicity
from inkwell.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def compared(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    told = con.sql(ORACLE_SQL[name])
    columns = sorted(told.columns)
    rows = found.select(*columns).collect()
    assert rows and compared(rows) == compared(told.select(*columns).fetchall())


# --- collocations ----------------------------------------------------------------------------------------


def brute_collocations(docs, min_count, longest, top):
    """The rows by counting all phrases in dictionaries."""
    counts, totals = {}, Counter()
    for lang, text in docs:
        lang, text = lang or "und", text or ""
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, found in counts.items():
        rows = []
        often = [g for g, f in found.items() if len(g) > 1 and f >= min_count]
        for g in often:
            a = found[g]
            inside = any(len(h) > len(g) and 100 * found[h] >= 100 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h in often)
            if not inside:
                score, k = min((1000 * a * totals[lang] // (found[g[:k]] * found[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), " ".join(g), found[g[:k]], found[g[k:]]))
        out += [(lang, rank, phrase, -a, left, right, totals[lang], -score) for rank, (score, a, _, phrase, left, right) in enumerate(sorted(rows)[:top], 1)]
    return out


@pytest.mark.parametrize("settings_of", [{}, {"word_cells": 1 << 13, "most_cells": 1 << 16, "group_chars": 300}])
def test_collocations_are_those_of_brute_force(spark, settings_of):
    chance = random.Random(5)
    vocabulary = ["a", "b", "Ab", "ÄB", "äb", "c'd", "e-f", "g\x00h", "é", " ", "x\x1fy", " "]
    docs = []
    for lang in ("en", "en", "fr", None, "und"):
        for _ in range(12):
            docs.append((lang, "".join(chance.choice(vocabulary) + chance.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r"]) for _ in range(chance.randrange(80)))))
    docs += [("fr", None), ("fr", ""), (None, "  ,. "), ("en", "a b a b a b a b a b a b a b a b a b"), ("de", "ein Wort")] + [("en", "one two three four five six")] * 5
    given_docs = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    found = collocations.collocations(given_docs, min_count=4, top=30, **settings_of)
    assert compared(found.collect()) == compared(brute_collocations(docs, 4, 5, 30))


def test_long_texts_are_cut_between_pieces_only():
    import pyarrow as pa

    text = "one two, " * 50 + "three four five " * 40 + "\n" + "six " * 100
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    parts = [t for _, t in collocations.Reader.slices(iter([batch]), 60)]
    whole = text.encode().translate(collocations.FOLD)
    assert len(parts) > 3 and b"\n".join(parts) == whole


def test_scores_beyond_64_bits_are_exact(spark):
    big = 9 * 10**11
    counts = spark.createDataFrame([("en", "a b", big - 7), ("en", "a", big), ("en", "b", big + 11)], "lang string, phrase string, f long")
    row = collocations.scored(counts, {"en": 7 * 10**12}).first()
    assert row.score == 1000 * (big - 7) * 7 * 10**12 // (big * (big + 11))


# --- lexical search --------------------------------------------------------------------------------------

lists = st.lists(st.lists(st.integers(0, 6), max_size=8), min_size=1, max_size=25)


@settings(max_examples=150, deadline=None)
@given(lists, st.lists(st.integers(0, 8), min_size=1, max_size=8), st.integers(0, 4000))
def test_maxscore_finds_all_that_reach_the_floor(docs, item, floor):
    rows = [(t, d, 50 + (t * 37 + n * 113 + len(doc)) % 900) for d, doc in enumerate(docs) for t, n in Counter(doc).items()]
    if not rows:
        return
    terms, at, adds = (np.array(c, np.int64) for c in zip(*rows))
    room = np.zeros(len(docs), np.int64)
    found, scores = lexical.Shard(terms, at, adds).search(dict(Counter(item)), floor, room)
    expected = Counter()
    for t, d, add in rows:
        expected[d] += add * item.count(t)
    assert dict(zip(found.tolist(), scores.tolist())) == {d: s for d, s in expected.items() if s > 0 and s >= floor}
    assert not room.any()


def brute_search(docs, items, top):
    words = [(i, [w.decode() for w in lexical.terms_of(t.encode())]) for i, t in docs if t]
    words = [(i, w) for i, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    df = Counter(itertools.chain.from_iterable(set(w) for _, w in words))
    out = []
    for item_id, text in items:
        scores = []
        for i, own in words:
            tf, m = Counter(own), 25 + (75 * len(own) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in (w.decode() for w in lexical.terms_of(text.encode())) if t in tf)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item_id, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_postings": 7, "block_bytes": 20}])
def test_search_is_that_of_brute_force(spark, sizes):
    chance = random.Random(3)
    vocabulary = ["a", "A", "b", "ça", "ÇA", "d1", "e_f", "g", "日本", "h-i"]
    docs = [(k if k % 7 else None, " ".join(chance.choices(vocabulary, k=chance.randrange(40)))) for k in range(120)]
    docs += [(5, None), (5, ""), (9, "..."), (11, "a b"), (11, "a b"), (11, "a b")]
    items = [(k, " ".join(chance.choices(vocabulary, k=6))) for k in range(9)] + [(50, "never"), (51, "")]
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **sizes)
    assert compared(found.collect()) == compared(brute_search(docs, items, lexical.TOP))


# --- toxicity --------------------------------------------------------------------------------------------


def test_words_are_folded():
    words = toxicity.words_of("ＩＤＩＯＴ id​iot іdіоt 1d10t i̶diot $cum 42 a@b x$5 été 3rd")
    assert words == ["idiot", "idiot", "idiot", "idiot", "idiot", "scum", "42", "aab", "xss", "été", "erd"]
    lexicon = toxicity.Lexicon({" loser ": 2.0, " idiot ": 2.0, " lowei": 1.0})
    assert toxicity.words_of("1oser ïdïot löweis", lexicon) == ["loser", "idiot", "löweis"]
    assert toxicity.words_of("слово и дело") == ["слово", "и", "дело"]  # words of another script stay


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["bad", "badly", "b", "xbad", "worse", "wor", "worst", "case", "the"]), max_size=14))
def test_hits_are_those_of_a_scan(words):
    entries = {" bad ": 2.0, " wor": 1.5}
    lexicon = toxicity.Lexicon(entries, ["worst case"])
    expected, at = [], 0
    for k, word in enumerate(words):
        free = word == "worst" and words[k + 1 : k + 2] == ["case"]
        expected += [(at, e, w) for e, w in entries.items() if f" {word} ".startswith(e) and not free]
        at += len(word) + 1
    assert sorted(lexicon.hits(words)) == sorted(expected)


def test_of_entries_in_each_other_one_is_taken():
    found = toxicity.apart([(" lo", 0.2, 900), (" lowe", 4.0, 100), (" lowei", 4.0, 100), (" loweis ", 5.0, 10), (" idiot ", 4.0, 50), (" idiot", 4.0, 50)])
    assert found == {" lowei": 4.0, " idiot ": 4.0}


@pytest.fixture(scope="module")
def planted(spark):
    """Toxic texts with two words and a stem; ``trash can`` is harmless."""
    chance = random.Random(11)
    syllables = ["ba", "ke", "mi", "lo", "nu", "ra", "se", "ti"]
    word = lambda: "".join(chance.choices(syllables, k=3))
    docs, labels = [], []
    for k in range(900):
        words = [word() for _ in range(60)]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(4):
                words[chance.randrange(60)] = chance.choice(["trash", "moron", "vequ" + word()])
        elif k % 4 == 1:
            at = chance.randrange(59)
            words[at : at + 2] = ["trash", "can"]
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_lexicon_is_learned_with_exceptions(planted):
    lexicon = toxicity.learn(*planted)
    assert {" trash ", " moron ", " vequ"} <= set(lexicon.entries) and len(lexicon.entries) < 8
    assert any("trash can" in e for e in lexicon.exceptions)
    clean = "bakemi lonura " * 30
    assert lexicon.score(clean + "trash can") < 0.7 <= lexicon.score(clean + "trash moron m0r0n vequbaba")
    assert lexicon.score("") == lexicon.score(None) == lexicon.score("!?") < 0.1


def test_held_out_toxic_documents_are_found(spark, planted):
    docs, labels = planted
    lexicon = toxicity.learn(docs, labels)
    rows = toxicity.judged(docs, lexicon).join(labels, "doc_id").select("score", "toxic", toxicity.held_out().alias("held")).collect()
    held = [(r.score >= toxicity.THRESHOLD, r.toxic == 1) for r in rows if r.held]
    assert len(held) > 200 and sum(a == b for a, b in held) / len(held) > 0.98


def test_held_out_documents_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    rows = [r for r in toxicity.op13_toxicity(spark, folder).collect() if r.held_out and r.doc_id in truth]
    wrong = sum(r.predicted != truth[r.doc_id] for r in rows)
    assert len(rows) > 100 and wrong <= 3


def test_without_one_label_there_is_no_lexicon(spark, planted):
    docs, labels = planted
    lexicon = toxicity.learn(docs, labels.where("toxic = 0"))
    assert not lexicon.entries and lexicon.score("moron") == 0.0


def test_very_long_words_are_not_remembered():
    codes = collocations.Codes("en")
    assert codes[b"x" * 1000] == codes[b"x" * 1000] != codes[b"y"] and len(codes) == 3
    lexicon = toxicity.Lexicon({" idiot ": 2.0})
    before = toxicity.bare.cache_info().currsize
    assert toxicity.words_of("é" * 5000 + " ïdiot", lexicon)[1] == "idiot" and toxicity.bare.cache_info().currsize <= before + 1


def test_phrases_that_begin_alike_share_an_automaton(spark):
    given = [f"w{a} w{b}{tail}" for a in range(20) for b in range(20) for tail in ("", " x", " x y", " x y z")]
    groups = spark.createDataFrame([(p,) for p in given], "phrase string").select("phrase", collocations._group(7).alias("k")).collect()
    held = {}
    for r in groups:
        held.setdefault(" ".join(r.phrase.split()[:2]), set()).add(r.k)
    assert all(len(k) == 1 for k in held.values()) and len({r.k for r in groups}) == 7
