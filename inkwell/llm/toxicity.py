"""Toxicity by a weighted lexicon.

Texts are folded to words: compatibility forms are unified, invisible characters and stacked accents go, letters of other scripts
that look Latin become Latin, and digits and signs inside a word become the letters that they stand for ("1d10t").
An entry of the lexicon is a word or the beginning of one, with the space before it (and after a whole word), and a
weight. Aho-Corasick finds all entries in one pass. A hit inside an exception phrase (an entry's word with the
word before or after it, which is mostly harmless) doesn't count. The sum of weights, by itself and by the number of words,
goes through a logistic curve.

Entries, weights, exceptions and the curve are learned from labelled rows; their text and label alone. The fit reads at most
``SAMPLE_TEXTS`` distinct texts of each label, chosen by hash, whole. A candidate is any beginning of at least three
letters, or a whole word; its weight is the lower end of the log odds of its rates among the words of either label. Occurrences
count once for the same word between the same neighbours, else copies of one text would make its words entries.
Beginnings that lie in each other share their words, so that of those one is taken: that with the most weight over all occurrences,
and the longest of equals.

Defined results: a null or empty text, and one without a word, has no hits and gets the score of its length 0. If either label is
missing among the rows to learn from, there is no lexicon and every score is 0. Where labels repeat a doc_id the
largest counts; rows without a doc_id aren't learned from and aren't held out. Repeated rows are scored alike; other columns don't matter.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import cut, let_go, pieces, table, texts, tidy, unsigned_share
from inkwell.llm.langid import held_out

SAMPLE_TEXTS = 8000
#: An entry's least weight, texts of label 1 and different places in them; the most entries and exceptions.
MIN_WEIGHT, MIN_DOCS, MIN_PLACES, MOST_ENTRIES = 1.6, 3, 4, 20_000
#: A whole word of so little weight may still be an entry, once its exceptions are left out.
MAYBE_WEIGHT = 0.3
#: Standard errors below the log odds where the weight lies.
CAUTION = 1.64
SHORTEST, LONGEST = 3, 12
#: Harmless documents that a phrase needs to be an exception, and how often there must be of them one toxic one.
EXCEPTION_DOCS, EXCEPTION_RATIO = 5, 5
THRESHOLD = 0.7

#: Cyrillic and Greek letters that look like Latin ones.
HOMOGLYPHS = str.maketrans("авекмнорстухіјѕԁһӏοανρικτυχεց", "abekmhopctyxijsdhloavpiktuxeg")
#: What stands for a letter inside a word; 1 is also l.
SIGNS = str.maketrans("013457@$", "oieastas")
OTHER_ONE = str.maketrans("013457@$", "oleastas")

WORD = re.compile(r"[^\W_]+(?:[@$]+[^\W_]+)*|[@$](?=[^\W\d_])[^\W_]+(?:[@$]+[^\W_]+)*")
SIGNED = re.compile(r"[\d@$]")
INVISIBLE = re.compile("[­͏؜​-‏‪-‮⁠-⁤︀-️﻿]")
FOREIGN = re.compile("[Ͱ-ԯ]")
STACKED = re.compile("[̀-ͯ]+")


def unified(text: str) -> str:
    """Lower case, compatibility forms, without invisible characters, free accents and foreign lookalikes in Latin words."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).lower()
    if STACKED.search(text):
        text = STACKED.sub("", text)
    if FOREIGN.search(text):
        text = re.sub(r"\w+", lambda m: latin(m[0]), text)
    return text


def latin(word: str) -> str:
    """``word`` with lookalikes made Latin, if then no letter of another script is left."""
    shown = word.translate(HOMOGLYPHS)
    return word if FOREIGN.search(shown) else shown


@functools.lru_cache(maxsize=1 << 16)
def bare(word: str) -> str:
    """``word`` without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def variants(word: str) -> list[str]:
    """How a word with digits or signs may be read, the likelier first; a number stands for itself."""
    if not any(map(str.isalpha, word)):
        return [word]
    return list(dict.fromkeys([word.translate(SIGNS), word.translate(OTHER_ONE)]))


def words_of(text: str | None, lexicon: Lexicon | None = None) -> list[str]:
    """The folded words. With a lexicon, a word is read so that it is an entry, if it can be."""
    found = WORD.findall(unified(text)) if text else []
    for k, word in enumerate(found):
        if SIGNED.search(word):
            read = variants(word)
            found[k] = read[0] if lexicon is None else next((w for w in read if lexicon.knows(w)), read[0])
        elif lexicon is not None and not word.isascii() and len(word) <= lexicon.longest and (plain := bare(word)) in lexicon.whole:
            found[k] = plain
    return found


class Lexicon:
    """Entries with weights and exception phrases in one automaton. ``curve``: bias and weights of the two measures."""

    def __init__(self, entries: dict[str, float], exceptions: Iterable[str] = (), curve: tuple[float, float, float] | None = None):
        self.entries, self.exceptions, self.curve = entries, frozenset(exceptions), curve
        self.whole = {e[1:-1] for e in entries if e[-1] == " "}
        self.longest = max(map(len, self.whole), default=0)
        self.found = ahocorasick.Automaton()
        for entry, weight in entries.items():
            self.found.add_word(entry, (len(entry), weight, entry))
        for phrase in self.exceptions:
            self.found.add_word(f" {phrase} ", (len(phrase) + 2, None, phrase))
        if len(self.found):
            self.found.make_automaton()

    def knows(self, word: str) -> bool:
        return any(weight is not None for _, (_, weight, _) in self.found.iter(f" {word} ")) if len(self.found) else False

    def hits(self, words: list[str]) -> list[tuple[int, str, float]]:
        """(place in the line of words, entry, weight), without those in an exception phrase."""
        if not len(self.found) or not words:
            return []
        entries, free = [], []
        for end, (length, weight, entry) in self.found.iter(f" {' '.join(words)} "):
            (free if weight is None else entries).append((end - length + 1, end, entry, weight))
        return [(start, entry, weight) for start, _, entry, weight in entries if not any(a <= start < b for a, b, _, _ in free)]

    def measures(self, text: str | None) -> tuple[float, float]:
        """(weight by words, weight), on a scale of logarithms."""
        words = words_of(text, self)
        total = sum(weight for _, _, weight in self.hits(words))
        return math.log1p(100 * total / (len(words) + 5)), math.log1p(total)

    def score(self, text: str | None) -> float:
        if self.curve is None:
            return 0.0
        bias, by_words, by_all = self.curve
        density, total = self.measures(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + by_words * density + by_all * total))))


class Sizes(NamedTuple):
    """Words of the texts of either label."""

    toxic: int
    clean: int


def to_learn_from(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` of the rows that aren't held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    return known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))


def sample(docs: DataFrame, given: DataFrame, most: int = SAMPLE_TEXTS) -> DataFrame:
    """``toxic, text``: at most ``most`` distinct texts of each label of ``given`` from ``docs(doc_id, text)``.

    Ids are chosen by hash (no more than twice as many as texts are wanted) and broadcast, so that only those texts move. They are
    thinned by another hash before they are ranked, so that no task ranks all labels.
    """
    counts = given.groupBy("toxic").agg(F.count("*").alias("n"))
    thin = given.join(F.broadcast(counts), "toxic").where(unsigned_share(F.xxhash64("doc_id"), 29) < F.lit(8.0 * most) / F.col("n"))
    by_hash = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = thin.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= 2 * most).select("doc_id", "toxic")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    distinct = rows.groupBy(F.xxhash64("text").alias("key"), "toxic").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("toxic").orderBy("key"))
    return cut(distinct.withColumn("place", place).where(F.col("place") <= most).select("toxic", "text"))


def beginnings(word: str) -> list[str]:
    """The entries that a word may be of: itself, and what it begins with."""
    return [f" {word} ", *(f" {word[:n]}" for n in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def lower_odds(toxic, clean, sizes: Sizes):
    """Columns to column: the log odds of an entry's rates among words of either label, ``CAUTION`` standard errors below."""
    odds = F.log((toxic + 0.5) / (sizes.toxic + 1.0)) - F.log((clean + 0.5) / (sizes.clean + 1.0))
    return odds - CAUTION * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def counts_of(texts_of: DataFrame) -> DataFrame:
    """``entry, toxic, clean``: how many words of either label each candidate is or begins; the empty entry is all words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: tuple[Counter, Counter] = (Counter(), Counter())

        def told() -> pa.RecordBatch:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for own, found in zip(counts, words):
                for word, n in found.items():
                    for entry in beginnings(word):
                        own[entry] += n
                own[""] += sum(found.values())
                found.clear()
            entries = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), *(pa.array([counts[k][e] for e in entries], pa.int64()) for k in (1, 0))], names=["entry", "toxic", "clean"])

        for batch in pieces(batches, "text"):
            for toxic, text in zip(batch.column(0).to_pylist(), texts(batch, "text")):
                words[toxic].update(words_of(text))
            if sum(map(len, words)) > 1 << 17:
                yield told()
        yield told()

    return texts_of.mapInArrow(run, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def candidates(counts: DataFrame, sizes: Sizes) -> dict[str, float]:
    """Entries that are told by their words alone, with their weights; the most telling ``MOST_ENTRIES``."""
    weighed = counts.withColumn("weight", lower_odds(F.col("toxic"), F.col("clean"), sizes)).where((F.col("toxic") >= MIN_PLACES) & (F.col("entry") != ""))
    weighed = weighed.where((F.col("weight") >= MIN_WEIGHT) | F.col("entry").endswith(" ") & (F.col("weight") >= MAYBE_WEIGHT))
    return {r.entry: r.weight for r in weighed.orderBy(F.desc(F.col("weight") * F.col("toxic")), "entry").limit(MOST_ENTRIES).select("entry", "weight").collect()}


def seen(texts_of: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``entry, toxic, doc, before, word, after``: each different place of an entry in a text."""
    shared = texts_of.sparkSession.sparkContext.broadcast((lexicon.entries, lexicon.exceptions))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*shared.value)
        for batch in pieces(batches, "text"):
            rows = set()
            for toxic, text in zip(batch.column(0).to_pylist(), texts(batch, "text")):
                words = words_of(text)
                starts = dict(zip(itertools.accumulate((len(w) + 1 for w in words), initial=0), range(len(words))))
                key = hash(text)
                for start, entry, _ in own.hits(words):  # one for each entry: here they may lie in each other
                    k = starts[start]
                    rows.add((entry, toxic, key, words[k - 1] if k else "", words[k], words[k + 1] if k + 1 < len(words) else ""))
            found = list(rows)
            kinds = {"entry": pa.string(), "toxic": pa.bool_(), "doc": pa.int64(), "before": pa.string(), "word": pa.string(), "after": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    return texts_of.mapInArrow(run, "entry string, toxic boolean, doc long, before string, word string, after string")


def weighed(texts_of: DataFrame, lexicon: Lexicon, sizes: Sizes) -> list[tuple[str, float, int]]:
    """(entry, weight, places of label 1) of the lexicon's entries outside its exceptions."""
    places = {label: F.count_distinct(F.when(F.col("toxic") == label, F.struct("before", "word", "after"))) for label in (True, False)}
    docs = F.count_distinct(F.when(F.col("toxic"), F.col("doc")))
    counts = seen(texts_of, lexicon).groupBy("entry").agg(places[True].alias("toxic"), places[False].alias("clean"), docs.alias("docs"))
    kept = counts.withColumn("weight", lower_odds(F.col("toxic"), F.col("clean"), sizes)).where((F.col("weight") >= MIN_WEIGHT) & (F.col("docs") >= MIN_DOCS) & (F.col("toxic") >= MIN_PLACES))
    return [(r.entry, r.weight, r.toxic) for r in kept.select("entry", "weight", "toxic").collect()]


def apart(entries: list[tuple[str, float, int]]) -> dict[str, float]:
    """Of entries that lie in each other that with the most weight over all places; of equals the longest."""
    taken: dict[str, float] = {}
    blocked: set[str] = set()  # beginnings of what is taken
    for entry, weight, n in sorted(entries, key=lambda e: (-round(e[1] * e[2], 6), -len(e[0]), e[0])):
        if entry not in blocked and not any(entry[:k] in taken for k in range(2, len(entry) + 1)):
            taken[entry] = weight
            blocked.update(entry[:k] for k in range(2, len(entry) + 1))
    return taken


def exceptions(texts_of: DataFrame, lexicon: Lexicon) -> list[str]:
    """Phrases of an entry's word and a neighbour that are mostly harmless; the commonest ``MOST_ENTRIES``."""
    around = F.array(F.concat_ws(" ", "before", "word"), F.concat_ws(" ", "word", "after"))
    phrases = seen(texts_of, lexicon).where("before != '' and after != ''").select("toxic", "doc", F.explode(around).alias("phrase"))
    docs = {label: F.count_distinct(F.when(F.col("toxic") == label, F.col("doc"))) for label in (True, False)}
    counts = phrases.groupBy("phrase").agg(docs[True].alias("toxic"), docs[False].alias("clean"))
    free = counts.where((F.col("clean") >= EXCEPTION_DOCS) & (F.col("clean") >= EXCEPTION_RATIO * F.col("toxic")))
    return [r.phrase for r in free.orderBy(F.desc("clean"), "phrase").limit(MOST_ENTRIES).collect()]


def curve(texts_of: DataFrame, lexicon: Lexicon, share_toxic: float) -> tuple[float, float, float]:
    """The logistic curve over both measures, by Newton's steps with a small penalty; ``share_toxic`` of all rows have label 1."""
    shared = texts_of.sparkSession.sparkContext.broadcast((lexicon.entries, lexicon.exceptions))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*shared.value)
        for batch in pieces(batches, "text"):
            found = [own.measures(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1))], names=["toxic", "density", "total"])

    rows = texts_of.mapInArrow(run, "toxic boolean, density double, total double").orderBy("toxic", "density", "total").collect()
    y = np.array([r.toxic for r in rows], float)
    x = np.array([(1.0, r.density, r.total) for r in rows]).reshape(-1, 3)
    share = np.where(y > 0, share_toxic / max(1.0, y.sum()), (1 - share_toxic) / max(1.0, (1 - y).sum())) * len(y)
    beta, penalty = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2]) * max(1.0, len(y) / 100)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (share * (y - p)) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in np.maximum(beta, [-np.inf, 0.0, 0.0]))


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_TEXTS) -> Lexicon:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; rows that are held out take no part."""
    given = to_learn_from(labels)
    share_toxic = given.agg(F.avg(F.col("toxic").cast("int"))).first()[0]
    texts_of = sample(docs, given, most)
    counts = cut(counts_of(texts_of))
    all_words = counts.where("entry = ''").first()
    sizes = Sizes(all_words.toxic, all_words.clean) if all_words else Sizes(0, 0)
    lexicon = Lexicon({})
    if all(sizes):
        first = Lexicon(candidates(counts, sizes))
        free = exceptions(texts_of, first)
        final = Lexicon(apart(weighed(texts_of, Lexicon(first.entries, free), sizes)))
        final = Lexicon(final.entries, [f for f in free if any(map(final.knows, f.split(" ")))])
        lexicon = Lexicon(final.entries, final.exceptions, curve(texts_of, final, share_toxic))
    let_go(counts)
    let_go(texts_of)
    return lexicon


def judged(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score`` of each row of ``docs(doc_id, text)``: its whole text against the lexicon."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.entries, lexicon.exceptions, lexicon.curve))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*shared.value)
        for batch in pieces(batches, "text"):
            scores = [own.score(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    fields = docs.select("doc_id").schema.add("score", "double")
    return docs.select("doc_id", "text").mapInArrow(run, fields)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    found = judged(docs, lexicon)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
