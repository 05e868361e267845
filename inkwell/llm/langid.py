"""Language identification by compression.

A text goes to the language whose dictionary makes it smallest under zstandard. A dictionary is raw
content: the words that most training documents of the language have, the commonest last, where
matches are cheapest. A text is shown to the compressor as its distinct lower-cased words, so that
capitals, repeated lines and passages copied between languages don't decide.

Where the best two sizes are close, smaller dictionaries are tried too and the sizes are added up. There
the text is led by the dictionary's own end, whose size is taken off again: zstandard stores a few words by
themselves as they are, so that they weigh the same in every language. A text that stays within
a margin of a second language is marked as rejected. The margin is learned on training texts that gave no words: the largest
one, within narrow bounds, below which at least three in four texts are told wrong.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; equal sums
go to the language that comes first by code point. Without any training row every text is ``und``.
Repeated rows are predicted alike; other columns of the input don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import cut, let_go, pieces, plain_names, table, texts, tidy, unsigned_share

UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+")
#: (bytes of the dictionary, compression level); all but the first serve close calls.
DICTIONARIES = ((100_000, 4), (32_000, 9), (8_000, 9))
#: Bytes of the dictionary's end that lead a text in close calls.
LEAD = 300
#: The fit reads at most so many distinct texts of each of the commonest languages, each of them whole: for the words, and then
#: others for the margin.
SAMPLE_TEXTS, MARGIN_TEXTS, MOST_LANGUAGES = 600, 300, 200
#: The margin below which smaller dictionaries are tried; what rejection asks for at least and at most; and, so that texts whose
#: language can be told stay, what share of the training texts that a larger margin than the least rejects is wrong, and of how many.
CLOSE, MIN_MARGIN, MOST_MARGIN, WRONG_SHARE, WRONG_TEXTS = 0.05, 0.001, 0.005, 0.75, 5


def words_of(text: str) -> list[str]:
    """Distinct lower-cased words of letters, in order of appearance. What ``\\w`` has besides (fractions, raised digits, Roman numerals) is none."""
    found = dict.fromkeys(WORDS.findall(text.lower()))
    if all(map(str.isalpha, found)):
        return list(found)
    return list(dict.fromkeys(part for word in found for part in "".join(c if c.isalpha() else " " for c in word).split()))


def training_sample(labelled: DataFrame, most: int, languages: int = MOST_LANGUAGES) -> DataFrame:
    """lang, text, place: at most ``most`` distinct texts of each of the commonest languages of ``labelled(doc_id, text, lang)``, those with the smallest hash first.

    Rows are thinned by hash before they are ranked, by the language's count, so no language is gathered whole.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    share = unsigned_share(F.xxhash64("doc_id"), 17)
    return (
        known.join(F.broadcast(counts), "lang")
        .where(share < F.lit(4.0 * most) / F.col("n"))
        .select("lang", "text", F.xxhash64("text").alias("key"))
        .dropDuplicates(["lang", "key"])
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")))
        .where(F.col("place") <= most)
        .select("lang", "text", "place")
    )


def training_words(sample: DataFrame, most_bytes: int = DICTIONARIES[0][0]) -> dict[str, list[str]]:
    """Each language's words by falling document frequency in ``sample(lang, text)``.

    Words are counted where the texts are; the driver gets as many of a language as fill ``most_bytes``.
    """

    @tidy
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = [(lang, word) for lang, text in zip(texts(batch, "lang"), texts(batch, "text")) for word in words_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["lang", "word"])

    counted = sample.select("lang", "text").mapInArrow(split, "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    fitting = counted.withColumn("bytes", F.sum(F.octet_length("word") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("bytes") <= most_bytes)
    found: dict[str, list[str]] = {}
    for row in fitting.select("lang", "n", "word").orderBy("lang", F.desc("n"), "word").collect():
        found.setdefault(row.lang, []).append(row.word)
    return found


def dictionaries(words: dict[str, list[str]], sizes=DICTIONARIES) -> list[dict[str, bytes]]:
    """For each size, every language's raw-content dictionary: the commonest words that fit, commonest last."""
    out = []
    for most, _ in sizes:
        made = {}
        for lang, ranked in sorted(words.items()):
            taken, held = [], 0
            for word in ranked:
                held += len(word.encode()) + 1
                if held > most:
                    break
                taken.append(word)
            made[lang] = ("\n".join(reversed(taken)) + "\n").encode()
        out.append(made)
    return out


class Classifier:
    """Compressors of one worker; built from the broadcast dictionaries."""

    def __init__(self, made: list[dict[str, bytes]], levels: list[int], close: float = CLOSE, min_margin: float = MIN_MARGIN):
        self.languages = sorted(made[0]) if made else []
        self.close, self.min_margin = close, min_margin
        self.rounds = [[self._compressor(one[lang], level) for lang in self.languages] for one, level in zip(made, levels)]
        leads = [[one[lang][-LEAD:] + b"\n" for lang in self.languages] for one in made[1:]]
        #: (compressor, lead, size of the lead alone) by language, for each round of a close call
        self.close_rounds = [[(c, lead, len(c.compress(lead))) for c, lead in zip(compressors, row)] for compressors, row in zip(self.rounds[1:], leads)]

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False, write_dict_id=False)

    @staticmethod
    def _margin(sizes: list[int]) -> float:
        if len(sizes) < 2:
            return 1.0
        best, second = sorted(sizes)[:2]
        return (second - best) / second

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, the margin over the runner-up (0 to 1), and whether the text is accepted."""
        words = words_of(text) if text else []
        if not words or not self.languages:
            return UNKNOWN, 0.0, False
        shown = "\n".join(words).encode()
        sizes = [len(c.compress(shown)) for c in self.rounds[0]]
        if self._margin(sizes) < self.close:
            for row in self.close_rounds:
                sizes = [a + len(c.compress(lead + shown + b"\n")) - alone for a, (c, lead, alone) in zip(sizes, row)]
        margin = self._margin(sizes)
        return self.languages[sizes.index(min(sizes))], margin, margin >= self.min_margin


def identify(docs: DataFrame, words: dict[str, list[str]], carry: list[str], close: float = CLOSE, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``carry`` columns of ``docs`` with lang_pred, score and accepted for each row's whole ``text``.

    ``carry`` may name ``text`` itself; no other column takes part in the prediction.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(dictionaries(words))
    levels = [level for _, level in DICTIONARIES]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value, levels, close, min_margin)
        for batch in pieces(batches, shown):
            found = [model.predict(t) for t in texts(batch, shown)]
            added = [pa.array([f[k] for f in found], kind) for k, kind in ((0, pa.string()), (1, pa.float64()), (2, pa.bool_()))]
            kept = [batch.column(i) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays(kept + added, names=[*carry, "lang_pred", "score", "accepted"])

    shown = "text" if "text" in carry else "_text"
    given = docs.select(*[F.col(f"`{c}`") for c in carry], *([] if shown == "text" else [F.col("text").alias(shown)]))
    fields = given.select(*[f"`{c}`" for c in carry]).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("accepted", "boolean")):
        fields = fields.add(name, kind)
    return given.mapInArrow(run, fields)


def held_out():
    """True where crc32 of the doc_id's digits leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> tuple[dict[str, list[str]], float]:
    """The words of each language and the margin for rejection, from the documents that aren't held out; a null doc_id takes no part in the fit."""
    sample = cut(training_sample(docs.where(F.col("doc_id").isNotNull() & ~held_out()), SAMPLE_TEXTS + MARGIN_TEXTS))
    words = training_words(sample.where(F.col("place") <= SAMPLE_TEXTS))
    found = identify(sample.where(F.col("place") > SAMPLE_TEXTS), words, ["lang"], min_margin=0.0)
    margin = least_margin([(r.score, r.lang == r.lang_pred) for r in found.where(F.col("lang_pred") != UNKNOWN).select("score", "lang", "lang_pred").collect()])
    let_go(sample)
    return words, margin


def least_margin(told: list[tuple[float, bool]], share: float = WRONG_SHARE, few: int = WRONG_TEXTS, least: float = MIN_MARGIN, most: float = MOST_MARGIN) -> float:
    """The largest margin below which at least ``share`` of ``told(margin, right)``, and of ``few`` of them at least, are wrong, between ``least`` and ``most``."""
    margin, wrong = least, 0
    for n, (m, right) in enumerate(sorted(told), 1):
        wrong += not right
        if m > most:
            break
        if n >= few and wrong >= share * n:
            margin = max(margin, math.nextafter(m, 2.0))
    return margin


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    words, margin = learn(docs)
    found = identify(docs, words, ["doc_id"], min_margin=margin)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language can't be told go; a missing ``lang`` isn't filled in."""
    named = plain_names(docs, "text")
    words, margin = learn(docs)
    found = identify(named, words, named.columns, min_margin=margin)
    return found.where("accepted").select(*named.columns).toDF(*docs.columns)
