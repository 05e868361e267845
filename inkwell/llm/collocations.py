"""Collocations: phrases whose words stand together more often than their parts would by chance.

The corpus is read four times, always whole texts and in slices of bounded size:

1. words are counted in a sketch of hashed cells (a count-min sketch of one row), and exactly in total;
2. so are phrases of 2 to 5 words whose words may all be frequent. A cell's sum is never below the count of
   a phrase in it, so that a phrase whose cell stays below ``min_count`` is no candidate;
3. the distinct phrases that pass, and whose inner phrases pass, are the candidates;
4. candidates are compiled into Aho-Corasick automata whose keys carry a space at both ends, so that words match
   whole. Each shard of the corpus is scanned, overlapping matches are counted and the shards' counts summed.

Thresholds and scores use the exact counts alone. Cells are dealt to tasks by ranges and grow with the corpus up to
``MOST_CELLS`` (a bit of each is broadcast); beyond that the bounds get looser and candidates more, but no phrase is
lost. Candidates are dealt by a hash of their first two words into automata of about ``GROUP_CHARS`` characters, so that those that begin
alike share their nodes; each automaton scans the corpus by itself.

Defined results: a null text is empty, a null language is ``und`` (and counts with documents of that name); repeated
rows count as often as they are there. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import cut, let_go, pieces, table, texts, tidy, utf8

#: A-Z become a-z, the characters that end a piece a line feed, tabs spaces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
BREAK = b"\n"
MIN_COUNT, LONGEST, TOP = 100, 5, 2000
WORD_CELLS, MOST_CELLS, WORDS_A_CELL = 1 << 24, 1 << 29, 8
RANGES = 1024
#: Bytes of text of one language that are handled at once; words whose hashes a worker remembers, and how long they may be.
SLICE_BYTES, REMEMBERED, KEPT_BYTES = 4 << 20, 1 << 20, 64
GROUP_CHARS = 16 << 20
BUCKETS, KEYS_A_ROW = 256, 4096
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Codes(dict):
    """64-bit hashes of a language's words; 0 stands for nothing between two spaces, 1 for the end of a piece."""

    def __init__(self, lang: str):
        super().__init__({b"": 0, BREAK: 1})
        self.seed = xxhash.xxh64_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        code = max(2, xxhash.xxh64_intdigest(word, self.seed))
        if len(word) <= KEPT_BYTES:
            self[word] = code
        return code


class Reader:
    """Slices of record batches of (lang, text) as words, with the words' hashes remembered between slices."""

    def __init__(self) -> None:
        self.codes: dict[str, Codes] = {}

    @staticmethod
    def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = SLICE_BYTES) -> Iterator[tuple[str, bytes]]:
        """(language, folded text of some of its documents), about ``most_bytes`` at a time; a longer one is cut between pieces."""
        held: dict[str, list[bytes]] = {}
        size = 0

        def folded() -> Iterator[tuple[str, bytes]]:
            for lang, found in held.items():
                text = BREAK.join(found).translate(FOLD)
                start = 0
                while len(text) - start > 2 * most_bytes and (end := text.find(BREAK, start + most_bytes)) >= 0:
                    yield lang, text[start:end]
                    start = end + 1
                yield lang, text[start:]

        for batch in pieces(batches, "text"):
            for lang, text in zip(texts(batch, "lang"), utf8(batch, "text")):
                if text:
                    held.setdefault(lang, []).append(text)
                    size += len(text)
            if size >= most_bytes:
                yield from folded()
                held, size = {}, 0
        yield from folded()

    def words(self, lang: str, text: bytes) -> tuple[list[bytes], np.ndarray]:
        """The words of a slice and the ends of pieces between them, each with its hash."""
        found = text.replace(BREAK, b" \n ").split(b" ")
        codes = self.codes.get(lang)
        if codes is None or len(codes) > REMEMBERED:
            if sum(map(len, self.codes.values())) > REMEMBERED:
                self.codes = {}
            codes = self.codes[lang] = Codes(lang)
        hashes = np.fromiter(map(codes.__getitem__, found), np.uint64, len(found))
        there = hashes != 0
        return [w for w in found if w], hashes[there]


def mixed(hashes: np.ndarray) -> np.ndarray:
    """The bits of a hash spread over all of it."""
    hashes = hashes ^ (hashes >> np.uint64(31))
    hashes *= GOLDEN
    return hashes ^ (hashes >> np.uint64(29))


def phrases(hashes: np.ndarray, known: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length from 2 on: (length, the phrase's hash at each place, whether all its words are ``known``)."""
    found, whole = hashes, known
    for n in range(2, longest + 1):
        found = mixed(found[:-1] * GOLDEN + hashes[n - 1 :]) if len(found) > 1 else found[:0]
        whole = whole[:-1] & known[n - 1 :] if len(whole) > 1 else whole[:0]
        yield n, found, whole


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the cell of each hash has its bit set; there are 8 times as many cells as bytes, a power of two."""
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


CELL_FIELDS = "range int, at binary, n binary, lang string, words long"


def cell_rows(hashes: np.ndarray, cells: int, min_count: int) -> Iterator[tuple]:
    """A slice's counts by range of cells. Counts above ``min_count`` are kept as that: the cell has enough by then."""
    at, n = np.unique(hashes & np.uint64(cells - 1), return_counts=True)
    width = cells // RANGES
    borders = np.searchsorted(at, np.arange(RANGES + 1, dtype=np.uint64) * np.uint64(width))
    offsets = (at % np.uint64(width)).astype(np.uint16 if width <= 1 << 16 else np.uint32)
    n = np.minimum(n, min_count).astype(np.uint8 if min_count < 256 else np.uint32)
    for k in range(RANGES):
        low, top = borders[k], borders[k + 1]
        if top > low:
            yield k, offsets[low:top].tobytes(), n[low:top].tobytes(), None, None


def cell_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"range": pa.int32(), "at": pa.binary(), "n": pa.binary(), "lang": pa.string(), "words": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def frequent_cells(rows: DataFrame, cells: int, min_count: int) -> tuple[np.ndarray, dict[str, int]]:
    """(a bit for each cell that reaches ``min_count``, words of each language) from ``CELL_FIELDS`` rows.

    A task sums ranges of ``cells / RANGES`` cells; the driver gets a bit of each cell and a number per language.
    """
    width = cells // RANGES
    kinds = (np.uint16 if width <= 1 << 16 else np.uint32, np.uint8 if min_count < 256 else np.uint32)

    @tidy
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, words = None, None, Counter()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(sums >= min_count, bitorder="little").tobytes()], pa.binary()), pa.array([None], pa.string()), pa.array([None], pa.int64())], names=["range", "bits", "lang", "words"])

        for batch in batches:
            for number, where, counts, lang, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if lang is not None:
                    words[lang] += n
                    continue
                if number != at:
                    if at is not None:
                        yield done()
                    at, sums = number, np.zeros(width, np.uint64)
                sums[np.frombuffer(where, kinds[0])] += np.frombuffer(counts, kinds[1])
        if at is not None:
            yield done()
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(words), pa.int32()), pa.array([None] * len(words), pa.binary()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["range", "bits", "lang", "words"])

    dealt = rows.repartition(F.col("range")).sortWithinPartitions("range")
    found = dealt.mapInArrow(summed, "range int, bits binary, lang string, words long").collect()
    bits, words = np.zeros(cells // 8, np.uint8), Counter()
    for r in found:
        if r.bits is not None:
            bits[r.range * width // 8 : (r.range + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
        else:
            words[r.lang] += r.words
    return bits, dict(words)


def word_bounds(docs: DataFrame, min_count: int, cells: int) -> tuple[np.ndarray, dict[str, int]]:
    """The sketch of words of ``docs(lang, text)`` and the number of words of each language."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, words = Reader(), Counter()
        for lang, text in reader.slices(batches):
            hashes = reader.words(lang, text)[1]
            hashes = hashes[hashes != 1]
            words[lang] += len(hashes)
            if rows := list(cell_rows(hashes, cells, min_count)):
                yield cell_batch(rows)
        if words:
            yield cell_batch([(-1 - xxhash.xxh32_intdigest(lang.encode()) % 8, None, None, lang, n) for lang, n in words.items()])

    return frequent_cells(docs.mapInArrow(run, CELL_FIELDS), cells, min_count)


def phrase_bounds(docs: DataFrame, shared_words, min_count: int, cells: int, longest: int) -> np.ndarray:
    """The sketch of phrases of 2 to ``longest`` words that the sketch of words lets pass."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for lang, text in reader.slices(batches):
            hashes = reader.words(lang, text)[1]
            known = has(shared_words.value, hashes) & (hashes != 1)
            found = [h[whole] for _, h, whole in phrases(hashes, known, longest)]
            if rows := list(cell_rows(np.concatenate(found), cells, min_count)):
                yield cell_batch(rows)

    return frequent_cells(docs.mapInArrow(run, CELL_FIELDS), cells, min_count)[0]


def candidate_phrases(docs: DataFrame, shared_words, shared_phrases, longest: int) -> DataFrame:
    """``phrase``: in whatever language; those that both sketches let pass, as do the phrases inside them.

    A slice's phrases travel in one row for each bucket of their hash; a bucket's task leaves each once.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, told = Reader(), set()
        for lang, text in reader.slices(batches):
            words, hashes = reader.words(lang, text)
            known = has(shared_words.value, hashes) & (hashes != 1)
            passing, out = None, {}
            for n, found, whole in phrases(hashes, known, longest):
                passes = whole.copy() if passing is None else passing[:-1] & passing[1:]
                places = np.flatnonzero(passes)
                passes[places[~has(shared_phrases.value, found[places])]] = False
                passing = passes
                places = np.flatnonzero(passes)
                distinct, first = np.unique(found[places], return_index=True)
                for h, i in zip(distinct.tolist(), places[first].tolist()):
                    if h not in told:
                        told.add(h)
                        phrase = b" ".join(words[i : i + n])
                        out.setdefault(xxhash.xxh32_intdigest(phrase) % BUCKETS, []).append(phrase)
                if not len(places):
                    break
            if len(told) > 4 * REMEMBERED:
                told = set()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([BREAK.join(found) for found in out.values()], pa.binary())], names=["bucket", "phrases"])

    @tidy
    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, told = None, set()
        for batch in batches:
            for bucket, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != at and told:
                    yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in told], pa.string())], names=["phrase"])
                    told = set()
                at = bucket
                told.update(found.split(BREAK))
        yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in told], pa.string())], names=["phrase"])

    dealt = docs.mapInArrow(run, "bucket int, phrases binary").repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(once, "phrase string")


def automaton(keys: Iterable[str]) -> ahocorasick.Automaton:
    """Of phrases with a space at both ends; the value of a key is its place."""
    found = ahocorasick.Automaton()
    for k, key in enumerate(keys):
        found.add_word(f" {key} ", k)
    if len(found):
        found.make_automaton()
    return found


_built: tuple[list[str], ahocorasick.Automaton] | None = None


def shared_automaton(keys: list[str]) -> ahocorasick.Automaton:
    """The automaton of a broadcast list of keys. A worker keeps that of the list that it has used last."""
    global _built
    if _built is None or _built[0] is not keys:
        _built = (keys, automaton(keys))
    return _built[1]


def matches(docs: DataFrame, keys: list[str], min_count: int) -> DataFrame:
    """``lang, phrase, f``: overlapping occurrences of ``keys`` in each language of ``docs(lang, text)``, from ``min_count`` on.

    A task's counts travel in one row for each language and ``KEYS_A_ROW`` keys, and are summed by those.
    """
    shared = docs.sparkSession.sparkContext.broadcast(keys)
    kinds = {"lang": pa.string(), "part": pa.int32(), "at": pa.binary(), "n": pa.binary()}

    def batch(counts: dict[str, Counter]) -> pa.RecordBatch:
        rows = []
        for lang, found in counts.items():
            at, n = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
            order = np.argsort(at)
            at, n = at[order], n[order]
            part, starts = np.unique(at // KEYS_A_ROW, return_index=True)
            for k, a, b in zip(part.tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)]):
                rows.append((lang, k, (at[a:b] - k * KEYS_A_ROW).astype(np.uint16).tobytes(), n[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts = shared_automaton(shared.value), {}
        for lang, text in Reader.slices(batches):
            line = " ".join(filter(None, text.replace(BREAK, b" \n ").decode().split(" ")))
            counts.setdefault(lang, Counter()).update(map(itemgetter(1), found.iter(f" {line} ")))
            if sum(map(len, counts.values())) > 4 * REMEMBERED:
                yield batch(counts)
                counts = {}
        yield batch(counts)

    @tidy
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros(KEYS_A_ROW, np.int64)

        def told() -> pa.RecordBatch:
            places = np.flatnonzero(sums >= min_count)
            names = [shared.value[at[1] * KEYS_A_ROW + k] for k in places.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(sums[places], pa.int64())], names=["lang", "phrase", "f"])

        for batch in batches:
            for lang, part, where, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (lang, part) != at:
                    if at is not None:
                        yield told()
                    at, sums = (lang, part), np.zeros(KEYS_A_ROW, np.int64)
                sums[np.frombuffer(where, np.uint16)] += np.frombuffer(counts, np.int64)
        if at is not None:
            yield told()

    dealt = docs.mapInArrow(run, "lang string, part int, at binary, n binary").repartition("lang", "part").sortWithinPartitions("lang", "part")
    return dealt.mapInArrow(summed, "lang string, phrase string, f long")


def _group(groups: int) -> Column:
    """Which of ``groups`` automata a ``phrase`` belongs to: that of all phrases with its first two words."""
    return F.pmod(F.xxhash64(F.substring_index("phrase", " ", 2)), F.lit(groups))


def counted(docs: DataFrame, candidates: DataFrame, min_count: int, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``lang, phrase, f``: exact counts of at least ``min_count`` of the candidates and of their single words."""
    words = candidates.select(F.explode(F.split("phrase", " ")).alias("phrase"))
    keys = cut(candidates.unionByName(words).distinct())
    size = keys.agg(F.sum(F.length("phrase") + 2)).first()[0] or 0
    groups = max(1, -(-size // group_chars))
    every = docs.sparkSession.createDataFrame([], "lang string, phrase string, f long")
    for k in range(groups):
        own = keys.where(_group(groups) == k)
        if chosen := [r.phrase for r in own.collect()]:
            every = every.unionByName(matches(docs, sorted(chosen), min_count))
    kept = cut(every)
    let_go(keys)
    return kept


def scored(counts: DataFrame, totals: dict[str, int], top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases by their lowest-scoring cut, without those that lie in longer ones as often."""
    spark = counts.sparkSession
    sizes = spark.createDataFrame(list(totals.items()), "lang string, n long")
    phrase = counts.withColumn("w", F.split("phrase", " "))
    candidates = phrase.where(F.size("w") >= 2)
    longer = candidates.where(F.size("w") >= 3)
    inner = [F.array_join(F.slice("w", start, F.size("w") - 1), " ") for start in (1, 2)]
    inside = longer.select("lang", "f", F.explode(F.array(*inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    own = candidates.join(inside, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") < F.col("f")))
    cuts = own.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("rest"))
    parts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    parts = parts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    parts = parts.join(F.broadcast(sizes), "lang")
    score = F.expr("(1000 * cast(a as decimal(19,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = parts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("low"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    told = lowest.select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))
    ranked = told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, word_cells: int = WORD_CELLS, most_cells: int = MOST_CELLS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """The collocations of ``docs(lang, text)``, per language; see the module's text."""
    spark = docs.sparkSession
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    word_bits, totals = word_bounds(given, min_count, word_cells)
    cells = min(most_cells, max(1 << 16, 1 << (sum(totals.values()) // WORDS_A_CELL).bit_length()))
    shared_words = spark.sparkContext.broadcast(word_bits)
    shared_phrases = spark.sparkContext.broadcast(phrase_bounds(given, shared_words, min_count, cells, longest))
    counts = counted(given, candidate_phrases(given, shared_words, shared_phrases, longest), min_count, group_chars)
    found = cut(scored(counts, totals, top))
    let_go(counts)
    return found


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COLLOCATIONS_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w[i:i + k - 1] AS g, k FROM starts, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, g, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
inside AS (SELECT lang, g, max(f) AS around FROM (
    SELECT lang, g[1:k - 1] AS g, f FROM f WHERE k >= 3 UNION ALL SELECT lang, g[2:k] AS g, f FROM f WHERE k >= 3) GROUP BY ALL),
own AS (SELECT f.* FROM f LEFT JOIN inside USING (lang, g) WHERE k >= 2 AND (around IS NULL OR around < f)),
cuts AS (SELECT lang, g, f AS a, k, c, g[1:c] AS first, g[c + 1:k] AS rest FROM own, (SELECT unnest(range(1, {LONGEST})) AS c) WHERE c < k),
s AS (SELECT cuts.lang, cuts.g, a, x.f AS l, y.f AS r, n, c, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
    FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.g = first JOIN f AS y ON y.lang = cuts.lang AND y.g = rest JOIN n ON n.lang = cuts.lang),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
told AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM low)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM told QUALIFY rank <= {TOP}
"""
