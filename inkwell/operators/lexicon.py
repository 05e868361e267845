"""Style gate with a lexicon of any size: one index of all words, one pass over a text.

``style.line_violations`` tests a line once for each word, which suits a handful of words. Here the words of a lexicon
table go into an index by rolling hash (``Index``), some 30 bytes a word, so that the time for a text grows with the lengths
that words have and not with their number. Its size is counted first: words are dealt into parts of ``PART_CHARS`` characters, of which each is
broadcast and reads the texts by itself.

Rows: fatal words in any line, high words in lines outside dialogue, medium words that occur more often in a text than they may
(line null). A word that is fatal isn't high as well; a word is listed once for each line.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell import params

PART_CHARS = 64 << 20
#: Characters of texts that are looked up together, or those of one text.
TOGETHER_CHARS = 1 << 18
SEVERITIES = ("fatal", "high", "medium")
#: What a violation is besides its document's key.
FIELDS = (("line", T.IntegerType(), pa.int32()), ("word", T.StringType(), pa.string()), ("severity", T.StringType(), pa.string()), ("context", T.StringType(), pa.string()), ("n", T.LongType(), pa.int64()), ("allowed", T.IntegerType(), pa.int32()))


def words_of(lexicon: DataFrame, default_allowed: int = params.DEFAULT_ALLOWED) -> DataFrame:
    """word, fatal, high, allowed (null unless medium) of ``lexicon(word, severity, allowed)``; one row for each word."""
    of = {s: F.bool_or(F.col("severity") == s) for s in SEVERITIES}
    limit = F.min(F.when(F.col("severity") == "medium", F.coalesce("allowed", F.lit(default_allowed))))
    known = lexicon.where(F.length("word") > 0).groupBy("word").agg(of["fatal"].alias("fatal"), of["high"].alias("high"), limit.cast("int").alias("allowed"))
    return known.select("word", F.coalesce("fatal", F.lit(False)).alias("fatal"), (F.coalesce("high", F.lit(False)) & ~F.coalesce("fatal", F.lit(False))).alias("high"), "allowed").where("fatal OR high OR allowed IS NOT NULL")


def narrative_lines(lines: Sequence[str], opening: Sequence[str], closing: Sequence[str]) -> list[bool]:
    """Which of the stripped ``lines`` lie outside dialogue.

    A line that starts with an opening mark starts dialogue and is dialogue; the next one that ends with a closing mark ends it.
    """
    found, inside = [], False
    for line in lines:
        if line.startswith(tuple(opening)):
            inside = True
            found.append(False)
        else:
            found.append(not inside)
            if inside and line.endswith(tuple(closing)):
                inside = False
    return found


#: Of the hash of a run of characters c: the sum of c * BASE ** place, modulo 2 ** 64; BACK undoes BASE.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
_MIX, _BY_LENGTH = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)])


class Index:
    """Which of ``words`` begin where in a text.

    Words lie in order of the hash of their characters and length. A text's runs of each length that words have are looked up by
    theirs: first in a table of bits, then by halving; what is found is compared itself. A place is left once its characters
    begin no word.
    """

    def __init__(self, words: pa.Array):
        self.words, self.up, self.back = words, _powers(BASE, 1 << 12), _powers(BACK, 1 << 12)
        codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes
        self.lengths = np.unique(sizes).tolist()
        self.least = self.lengths[0] if self.lengths else 0
        self.shift = np.uint64(64 - max(10, (16 * len(sizes)).bit_length()))
        hashes, fronts = np.zeros(len(sizes), np.uint64), np.zeros(1 << (64 - int(self.shift)), bool)
        for place in range(self.lengths[-1] if self.lengths else 0):
            longer = np.flatnonzero(sizes > place)
            hashes[longer] += codes[starts[longer] + place] * self._power(self.up, place)
            if place + 1 >= self.least:
                fronts[self._mixed(hashes[longer], place + 1) >> self.shift] = True
        hashes = self._mixed(hashes, sizes.astype(np.uint64))
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        wholes = np.zeros(len(fronts), bool)
        wholes[hashes >> self.shift] = True
        self.fronts, self.wholes = np.packbits(fronts, bitorder="little"), np.packbits(wholes, bitorder="little")

    @staticmethod
    def _power(powers: np.ndarray, place: int) -> np.uint64:
        return powers[place] if place < len(powers) else np.uint64(pow(int(powers[1]), place, 1 << 64))

    @staticmethod
    def _mixed(hashes: np.ndarray, length) -> np.ndarray:
        mixed = (hashes + np.asarray(length, np.uint64).reshape(-1) * _BY_LENGTH) * _MIX
        return (mixed ^ (mixed >> np.uint64(32))) * _MIX

    def _may(self, table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return np.flatnonzero((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)

    def iter(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(place, word's number, length) of every word in ``text``; the places of one word rise."""
        n = len(text)
        if not self.lengths or n < self.least:
            return
        if len(self.up) <= n:
            self.up, self.back = _powers(BASE, 2 * n), _powers(BACK, 2 * n)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.up[:n], dtype=np.uint64)])
        at = np.arange(n - self.least + 1)
        for length in range(self.least, self.lengths[-1] + 1):
            at = at[: np.searchsorted(at, n - length, "right")]
            hashes = self._mixed((sums[at + length] - sums[at]) * self.back[at], length)
            begun = self._may(self.fronts, hashes)
            if not len(begun):
                return
            at, hashes = at[begun], hashes[begun]
            some = self._may(self.wholes, hashes)
            first = np.searchsorted(self.hashes, hashes[some])
            known = first < len(self.hashes)
            some, first = some[known], first[known]
            same = self.hashes[first] == hashes[some]
            some, first = some[same], first[same]
            told = self.order[first]
            for place, k, word, name in zip(at[some].tolist(), first.tolist(), told.tolist(), self.words.take(pa.array(told)).to_pylist()):
                run = text[place : place + length]
                while name != run and k + 1 < len(self.hashes) and self.hashes[k + 1] == self.hashes[k]:
                    k += 1
                    word = int(self.order[k])
                    name = self.words[word].as_py()
                if name == run:
                    yield place, word, length


class Gate:
    """The index of rows (word, fatal, high, allowed)."""

    def __init__(self, words: pa.Table | Sequence[tuple], opening: Sequence[str], closing: Sequence[str]):
        self.opening, self.closing = opening, closing
        if not isinstance(words, pa.Table):
            words = pa.table([pa.array([w[k] for w in words], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.bool_(), pa.int32()))], ["word", "fatal", "high", "allowed"])
        self.found = Index(pa.concat_arrays(words.column(0).chunks).cast(pa.large_string()) if words.num_rows else pa.array([], pa.large_string()))
        self.fatal, self.high = (words.column(k).to_pylist() for k in (1, 2))
        self.allowed = words.column(3).fill_null(-1).to_pylist()

    def violations(self, text: str) -> list[tuple]:
        return self.every([text])[0]

    def every(self, texts: Sequence[str]) -> list[list[tuple]]:
        """(line, word, severity, context, n, allowed) of each text, lines in order and then the text's counts; the texts are looked up as one."""
        begins = [0]
        for text in texts[:-1]:
            begins.append(begins[-1] + len(text) + 1)
        hits: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for place, k, length in self.found.iter("\n".join(texts)):
            at = bisect_right(begins, place) - 1
            if place + length <= begins[at] + len(texts[at]):
                hits[at].append((place - begins[at], k, length))
        return [self._violations(*pair) for pair in zip(texts, hits)]

    def _violations(self, text: str, hits: Sequence[tuple[int, int, int]]) -> list[tuple]:
        names: dict[int, str] = {}
        bounds: dict[int, tuple[int, int]] = {}  # where what is left of a line lies
        lines = text.split("\n")
        starts = [0]
        for line in lines[:-1]:
            starts.append(starts[-1] + len(line) + 1)
        seen: set[tuple[int, int]] = set()  # (line, word) anywhere in the line
        inner: set[tuple[int, int]] = set()  # (line, word) within what is left when the line is stripped
        counts: dict[int, int] = {}
        ends: dict[int, int] = {}
        for start, k, length in hits:
            end = start + length - 1
            names[k] = text[start : end + 1]
            fatal, high = self.fatal[k], self.high[k]
            if self.allowed[k] >= 0 and start > ends.get(k, -1):
                counts[k] = counts.get(k, 0) + 1
                ends[k] = end
            if fatal or high:
                at = bisect_right(starts, start) - 1
                if end < starts[at] + len(lines[at]):
                    seen.add((at, k))
                    if high:
                        if at not in bounds:
                            own = lines[at]
                            bounds[at] = starts[at] + len(own) - len(own.lstrip()), starts[at] + len(own.rstrip())
                        if start >= bounds[at][0] and end < bounds[at][1]:
                            inner.add((at, k))
        stripped = [line.strip() for line in lines] if seen else []
        outside = narrative_lines(stripped, self.opening, self.closing) if inner else []
        out = [(at + 1, names[k], "fatal", stripped[at][:80], None, None) for at, k in seen if self.fatal[k]]
        out += [(at + 1, names[k], "high", stripped[at][:80], None, None) for at, k in inner if outside[at]]
        out.sort()
        return out + [(None, names[k], "medium", None, n, int(self.allowed[k])) for k, n in sorted(counts.items()) if n > self.allowed[k]]


_built: tuple[pa.Table, Gate] | None = None


def _gate(words: pa.Table, opening: Sequence[str], closing: Sequence[str]) -> Gate:
    """A worker keeps the index of the broadcast words that it has used last."""
    global _built
    if _built is None or _built[0] is not words or (_built[1].opening, _built[1].closing) != (opening, closing):
        _built = (words, Gate(words, opening, closing))
    return _built[1]


def lexicon_violations(docs: DataFrame, key: str, lexicon: DataFrame, opening=params.OPENING_QUOTES, closing=params.CLOSING_QUOTES, text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """key, line, word, severity, context, n, allowed of ``docs`` against ``lexicon(word, severity, allowed)``.

    A null text has no violations. Texts aren't shuffled: a document's lines, its dialogue and its words are told in one pass.
    """
    spark = docs.sparkSession
    words = words_of(lexicon).persist()
    given = docs.select(F.col(key), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    schema = given.select(key).schema
    for name, kind, _ in FIELDS:
        schema = schema.add(name, kind)
    chars = words.agg(F.sum(F.length("word"))).first()[0] or 0
    parts = max(1, -(-chars // part_chars))
    marks = tuple(opening), tuple(closing)

    def scan(part: int) -> DataFrame:
        own = words.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == part).orderBy("word").toArrow()
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gate = _gate(shared.value, *marks)
            for batch in batches:
                texts, first = batch.column(1).to_pylist(), 0
                ends, chars = [], 0
                for k, value in enumerate(texts):
                    chars += len(value)
                    if chars >= TOGETHER_CHARS or k == len(texts) - 1:
                        ends.append(k + 1)
                        chars = 0
                for end in ends:
                    rows, found = [], []
                    for k, mine in enumerate(gate.every(texts[first:end]), first):
                        rows += [k] * len(mine)
                        found += mine
                    first = end
                    columns = [pa.array(c, kind) for c, (_, _, kind) in zip(list(zip(*found)) or [()] * len(FIELDS), FIELDS)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=[key, *(f[0] for f in FIELDS)])

        return given.mapInArrow(run, schema)

    every = scan(0)
    for part in range(1, parts):
        every = every.unionByName(scan(part))
    words.unpersist()
    return every
