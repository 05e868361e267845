"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch keeps the k smallest distinct hashes of a text's shingles of five words. Sketches of parts
merge into the sketch of the whole (the k smallest of their union), so a long text can be sketched
piece by piece. Two sketches estimate the resemblance of the texts' shingle sets, the containment of
one in the other and the number of distinct shingles. The number is exact below k shingles, the other two
if both texts have fewer than k. Otherwise containment rests on the hashes of the contained text up to the
lesser of the full sketches' last hashes, a sample that is small where that text is much the smaller one;
their count is returned with it, and without any the containment is unknown (null).

Hashes are computed for a whole batch at once: a word's hash is a difference of running sums of
weighted bytes, a shingle's hash mixes the hashes of its words.

Defined results: words are runs of anything but ASCII white space; a text of fewer than five words is
one shingle; a null, empty or blank text has an empty sketch, and two empty sketches are alike (1.0),
an empty and another one aren't (0.0).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import pieces, table, texts, tidy

K = 128
SHINGLE = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Random weights of the 256 byte values; the seed fixes every sketch.
_BYTES = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes hashed at once.
BLOCK = 1 << 21


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Powers:
    """Powers of an odd number modulo 2**64 and their inverses, as far as they have been needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK)
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.full(size - 1, odd)]).cumprod(dtype=np.uint64) for odd in (_ODD, _INVERSE))
        return self.up, self.down


_powers = _Powers()


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word of ``data``, in order; equal words have equal hashes wherever they stand."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    space = _SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers.upto(len(raw))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw] * up[: len(raw)], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    if not len(words):
        return words
    size = min(size, len(words))
    total = len(words) - size + 1
    h = np.zeros(total, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + _mix(words[k : k + total] + np.uint64(k + 1))
    return _mix(h)


def smallest(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, sorted."""
    if len(hashes) > 8 * k:
        limit = np.uint64(min((1 << 64) - 1, int((1 << 64) * (3.0 * k / len(hashes)))))
        few = np.unique(hashes[hashes <= limit])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def sketch(text: str | None, k: int = K, size: int = SHINGLE, block: int = BLOCK) -> np.ndarray:
    """Bottom-k sketch of a whole text; a long one is hashed in blocks that overlap by ``size`` - 1 words and merged."""
    data = (text or "").encode()
    if len(data) <= block:
        return smallest(shingle_hashes(word_hashes(data), size), k)
    out, held = np.empty(0, np.uint64), np.empty(0, np.uint64)
    start, any_full = 0, False
    while start < len(data):
        end = min(len(data), start + block)
        while end < len(data) and not _SPACE[data[end]]:  # to the end of a word
            end += 1
        words = np.concatenate([held, word_hashes(data[start:end])])
        if len(words) >= size:
            any_full = True
            out = merge(out, smallest(shingle_hashes(words, size), k), k)
        held = words[-(size - 1) :] if size > 1 else words[:0]
        start = end
    return out if any_full else smallest(shingle_hashes(held, size), k)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of common shingles among all, from the k smallest hashes of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, common, assume_unique=True).sum()) / len(union)


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles; exact below k."""
    if len(a) < k:
        return float(len(a))
    return (k - 1) / ((int(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> tuple[float | None, int]:
    """Share of a's shingles that b has too, and the number of a's hashes that it was seen on.

    Up to the lesser of the full sketches' last hashes both sketches hold every hash of their texts, so a's
    hashes up to there are a fair sample of a's shingles; the standard error is at most half the root of their
    number's inverse. All of them count, and the share is exact, if no sketch is full. None without a hash.
    """
    if not len(a):
        return 1.0, 0
    ends = [int(x[k - 1]) for x in (a, b) if len(x) >= k]
    seen = a[: np.searchsorted(a, np.uint64(min(ends)), side="right")] if ends else a
    return (float(np.isin(seen, b, assume_unique=True).mean()) if len(seen) else None), len(seen)


def encoded(a: np.ndarray) -> str:
    """A sketch as text: unpadded base64 of its hashes, little-endian."""
    return base64.b64encode(a.astype("<u8").tobytes()).decode().rstrip("=")


def decoded(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text + "=" * (-len(text) % 4)), "<u8").astype(np.uint64)


def merge_sketches(parts: DataFrame, key: str, k: int = K, fan_in: int = 64) -> DataFrame:
    """One ``fingerprint`` for each ``key`` from its parts' fingerprints.

    A sketch is the k smallest of the parts' hashes, so the merge is a ranked distinct: parts are cut
    down inside (key, salt) first, and no task gets more than a salt's share of a hot key.
    """
    kind = parts.schema[key].dataType

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = [], []
            for name, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = decoded(one)
                names += [name] * len(values)
                found.append(values)
            flat = np.concatenate(found) if found else np.empty(0, np.uint64)
            # unsigned order as signed numbers
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.column(0).type), pa.array((flat ^ np.uint64(1 << 63)).view(np.int64))], names=["key", "h"])

    def least(rows: DataFrame, *by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
        return rows.withColumn("place", place).where(F.col("place") <= k).drop("place")

    flat = parts.select(key, "fingerprint").where(F.col("fingerprint").isNotNull()).mapInArrow(hashes, T.StructType().add("key", kind).add("h", "long")).distinct()
    few = least(least(flat.withColumn("salt", F.pmod("h", F.lit(fan_in))), "key", "salt"), "key")

    def join(held: list[int]) -> str:
        return encoded(np.sort(np.array(held, np.int64)).view(np.uint64) ^ np.uint64(1 << 63))

    gathered = few.groupBy("key").agg(F.collect_list("h").alias("held"))
    return gathered.select(F.col("key").alias(key), F.udf(join, "string", useArrow=True)("held").alias("fingerprint"))


def fingerprint_documents(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, n_distinct (estimate) of each row's whole text; narrow, no shuffle."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [sketch(t, k, size) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([encoded(a) for a in found], pa.string()), pa.array([distinct_shingles(a, k) for a in found], pa.float64())],
                names=["doc_id", "fingerprint", "n_distinct"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("fingerprint", "string").add("n_distinct", "double"))


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by as many (or all) first ones of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Rows of one range of doc_ids, about; and the most ranges, which bounds the table of their borders.
RANGE_ROWS, RANGES = 1000, 1 << 18


def _order():
    """doc_id; below all ids, rows without one by their text's hash."""
    spread = F.lit(-(1 << 62)) - F.shiftrightunsigned(F.xxhash64("text"), 2)
    return F.coalesce(F.col("doc_id").cast("long"), spread)


def in_ranges(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` by ranges of falling doc_id: range, extra, id, doc_id, text.

    Every range also gets, marked ``extra``, the row that follows its last one: the first row of the
    next range, for the last range the very first row. Spark's range partitioner samples the ids, so
    ranges are even however the ids are spread; their borders (at most ``RANGES``) are broadcast. Only
    ids and, once, the texts are shuffled.
    """
    spark = docs.sparkSession
    given = docs.select("doc_id", "text", _order().alias("id"))
    wanted = min(RANGES, max(1, -(-docs.count() // RANGE_ROWS)))
    parts = given.select("id").repartitionByRange(wanted, F.desc("id")).groupBy(F.spark_partition_id().alias("part"))
    borders = sorted((r.low, r.top) for r in parts.agg(F.min("id").alias("low"), F.max("id").alias("top")).collect())
    shared = spark.sparkContext.broadcast((np.array([b[0] for b in borders], np.int64), np.array([b[1] for b in borders], np.int64)))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def homes(ids: pd.Series) -> pd.Series:
        """An id's range, counted from the largest ids; the first id of a range also has the range before it."""
        lows, tops = shared.value
        held = ids.to_numpy(np.int64)
        place = np.searchsorted(lows, held, side="right") - 1
        number = (len(lows) - 1 - place).tolist()
        return pd.Series([[n, (n - 1) % len(lows)] if first else [n] for n, first in zip(number, (held == tops[place]).tolist())])

    dealt = given.withColumn("homes", homes("id")).select(F.posexplode("homes").alias("copy", "range"), "id", "doc_id", "text")
    placed = dealt.select("range", (F.col("copy") > 0).alias("extra"), "id", "doc_id", "text")
    return placed.repartition("range").sortWithinPartitions("range", "extra", F.desc("id"), F.xxhash64("text"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its edited text and the document with the next smaller doc_id.

    Rows of equal doc_id follow each other by their texts' hash.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_distinct", "containment_next", "containment_hashes"]
    kinds = ["long", "long", "string", "string", "string", "double", "double", "double", "double", "long"]

    def compared(one: tuple, following: tuple) -> tuple:
        doc_id, text, a = one
        _, after, b = following
        new = edited(text, after)
        c = sketch(new)
        return (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), encoded(a), encoded(c), resemblance(a, c), resemblance(a, b), distinct_shingles(a), *containment(a, b))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, at = None, None
        for batch in pieces(batches, "text"):
            found = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("range", "extra", "doc_id", "text")]
            for number, extra, doc_id, text in zip(*columns):
                if extra and at != number:  # a second row with the next range's first id
                    continue
                text = text or ""
                row = (doc_id, text, sketch(text))
                if kept is not None and at == number:
                    found.append(compared(kept, row))
                kept, at = (None, None) if extra else (row, number)
            arrays = [pa.array([f[k] for f in found], pa.int64() if kind == "long" else pa.string() if kind == "string" else pa.float64()) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return in_ranges(docs).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
