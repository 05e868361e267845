"""Ranked lexical search by MaxScore.

Documents are read once: each becomes its number of terms and the counts of the items' terms in it, which is what all
statistics and all scores are made of. A shard is a run of such rows in a task, with as many postings as ``SHARD_POSTINGS``;
its lists are built, searched and thrown away, so nothing is shuffled but each task's best.

In a shard each term has an upper bound of what it adds to a score. An item's terms are put in order of their bounds;
the longest run of lesser terms whose bounds add up to less than the item's k-th best score so far is non-essential: a
document that has none of the other, essential terms can't get into the ranking. Documents of the essential lists are
scored, and the non-essential lists are probed from the largest bound down, only for documents that may still qualify.

Items are searched in blocks of ``BLOCK_BYTES`` of text, whose terms are broadcast; each block reads the documents.

Defined results: a null text has no terms and isn't counted; each repeated row is a document of its own; a null doc_id
comes last among equal scores. Item rows that repeat an item_id count once, with the smallest text; an item without terms gets no
rows, as does every item of an empty table. Other columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import cut, let_go, pieces, table, tidy, utf8

#: Terms are runs of ASCII letters and digits and of everything beyond ASCII; only A-Z become lower-case.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TOP = 10
SHARD_POSTINGS = 1 << 18
BLOCK_BYTES = 4 << 20


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Posting lists of some documents: for each term the documents in rising order and what the term adds to their scores."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, adds: np.ndarray):
        order = np.argsort(terms, kind="stable")
        self.docs, self.adds = docs[order], adds[order]
        found, starts = np.unique(terms[order], return_index=True)
        ends = np.append(starts[1:], len(terms))
        self.lists = {t: (a, b, int(self.adds[a:b].max())) for t, a, b in zip(found.tolist(), starts.tolist(), ends.tolist())}

    def search(self, item: dict[int, int], floor: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that score ``floor`` or more, and above 0, for an item of terms and their repeats.

        ``held`` is room for a score of each document, all 0; it is given back so.
        """
        lists = sorted(((self.lists[t][2] * n, n, *self.lists[t][:2]) for t, n in item.items() if t in self.lists))
        bounds = np.cumsum([0, *(one[0] for one in lists)]).tolist()
        if not lists or bounds[-1] < floor:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        split = next(k for k in range(len(lists), -1, -1) if bounds[k] < floor) if floor > 0 else 0
        essential = lists[split:]
        for _, n, a, b in essential:
            held[self.docs[a:b]] += n * self.adds[a:b]
        touched = np.unique(np.concatenate([self.docs[a:b] for _, _, a, b in essential]))
        scores = held[touched]
        held[touched] = 0
        for k in range(split - 1, -1, -1):
            alive = scores + bounds[k + 1] >= floor
            touched, scores = touched[alive], scores[alive]
            if not len(touched):
                break
            _, n, a, b = lists[k]
            own = self.docs[a:b]
            at = np.minimum(np.searchsorted(own, touched), len(own) - 1)
            scores = scores + np.where(own[at] == touched, n * self.adds[a:b][at], 0)
        good = (scores >= floor) & (scores > 0)
        return touched[good], scores[good]


class Best:
    """The ``top`` best of each item so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]

    def floor(self, item: int) -> int:
        """What a document must score at least to get into the ranking."""
        rows = self.rows[item]
        return -rows[-1][0] if len(rows) == self.top else 0

    def add(self, item: int, scores: np.ndarray, ids: list[int | None]) -> None:
        if len(scores) > self.top:
            kept = np.flatnonzero(scores >= np.partition(scores, -self.top)[-self.top])
            scores, ids = scores[kept], [ids[k] for k in kept.tolist()]
        rows = self.rows[item] + [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids)]
        self.rows[item] = sorted(rows)[: self.top]


def counted(docs: DataFrame, numbers) -> DataFrame:
    """``doc_id, n, terms, counts``: of each document with a term its number of terms, and which of ``numbers`` it has how often."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = numbers.value
        for batch in pieces(batches, "text"):
            ids, n, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch, "text")):
                if found := terms_of(text):
                    has = Counter(filter(wanted.__contains__, found))
                    ids.append(doc_id)
                    n.append(len(found))
                    terms.append([wanted[t] for t in has])
                    counts.append(list(has.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def best_of_tasks(index: DataFrame, items, weights, n_docs: int, n_terms: int, top: int, shard_postings: int) -> DataFrame:
    """``item, doc_id, score``: the ``top`` of each item from each task's rows of ``counted``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, worth = items.value, weights.value
        best = Best(len(asked), top)
        held: list[pa.RecordBatch] = []

        def search() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, n = rows.column("doc_id").to_pylist(), rows.column("n").to_pylist()
            norms = np.array([8 * (25 + (75 * x * n_docs) // n_terms) for x in n], np.int64)
            terms, counts = (rows.column(c).combine_chunks() for c in ("terms", "counts"))
            of = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))
            numbers, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy()
            shard = Shard(numbers, of, worth[numbers] * ((1_000_000_000 * tf) // (1000 * tf + norms[of])))
            room = np.zeros(len(ids), np.int64)
            for k, item in enumerate(asked):
                found, scores = shard.search(item, best.floor(k), room)
                if len(found):
                    best.add(k, scores, [ids[d] for d in found.tolist()])

        size = 0
        for batch in batches:
            start = 0
            offsets = batch.column(2).offsets.to_numpy()
            while start < batch.num_rows:  # as many rows as fill a shard
                end = int(np.searchsorted(offsets, offsets[start] + shard_postings - size, side="left"))
                end = min(max(end, start + 1), batch.num_rows)
                held.append(batch.slice(start, end - start))
                size += int(offsets[end] - offsets[start])
                start = end
                if size >= shard_postings:
                    search()
                    held, size = [], 0
        if held:
            search()
        rows = [(k, None if null else i, -s) for k, found in enumerate(best.rows) for s, null, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """Items and their terms, some at a time; one row for each item_id."""
    given = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).groupBy("item_id").agg(F.min("text").alias("text"))
    held, size = [], 0
    for row in given.orderBy("item_id").toLocalIterator():
        held.append((row.item_id, Counter(terms_of(row.text.encode()))))
        size += len(row.text)
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, top: int = TOP, shard_postings: int = SHARD_POSTINGS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each of ``items(item_id, text)``; see the module's text."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    found = None
    for block in blocks(items, block_bytes):
        vocabulary = {t: k for k, t in enumerate(sorted(set().union(*(asked for _, asked in block))))}
        index = cut(counted(docs.select("doc_id", "text"), share(vocabulary)))
        n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        worth = np.zeros(len(vocabulary), np.int64)
        for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            worth[row.term] = weight(n_docs, row["count"])
        asked = [{vocabulary[t]: n for t, n in terms.items()} for _, terms in block]
        best = best_of_tasks(index, share(asked), share(worth), n_docs, n_terms, top, shard_postings)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, item_id) for k, (item_id, _) in enumerate(block)], "item int, item_id long")
        one = cut(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        let_go(index)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_UPPER, _LOWER)

LEXICAL_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
e AS (SELECT row_number() OVER () AS no, doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*)::HUGEINT AS n_docs, sum(n)::HUGEINT AS n_terms FROM e),
i AS (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id),
q AS (SELECT item_id, t, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM i) GROUP BY ALL),
p AS (SELECT no, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT no, doc_id, n, unnest(w) AS t FROM e) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY t, n_docs),
s AS (SELECT item_id, no, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM q JOIN p USING (t) JOIN w USING (t), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {TOP}
"""
