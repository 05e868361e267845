"""SimHash near-duplicates: fingerprints linked within a Hamming radius by BK-trees.

Fingerprints of all documents never meet in one place. With radius 2, cutting 64 bits into four
blocks leaves at least two blocks equal in any linked pair, so each pair of blocks gives a shard key
and every link lies inside some shard. A shard with more than ``SHARD`` fingerprints is cut again by
the same argument over the bits that its key leaves free: four blocks of them, then again; at the
third level a shard differs in 8 bits only, so it has 256 members at most. Each shard's BK-tree is
built where the shard lies (a broadcast of all trees would grow with the corpus), and a shard gives
a spanning forest of its links, never all pairs. Components come from alternating star contraction.

Defined results: text that is null or has no word has fingerprint zero and is linked like any other;
repeated rows give repeated result rows; null doc_ids never name a component unless it has no other.

The pipeline's stage asks for more than these fingerprints tell: all pairs of documents whose sets of
five-word shingles have a Jaccard similarity of ``NEAR`` or more. At 0.8 a SimHash differs in 10 of 64 bits
on average, and blocks of bits that find pairs up to 15 bits apart hold 4 bits or less, which shard nothing.
So the stage links fingerprints of five-word shingles by the same BK-trees, adds the pairs that share one of ``BANDS``
bands of ``ROWS`` min-hashes (a pair at 0.8 shares none of them in 4 of 10,000 cases, a closer pair less often), and
checks what either finds by its exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import cut, let_go, pieces, table, tidy, utf8

RADIUS = 2
SHARD = 512
SEED = 42
#: Words of a shingle and least similarity (as a fraction) of the pipeline's stage; min-hashes of its candidates.
WORDS, NEAR = 5, (4, 5)
BANDS, ROWS = 20, 5
_XORS, _FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64, endpoint=False) | np.array([[0], [1]], np.uint64)


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """Unsigned SimHash of the shingles of ``size`` words of UTF-8 ``text``, A-Z lower-cased."""
    return majority(shingle_hashes(text, size))


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """Hashes of the shingles of ``size`` words in order, repeats included, A-Z lower-cased; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    shingles = map(b" ".join, zip(*(islice(words, k, None) for k in range(size))))
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    held = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        held += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * held > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of each row's whole text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = np.array([fingerprint(t) for t in utf8(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("fp", "long"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _unsigned(value: int) -> int:
    """The 64 bits of a long: what is negative has as many bits set as its absolute value, not as its pattern."""
    return value & ((1 << 64) - 1)


def masks(free: list[int]) -> list[tuple[int, list[int]]]:
    """For the bits ``free``: each mask of two of their four blocks, and the bits which it leaves free."""
    width = len(free) // 4
    blocks = [free[k * width : (k + 1) * width] for k in range(4)]
    out = []
    for pair in combinations(range(4), 2):
        held = sum(1 << bit for k in pair for bit in blocks[k])
        out.append((held, [bit for k in range(4) if k not in pair for bit in blocks[k]]))
    return out


class BKTree:
    """Unsigned fingerprints by integer Hamming distance to their parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of the held values within ``radius``; only edges within reach are followed."""
        if not self.values:
            return []
        found, waiting = [], [0]
        while waiting:
            at = waiting.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            children = self.children[at]
            for edge in range(distance - radius, distance + radius + 1):
                child = children.get(edge)
                if child is not None:
                    waiting.append(child)
        return found

    def add(self, value: int) -> int:
        """Position of ``value``, which is inserted if it isn't held yet."""
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while at != new:
            distance = (self.values[at] ^ value).bit_count()
            if distance == 0:
                self.values.pop()
                self.children.pop()
                return at
            at = self.children[at].setdefault(distance, new)
        return new


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, smallest value of its component) for unsigned values of a shard that link to another one."""
    tree, parent = BKTree(), []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for value in sorted(values):
        near = tree.near(value, radius)
        at = tree.add(value)
        if at == len(parent):
            parent.append(at)
        for other in near:
            a, b = root(at), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(tree.values[k], tree.values[root(k)]) for k in range(len(parent)) if root(k) != k]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges inside each run of equal (mask, key); the rows come sorted by them."""
    names = ["a", "b"]
    kept: list[tuple[int, int, int]] = []

    def edges(run: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        return [(_signed(a), _signed(b)) for a, b in forest([_unsigned(v) for _, _, v in run])] if len(run) > 1 else []

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=names)

    for batch in batches:
        found: list[tuple[int, int]] = []
        for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if kept and kept[-1][:2] != row[:2]:
                found += edges(kept)
                kept = []
            kept.append(row)
        yield out(found)
    yield out(edges(kept))


def _sharded(rows: DataFrame, kinds: list[tuple[int, int, int]]) -> DataFrame:
    """A row for each mask that goes with the row's ``mask``. kinds: (mask that a row has, new mask's id, new mask's bits)."""
    options = F.array(*[F.struct(F.lit(old).alias("old"), F.lit(new).alias("new"), F.lit(_signed(bits)).cast("long").alias("bits")) for old, new, bits in kinds])
    chosen = F.filter(options, lambda o: o["old"] == F.col("mask"))
    return rows.select("fp", F.explode(chosen).alias("o")).select(F.col("o.new").alias("mask"), F.col("fp").bitwiseAND(F.col("o.bits")).alias("key"), "fp")


def links(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) between distinct ``fp`` within RADIUS that keep all their components connected."""
    rows, plan = distinct.select("fp", F.lit(0).alias("mask")), [(0, 0, list(range(64)))]
    found = []
    for level in range(3):
        kinds, after = [], []
        for old, bits, free in plan:
            for more, left in masks(free):
                kinds.append((old, len(after), bits | more))
                after.append((len(after), bits | more, left))
        keyed = _sharded(rows, kinds)
        counts = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = keyed.join(counts, ["mask", "key"])
        last = level == 2
        if not last:
            shared = cut(shared)
        small = shared if last else shared.where(F.col("n") <= shard)
        dealt = small.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key")
        found.append(dealt.mapInArrow(_forests, "a long, b long"))
        rows, plan = shared.where(F.col("n") > shard).select("fp", "mask"), after
        if last or rows.isEmpty():
            break
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``: root is the smallest node of its component.

    Large-star and small-star steps alternate until no edge changes; each step is an aggregation and
    an equi-join, and is cut into the shared folder.
    """
    smaller, larger = F.least("a", "b"), F.greatest("a", "b")

    def tidy(e: DataFrame) -> DataFrame:
        return e.where(F.col("a") != F.col("b")).select(larger.alias("a"), smaller.alias("b")).distinct()

    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(tidy(edges))
    before = stamp(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        starred = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = tidy(starred)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges, gone = cut(tidy(small)), edges
        after = stamp(edges)
        let_go(gone)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """doc_id, fp and component_id of each row of ``docs(doc_id, text)``."""
    marked = cut(fingerprints(docs))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least_doc")))
    return _named(marked, distinct, components(links(distinct, shard)))


def _named(marked: DataFrame, distinct: DataFrame, tree: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id) of ``marked(doc_id, fp)`` by the ``tree(node, root)`` over fp."""
    placed = distinct.join(tree, distinct.fp == tree.node, "left").select("fp", "least_doc", F.coalesce("root", "fp").alias("root"))
    linked = placed.join(tree.select("root").distinct(), "root", "left_semi")
    named = linked.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    table_of = placed.join(named, "root", "left").select("fp", F.coalesce("component_id", "least_doc").alias("component_id"))
    return marked.select("doc_id", "fp").join(table_of, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``size`` words."""
    return np.unique(shingle_hashes(text, size))


def band_keys(held: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes of a shingle set; sets that share a key are candidates."""
    if not len(held):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(held), 2048):
        np.minimum(least, ((held[start : start + 2048, None] ^ _XORS) * _FACTORS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64).view(np.int64)


def _set_name(held: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(held.tobytes(), SEED))


class NearSets:
    """Components of shingle sets linked by a similarity of ``NEAR``. Sets come by rising size.

    A set meets those that share a key with it (a band, or the component of its fingerprint) and aren't in its component yet. Sets too small for the
    newest one to link to are let go.
    """

    def __init__(self):
        self.parent: list[int] = []
        self.sets: list[np.ndarray | None] = []
        self.low = 0
        self.bands: dict[object, dict[int, list[int]]] = {}  # key -> root -> members

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def add(self, keys: list, held: np.ndarray) -> None:
        new, n = len(self.parent), len(held)
        self.parent.append(new)
        self.sets.append(held)
        while NEAR[1] * len(self.sets[self.low]) < NEAR[0] * n:
            self.sets[self.low] = None
            self.low += 1
        tried: set[int] = set()
        for key in keys:
            groups = self.bands.setdefault(key, {})
            for old in [r for r in groups if self.parent[r] != r]:
                a, b = groups.pop(old), groups.pop(self.root(old), [])
                longer, shorter = (a, b) if len(a) >= len(b) else (b, a)
                longer += shorter
                groups[self.root(old)] = longer
            for top, members in list(groups.items()):
                if self.root(top) == self.root(new):
                    continue
                for other in reversed(members):
                    if other >= self.low and other not in tried:
                        tried.add(other)
                        both = len(np.intersect1d(self.sets[other], held, assume_unique=True))
                        if NEAR[1] * both >= NEAR[0] * (len(self.sets[other]) + n - both):
                            a, b = self.root(other), self.root(new)
                            self.parent[max(a, b)] = min(a, b)
                            break
            groups.setdefault(self.root(new), []).append(new)


@tidy
def _near_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) that connect the components inside each run of equal ``part``; rows (part, n, fp, tree, held) come sorted."""
    now, names, sets = None, [], NearSets()

    def tree() -> pa.RecordBatch:
        pairs = [(names[k], names[sets.root(k)]) for k in range(len(names)) if sets.parent[k] != k]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for part, fp, root, held in zip(*(batch.column(c).to_pylist() for c in ("part", "fp", "tree")), batch.column("held")):
            if part != now:
                yield tree()
                now, names, sets = part, [], NearSets()
            if names and names[-1] == fp:  # rows that repeat a set
                continue
            one = np.frombuffer(held.as_py(), np.uint64)
            names.append(fp)
            sets.add([*band_keys(one).tolist(), *([] if root is None else [("tree", root)])], one)
    yield tree()


#: Sets of a group of candidates that are checked by one task against as many others of it.
SLICE = 1000


def _dealt(parts: DataFrame, size: int = SLICE) -> DataFrame:
    """part, fp of ``parts(group, fp)``: a group of up to ``size`` sets is one part.

    A larger one is cut into slices by hash, and every two slices meet in a part of their own: each pair of sets
    lies in some part, and no part has more than about two slices.
    """
    slices = parts.groupBy("group").agg(F.ceil(F.count("*") / size).alias("m"))
    own = F.pmod(F.xxhash64("fp"), F.col("m"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))
    met = parts.join(slices, "group").select("group", "fp", "m", own.alias("own"), other.alias("other"))
    # a slice meets itself in its part with the next one
    met = met.where((F.col("m") == 1) | (F.col("own") != F.col("other")))
    return met.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("part"), "fp")


def _checked(grouped: DataFrame, keyed: DataFrame, size: int = SLICE) -> DataFrame:
    """part, fp: where sets are checked against each other, from ``grouped(group, fp)`` and the keys ``keyed(key, fp)``.

    A group of up to ``size`` sets is one part. A larger one, which may hang together by chains only, is checked key
    by key, so that a set is written once for each of its keys at most; or, where that is less (its sets share
    large buckets), by slices of the whole group.
    """
    sizes = grouped.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > size)
    large = grouped.join(sizes, "group")
    buckets = keyed.join(large, "fp").groupBy("group", "key").agg(F.count("*").alias("b")).where("b > 1")
    cost = buckets.groupBy("group").agg(F.sum(F.col("b") * F.ceil(F.col("b") / size)).alias("by_key"))
    chained = cut(sizes.join(cost, "group").where(F.col("by_key") < F.col("n") * F.ceil(F.col("n") / size)).select("group"))
    whole = grouped.join(chained, "group", "left_anti")
    by_key = keyed.join(grouped.join(chained, "group", "left_semi"), "fp").select(F.xxhash64("group", "key").alias("group"), "fp")
    shared = by_key.groupBy("group").agg(F.count("*").alias("b")).where("b > 1").select("group")
    return _dealt(whole.select("group", "fp").unionByName(by_key.join(shared, "group", "left_semi")), size)


def _treed(sets: DataFrame) -> DataFrame:
    """``sets(simhash, ...)`` with ``tree``, what the SimHashes that BK-trees link to this one have in common.

    It is null where it would tell no new pair: for a set that is linked to none, and where all that are linked share a band.
    """
    of = sets.where(F.col("least_doc").isNotNull() & (F.size("bands") > 0)).groupBy(F.col("simhash").alias("fp")).agg(F.count("*").alias("n"))
    of = cut(of)
    linked = components(links(of.select("fp")))
    linked = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    shared = of.join(linked, of.fp == linked.node, "left").where("n > 1 OR root IS NOT NULL").select(F.col("fp").alias("simhash"), F.coalesce("root", "fp").alias("tree"))
    members = cut(sets.join(shared, "simhash").select("fp", "tree", "bands"))
    alike = members.select("tree", F.explode("bands").alias("key")).groupBy("tree", "key").agg(F.count("*").alias("n")).groupBy("tree").agg(F.max("n").alias("most"))
    apart = members.groupBy("tree").agg(F.count("*").alias("n")).join(alike, "tree").where("most < n")
    return sets.drop("simhash").join(members.join(apart, "tree", "left_semi").select("fp", "tree"), "fp", "left")


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fp (a hash of the shingle set) and component_id of each row of ``docs(doc_id, text)``: components of the
    pairs with a five-word Jaccard similarity of ``NEAR`` or more whose SimHashes the BK-trees link or that share a band (at exactly
    ``NEAR`` up to 4 pairs in 10,000 share none). A shingle set's SimHash is that of the text which its least doc_id goes by. Rows without doc_id link only to equal sets. Different texts may go by one doc_id."""
    id_type = docs.select("doc_id").schema

    @tidy
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes = [shingle_hashes(t, WORDS) for t in utf8(batch, "text")]
            sets = [np.unique(h) for h in hashes]
            columns = [pa.array([_set_name(s) for s in sets], pa.int64()), pa.array([_signed(majority(h)) for h in hashes], pa.int64()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_key", "fp", "simhash", "bands"])

    @tidy
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(parts, n, fp, tree, held) of rows (parts, fp, tree, text)."""
        for batch in pieces(batches, "text"):
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), map(shingle_set, utf8(batch, "text")))
            fit = [(parts, len(held), fp, root, held.tobytes()) for parts, fp, root, held in rows]
            kinds = (pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in fit], kind) for k, kind in enumerate(kinds)], names=["parts", "n", "fp", "tree", "held"])

    given = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    marked = cut(given.mapInArrow(mark, id_type.add("text_key", "long").add("fp", "long").add("simhash", "long").add("bands", T.ArrayType(T.LongType()))))
    told = F.struct("text_key", "simhash")
    least_told = F.min_by(told, F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key")))
    sets = marked.groupBy("fp").agg(F.min("doc_id").alias("least_doc"), least_told.alias("told"), F.first("bands").alias("bands"))
    sets = cut(sets.select("fp", "least_doc", F.col("told.text_key").alias("least_key"), F.col("told.simhash").alias("simhash"), "bands"))
    distinct = cut(_treed(sets))
    let_go(sets)
    named = distinct.where(F.col("least_doc").isNotNull())
    keyed = named.select(F.explode("bands").alias("key"), "fp").unionByName(named.where("tree IS NOT NULL").select(F.xxhash64(F.lit("tree"), "tree").alias("key"), "fp"))
    least = keyed.groupBy("key").agg(F.min("fp").alias("first"), F.count("*").alias("n")).where("n > 1")
    candidates = components(keyed.join(least, "key").select(F.col("fp").alias("a"), F.col("first").alias("b")))
    grouped = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root").distinct()).select(F.col("root").alias("group"), F.col("node").alias("fp"))
    asked = distinct.select("fp", "tree", "least_doc", "least_key").join(_checked(grouped, keyed, SLICE).groupBy("fp").agg(F.collect_set("part").alias("parts")), "fp")
    texts_of = given.join(asked, (F.col("doc_id") == F.col("least_doc")) & (F.col("text_key") == F.col("least_key"))).select("parts", "fp", "tree", "text")
    held = texts_of.mapInArrow(sets_of, "parts array<long>, n long, fp long, tree long, held binary").withColumn("part", F.explode("parts"))
    dealt = held.select("part", "n", "fp", "tree", "held").repartition("part").sortWithinPartitions("part", "n", "fp")
    tree = components(dealt.mapInArrow(_near_trees, "a long, b long"))
    return _named(marked, distinct.select("fp", "least_doc"), tree)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (``similar_documents``) the document with the smallest id stays.

    Rows that repeat a doc_id are one document, of which one row stays. Rows without an id can't be
    told apart by it, so they all stay.
    """
    found = similar_documents(docs.select("doc_id", "text"))
    kept = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = cut(kept)
    single = docs.join(kept.where("n = 1"), "doc_id", "left_semi")
    repeated = docs.join(kept.where("n > 1"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    alone = docs.where(F.col("doc_id").isNull())
    return single.unionByName(repeated).unionByName(alone).select(*[f"`{c}`" for c in docs.columns])
