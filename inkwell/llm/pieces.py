"""Encoding into and decoding from pieces with a unigram model.

The pieces lie in a double-array trie over UTF-8 bytes. A text's best segmentation is the one with the
largest sum of log scores, found by Viterbi. Spaces become the marker U+2581, one marker is put before
a text, and a character that no piece starts with falls back to its UTF-8 bytes. A marker that stands in
the text itself also goes by its bytes, so decoding gives back every text exactly.

No piece of a vocabulary of this kind has a marker after another character, so the segmentation of a
text is that of its chunks (markers and what follows up to the next marker). Distinct chunks of a batch
are segmented together, one byte position of all of them at a time, and kept for later batches. A long chunk (a text
without spaces) is walked by itself in time that is linear in its bytes, and takes six bytes of memory for each. A
vocabulary that breaks the rule is segmented by whole texts.

The tokenizer isn't trained here. A vocabulary file of the BPE kind carries merge ranks, not log scores;
they become the log scores of Zipf's law, -ln(rank + 2.7). A unigram file's own scores are used as they are.

Defined results: a null text gives null ids, an empty one no ids. Repeated rows are encoded alike.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import pieces as slices
from inkwell.llm.common import table, texts, tidy

MARKER = "▁"
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Chunks that a task remembers, in each of two generations, and their bytes with their ids.
REMEMBERED, REMEMBERED_BYTES = 150_000, 24 << 20
#: Chunks of more bytes (texts without spaces) are segmented by themselves, byte by byte.
LONG = 256
#: What an unknown character costs beyond the least score.
UNKNOWN_PENALTY = 10.0
#: Cells (chunks times bytes) of one Viterbi table.
CELLS = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """kinds: 0 ordinary, 1 byte, 2 never produced. score: a log score for each id."""

    pieces: list[str]
    score: np.ndarray
    kinds: np.ndarray

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """A model file's pieces with their scores; where these are ranks (0, -1, -2 and so on) Zipf's law gives the scores."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        kinds = np.array([1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0 for i in range(n)])
        score = np.array([model.get_score(i) for i in range(n)])
        ranks = score[kinds == 0]
        if np.array_equal(ranks, -np.arange(len(ranks))):
            rank = np.cumsum(kinds == 0) - 1
            score = -np.log(np.maximum(rank, 0) + 2.7) - math.log(math.log(n + 2.7))
        return cls([model.id_to_piece(i) for i in range(n)], score, kinds)


class DoubleArray:
    """Trie in two arrays: a child of node s by byte b is t = base[s] + b + 1 if check[t] == s. value: a piece's id or -1."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for word, number in words.items():
            at = 0
            for byte in word:
                if byte not in children[at]:
                    children[at][byte] = len(children)
                    children.append({})
                    value.append(-1)
                at = children[at][byte]
            value[at] = number
        size = len(children) + 1024
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        origin = 1  # places before it are nearly all taken, so the search for room starts here
        waiting = [(0, 0)]
        while waiting:
            node, place = waiting.pop()
            self.value[place] = value[node]
            edges = sorted(children[node])
            if not edges:
                continue
            at, full, fresh = max(edges[0] + 1, origin), 0, True
            while True:
                if at + 300 > len(taken):
                    taken.extend(bytes(len(taken)))
                if taken[at]:
                    full += 1
                else:
                    if fresh:
                        origin, fresh = at, False
                    start = at - edges[0] - 1
                    if not any(taken[start + b + 1] for b in edges[1:]):
                        break
                at += 1
            if full >= 0.9 * (at - origin + 1):
                origin = at
            if len(taken) > len(self.base):
                more = len(taken) - len(self.base)
                self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
                self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
                self.value = np.concatenate([self.value, np.full(more, -1, np.int32)])
            self.base[place] = start
            for byte in edges:
                to = start + byte + 1
                taken[to] = 1
                self.check[to] = place
                waiting.append((children[node][byte], to))
        # room so that a failed step never leaves the arrays
        self.base, self.check, self.value = (np.concatenate([a, np.full(300, fill, np.int32)]) for a, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))


class Encoder:
    """What a worker needs; small enough to broadcast (its size is the vocabulary file's)."""

    def __init__(self, vocabulary: Vocabulary):
        ordinary = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.kinds[i] == 0 and p}
        self.trie = DoubleArray({p.encode(): i for p, i in ordinary.items()})
        self.longest = max((len(p.encode()) for p in ordinary), default=0)
        self.score = vocabulary.score.astype(np.float64)
        self.unknown = float(min((vocabulary.score[i] for i in ordinary.values()), default=0.0)) - UNKNOWN_PENALTY
        self.byte_id = np.full(256, -1, np.int32)
        for i, p in enumerate(vocabulary.pieces):
            if vocabulary.kinds[i] == 1:
                self.byte_id[int(p[1:-1], 16)] = i
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces to fall back to")
        whole = any(MARKER in p.lstrip(MARKER) for p in ordinary)
        alone = not any("\n" in p for p in ordinary)
        self.chunk = re.compile(f".+" if whole else f"\n|{MARKER}*[^{MARKER}\n]+|{MARKER}+" if alone else f"{MARKER}*[^{MARKER}]+|{MARKER}+", re.S)
        self.out = pa.array([bytes([int(p[1:-1], 16)]) if k == 1 else b"" if k == 2 else p.replace(MARKER, " ").encode() for p, k in zip(vocabulary.pieces, vocabulary.kinds)], pa.binary())
        self.forget()

    def forget(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_bytes = 0
        self.lists: tuple[list, ...] | None = None

    def __getstate__(self):
        return {**self.__dict__, "young": {}, "old": {}, "young_bytes": 0, "lists": None}

    def viterbi(self, chunks: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Ids (int32 bytes) and score of each non-empty chunk."""
        n = len(chunks)
        lengths = np.array([len(c) for c in chunks])
        width = int(lengths.max())
        table_ = np.zeros((n, width + 1), np.uint8)
        flat = np.frombuffer(b"".join(chunks), np.uint8)
        mask = np.arange(width + 1)[None, :] < lengths[:, None]
        table_[mask] = flat
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        came = np.zeros((n, width + 1), np.int32)
        piece = np.full((n, width + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for p in range(width):
            rows = np.flatnonzero((p < lengths) & (best[:, p] > -np.inf))
            if not len(rows):
                continue
            first = table_[rows, p]
            char = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
            single = np.zeros(n, bool)
            char_of = np.zeros(n, np.int64)
            char_of[rows] = char
            here = best[:, p]
            active, state = rows, np.zeros(len(rows), np.int32)
            for d in range(min(self.longest, width - p)):
                step = base[state] + table_[active, p + d] + 1
                ok = (check[step] == state) & (p + d < lengths[active])
                active, state = active[ok], step[ok]
                if not len(active):
                    break
                found = value[state]
                hit = found >= 0
                if hit.any():
                    at, number = active[hit], found[hit]
                    single[at[char_of[at] == d + 1]] = True
                    score = here[at] + self.score[number]
                    better = score > best[at, p + d + 1]
                    at, number = at[better], number[better]
                    best[at, p + d + 1] = score[better]
                    came[at, p + d + 1] = p
                    piece[at, p + d + 1] = number
            alone = rows[~single[rows]]
            if len(alone):
                end = np.minimum(p + char_of[alone], lengths[alone])
                score = here[alone] + self.unknown
                better = score > best[alone, end]
                at, end = alone[better], end[better]
                best[at, end] = score[better]
                came[at, end] = p
                piece[at, end] = -1
        # back from the ends, all chunks at once
        position, rows = lengths.copy(), np.arange(n)
        trail_row, trail_from, trail_id = [], [], []
        while len(rows):
            before = came[rows, position[rows]]
            trail_row.append(rows)
            trail_from.append(before)
            trail_id.append(piece[rows, position[rows]])
            position[rows] = before
            rows = rows[before > 0]
        row, start, ids = (np.concatenate(t) for t in (trail_row, trail_from, trail_id))
        order = np.lexsort((start, row))
        row, start, ids = row[order], start[order], ids[order].astype(np.int32)
        bounds = np.searchsorted(row, np.arange(n + 1))
        out = []
        for k in range(n):
            mine = ids[bounds[k] : bounds[k + 1]]
            if (mine < 0).any():
                ends = [*start[bounds[k] + 1 : bounds[k + 1]].tolist(), int(lengths[k])]
                parts = [self.byte_id[np.frombuffer(chunks[k][a:b], np.uint8)] if i < 0 else [i] for i, a, b in zip(mine.tolist(), start[bounds[k] : bounds[k + 1]].tolist(), ends)]
                mine = np.concatenate(parts).astype(np.int32)
            out.append(mine.tobytes())
        return out, best[np.arange(n), lengths]

    def walk(self, chunk: bytes) -> bytes:
        """Ids (int32 bytes) of a chunk of any length: what ``viterbi`` gives, one byte after the other.

        Scores are kept for as many places as the longest piece has bytes; of the others what ends there and how long it is.
        """
        if self.lists is None:
            self.lists = tuple(a.tolist() for a in (self.trie.base, self.trie.check, self.trie.value, self.score))
        base, check, value, score = self.lists
        size, longest, nothing = len(chunk), max(self.longest, 4), -math.inf
        came, piece = array("H", bytes(2 * (size + 1))), array("i", [-1]) * (size + 1)
        ring = longest + 1
        best = [nothing] * ring
        best[0] = 0.0
        for p in range(size):
            here = best[p % ring]
            best[p % ring] = nothing  # the place of p + ring from now on
            if here == nothing:
                continue
            first = chunk[p]
            char = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            state, alone, end = 0, True, p
            for byte in chunk[p : p + longest]:
                step = base[state] + byte + 1
                if check[step] != state:
                    break
                state = step
                end += 1
                number = value[state]
                if number >= 0:
                    if end - p == char:
                        alone = False
                    found = here + score[number]
                    if found > best[end % ring]:
                        best[end % ring] = found
                        came[end] = end - p
                        piece[end] = number
            if alone:
                end = min(p + char, size)
                found = here + self.unknown
                if found > best[end % ring]:
                    best[end % ring] = found
                    came[end] = end - p
                    piece[end] = -1
        out, at = array("i"), size
        while at > 0:
            start = at - came[at]
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out.extend(self.byte_id[list(chunk[start:at])][::-1].tolist())
            at = start
        out.reverse()
        return out.tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Segment chunks that aren't remembered, those of like length together."""
        held = sorted(((c.encode(), c) for c in chunks), key=lambda x: len(x[0]))
        self.young_bytes += sum(6 * len(b) for b, _ in held)
        while held and len(held[-1][0]) > LONG:
            long, c = held.pop()
            self.young[c] = self.walk(long)
        start = 0
        while start < len(held):
            end, most = start + 1, CELLS // (len(held[start][0]) + 1)
            while end < len(held) and end - start < most and len(held[end][0]) <= 1.25 * len(held[start][0]) + 1 and (end - start) * len(held[end][0]) < CELLS:
                end += 1
            found, _ = self.viterbi([b for b, _ in held[start:end]])
            self.young.update(zip((c for _, c in held[start:end]), found))
            start = end

    def _chunks(self, text: str) -> list[str]:
        return self.chunk.findall(MARKER + text.replace(" ", MARKER)) if text else []

    def encode(self, held: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text."""
        split: list = []
        for text in held:
            if text is None:
                split.append(None)
            elif MARKER in text:  # markers of the text itself are spelt by their bytes
                first, *rest = text.split(MARKER)
                parts = [self._chunks(first) if first else [MARKER]]
                for more in rest:
                    parts += [None, self.chunk.findall(more.replace(" ", MARKER))]
                split.append(parts)
            else:
                split.append([self._chunks(text)])
        if len(self.young) > REMEMBERED or self.young_bytes > REMEMBERED_BYTES:
            self.old, self.young = self.young if self.young_bytes <= 2 * REMEMBERED_BYTES else {}, {}
            self.young_bytes = 0
        seen = {c for one in split if one for part in one if part for c in part}
        missing = []
        for c in seen:
            if c not in self.young:
                if c in self.old:
                    self.young[c] = self.old[c]
                else:
                    missing.append(c)
        self._learn(missing)
        known = self.young
        marker = self.byte_id[np.frombuffer(MARKER.encode(), np.uint8)].tobytes()
        out = []
        for one in split:
            if one is None:
                out.append(None)
            else:
                out.append(np.frombuffer(b"".join(marker if part is None else b"".join([known[c] for c in part]) for part in one), np.int32))
        return out

    def decode(self, ids: list[np.ndarray | None]) -> list[str | None]:
        """The texts that ``ids`` stand for; bytes that aren't UTF-8 become U+FFFD."""
        counts = [0 if i is None else len(i) for i in ids]
        flat = np.concatenate([i for i in ids if i is not None] or [np.empty(0, np.int32)])
        spelt = self.out.take(pa.array(flat))
        offsets = np.frombuffer(spelt.buffers()[1], np.int32)[spelt.offset : spelt.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        data = spelt.buffers()[2].to_pybytes() if len(flat) and spelt.buffers()[2] is not None else b""
        out, at = [], 0
        for one, n in zip(ids, counts):
            if one is None:
                out.append(None)
                continue
            raw = data[offsets[at] : offsets[at + n]] if n else b""
            out.append(raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace"))
            at += n
        return out


def encode_documents(docs: DataFrame, carry: list[str], encoder: Encoder) -> DataFrame:
    """``carry`` columns with n_tokens, ids and round_trip (decoding gives the text back) of each whole ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(encoder)
    shown = "text" if "text" in carry else "_text"
    given = docs.select(*[F.col(f"`{c}`") for c in carry], *([] if shown == "text" else [F.col("text").alias(shown)]))
    schema = given.select(*[f"`{c}`" for c in carry]).schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType())).add("round_trip", "boolean")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Encoder.__new__(Encoder)
        model.__dict__.update(shared.value.__dict__)
        model.forget()
        for batch in slices(batches, shown, 1 << 20):
            held = texts(batch, shown)
            ids = model.encode(held)
            counts = [None if i is None else len(i) for i in ids]
            offsets = np.concatenate([[0], np.cumsum([n or 0 for n in counts])]).astype(np.int32)
            flat = np.concatenate([i for i in ids if i is not None] or [np.empty(0, np.int32)])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=pa.array([i is None for i in ids], pa.bool_()))
            same = [a == b for a, b in zip(held, model.decode(ids))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(carry))), pa.array(counts, pa.int64()), lists, pa.array(same, pa.bool_())], names=[*carry, "n_tokens", "ids", "round_trip"])

    return given.mapInArrow(run, schema)


def op9_pieces(spark: SparkSession, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), ["doc_id"], Encoder(Vocabulary.read(model_file)))


def encode_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: what training reads of each document, without its text."""
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return encode_documents(docs, kept, Encoder(Vocabulary.read(MODEL_FILE)))
