"""Chat formatting: roles of a raw transcript's lines by a hidden Markov model, then canonical turns.

A state is a role and whether the line opens a turn. A line shows which speaker marker it starts with, how
long it is, how it begins and ends, and whether it is the first of its row. Transitions and emissions are counted (add-one) on a
bounded sample of conversations with known roles. The most probable path is found by Viterbi.

A conversation is cut into chunks of ``CHUNK`` turns, however long it is, and a chunk in which turns repeat
so often that it has over ``DENSE`` times as many rows is cut again, into parts of single turns. A chunk's effect on path scores is
a max-plus matrix over the states, so pass one reduces each chunk to its matrix, a scan over a
conversation's matrices fixes the states at the chunks' borders, and pass two finds each chunk's path
between them: together they give the path that Viterbi finds over the whole conversation.

A row's ``rendered`` is what it adds to the canonical text: joined in order of turn, the rows of a
conversation give a ``<|role|>`` header and the lines of each turn, with ``<|end|>`` between turns.

Defined results: a null text is an empty line; a null role gives no marker; a row without conv_id is a
conversation by itself; repeated turns stand in order of role and text, rows without a turn before all others in
order of their text's hash; in a chunk that is cut again a turn's rows stand in parts by their place in
the input. Without training rows roles are guessed from markers alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import cut, table, unsigned_share
from inkwell.operators.joins import if_small

ROLES = ("system", "user", "assistant")
#: Speaker markers by role.
MARKERS = {
    "system": ("system", "instruction", "instructions"),
    "user": ("user", "human", "q", "question", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "model"),
}
_ROLE_OF = {name: role for role, names in MARKERS.items() for name in names}
_MARK = re.compile(r"\s*(?:#{1,4}\s*|\*\*|\[|<\|?|>\s*)?(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")(?:\*\*|\]|\|?>)?\s*(?:[:>\]]\s?|$)", re.I)
STATES = len(ROLES) * 2  # opening states first, then the inner ones
SAMPLE_ROWS, CHUNK, DENSE = 4000, 512, 8
#: Chunks that a conversation's rows without a turn are dealt to.
UNTOLD = 1024
LENGTHS = (0, 20, 60, 120, 240, 480, 960)


def marker(line: str) -> tuple[int, int]:
    """Role number of the line's speaker marker (3: none) and where the text behind it starts."""
    found = _MARK.match(line)
    return (ROLES.index(_ROLE_OF[found[1].lower()]), found.end()) if found else (3, 0)


def observed(line: str, first: bool) -> tuple[int, int, int, int, int]:
    """What a line shows: marker, length, end, beginning and place in its row. The text behind a marker speaks as one without."""
    mark, at = marker(line)
    text = line[at:].strip()
    begins = 0 if not text else 1 if text[0].isupper() else 2 if text[0].islower() else 3
    return mark, sum(len(text) > n for n in LENGTHS), 2 if text.endswith("?") else 1 if text.endswith((".", "!", "\"")) else 0, begins, int(first)


SHAPES = (4, len(LENGTHS) + 1, 3, 4, 2)


def shown_by(lines: list[str]) -> list[tuple[int, ...]]:
    """``observed`` of a row's lines."""
    return [observed(line, k == 0) for k, line in enumerate(lines)]


class Counts:
    """How often paths start in a state, go from one to another, and what is shown in each; sums of them are counts too."""

    SIZE = STATES * (1 + STATES + sum(SHAPES))

    def __init__(self, flat: np.ndarray | None = None):
        flat = np.zeros(self.SIZE) if flat is None else flat
        ends = np.cumsum([STATES, STATES * STATES, *(STATES * n for n in SHAPES)])
        parts = np.split(flat, ends[:-1])
        self.flat, self.start, self.move = flat, parts[0], parts[1].reshape(STATES, STATES)
        self.shown = [p.reshape(STATES, n) for p, n in zip(parts[2:], SHAPES)]

    def add(self, states: list[int], seen: list[tuple[int, ...]], before: int | None = None, within: bool = False) -> None:
        """A path and what it shows; ``within`` leaves out how it begins."""
        for state, values in zip(states, seen):
            if before is not None:
                self.move[before, state] += 1
            elif not within:
                self.start[state] += 1
            before = state
            for table_, value in zip(self.shown, values):
                table_[state, value] += 1


class Model:
    """Log probabilities."""

    def __init__(self, counts: Counts):
        start, move = counts.start + 1, counts.move + 1
        shown = [s + 1 for s in counts.shown]
        for role in range(3):  # what a marker says, even without training rows
            shown[0][role, role] += 5
            shown[0][3:, 3] += 5
        shown[4][:3, 1] += 5
        shown[4][3:, 0] += 5
        allowed = np.ones((STATES, STATES), bool)
        for a in range(STATES):
            for b in range(3, STATES):
                allowed[a, b] = a % 3 == b % 3  # a turn goes on in its own role
        start[3:] = 0
        with np.errstate(divide="ignore"):
            self.start = np.log(start / start.sum())
            self.move = np.log(np.where(allowed, move, 0) / np.where(allowed, move, 0).sum(axis=1, keepdims=True))
        self.shown = [np.log(s / s.sum(axis=1, keepdims=True)) for s in shown]

    def emit(self, rows: list[list[str]]) -> np.ndarray:
        """Log probabilities of what the rows' lines show, by line and state."""
        seen = [values for lines in rows for values in shown_by(lines)]
        return sum(table_[:, [s[k] for s in seen]] for k, table_ in enumerate(self.shown)).T

    def matrix(self, emitted: np.ndarray) -> np.ndarray:
        """Best score from each state before the lines to each state at the last line."""
        total = None
        for e in emitted:
            step = self.move + e[None, :]
            total = step if total is None else (total[:, :, None] + step[None, :, :]).max(axis=1)
        return total

    def path(self, emitted: np.ndarray, before: int | None = None, last: int | None = None) -> list[int]:
        """Best path after the state ``before`` (None: the conversation starts) to the state ``last`` (None: any)."""
        score, came = (self.start if before is None else self.move[before]) + emitted[0], []
        for e in emitted[1:]:
            options = score[:, None] + self.move
            came.append(options.argmax(axis=0))
            score = options.max(axis=0) + e
        out = [int(score.argmax()) if last is None else last]
        for back in reversed(came):
            out.append(int(back[out[-1]]))
        return out[::-1]

    def begun(self, emitted: np.ndarray) -> np.ndarray:
        """Best score of ending in each state if the conversation starts with these lines."""
        score = self.start + emitted[0]
        for e in emitted[1:]:
            score = (score[:, None] + self.move).max(axis=0) + e
        return score


def borders(chunks: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int | None, int]]:
    """(state before, state at the end) of each chunk of one conversation, from its (matrix, begun)."""
    score, came = chunks[0][1], []
    for matrix, _ in chunks[1:]:
        options = score[:, None] + matrix
        came.append(options.argmax(axis=0))
        score = options.max(axis=0)
    ends = [int(score.argmax())]
    for back in reversed(came):
        ends.append(int(back[ends[-1]]))
    ends.reverse()
    return list(zip([None, *ends[:-1]], ends))


def rows_lines(raw: str | None) -> list[str]:
    return (raw or "").split("\n")


def render(lines: list[str], states: list[int], opening: bool) -> str:
    """Canonical text that the lines add: where a turn opens, the one before it ends (but for the ``opening`` one)."""
    out = []
    for line, state in zip(lines, states):
        mark, at = marker(line)
        own = state < 3 and mark == state
        if state < 3:
            out.append(("" if opening else "<|end|>\n") + f"<|{ROLES[state]}|>\n")
            opening = False
        text = line[at:] if own else line
        if text.strip() or not own:  # a line that was a marker only is gone
            out.append(text + "\n")
    return "".join(out)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each (key, chunk, part); they come sorted."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[0][c] != row[c] for c in ("chunk", "part", "key")):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def parse(transcripts: DataFrame, model: Model, chunk: int = CHUNK) -> DataFrame:
    """conv_id, turn, role, role_pred and rendered of each row of ``transcripts(conv_id, turn, role, raw)``.

    ``role`` is carried for comparison only. A chunk holds the rows of ``chunk`` consecutive turn numbers. Those with
    too many rows are broadcast if they are few, which is counted first.
    """
    spark = transcripts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    untold = -1 - F.pmod(F.xxhash64("raw"), F.lit(UNTOLD))
    number = F.coalesce(F.floor(F.col("turn") / chunk).cast("long"), untold)
    key = F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    given = cut(transcripts.select(key.alias("key"), number.alias("chunk"), "conv_id", "turn", "role", "raw", F.monotonically_increasing_id().alias("row")))
    place = ("key", "chunk", "part")
    order = (*place, "turn", "role", "raw")
    dense = given.groupBy("key", "chunk").agg(F.ceil(F.count("*") / chunk).alias("parts")).where(F.col("parts") > DENSE)
    part = F.coalesce(F.pmod("turn", F.lit(chunk)), F.lit(0)) * F.col("parts") + F.pmod(F.xxhash64("row"), F.col("parts"))
    rows = given.join(if_small(dense), ["key", "chunk"], "left").withColumn("part", F.coalesce(part, F.lit(0)).cast("long")).drop("parts", "row")
    each = rows.select(*place).distinct()
    several = each.join(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key", "left_semi")
    sums = "key string, chunk long, part long, m array<double>, begun array<double>"

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in _chunks(batches):
            emitted = shared.value.emit([rows_lines(row["raw"]) for row in one])
            values = (*[one[0][c] for c in place], shared.value.matrix(emitted).ravel().tolist(), shared.value.begun(emitted).tolist())
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[*place, "m", "begun"])

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["chunk", "part"])
        found = borders([(np.array(m).reshape(STATES, STATES), np.array(b)) for m, b in zip(group["m"], group["begun"])])
        return pd.DataFrame({**{c: group[c].to_numpy() for c in place}, "before": [-1 if a is None else a for a, _ in found], "at_end": [b for _, b in found]})

    long_ones = rows.join(several, list(place), "left_semi").repartition(*place).sortWithinPartitions(*order)
    ends = cut(long_ones.mapInArrow(reduce, sums).groupBy("key").applyInPandas(scan, "key string, chunk long, part long, before int, at_end int"))
    dealt = rows.join(ends, list(place), "left").repartition(*place).sortWithinPartitions(*order)
    names = ["conv_id", "turn", "role", "role_pred", "rendered"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, pa.DataType] = {}

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds.update({f.name: f.type for f in batch.schema})
                yield batch

        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            types = [kinds.get("conv_id"), kinds.get("turn"), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

        for one in _chunks(watched()):
            held = [rows_lines(row["raw"]) for row in one]
            emitted = shared.value.emit(held)
            before, last = one[0]["before"], one[0]["at_end"]
            opening = before is None or before < 0
            states = shared.value.path(emitted, None if opening else before, last)
            at = 0
            for row, lines in zip(one, held):
                mine = states[at : at + len(lines)]
                role = max(range(3), key=lambda r: sum(s % 3 == r for s in mine))
                out.append((row["conv_id"], row["turn"], row["role"], ROLES[role], render(lines, mine, opening and at == 0)))
                at += len(lines)
            if len(out) >= 2000:
                yield flushed()
                out = []
        if out:
            yield flushed()

    schema = transcripts.select("conv_id", "turn", "role").schema.add("role_pred", "string").add("rendered", "string")
    return dealt.select("conv_id", *place, "turn", "role", "raw", "before", "at_end").mapInArrow(run, schema)


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, raw: turns as people paste them, in one of four styles by conversation.

    Two styles have a marker before the text, one has it on a line of its own, and one leaves half of
    the turns without any.
    """
    role, text = F.col("role"), F.coalesce("text", F.lit(""))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    short = F.when(role == "user", "Q").when(role == "assistant", "A").otherwise("Instruction")
    heading = F.when(role == "user", "Human").otherwise(F.initcap(role))
    marked = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(2)) == 0
    raw = (
        F.when(role.isNull(), text)
        .when(style == 0, F.concat(F.initcap(role), F.lit(": "), text))
        .when(style == 1, F.concat(F.lit("### "), heading, F.lit("\n"), text))
        .when(style == 2, F.concat(short, F.lit(": "), text))
        .when(marked, F.concat(F.lit("["), role, F.lit("]: "), text))
        .otherwise(text)
    )
    return conversations.select("conv_id", "turn", "role", raw.alias("raw"))


def held_out():
    """True where crc32 of the conv_id's digits leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 3 == 1, F.lit(False))


def learn(transcripts: DataFrame, sample_rows: int = SAMPLE_ROWS, most_turn: int = 64) -> Model:
    """Counts over about ``sample_rows`` turns: conversations chosen by hash, the turns below ``most_turn`` of each.

    A turn that is repeated counts once; rows without conversation take no part. A turn is counted where its row
    is: the driver gets fixed numbers of counts for each, never its text.
    """
    early = transcripts.where(F.col("role").isin(*ROLES) & F.col("turn").between(0, most_turn - 1) & F.col("conv_id").isNotNull())
    n = early.agg(F.approx_count_distinct(F.struct("conv_id", "turn"))).first()[0]
    chosen = early.where(unsigned_share(F.col("conv_id"), 5) < sample_rows / max(n, 1))
    once = chosen.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "raw")).alias("r")).select("conv_id", "turn", "r.role", "r.raw")
    ids = once.select("conv_id", "turn").schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for role, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own, lines = Counts(), rows_lines(raw)
                opens = ROLES.index(role)
                own.add([opens + 3 * (k > 0) for k in range(len(lines))], shown_by(lines), within=True)
                found.append((opens, opens + 3 * (len(lines) > 1), own.flat.astype(np.int64).tolist()))
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["conv_id", "turn", "first", "last", "counts"])

    total, before = Counts(), (None, 0)
    rows = once.mapInArrow(count, ids.add("first", T.IntegerType()).add("last", T.IntegerType()).add("counts", T.ArrayType(T.LongType())))
    for r in rows.orderBy("conv_id", "turn").toLocalIterator():
        total.flat += np.array(r.counts)
        if before[0] == r.conv_id:
            total.move[before[1], r.first] += 1
        else:
            total.start[r.first] += 1
        before = (r.conv_id, r.last)
    return Model(total)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of all turns; conversations that are ``held_out`` take no part in the fit."""
    transcripts = as_transcripts(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return parse(transcripts, learn(transcripts.where(~held_out()))).withColumn("held_out", held_out())
