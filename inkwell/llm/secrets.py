"""Secret scans through a trigram inverted index.

Every rule's regex is turned into a Boolean query over trigrams that any match must contain. For each
batch of documents an index posts the trigrams which occur in some query; a rule's query is answered
by intersecting and uniting postings, and its regex then runs over the candidates only. A rule from
which no mandatory trigram follows (a bare character class) scans every document.

Spans are code points, end exclusive. Defined results: a null or empty text has no spans; repeated
rows give repeated results; columns other than doc_id and text don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from inkwell.llm.common import pieces, plain_names, table, texts, tidy, utf8

try:  # the parser is a public module of the standard library under either name
    from re import _constants as rc
    from re import _parser as rp
except ImportError:  # pragma: no cover
    import sre_constants as rc
    import sre_parse as rp


@dataclass(frozen=True)
class Rule:
    """least: characters that ``group`` must have for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: From BEGIN to the END of the same label with no other BEGIN between; without one, over the header fields and
#: base64 that follow (long runs, or what ends its line). Line ends may be escaped, as in JSON.
PRIVATE_KEY = (
    r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY((?: BLOCK)?)-----"
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY\2-----"
    r"|(?:(?:\s|\\[rn])+(?:(?:Proc-Type|DEK-Info|Version|Comment):(?:(?!\\n)[^\n])*"
    r"|[A-Za-z0-9+/=]{20,}|[A-Za-z0-9+/=]+(?=[ \t\r]*(?:\n|\\[rn]|[\"']|\Z))))*)"
)
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("private_key", PRIVATE_KEY),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^/\s:@\"']*:[^/\s:@\"']{3,}@"),
)

#: A query is ALL (no demand), a trigram, or ("and" | "or", frozenset of queries).
ALL = "ALL"
#: Sets of exact strings, prefixes and suffixes beyond this many members are given up.
MOST_STRINGS = 64


def _join(kind: str, parts: list) -> object:
    flat: set = set()
    for part in parts:
        if part == ALL:
            if kind == "or":
                return ALL
        elif isinstance(part, tuple) and part[0] == kind:
            flat |= part[1]
        else:
            flat.add(part)
    if not flat:
        return ALL
    return flat.pop() if len(flat) == 1 else (kind, frozenset(flat))


def _of_strings(strings: set[str]) -> object:
    """What a match that contains one of ``strings`` must contain."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings]) if strings else ALL


@dataclass
class _Facts:
    """exact: all strings that the part can match (None if too many); else prefixes, suffixes and a query."""

    exact: set[str] | None
    prefix: set[str]
    suffix: set[str]
    query: object = ALL


def _short(strings: set[str], first: bool) -> set[str]:
    out = {s[:2] if first else s[-2:] for s in strings}
    return out if len(out) <= MOST_STRINGS else {""}


def _loose(facts: _Facts) -> _Facts:
    """The same facts without an exact set."""
    if facts.exact is None:
        return facts
    return _Facts(None, _short(facts.exact, True), _short(facts.exact, False), _join("and", [facts.query, _of_strings(facts.exact)]))


def _concat(a: _Facts, b: _Facts) -> _Facts:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _Facts({x + y for x in a.exact for y in b.exact}, set(), set(), _join("and", [a.query, b.query]))
    ends = a.exact if a.exact is not None else a.suffix
    starts = b.exact if b.exact is not None else b.prefix
    across = _of_strings({x + y for x in ends for y in starts}) if len(ends) * len(starts) <= MOST_STRINGS * 4 else ALL
    first, last = _loose(a), _loose(b)
    prefix = _short({x + y for x in a.exact for y in starts}, True) if a.exact is not None else first.prefix
    suffix = _short({x + y for x in ends for y in b.exact}, False) if b.exact is not None else last.suffix
    return _Facts(None, prefix, suffix, _join("and", [first.query, last.query, across]))


def _either(a: _Facts, b: _Facts) -> _Facts:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS and a.query == b.query == ALL:
        return _Facts(a.exact | b.exact, set(), set())
    a, b = _loose(a), _loose(b)
    return _Facts(None, _short(a.prefix | b.prefix, True), _short(a.suffix | b.suffix, False), _join("or", [a.query, b.query]))


def _anything() -> _Facts:
    return _Facts(None, {""}, {""})


def _analyse(tokens, fold: bool) -> _Facts:
    facts = _Facts({""}, set(), set())
    for op, value in tokens:
        if op is rc.LITERAL:
            char = chr(value)
            part = _Facts({char.lower() if fold else char}, set(), set())
        elif op is rc.IN:
            chars: set[str] | None = set()
            for kind, item in value:
                if kind is rc.LITERAL:
                    chars.add(chr(item))
                elif kind is rc.RANGE and item[1] - item[0] < 6:
                    chars |= {chr(c) for c in range(item[0], item[1] + 1)}
                else:
                    chars = None
                    break
            part = _anything() if chars is None or len(chars) > 6 else _Facts({c.lower() if fold else c for c in chars}, set(), set())
        elif op is rc.SUBPATTERN:
            part = _analyse(value[3], fold)
        elif op is rc.BRANCH:
            parts = [_analyse(p, fold) for p in value[1]]
            part = parts[0]
            for more in parts[1:]:
                part = _either(part, more)
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            least, most, inner = value
            one = _analyse(inner, fold)
            if least == 0:
                part = _either(one, _Facts({""}, set(), set())) if most == 1 else _anything()
            elif least == most == 1:
                part = one
            else:
                one = _loose(one)
                part = _Facts(None, one.prefix, one.suffix, one.query)
        elif op is rc.AT:
            part = _Facts({""}, set(), set())
        else:
            part = _anything()
        facts = _concat(facts, part)
    return facts


def trigram_query(pattern: str) -> object:
    """The Boolean query over lower-cased trigrams that every match of ``pattern`` satisfies."""

    def lowered(q: object) -> object:
        if q == ALL or isinstance(q, str):
            return q if q == ALL else q.lower()
        return _join(q[0], [lowered(x) for x in q[1]])

    facts = _loose(_analyse(rp.parse(pattern, re.A), True))
    return lowered(facts.query)


def trigrams_of(query: object) -> set[str]:
    if query == ALL:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


def marks(wanted: list[str]) -> np.ndarray:
    """Whether each of the 2**24 byte triples is one of ``wanted``."""
    out = np.zeros(1 << 24, bool)
    out[[int.from_bytes(w.encode(), "big") for w in wanted if len(w.encode()) == 3]] = True
    return out


class TrigramIndex:
    """Postings (sorted document positions) of the ``wanted`` trigrams over a batch of texts, ASCII case folded."""

    def __init__(self, texts_utf8: list[bytes | None], wanted: list[str], marked: np.ndarray | None = None):
        self.n = len(texts_utf8)
        held = [t or b"" for t in texts_utf8]
        data = np.frombuffer(b"\0\0\0".join(held).lower(), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) + 3 for t in held])])
        self.postings: dict[str, np.ndarray] = {w: np.empty(0, np.int64) for w in wanted}
        codes = {int.from_bytes(w.encode(), "big"): w for w in wanted if len(w.encode()) == 3}
        if len(data) < 3 or not codes:
            return
        marked = marks(wanted) if marked is None else marked
        pairs = data.astype(np.uint32)
        found = (pairs[:-2] << 16) | (pairs[1:-1] << 8) | pairs[2:]
        where = np.flatnonzero(marked[found])
        document = np.searchsorted(starts, where, side="right") - 1
        code = found[where]
        for number, w in codes.items():
            self.postings[w] = np.unique(document[code == number])

    def answer(self, query: object) -> np.ndarray:
        if query == ALL:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[query] if len(query.encode()) == 3 else np.arange(self.n)
        parts = sorted((self.answer(q) for q in query[1]), key=len)
        out = parts[0]
        for part in parts[1:]:
            out = np.intersect1d(out, part, assume_unique=True) if query[0] == "and" else np.union1d(out, part)
        return out


Span = tuple[str, int, int]
FOUND = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, re.A), trigram_query(r.pattern)) for r in rules]
        self.wanted = sorted(set().union(*(trigrams_of(q) for _, _, q in self.rules)))
        self.marked = marks(self.wanted)

    def scan(self, held: list[str | None], as_utf8: list[bytes | None]) -> list[list[Span]]:
        """Each text's spans by rule, in order of the rules."""
        index = TrigramIndex(as_utf8, self.wanted, self.marked)
        out: list[list[Span]] = [[] for _ in held]
        for rule, regex, query in self.rules:
            for k in index.answer(query).tolist():
                if held[k]:
                    out[k] += [(rule.kind, *m.span()) for m in regex.finditer(held[k]) if len(m[rule.group]) >= rule.least]
        return out


Make = Callable[[pa.RecordBatch, list[list[Span]]], pa.RecordBatch]


def scanned(docs: DataFrame, schema: T.StructType, make: Make, rules: tuple[Rule, ...]) -> DataFrame:
    """``make`` of each batch of ``docs`` and its texts' spans; one pass through one worker."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in pieces(batches, "text"):
            yield make(batch, scanner.scan(texts(batch, "text"), utf8(batch, "text")))

    return docs.mapInArrow(run, schema)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """``docs`` (with ``text``) and ``found``, an array of (kind, start, end) by rule and start, for each whole text."""

    def make(batch: pa.RecordBatch, spans: list[list[Span]]) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        found = pa.array([[dict(zip(("kind", "start", "end"), s)) for s in one] for one in spans], kind)
        return pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "found"])

    return scanned(docs, T.StructType([*docs.schema.fields, T.StructField("found", FOUND)]), make, rules)


def joined(spans: list[Span], order: dict[str, int]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = {r.kind: k for k, r in enumerate(BASE + MORE)}
    base = [r.kind for r in BASE]

    def make(batch: pa.RecordBatch, rows: list[list[Span]]) -> pa.RecordBatch:
        counts = [pa.array([sum(s[0] == kind for s in one) for one in rows], pa.int64()) for kind in base]
        hashes = [hashlib.sha256(joined([s for s in one if s[0] in base], order).encode()).hexdigest() for one in rows]
        spans = [joined(one, order) for one in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(hashes, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = docs.select("doc_id").schema
    for name, kind in (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string")):
        schema = schema.add(name, kind)
    return scanned(docs, schema, make, BASE + MORE)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """``text`` with each span's characters replaced by ``[kind]``; overlapping spans become one."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; its secrets are replaced by their kind, and ``n_chars`` follows the text."""
    named = plain_names(docs, "text", "n_chars")
    columns = named.columns

    def make(batch: pa.RecordBatch, spans: list[list[Span]]) -> pa.RecordBatch:
        clean = [redact(t, s) for t, s in zip(texts(batch, "text"), spans)]
        made = {"text": pa.array(clean, pa.string())}
        if "n_chars" in columns:
            before = batch.column(columns.index("n_chars"))
            counts = [len(t) if s and t is not None else n for t, s, n in zip(clean, spans, before.to_pylist())]
            made["n_chars"] = pa.array(counts, before.type)
        return pa.RecordBatch.from_arrays([made.get(c, batch.column(i)) for i, c in enumerate(columns)], names=columns)

    return scanned(named, named.schema, make, BASE + MORE).toDF(*docs.columns)
