"""Which facts a text's terms touch: postings of all facts' terms in a worker, one pass over a text.

A text shares some term with most facts, so a row for each term that it shares would be some hundred times the texts.
Here a text's terms are looked up where it lies, and only what comes of them leaves it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkwell import params

#: Rows of postings that a worker holds, at most.
POSTED_ROWS = 1_000_000
#: Rows of a batch that a worker gives, or those of one text.
GIVEN_ROWS = 100_000
#: White space as Unicode has it; Python's own has four control characters more.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS = re.compile(params.SEPARATORS.removeprefix("(?U)").replace("[", "[^", 1).replace(r"\s", WHITE).removesuffix("+") + "{2,}")

#: (fact's number of each pair, its other columns) of a text's counts: shared short terms and shared trigrams by fact; for brief facts all shared terms.
Finish = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


def scores(counts: np.ndarray, brief: np.ndarray) -> np.ndarray:
    """The score of each fact, 0 where it isn't touched enough; as ``cognition.term_scores`` has it."""
    shorts, trigrams = counts[:, 0], counts[:, 1]
    return np.where(brief, 10 * (shorts + trigrams > 0), np.where(shorts > 0, shorts + 2, np.where(trigrams >= 2, trigrams, 0)))


class Postings:
    """Facts by the (kind, term) that find them; facts go by numbers."""

    def __init__(self, kinds: Sequence[str], terms: Sequence[str], facts: Sequence[int], brief: np.ndarray, stop_words: Sequence[str], stop_ngrams: Sequence[str]):
        self.brief, self.stop_words = brief, frozenset(stop_words)
        self.numbers: dict[str, dict[str, int]] = {"s": {}, "b": {}, "t": {}}
        lists: list[list[int]] = []
        for kind, term, fact in zip(kinds, terms, facts):
            if term in (stop_words if kind == "s" else stop_ngrams):
                continue
            if kind == "s" and len(term) > 4:  # a token of a text that is longer is no short term
                continue
            number = self.numbers[kind].setdefault(term, len(lists))
            if number == len(lists):
                lists.append([])
            lists[number].append(2 * fact + (kind != "s"))
        self.lists = [np.array(held, np.int64) for held in lists]

    def counts(self, text: str) -> np.ndarray | None:
        """(short terms, other terms) that the text shares with each fact; None if it shares none."""
        words = set(_WORDS.findall(text)) - self.stop_words
        longer = [w for w in words if len(w) > 4]
        shared = [n for w in words if (n := self.numbers["s"].get(w)) is not None]
        for size, kind in ((2, "b"), (3, "t")):
            if held := self.numbers[kind]:
                grams = {w[i : i + size] for w in longer for i in range(len(w) - size + 1)}
                shared += [n for g in grams if (n := held.get(g)) is not None]
        if not shared:
            return None
        return np.bincount(np.concatenate([self.lists[k] for k in shared]), minlength=2 * len(self.brief)).reshape(-1, 2)


_built: tuple[tuple, Postings] | None = None


def _postings(held: tuple) -> Postings:
    """A worker keeps the postings that it has used last."""
    global _built
    if _built is None or _built[0] is not held:
        _built = (held, Postings(*held))
    return _built[1]


class Held:
    """The rows of ``posted(kind, term, fact_key, brief)`` on all workers, and the keys of their facts."""

    def __init__(self, posted: pa.Table, spark, stop_words: Sequence[str] = params.STOP_WORDS, stop_ngrams: Sequence[str] = params.STOP_NGRAMS):
        keys, self.numbers = posted.column(2).to_pylist(), {}
        facts = [self.numbers.setdefault(k, len(self.numbers)) for k in keys]
        brief = np.zeros(len(self.numbers), bool)
        brief[facts] = posted.column(3).to_numpy()
        self.keys = pa.array(list(self.numbers), posted.column(2).type)
        self.shared = spark.sparkContext.broadcast((posted.column(0).to_pylist(), posted.column(1).to_pylist(), facts, brief, list(stop_words), list(stop_ngrams)))

    @classmethod
    def of(cls, posted: DataFrame, fact_key: str, most: int = POSTED_ROWS, **stops) -> Held | None:
        """None if there are more than ``most`` rows."""
        rows = posted.select("kind", "term", fact_key, "brief").limit(most + 1).toArrow()
        return cls(rows, posted.sparkSession, **stops) if rows.num_rows <= most else None

    def touched(self, texts: DataFrame, key: str, text: str, fact_field, columns: str, finish: Finish) -> DataFrame:
        """key, fact and ``columns``: what ``finish`` makes of the counts of each text. Rows of one key stay apart."""
        given = texts.select(F.col(key), F.col(text).cast("binary").alias("_text")).where(F.col("_text").isNotNull())
        schema = StructType([*given.select(key).schema, fact_field, *(StructType.fromDDL(columns) if columns else ())])
        names, shared, keys = schema.names, self.shared, self.keys

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            postings = _postings(shared.value)
            for batch in batches:
                rows, parts, waiting = [], [], 0

                def given_rows() -> pa.RecordBatch:
                    repeats = pa.array(np.repeat(rows, [len(p[0]) for p in parts]))
                    found = [pa.array(np.concatenate(c)) for c in list(zip(*parts))[1:]]
                    facts = keys.take(pa.array(np.concatenate([p[0] for p in parts])))
                    return pa.RecordBatch.from_arrays([batch.column(0).take(repeats), facts, *found], names=names)

                for k, value in enumerate(batch.column(1)):
                    counts = postings.counts(value.as_py().decode("utf-8", "replace"))
                    found = None if counts is None else finish(counts, postings.brief)
                    if found is not None and len(found[0]):
                        rows.append(k)
                        parts.append(found)
                        waiting += len(found[0])
                    if waiting >= GIVEN_ROWS:
                        yield given_rows()
                        rows, parts, waiting = [], [], 0
                if parts:
                    yield given_rows()

        return given.mapInArrow(run, schema)
