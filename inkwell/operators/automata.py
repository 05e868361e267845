"""Which of many words or passages a text holds: one Aho-Corasick automaton, one pass over a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of the words of one automaton, which is broadcast; more words make more automata, each of which reads the texts.
PART_CHARS = 4 << 20

_built: tuple[list, ahocorasick.Automaton] | None = None


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    """A worker keeps the automaton of the broadcast words that it has used last."""
    global _built
    if _built is None or _built[0] is not words:
        found = ahocorasick.Automaton()
        for word in words:
            found.add_word(word, word)
        if len(found):
            found.make_automaton()
        _built = (words, found)
    return _built[1]


def scanned(texts: DataFrame, key: str, text: str, words: DataFrame, word: str, marked: Callable, kind: str, part_chars: int = PART_CHARS) -> DataFrame:
    """key and the columns ``kind`` that ``marked(values, found, part)`` makes of a batch's texts: (row of each mark, its columns).

    ``found(text)`` gives the words in a text. Where words make more than one automaton, each ``part`` of them is a pass of its own.
    """
    spark = texts.sparkSession
    listed = words.select(F.col(word).alias("word")).where(F.length("word") > 0).distinct().persist()
    given = texts.select(key, F.col(text).alias("_text"))
    schema = StructType([*given.select(key).schema, *StructType.fromDDL(kind)])
    parts = max(1, -(-(listed.agg(F.sum(F.length("word"))).first()[0] or 0) // part_chars))

    def scan(part: int) -> DataFrame:
        own = [r.word for r in listed.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == part).collect()]
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared.value)

            def found(value: str) -> set[str] | tuple:
                return {w for _, w in automaton.iter(value)} if len(automaton) else ()

            for batch in batches:
                rows, columns = marked(batch.column(1).to_pylist(), found, part)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=schema.names)

        return given.mapInArrow(run, schema)

    every = scan(0)
    for part in range(1, parts):
        every = every.unionByName(scan(part))
    listed.unpersist()
    return every


def words_in(texts: DataFrame, key: str, text: str, words: DataFrame, word: str = "word", part_chars: int = PART_CHARS) -> DataFrame:
    """key and ``word``, once for each row of ``texts`` and each of ``words`` that its ``text`` holds. Nulls and empty words hold, and are held by, nothing."""

    def marked(values: list[str], found: Callable, part: int) -> tuple[list[int], list[pa.Array]]:
        held = [(k, w) for k, value in enumerate(values) for w in found(value)]
        return [k for k, _ in held], [pa.array([w for _, w in held], pa.string())]

    return scanned(texts.where(F.length(text) > 0), key, text, words, word, marked, f"{word} string", part_chars)
