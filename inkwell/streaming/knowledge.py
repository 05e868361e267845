"""What agents know, kept up to date while entries arrive.

Each (agent, fact) is a key with one value as its state, so that an agent who hears most of all entries is spread over the
tasks. A batch reads and writes the state of its own keys alone, and tells which of them have changed; what has
been told is a log of changes by batch, of which the last of a key holds. Before a batch is dealt by key, each of its tasks
keeps only the entries that its keys rest on, so that the Python state meets two rows of a key from a task, not all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from inkwell.sources.vault import exists

ENTRY = "agent {agent}, fact_id {fact}, confidence double, source {source}, confirmed_at_chapter int"
#: The state store that keyed state of this kind needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows among which a task looks for what its keys rest on; rows of a file of ``replayed``.
LOOKED_ROWS, FILE_ROWS = 500_000, 250_000


def _deciding(rows: pa.Table) -> pa.Table:
    """Of each (agent, fact_id) the best row and the first one, by ``seq``."""
    placed = rows.select(["agent", "fact_id", "seq", "confidence"]).append_column("at", pa.array(np.arange(rows.num_rows)))

    def first_by(order: list[tuple[str, str]]) -> pa.ChunkedArray:
        return placed.take(pc.sort_indices(placed, sort_keys=order)).group_by(["agent", "fact_id"], use_threads=False).aggregate([("at", "first")]).column("at_first")

    best, first = first_by([("confidence", "descending"), ("seq", "ascending")]), first_by([("seq", "ascending")])
    return rows.take(pc.unique(pa.chunked_array([*best.chunks, *first.chunks], pa.int64())))


def _deciding_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The deciding rows of a task's keys, of each run of ``LOOKED_ROWS`` where its keys are too many to be held."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= LOOKED_ROWS:
            kept = _deciding(pa.Table.from_batches(held))
            held, n = kept.to_batches(), kept.num_rows
            if 2 * n > LOOKED_ROWS:
                yield from held
                held, n = [], 0
    if held:
        yield from _deciding(pa.Table.from_batches(held)).to_batches()


class Knowing(StatefulProcessor):
    """The best entry of a key (its confidence and source, the first to reach it) and the chapter of its first one, by ``seq``."""

    def __init__(self, source: str):
        self.source = source

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", f"confidence double, best_seq long, source {self.source}, first_seq long, chapter int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old = tuple(self.held.get()) if self.held.exists() else None
        now = old
        for r in rows:
            best, first = (r.confidence, -r.seq, r.source), (r.seq, r.chapter)
            if now is not None:
                best = max((now[0], -now[1], now[2]), best, key=lambda b: b[:2])
                first = min((now[3], now[4]), first, key=lambda f: f[0])
            now = (best[0], -best[1], best[2], *first)
        if now != old:
            self.held.update(now)
            if old is None or (now[0], now[2], now[4]) != (old[0], old[2], old[4]):
                yield Row(agent=key[0], fact_id=key[1], confidence=now[0], source=now[2], confirmed_at_chapter=now[4])

    def close(self) -> None:
        pass


def advancing_knowledge(entries: DataFrame) -> DataFrame:
    """agent, fact_id, confidence, source, confirmed_at_chapter of the keys that a batch of ``entries`` changes.

    ``entries`` is a stream of (agent, fact_id, seq, confidence, source, chapter); entries without a confidence or a ``seq`` don't count. The last
    row told of a key is that of ``cognition.merged_knowledge`` over all its entries so far, in whatever order they came.
    """
    entries.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kinds = dict(entries.dtypes)
    given = entries.where("confidence IS NOT NULL AND seq IS NOT NULL").select("agent", "fact_id", F.col("seq").cast("long").alias("seq"), F.col("confidence").cast("double").alias("confidence"), "source", F.col("chapter").cast("int").alias("chapter"))
    out = ENTRY.format(agent=kinds["agent"], fact=kinds["fact_id"], source=kinds["source"])
    given = given.mapInArrow(_deciding_batches, given.schema)
    return given.groupBy("agent", "fact_id").transformWithState(statefulProcessor=Knowing(kinds["source"]), outputStructType=out, outputMode="Update", timeMode="None")


def keep_knowledge(entries: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write what each batch changes to its own folder; a batch that is repeated overwrites that folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    told = advancing_knowledge(entries).writeStream.outputMode("update").foreachBatch(write)
    return told.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def kept_knowledge(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table that the batches so far add up to; None before the first."""
    if not exists(spark, f"{folder}/batch=*"):
        return None
    told = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    row = F.struct("confidence", "source", "confirmed_at_chapter")
    return told.groupBy("agent", "fact_id").agg(F.max_by(row, "batch").alias("r")).select("agent", "fact_id", "r.*")


def replayed(entries: DataFrame, folder: str, batches: int, order: str = "seq") -> DataFrame:
    """The table after ``entries`` came as a stream of ``batches`` batches, by falling ``order`` (late ones last), with all state below ``folder``.

    A batch is as many files of about ``FILE_ROWS`` as it needs, so that it is written and read by as many tasks.
    """
    spark, place = entries.sparkSession, f"{folder}/replay-{uuid.uuid4().hex}"
    files = max(1, -(-entries.count() // (batches * FILE_ROWS)))
    entries.repartitionByRange(batches * files, F.desc(order)).write.parquet(f"{place}/in")
    arriving = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", files).parquet(f"{place}/in")
    keep_knowledge(arriving, f"{place}/out", f"{place}/state").awaitTermination()
    found = kept_knowledge(spark, f"{place}/out")
    return found if found is not None else advancing_schema(entries)


def advancing_schema(entries: DataFrame) -> DataFrame:
    """No rows of what ``kept_knowledge`` gives."""
    kinds = dict(entries.dtypes)
    return entries.sparkSession.createDataFrame([], ENTRY.format(agent=kinds["agent"], fact=kinds["fact_id"], source=kinds["source"]))
