"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.tables import read_table, spread

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which executors and the driver share.

    Where it is unset a session on one machine gets a temporary folder; on a cluster that would be lost data.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _own_folder
    _own_folder = _own_folder or tempfile.mkdtemp(prefix="checkpoint-")
    return _own_folder


_own_folder: str | None = None


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in ``shared_folder`` and cut its lineage."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def let_go(df: DataFrame) -> None:
    """Delete what ``cut`` has written for ``df``, which nothing may read any more."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.nodeName() == "LogicalRDD":
        written = plan.rdd().getCheckpointFile()
        if written.isDefined():
            delete(df.sparkSession, written.get())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one small file is spread over all cores."""
    return spread(read_table(spark, sf_dir, name))


def unsigned_share(column, seed: int = 0):
    """A repeatable value in [0, 1) from a column's value."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slice record batches so that one slice holds about ``most_bytes`` of ``column`` (or a single row)."""
    for batch in batches:
        start, held = 0, 0
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        for i, n in enumerate(lengths):
            if held and held + (n or 0) > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < len(lengths):
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The column's strings as UTF-8 bytes, without decoding them."""
    values = batch.column(batch.schema.get_field_index(column))
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return values.cast(kind).to_pylist()


def plain_names(docs: DataFrame, *kept: str) -> DataFrame:
    """``docs`` with every column but ``kept`` named by its place, so that added columns can't clash."""
    return docs.toDF(*[c if c in kept else f"_c{i}" for i, c in enumerate(docs.columns)])


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow that gives freed memory back at its end: a worker that waits for its next task would keep it."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole
