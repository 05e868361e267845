"""Parquet tables of a folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Files of at most so many bytes together are dealt out to all cores.
SMALL_BYTES = 16 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """A table as read, dealt out to all cores if its files are small.

    A row group is read by one task, so a small file would leave all cores but one idle in the work that
    follows. Larger tables have row groups enough and stay where they are: nothing of them is shuffled.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most else df


def kept(df: DataFrame) -> DataFrame:
    """``df`` as rows below ``shared_place``: what is used more than once is found once."""
    path = f"{shared_place(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_own_folder: str | None = None


def shared_place(spark: SparkSession) -> str:
    """Where executors and the driver may write: ``spark.checkpoint.dir``. A session on one machine may do without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _own_folder
    _own_folder = _own_folder or tempfile.mkdtemp(prefix="shared-")
    return _own_folder
