"""Gates over streams. The batch operators carry no state between rows of different keys, so most run as they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators import style


def document_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def overused_stream(docs: DataFrame, key: str, limits: dict[str, int | None]) -> DataFrame:
    """Words used too often in each arriving document; stateless."""
    return style.overused(docs, key, limits)


def windowed_scenes(events: DataFrame, ts: str = "ts", late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Agents and events of each place and hour; a window closes ``late`` after its end."""
    held = events.withWatermark(ts, late).groupBy(F.window(ts, length), "location")
    return held.agg(F.approx_count_distinct("agent").alias("n_agents"), F.count("*").alias("n_events"))


def keep_violations(docs: DataFrame, key: str, fatal: Sequence[str], high: Sequence[str], out: str, checkpoint: str):
    """Write the line violations of each micro-batch; a batch that is repeated overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        style.line_violations(batch, key, fatal, high).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
