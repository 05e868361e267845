"""Stored state of agents, tick results and chapter states: JSON in, partitioned Parquet and JSON out.

A writer never overwrites what a plan may still be reading: it writes a new snapshot beside the old one and
then moves a pointer file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.vault import exists

MEMORY = "struct<id:string,content:string,type:string,created_at_chapter:int,importance:int,tags:array<string>,location:string>"
BELIEF = "struct<subject:string,proposition:string,confidence:double,source_memories:array<string>,created_at_chapter:int,status:string,revised_evidence:string>"
KNOWLEDGE = "map<string,struct<confidence:double,source:string,confirmed_at_chapter:int>>"
STATE = f"name string, role string, memories array<{MEMORY}>, beliefs array<{BELIEF}>, goals struct<immediate:string,arc:string,story:string>, emotional_state string, mutation_phase int, perception_stage string, location string, relationships map<string,struct<type:string,trust:double,tension:double>>, knowledge {KNOWLEDGE}, tom map<string,map<string,string>>, unknown_to_character array<string>"
REQUIRED_TICK = ("arc_id", "character_trajectories", "suggested_chapter_split")


def load_states(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each agent file; missing keys get defaults, files that aren't JSON are left out."""
    if not exists(spark, f"{folder}/*.json"):
        return spark.createDataFrame([], STATE)
    return states_of(spark.read.text(f"{folder}/*.json", wholetext=True))


def states_of(texts: DataFrame, text: str = "value") -> DataFrame:
    """States from JSON texts; missing keys get defaults, texts that aren't JSON are left out."""
    read = texts.select(F.from_json(text, STATE + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("s")).select("s.*").where("_broken is null")
    return read.drop("_broken").withColumns({
        "emotional_state": F.coalesce("emotional_state", F.lit("平静")), "mutation_phase": F.coalesce("mutation_phase", F.lit(0)),
        "perception_stage": F.coalesce("perception_stage", F.lit("")), "location": F.coalesce("location", F.lit("")),
    })


def memories_of(states: DataFrame) -> DataFrame:
    return states.select(F.col("name").alias("agent"), F.posexplode("memories").alias("seq", "m")).select("agent", "seq", "m.*")


def beliefs_of(states: DataFrame) -> DataFrame:
    held = states.select(F.col("name").alias("agent"), F.posexplode("beliefs").alias("seq", "b")).select("agent", "seq", "b.*")
    return held.withColumns({"status": F.coalesce("status", F.lit("active")), "confidence": F.coalesce("confidence", F.lit(0.0))})


def knowledge_of(states: DataFrame) -> DataFrame:
    return states.select(F.col("name").alias("agent"), F.explode("knowledge").alias("fact_id", "k")).select("agent", "fact_id", "k.*")


def tom_of(states: DataFrame) -> DataFrame:
    pairs = states.select(F.col("name").alias("who"), F.explode("tom").alias("target", "v"))
    return pairs.select("who", "target", F.explode("v").alias("fact_id", "verdict"))


class Moved(RuntimeError):
    """Another writer has saved a snapshot meanwhile."""


def _listed(spark: SparkSession, pattern: str) -> list:
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return list(place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or [])


def version(spark: SparkSession, folder: str) -> int:
    """The number of the last snapshot's pointer; 0 before the first."""
    return max((int(f.getPath().getName()[len("current-") : -len(".txt")]) for f in _listed(spark, f"{folder}/current-*.txt")), default=0)


def _pointer(folder: str, number: int) -> str:
    return f"{folder}/current-{number:09d}.txt"


def _write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, overwrite)
    out.write(bytearray(text.encode()))
    out.close()


def save_snapshot(rows: DataFrame, folder: str, partition_by: Sequence[str] = (), keep: int = 2, after: int | None = None) -> str:
    """Write ``rows`` as a new snapshot and point to it; the path is returned. The last ``keep`` snapshots stay, the new one among them.

    Pointers are numbered and a number is given out once: if another writer has saved after version ``after`` (default: the one at the start),
    this snapshot goes again and ``Moved`` is raised, so that no update is lost.
    """
    spark = rows.sparkSession
    after = version(spark, folder) if after is None else after
    path = f"{folder}/snapshot-{uuid.uuid4().hex}"
    rows.write.partitionBy(*partition_by).parquet(path)
    files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        if version(spark, folder) != after:
            raise Moved(folder)
        _write_text(spark, _pointer(folder, after + 1), path, overwrite=False)
    except (Moved, Py4JJavaError) as error:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
        if isinstance(error, Moved) or "FileAlreadyExists" in str(error):
            raise Moved(folder) from error
        raise
    held = [f for f in _listed(spark, f"{folder}/snapshot-*") if not path.endswith(f.getPath().getName())]
    for old in sorted(held, key=lambda f: f.getModificationTime(), reverse=True)[keep - 1 :]:
        files.delete(old.getPath(), True)
    for old in _listed(spark, f"{folder}/current-*.txt"):
        if old.getPath().getName() <= f"current-{after + 1 - keep:09d}.txt":
            files.delete(old.getPath(), False)
    return path


def load_snapshot(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame | None:
    """What the last ``save_snapshot`` (or that of ``number``) has written; None before the first."""
    number = version(spark, folder) if number is None else number
    if not number:
        return None
    return spark.read.parquet(spark.read.text(_pointer(folder, number), wholetext=True).first().value)


def upsert_snapshot(rows: DataFrame, folder: str, keys: Sequence[str], partition_by: Sequence[str] = (), tries: int = 3) -> str:
    """A snapshot of the old rows whose keys aren't in ``rows``, and of ``rows``; made again if another writer was first."""
    for left in reversed(range(tries)):
        at = version(rows.sparkSession, folder)
        old = load_snapshot(rows.sparkSession, folder, at)
        try:
            return save_snapshot(rows if old is None else old.join(rows, list(keys), "left_anti").unionByName(rows), folder, partition_by, after=at)
        except Moved:
            if not left:
                raise
    raise ValueError("tries must be 1 or more")


def clear(spark: SparkSession, folder: str, agent: str | None = None) -> None:
    """Forget one agent or all of them, in older snapshots too."""
    old = load_snapshot(spark, folder)
    if old is not None:
        save_snapshot(old.where(F.col("agent") != agent) if agent is not None else old.limit(0), folder, keep=1)


def as_json(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One JSON object for each row."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def write_notes(rows: DataFrame, path: str, column: str = "markdown", by: str | None = None) -> None:
    """Markdown blocks as text files, one folder for each ``by``."""
    kept = rows.select(F.col(column).alias("value"), *([by] if by else []))
    (kept.write.partitionBy(by) if by else kept.write).text(path)


def save_tick(result: DataFrame, folder: str, stamp: str) -> str:
    """A tick result under its time stamp, and a pointer to the latest."""
    path = f"{folder}/tick-{stamp}"
    result.write.json(path)
    _write_text(result.sparkSession, f"{folder}/latest.txt", path)
    return path


def load_tick(spark: SparkSession, path: str, required: Sequence[str] = REQUIRED_TICK) -> dict:
    """A tick result as a dict; its required keys must be there."""
    found = json.loads(spark.read.text(path, wholetext=True).first().value)
    missing = [k for k in required if k not in found]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return found


TICK_EVENT = "struct<day:int,time:string,location:string,brief:string,pov:string>"


def tick_events(spark: SparkSession, tick: dict) -> DataFrame:
    """pov, seq, day, time, location, brief of a tick result's trajectories."""
    rows = [(pov, k, e.get("day", 0), e.get("time", ""), e.get("location", "?"), e.get("brief", "")) for pov, held in tick.get("character_trajectories", {}).items() for k, e in enumerate(held)]
    return spark.createDataFrame(rows, "pov string, seq int, day int, time string, location string, brief string")


def chapter_note(markdown: DataFrame, novel: str, folder: str) -> str:
    """Upsert chapters' sections (chapter, markdown) of a novel's state note."""
    return upsert_snapshot(markdown.withColumn("novel", F.lit(novel)), folder, ["novel", "chapter"])


#: Buckets of a table that is upserted in part.
BUCKETS = 64


def upsert_buckets(rows: DataFrame, folder: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Replace the rows of ``rows``' keys in the table at ``folder``, and add those of new keys; only the buckets of these keys are read and written.

    A bucket is a hash of the keys. The new files of all touched buckets are complete before any old one goes (dynamic partition
    overwrite), and the other buckets' files stay as they are. Readers of a table between both see the old or the new files of a bucket.
    ``rows`` must not read the table; keys that repeat in ``rows`` all stay.
    """
    spark = rows.sparkSession
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    if exists(spark, f"{folder}/bucket=*"):
        old = spark.read.schema(placed.schema).option("basePath", folder).parquet(folder)
        touched = [r.bucket for r in placed.select("bucket").distinct().collect()]  # no more than ``buckets``
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
        kept = old.where(F.col("bucket").isin(touched)).alias("o").join(placed.select(*keys).distinct().alias("n"), same, "left_anti")
        placed = kept.select(*placed.columns).unionByName(placed)
    placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def bucketed(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table that ``upsert_buckets`` has written; None before the first."""
    return spark.read.option("basePath", folder).parquet(folder).drop("bucket") if exists(spark, f"{folder}/bucket=*") else None
