"""Steps that need a language model, behind a function that is passed in.

A model is any picklable ``f(system, prompt) -> str``. Calls run in ``mapInPandas`` on the executors, so the
client must be made inside the function or be picklable. Without one, a deterministic stub answers, and every
plan can be run and checked offline. ``paid_once`` keeps answers: it calls once for each distinct question, also when
tasks fail and in later runs. The others call for each row, and again where a task is retried.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.text import blank_to_null
from inkwell.sources.model_json import extract_json
from inkwell.sources.vault import exists
from inkwell.sources.vault_source import opened

Model = Callable[[str, str], str]
#: Calls for a text, and for an object that must parse (each of which is retried once when it fails).
TEXT_TRIES, OBJECT_TRIES = 2, 3


def stub(system: str, prompt: str) -> str:
    """A fixed answer for each question: the prompt's last line and a fingerprint."""
    mark = hashlib.sha256(f"{system}\0{prompt}".encode()).hexdigest()[:8]
    last = prompt.strip().split("\n")[-1] if prompt.strip() else ""
    return f"[{mark}] {last}"


def stub_object(system: str, prompt: str) -> str:
    return json.dumps({"stub": hashlib.sha256(f"{system}\0{prompt}".encode()).hexdigest()[:8]})


def _tried(model: Model, system: str, prompt: str, tries: int) -> str | None:
    for _ in range(tries):
        try:
            return model(system, prompt)
        except Exception:  # whatever a client raises: a failed call is a missing answer  # noqa: BLE001, S112
            continue
    return None


def answered(asks: DataFrame, model: Model = stub, name: str = "answer", cache: DataFrame | None = None) -> DataFrame:
    """``asks(key, system, prompt)`` with the model's text, null where every try failed."""
    hashed = asks.withColumn("asked", F.sha2(F.concat_ws("\0", "system", "prompt"), 256))
    if cache is not None:
        known = hashed.join(cache.select("asked", F.col("answer").alias(name)), "asked")
        return known.unionByName(_asked(hashed.join(cache, "asked", "left_anti"), model, name, TEXT_TRIES, False))
    return _asked(hashed, model, name, TEXT_TRIES, False)


ANSWERS = "asked string, answer string"
#: Questions of a task and calls that it has under way at once.
TASK_CALLS, CALLS_AT_ONCE = 200, 8


def _noted(model: Model, journal: str, tries: int, at_once: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over (asked, system, prompt): answers, each written to ``journal`` as it comes and read from there by a task that runs again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(journal)

        def one(asked: str, system: str, prompt: str) -> str | None:
            place = f"{root}/{asked[:2]}/{asked}"
            if store.get_file_info(place).type == pafs.FileType.File:
                with store.open_input_stream(place) as file:
                    return file.read().decode()
            answer = _tried(model, system or "", prompt or "", tries)
            if answer is not None:
                store.create_dir(f"{root}/{asked[:2]}")
                part = f"{place}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(answer.encode())
                store.move(part, place)
            return answer

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                yield batch[["asked"]].assign(answer=pd.Series(list(pool.map(one, batch["asked"], batch["system"], batch["prompt"])), index=batch.index, dtype=object))

    return run


def paid_once(asks: DataFrame, folder: str, model: Model = stub, name: str = "answer", tries: int = TEXT_TRIES, at_once: int = CALLS_AT_ONCE) -> DataFrame:
    """``asks(system, prompt, ...)`` with the model's text, null where every try failed; answers are kept in ``folder``.

    Equal questions are one call. Questions whose answers are kept aren't asked; the others' answers are written before anything reads
    them. Within a run each answer is also noted by itself as it comes, so that a task that is run again asks only what wasn't
    answered; the notes go once the table is there. Failed questions are asked again in the next run. Two attempts of one task at the same
    time (speculation) may both call. ``folder`` is one that executors share, used by one run at a time.
    """
    spark = asks.sparkSession
    hashed = asks.withColumn("_asked", F.sha2(F.concat_ws("\0", F.coalesce("system", F.lit("")), F.coalesce("prompt", F.lit(""))), 256))
    table, journal = f"{folder}/answers", f"{folder}/notes"
    known = spark.read.schema(ANSWERS).parquet(table) if exists(spark, f"{table}/*.parquet") else spark.createDataFrame([], ANSWERS)
    wanted = hashed.groupBy(F.col("_asked").alias("asked")).agg(F.first("system").alias("system"), F.first("prompt").alias("prompt")).join(known, "asked", "left_anti")
    n = wanted.count()
    if n:
        dealt = wanted.repartition(max(1, -(-n // TASK_CALLS)), "asked")
        dealt.mapInPandas(_noted(model, journal, tries, at_once), ANSWERS).where("answer IS NOT NULL").write.mode("append").parquet(table)
        place = spark._jvm.org.apache.hadoop.fs.Path(journal)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        known = spark.read.schema(ANSWERS).parquet(table) if exists(spark, f"{table}/*.parquet") else known
    answers = known.select(F.col("asked").alias("_asked"), F.col("answer").alias(name))
    return hashed.join(answers, "_asked", "left").select(*[hashed[c] for c in asks.columns], name)


def answered_objects(asks: DataFrame, model: Model = stub_object, name: str = "answer") -> DataFrame:
    """``asks(key, system, prompt)`` with an object as JSON; ``{}`` where no try gave one."""
    return _asked(asks.withColumn("asked", F.sha2(F.concat_ws("\0", "system", "prompt"), 256)), model, name, TEXT_TRIES, True)


def _asked(asks: DataFrame, model: Model, name: str, tries: int, objects: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for system, prompt in zip(batch["system"], batch["prompt"]):
                if not objects:
                    out.append(_tried(model, system or "", prompt or "", tries))
                    continue
                found = None
                for _ in range(OBJECT_TRIES):
                    found = extract_json(_tried(model, system or "", prompt or "", tries))
                    if found is not None:
                        break
                out.append(json.dumps(found or {}, ensure_ascii=False))
            yield batch.assign(**{name: pd.Series(out, index=batch.index, dtype=object)})

    return asks.mapInPandas(run, T.StructType([*asks.schema.fields, T.StructField(name, T.StringType())]))


def repaired(texts: DataFrame, model: Model, system: str, key: str, text: str = "text") -> DataFrame:
    """``texts`` rewritten by the model; a rewrite that is missing or lost over half of the length is refused."""
    asks = texts.select(key, F.lit(system).alias("system"), F.col(text).alias("prompt"))
    new = answered(asks, model, "_new").select(key, "_new")
    held = F.col(text)
    kept = F.when(F.length("_new") < 0.5 * F.length(held), held).otherwise(F.coalesce(blank_to_null(F.col("_new")), held))
    return texts.join(new, key).withColumn(text, kept).drop("_new")


def reflections(replies: DataFrame, chapter: Column, agent: str = "agent") -> DataFrame:
    """Memories from replies (agent, answer JSON): content, importance (7 without one), tags and ``reflection``."""
    schema = "reflections array<struct<content:string,importance:int,tags:array<string>>>"
    rows = replies.select(agent, F.posexplode(F.from_json("answer", schema)["reflections"]).alias("at", "r")).where(F.length("r.content") > 0)
    return rows.select(
        agent, F.concat_ws("_", F.col(agent).cast("string"), F.lit("refl"), chapter.cast("string"), F.col("at").cast("string")).alias("id"), "r.content", F.lit("reflection").alias("type"), chapter.alias("created_at_chapter"),
        F.coalesce("r.importance", F.lit(7)).alias("importance"), F.concat(F.coalesce("r.tags", F.array().cast("array<string>")), F.array(F.lit("reflection"))).alias("tags"),
    )


def turns(replies: DataFrame) -> DataFrame:
    """Turns of shared scenes (day, location, answer JSON)."""
    schema = "turns array<struct<agent:string,time:string,action:string,inner:string>>"
    rows = replies.select("day", "location", F.posexplode(F.from_json("answer", schema)["turns"]).alias("seq", "t"))
    return rows.select("day", "location", "seq", "t.*")


def actions(replies: DataFrame, agent: str = "agent") -> DataFrame:
    """Actions of agents (agent, answer JSON); either key of visibility counts."""
    fields = "day:int,time:string,location:string,action:string,inner:string,warm_action:string,visible_to_protagonist:boolean,visible:boolean"
    rows = replies.select(agent, F.posexplode(F.from_json("answer", f"actions array<struct<{fields}>>")["actions"]).alias("seq", "a")).select(agent, "seq", "a.*")
    return rows.withColumn("visible", F.coalesce("visible_to_protagonist", "visible")).drop("visible_to_protagonist")


def belief_updates(replies: DataFrame, agent: str = "agent") -> DataFrame:
    """Belief updates of agents, under either name that models use."""
    one = "array<struct<subject:string,proposition:string,confidence:double,revises:string,evidence:string>>"
    parsed = F.from_json("answer", f"belief_updates {one}, beliefs_at_end {one}")
    held = F.coalesce(parsed["belief_updates"], parsed["beliefs_at_end"])
    return replies.select(agent, F.posexplode(held).alias("seq", "b")).select(agent, "seq", "b.*")
