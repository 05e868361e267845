"""A training corpus from ``documents``: each stage reads what the one before it kept, from Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.common import delete, shared_folder, table
from inkwell.llm.langid import keep_identified
from inkwell.llm.mixing import mix_sources
from inkwell.llm.pieces import encode_corpus
from inkwell.llm.secrets import redact_secrets
from inkwell.llm.simhash import keep_one

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("language_id", keep_identified),
    ("near_duplicates", keep_one),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_corpus),
]

#: SQL has neither the compression nor the Viterbi that the stages need; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stages are written below ``spark.checkpoint.dir``; each is deleted once the next is there.

    The last stage's folder is what the returned rows are read from, so it stays until its reader deletes it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    written = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if written:
            delete(spark, written)
        written = path
    return docs
