"""A training corpus from documents, in five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from titleforge.llm import decontam, langid, linededup, mixing, simhash
from titleforge.llm.common import read_table, shared_dir

STAGES = [
    ("language_id", lambda spark, docs, sf_dir: langid.stage(docs)),
    ("line_dedup", lambda spark, docs, sf_dir: linededup.stage(docs)),
    ("near_dedup", lambda spark, docs, sf_dir: simhash.stage(docs)),
    ("decontamination", lambda spark, docs, sf_dir: decontam.stage(docs, read_table(spark, sf_dir, "benchmark"))),
    ("mixing", lambda spark, docs, sf_dir: mixing.stage(docs)),
]

#: SQL can't express the trained models of the first stage, the fingerprints of the third or the raking of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage keeps of documents. The stages' tables stay in a folder of their own in the shared folder."""
    at = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
