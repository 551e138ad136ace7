"""The folder that the driver and all executors share, for what is written and read again."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only on a single machine without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="titleforge-"))
    return spark.sparkContext.getCheckpointDir()


def place(spark: SparkSession, kind: str, *key: object) -> str:
    """A folder of this application for what ``key`` says; the same key is the same folder."""
    name = hashlib.sha1(repr(key).encode()).hexdigest()[:16]
    return f"{shared_dir(spark)}/titleforge-{spark.sparkContext.applicationId}/{kind}-{name}"
