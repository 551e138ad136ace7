"""What the operators share: the cluster's shared folder, lineage cuts, key columns, bounded training samples."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from titleforge.llm.textvec import doc_groups, text_bytes

_HIGH = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary folder only on a single machine without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="titleforge-"))
    return spark.sparkContext.getCheckpointDir()


#: Rows of an Arrow batch, where the session has Spark's own default: texts may be long, and a batch is in memory on both sides.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once a Spark context, so that jobs run wherever the driver imported it from."""
    sc, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, BATCH_ROWS)
    if getattr(sc, "_titleforge_llm", False):
        return
    package = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(), "titleforge_llm.zip")
    with zipfile.ZipFile(to, "w") as z:
        z.writestr("titleforge/__init__.py", "")
        for p in sorted(package.glob("*.py")):
            z.write(p, f"titleforge/llm/{p.name}")
    sc.addPyFile(to)
    sc._titleforge_llm = True


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (local, or any that Arrow knows) and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **cols: Column) -> DataFrame:
    """All columns of df in one struct ``row``, so that no column of the caller can clash with the operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[v.alias(k) for k, v in cols.items()])


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that were packed, in their order, with those in ``changed`` replaced."""
    return df.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in columns])


def id_type(docs: DataFrame, id_col: str) -> T.DataType:
    """What ids are compared as: whole numbers as such, ids of any other type by their text."""
    kind = docs.schema[id_col].dataType
    return T.LongType() if isinstance(kind, (T.IntegralType, T.NullType)) else T.StringType()


def id_of(docs: DataFrame, id_col: str) -> Column:
    return F.col(f"`{id_col}`").cast(id_type(docs, id_col))


def doc_key(doc_id: Column, text_hash: Column, kind: T.DataType = T.LongType()) -> Column:
    """A struct whose order is: rows with an id first, by id, then by the hash of the text."""
    none = F.lit(_HIGH) if isinstance(kind, T.LongType) else F.lit("")
    return F.struct(doc_id.isNull().alias("no_id"), F.coalesce(doc_id, none).alias("id"), text_hash.alias("th"))


def key_id(key: Column) -> Column:
    return F.when(~key["no_id"], key["id"])


def count_words(text: Column) -> Column:
    """Runs of characters other than blanks, 0 for null. An Arrow batch takes a quarter of what a regular expression takes in the JVM."""

    @F.arrow_udf(T.LongType())
    def run(texts: pa.Array) -> pa.Array:
        data, offs = text_bytes(texts)
        out = np.zeros(len(offs) - 1, dtype=np.int64)
        for d0, d1 in doc_groups(offs):
            part = data[offs[d0] : offs[d1]]
            blank = (part == 32) | ((part >= 9) & (part <= 13))
            begins = ~blank
            begins[1:] &= blank[:-1]
            own = offs[d0 : d1 + 1] - offs[d0]
            heads = own[:-1][own[:-1] < own[1:]]  # a text's first character begins a word whatever is before it
            begins[heads] = ~blank[heads]
            out[d0:d1] = np.diff(np.searchsorted(np.flatnonzero(begins), own))
        return pa.array(out, pa.int64())

    return run.asNondeterministic()(text)  # else filters below it would run it once more


def sample_by_class(rows: DataFrame, label: str, order: Column, per_class: int) -> DataFrame:
    """At most per_class rows of each label, the first by ``order``; the rank limit is applied before the shuffle."""
    w = Window.partitionBy(label).orderBy("_order", *[c for c in rows.columns if c != label])
    return rows.withColumn("_order", order).withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= per_class).drop("_order", "_rank")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int) -> list:
    """At most per_class rows (id, y, t) of each label 0 and 1, in an order that the data alone decide. Texts that are null or empty are left out."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1)).distinct()
    chosen = sample_by_class(known, "y", F.xxhash64("id", F.lit(seed)), per_class)  # at most 2 * per_class ids, so it may be broadcast
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).filter(F.col("t") != "").join(F.broadcast(chosen), "id")
    rows = sample_by_class(rows, "y", F.xxhash64("id", "t", F.lit(seed)), per_class)
    return sorted(rows.withColumn("h", F.xxhash64("id", "t", F.lit(seed))).collect(), key=lambda r: (r["h"], str(r["id"]), r["y"], r["t"]))


def with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])
