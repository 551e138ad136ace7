"""The four tab-separated tables: reading (plain or gzip), typing, ordering and de-duplication on ingest."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from titleforge import schema as S
from titleforge.errors import DataError

FILES = {"titles": "title.basics.tsv", "akas": "title.akas.tsv", "episodes": "title.episode.tsv", "ratings": "title.ratings.tsv"}
_RAW = {"titles": S.TITLES_RAW, "akas": S.AKAS_RAW, "episodes": S.EPISODES_RAW, "ratings": S.RATINGS_RAW}
_KEYS = {"titles": ["tconst"], "akas": ["titleId", "ordering"], "episodes": ["tconst"], "ratings": ["tconst"]}


def missing_tables(data_dir: str) -> list[str]:
    """The tables of which there is no file, plain or compressed, or an empty one."""
    size = lambda p: os.path.getsize(p) if os.path.exists(p) else 0
    return [t for t, f in FILES.items() if not size(os.path.join(data_dir, f)) and not size(os.path.join(data_dir, f + ".gz"))]


def read_raw(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tabs, a header, no quoting; \\N is null."""
    return spark.read.schema(schema).options(sep="\t", header=True, quote="", escape="", nullValue="\\N", enforceSchema=False).csv(path)


def write_raw(raw: DataFrame, path: str) -> None:
    """A raw table as text that read_raw reads: null is \\N, and no field may hold a tab or a line's end."""
    raw.write.mode("overwrite").options(sep="\t", header=True, quote="", escape="", nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def number(c: str) -> Column:
    """An unsigned number; null for anything else."""
    return F.expr(f"try_cast(case when {c} rlike '^[0-9]+$' then {c} end as int)")


def _strict_kind(c: str) -> Column:
    return F.when(F.col(c).isin(*S.KINDS), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("unknown title kind: "), F.coalesce(F.col(c), F.lit("null")))).cast("string"))


def typed(name: str, raw: DataFrame, strict: bool = True) -> DataFrame:
    """A raw table in the engine's schema. Empty texts come from the reader as null and are '' again; an unknown kind or flag is an error if strict."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    if name == "titles":
        kind = _strict_kind("titleType") if strict else F.when(F.col("titleType").isin(*S.KINDS), F.col("titleType"))
        adult = (F.col("isAdult").cast("int") if strict else F.expr("try_cast(isAdult as int)")) != 0
        return raw.select(F.col("tconst").alias("id"), kind.alias("kind"), text("primaryTitle").alias("title"), text("originalTitle").alias("original_title"), F.coalesce(adult, F.lit(False)).alias("is_adult"), number("startYear").alias("start_year"), number("endYear").alias("end_year"), number("runtimeMinutes").alias("runtime_minutes"), text("genres").alias("genres"))
    if name == "akas":
        return raw.select(F.col("titleId").alias("id"), "ordering", text("title").alias("title"), "region", "language", "types", "attributes", F.expr("try_cast(isOriginalTitle as int) <> 0").alias("is_original"))
    if name == "episodes":
        return raw.select(F.col("tconst").alias("id"), F.col("parentTconst").alias("tvshow_id"), number("seasonNumber").alias("season"), number("episodeNumber").alias("episode"))
    if name == "ratings":
        return raw.select(F.col("tconst").alias("id"), F.col("averageRating").alias("rating"), F.col("numVotes").alias("votes"))
    raise DataError(f"no such table: {name}")


def first_lines(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the one whose fields come first in order."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in raw.columns]
    w = Window.partitionBy(*keys).orderBy(F.concat_ws("\t", *fields))
    return raw.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def read_table(spark: SparkSession, data_dir: str, name: str, dedup_first_column: bool = False, strict: bool = True) -> DataFrame:
    """A table of a folder, one row for each natural key (or, on demand, for each value of the first column)."""
    path = os.path.join(data_dir, FILES[name])
    path = path if os.path.exists(path) or not os.path.exists(path + ".gz") else path + ".gz"
    if path.startswith("/") and not os.path.exists(path):
        raise DataError(f"there is no file {path}")
    raw = read_raw(spark, path, _RAW[name])
    return typed(name, first_lines(raw, _KEYS[name][:1] if dedup_first_column else _KEYS[name]), strict)


def rewrite(spark: SparkSession, data_dir: str, name: str) -> None:
    """A table's file without lines that repeat a key, in the order of its lines. The old one is replaced when the new one is whole."""
    path = os.path.join(data_dir, FILES[name])
    old = path if os.path.exists(path) else path + ".gz"
    raw = first_lines(read_raw(spark, old, _RAW[name]), _KEYS[name])
    write_raw(raw.orderBy(*_KEYS[name]).coalesce(1), path + ".new")
    (part,) = [f for f in os.listdir(path + ".new") if f.startswith("part-")]
    os.replace(os.path.join(path + ".new", part), path + ".tmp")
    shutil.rmtree(path + ".new")
    if os.path.isdir(path):
        shutil.rmtree(path)
    os.replace(path + ".tmp", path)
