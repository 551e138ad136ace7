"""The driver's tables in the roles of the engine's: documents are titles, their labels ratings, some of them episodes."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.functions.analysis import NgramType
from titleforge.operators.index import NameIndex, title_names
from titleforge.operators.search import Catalog
from titleforge.sources.shared import place


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores (a small file of one row group), dealt out to all of them; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "movie").when(F.col("lang") == "de", "tvSeries").when(F.col("lang") == "fr", "tvEpisode").otherwise("short")
    year = F.when(F.col("doc_id") % 10 != 9, (1900 + F.col("n_chars") % 120).cast("int"))
    named = d.select(
        F.concat(F.lit("d"), "doc_id").alias("id"), kind.alias("kind"), F.substring("text", 1, 40).alias("title"), F.substring("text", 41, 40).alias("original_title"),
        (F.col("doc_id") % 50 == 49).alias("is_adult"), year.alias("start_year"), F.when(F.col("lang") == "de", year + 5).alias("end_year"), (F.col("n_chars") % 200).cast("int").alias("runtime_minutes"), F.col("source").alias("genres"),
    )
    return spread(named)


def akas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two alternate names of every third document."""
    d = read(spark, sf_dir, "documents").filter("doc_id % 3 = 0")
    slices = F.array(F.struct(F.lit(1).alias("ordering"), F.substring("text", 81, 30).alias("title")), F.struct(F.lit(2).alias("ordering"), F.substring("text", 111, 30).alias("title")))
    return spread(d.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.explode(slices).alias("s"), F.col("lang").alias("region"))).select("id", "s.ordering", "s.title", "region", F.lit(None).cast("string").alias("language")).filter("title <> ''")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").filter("lang = 'fr'")
    return d.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.concat(F.lit("d"), F.col("doc_id") % 40).alias("tvshow_id"), F.nullif((F.col("doc_id") % 6).cast("int"), F.lit(0)).alias("season"), F.nullif((F.col("doc_id") % 11).cast("int"), F.lit(0)).alias("episode"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select(F.concat(F.lit("d"), "doc_id").alias("id"), (F.col("quality") + 5).cast("float").alias("rating"), (F.col("doc_id") * 37 % 3000).alias("votes"))


def saved_index(spark: SparkSession, sf_dir: str, ngram: NgramType = NgramType.WINDOW, size: int = 3, include_adult: bool = False) -> NameIndex:
    """The index of all names of the tables, saved in the shared folder at its first use and loaded from there by all that follow in this application."""
    context, key = spark.sparkContext, (sf_dir, str(ngram), size, include_adult)
    saved = context.__dict__.setdefault("_titleforge_indexes", {})
    if key not in saved:
        saved[key] = place(spark, "index", *key)
        return NameIndex.create(title_names(titles(spark, sf_dir), akas(spark, sf_dir), include_adult), saved[key], ngram, size)
    return NameIndex.load(spark, saved[key])


def whole_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """A catalog for batches that go through all names: its index has no postings."""
    index = NameIndex.counted(title_names(titles(spark, sf_dir), akas(spark, sf_dir)), place(spark, "counted", sf_dir, uuid.uuid4().hex))
    return replace(catalog(spark, sf_dir, indexed=False), index=index)


def catalog(spark: SparkSession, sf_dir: str, indexed: bool = True, ngram: NgramType = NgramType.WINDOW, size: int = 3, include_adult: bool = False) -> Catalog:
    index = saved_index(spark, sf_dir, ngram, size, include_adult) if indexed else None
    return Catalog(titles(spark, sf_dir), index, akas(spark, sf_dir), episodes(spark, sf_dir), ratings(spark, sf_dir), include_adult)


SQL_TITLES = """titles AS (
  SELECT 'd' || doc_id AS id,
         CASE lang WHEN 'en' THEN 'movie' WHEN 'de' THEN 'tvSeries' WHEN 'fr' THEN 'tvEpisode' ELSE 'short' END AS kind,
         substring(text, 1, 40) AS title, substring(text, 41, 40) AS original_title, doc_id % 50 = 49 AS is_adult,
         CASE WHEN doc_id % 10 <> 9 THEN CAST(1900 + n_chars % 120 AS INT) END AS start_year,
         CASE WHEN doc_id % 10 <> 9 AND lang = 'de' THEN CAST(1905 + n_chars % 120 AS INT) END AS end_year,
         CAST(n_chars % 200 AS INT) AS runtime_minutes, source AS genres
  FROM documents),
akas AS (
  SELECT 'd' || doc_id AS id, o.ordering, substring(text, 51 + 30 * o.ordering, 30) AS title, lang AS region
  FROM documents, (VALUES (1), (2)) o(ordering) WHERE doc_id % 3 = 0 AND substring(text, 51 + 30 * o.ordering, 30) <> ''),
episodes AS (
  SELECT 'd' || doc_id AS id, 'd' || (doc_id % 40) AS tvshow_id, CAST(nullif(doc_id % 6, 0) AS INT) AS season, CAST(nullif(doc_id % 11, 0) AS INT) AS episode
  FROM documents WHERE lang = 'fr'),
ratings AS (SELECT 'd' || doc_id AS id, CAST(quality + 5 AS FLOAT) AS rating, doc_id * 37 % 3000 AS votes FROM labels),
shown AS (SELECT * FROM titles WHERE NOT is_adult)"""

SQL_NAMES = """names AS (
  SELECT id, 0 AS variant, title AS name FROM shown
  UNION ALL SELECT id, 1, original_title FROM shown WHERE original_title <> title
  UNION ALL SELECT t.id, 2 + a.ordering, a.title FROM shown t JOIN akas a ON a.id = t.id WHERE a.title <> t.title)"""


def sql_window(text: str, n: int = 3) -> str:
    return f"CASE WHEN length({text}) = 0 THEN [] ELSE list_transform(range(1, greatest(1, length({text}) - {n - 1}) + 1), lambda i: substring({text}, CAST(i AS INT), {n})) END"


def sql_edge(text: str, n: int) -> str:
    w = "list_filter(string_split_regex(" + text + r", '\s+'), lambda w: w <> '')"
    return f"flatten(list_transform({w}, lambda w: list_transform(range(least(3, length(w)), greatest(least(3, length(w)), least({n}, length(w))) + 1), lambda k: substring(w, 1, CAST(k AS INT)))))"
