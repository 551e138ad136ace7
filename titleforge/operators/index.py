"""The name index: n-gram postings of every name of every title, as DataFrames; saved and loaded as Parquet."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.errors import ConfigError, CorruptIndex, VersionMismatch
from titleforge.functions.analysis import MAX_LENGTH, MAX_TF, NgramType, counted, ngrams, normalize

VERSION = 2


def title_names(titles: DataFrame, akas: DataFrame | None = None, include_adult: bool = False) -> DataFrame:
    """(id, variant, name): primary titles (variant 0), original titles that differ (1), alternate names that differ from the primary (2 + ordering).

    An alternate name equal to the original, or to another alternate name, is a name of its own.
    """
    t = titles if include_adult or "is_adult" not in titles.columns else titles.filter(~F.coalesce("is_adult", F.lit(False)))
    out = t.select("id", F.lit(0).cast("long").alias("variant"), F.col("title").alias("name"))
    if "original_title" in t.columns:
        out = out.unionByName(t.filter(F.col("original_title") != F.col("title")).select("id", F.lit(1).cast("long").alias("variant"), F.col("original_title").alias("name")))
    if akas is not None:
        a = akas.select("id", "ordering", F.col("title").alias("name"))
        other = t.select("id", "title").join(a, "id").filter(F.col("name") != F.col("title"))
        out = out.unionByName(other.select("id", (F.col("ordering").cast("long") + 2).alias("variant"), "name"))
    return out


def counted_names(names: DataFrame, ngram: NgramType, size: int) -> DataFrame:
    """(id, variant, doc_len, counts) of each name; counts are its distinct grams with their frequencies."""
    lowered = names.select("id", "variant", normalize(F.col("name")).alias("text"))
    d = counted(lowered, ngrams(F.col("text"), ngram, size), ["id", "variant"])
    return d.select("id", "variant", F.least("length", F.lit(MAX_LENGTH)).alias("doc_len"), F.transform("counts", lambda c: F.struct(c["term"].alias("term"), F.least(c["tf"], F.lit(MAX_TF)).alias("tf"))).alias("counts"))


def postings_of(docs: DataFrame) -> DataFrame:
    # explode would infer a filter on the array and push it, written out in full, below the projections that count.
    return docs.select("id", "variant", "doc_len", F.explode_outer("counts").alias("c")).filter("c is not null").select(F.col("c.term").alias("term"), "id", "variant", "doc_len", F.col("c.tf").alias("tf"))


@dataclass
class NameIndex:
    """docs(id, variant, doc_len, counts) by name, postings(term, id, variant, doc_len, tf) by term, terms(term, df), and the corpus's size and mean length."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    ngram: NgramType
    size: int

    @classmethod
    def build(cls, names: DataFrame, ngram: NgramType = NgramType.WINDOW, size: int = 3) -> "NameIndex":
        """Counting is within rows, so nothing is shuffled until something asks for terms or a saved index.

        What is built counts the grams anew each time it's used: save it and load it for more than one use.
        """
        if size < 1:
            raise ConfigError("the ngram size must be at least 1")
        docs = counted_names(names, ngram, size)
        n, avgdl = docs.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
        postings = postings_of(docs)
        return cls(docs, postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n, float(avgdl or 0.0), ngram, size)

    @classmethod
    def create(cls, names: DataFrame, path: str, ngram: NgramType = NgramType.WINDOW, size: int = 3) -> "NameIndex":
        """Build, save and load: the grams of each name are counted once."""
        if size < 1:
            raise ConfigError("the ngram size must be at least 1")
        spark = names.sparkSession
        counted_names(names, ngram, size).write.mode("overwrite").parquet(f"{path}/docs")
        docs = spark.read.parquet(f"{path}/docs")
        n, avgdl = docs.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
        cls(docs, postings_of(docs), docs, n, float(avgdl or 0.0), ngram, size)._save_terms(path)
        return cls.load(spark, path)

    @classmethod
    def counted(cls, names: DataFrame, path: str, ngram: NgramType = NgramType.WINDOW, size: int = 3) -> "NameIndex":
        """As build, with the counted grams saved, but no postings: for batches that go through all names (search.scan_names)."""
        if size < 1:
            raise ConfigError("the ngram size must be at least 1")
        counted_names(names, ngram, size).write.mode("overwrite").parquet(f"{path}/docs")
        docs = names.sparkSession.read.parquet(f"{path}/docs")
        n, avgdl = docs.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
        postings = postings_of(docs)
        return cls(docs, postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n, float(avgdl or 0.0), ngram, size)

    def save(self, path: str) -> None:
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        saved = self.postings.sparkSession.read.parquet(f"{path}/docs")
        NameIndex(saved, postings_of(saved), self.terms, self.n, self.avgdl, self.ngram, self.size)._save_terms(path)

    def _save_terms(self, path: str) -> None:
        """Postings are parted by title and sorted by term in each part: a query reads the row groups of its terms, and the scores
        of a name add up where its postings lie, before the shuffle. The config is last: without it nothing loads."""
        spark = self.postings.sparkSession
        self.postings.repartition("id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        saved = spark.read.parquet(f"{path}/postings")
        saved.groupBy("term").agg(F.count(F.lit(1)).alias("df")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        config = json.dumps({"version": VERSION, "n": self.n, "avgdl": self.avgdl, "ngram": str(self.ngram), "size": self.size})
        spark.createDataFrame([(config,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "NameIndex":
        try:
            c = json.loads(spark.read.text(f"{path}/config").first()[0])
        except Exception as e:
            raise CorruptIndex(f"no readable config in {path}") from e
        if c.get("version") != VERSION:
            raise VersionMismatch(VERSION, c.get("version"))
        docs, postings, terms = (spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "terms"))
        return cls(docs, postings, terms, c["n"], c["avgdl"], NgramType.parse(c["ngram"]), c["size"])
