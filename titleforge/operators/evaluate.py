"""Evaluation of search settings: ranks of known answers with ties, mean reciprocal rank, found ratio."""

from __future__ import annotations

import itertools
import time
import tomllib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.errors import ConfigError, CorruptIndex, DataError, VersionMismatch
from titleforge.functions.analysis import NgramType
from titleforge.functions.scoring import Scorer
from titleforge.functions.similarity import Similarity
from titleforge.operators.index import NameIndex, title_names
from titleforge.operators.search import Catalog, search
from titleforge.query import Query
from titleforge.sources.shared import place

RESULTS = "name string, query string, answer string, rank long, duration_seconds double"


@dataclass(frozen=True)
class Spec:
    """A setting to evaluate. Specs of one ngram type and size share an index."""

    result_size: int = 30
    ngram_size: int = 3
    ngram_type: NgramType = NgramType.WINDOW
    similarity: Similarity = Similarity.NONE
    scorer: Scorer | None = Scorer.OKAPI_BM25

    def __post_init__(self):
        if self.result_size < 1:
            raise ConfigError("the result size must be at least 1")
        if self.ngram_size < 2:
            raise ConfigError("the ngram size must be at least 2")

    @property
    def index_name(self) -> str:
        return f"ngram-{self.ngram_size}_ngram-type-{self.ngram_type}"

    def __str__(self) -> str:
        return f"size-{self.result_size}_{self.index_name}_sim-{self.similarity}_scorer-{self.scorer or 'none'}"

    def query(self, text: str) -> Query:
        return Query.parse(text).sized(self.result_size).similar(self.similarity).name_scorer(self.scorer)


def grid(ngram_sizes=(3,), result_sizes=(30,), similarities=tuple(Similarity), scorers=tuple(Scorer), ngram_types=(NgramType.WINDOW,)) -> list[Spec]:
    """The product of all settings, in this nesting order."""
    return [Spec(r, n, t, sim, sc) for n, r, sim, sc, t in itertools.product(ngram_sizes, result_sizes, similarities, scorers, ngram_types)]


#: The tasks that are evaluated if no others are given.
TRUTH = Path(__file__).resolve().parent.parent / "data" / "truth.toml"


def load_truth(path: str | Path | None = None) -> list[tuple[str, str]]:
    """(query, answer) of the tasks of a TOML file, or of the default ones."""
    path = TRUTH if path is None else path
    try:
        return [(t["query"], t["answer"]) for t in tomllib.loads(Path(path).read_text(encoding="utf-8"))["task"]]
    except (OSError, tomllib.TOMLDecodeError, KeyError, TypeError) as e:
        raise DataError(f"bad truth data in {path}") from e


def tie_ranks(scored: DataFrame) -> DataFrame:
    """scored (qid, id, score, ...) with ``tie_rank``: how many of the query score at least as much, to within 1e-10. So equals share the last one's place."""
    rank = "count(*) over (partition by qid order by -score range between unbounded preceding and 1e-10D following)"
    return scored.withColumn("tie_rank", F.expr(rank))


def answer_ranks(results: DataFrame, truth: DataFrame) -> DataFrame:
    """truth (qid, query, answer) with the tie-aware rank of each answer, null if it isn't found."""
    ranked = tie_ranks(results).select(F.col("qid"), F.col("id").alias("answer"), F.col("tie_rank").cast("long").alias("rank"))
    return truth.join(ranked, ["qid", "answer"], "left")


def index_for(catalog: Catalog, spec: Spec, indexes: dict[str, NameIndex], index_dir: str | None = None) -> NameIndex:
    """The index that a spec needs: the one in ``indexes``, else one saved in index_dir, which is made if it isn't there."""
    if spec.index_name not in indexes:
        at = f"{index_dir or place(catalog.spark, 'eval', uuid.uuid4().hex)}/{spec.index_name}"
        try:
            found = NameIndex.load(catalog.spark, at) if index_dir else None
        except (CorruptIndex, VersionMismatch):
            found = None
        indexes[spec.index_name] = found or NameIndex.create(title_names(catalog.titles, catalog.akas, catalog.include_adult), at, spec.ngram_type, spec.ngram_size)
    return indexes[spec.index_name]


def evaluate(catalog: Catalog, specs: Iterable[Spec], truth: list[tuple[str, str]], indexes: dict[str, NameIndex] | None = None, stop_ratio: float = 0.01, index_dir: str | None = None) -> DataFrame:
    """(name, query, answer, rank, duration_seconds) of each task and spec: one batch a spec, one saved index for all specs that can share it."""
    indexes = {} if indexes is None else indexes
    spark, out = catalog.spark, None
    rows = spark.createDataFrame([(str(i), q, a) for i, (q, a) in enumerate(truth)], "qid string, query string, answer string")
    for spec in specs:
        c = replace(catalog, index=index_for(catalog, spec, indexes, index_dir))
        found = search(c, [(str(i), spec.query(q)) for i, (q, _) in enumerate(truth)], stop_ratio)
        own = answer_ranks(found, rows).select(F.lit(str(spec)).alias("name"), "query", "answer", "rank", F.lit(None).cast("double").alias("duration_seconds"))
        out = own if out is None else out.unionByName(own)
    return out


def timed(catalog: Catalog, spec: Spec, truth: list[tuple[str, str]], stop_ratio: float = 0.01, indexes: dict[str, NameIndex] | None = None, index_dir: str | None = None) -> Iterator[tuple[str, str, str, int | None, float]]:
    """As evaluate, a query at a time with its wall-clock seconds, for benchmarks. The index is there before the clock starts."""
    indexes = {} if indexes is None else indexes
    index_for(catalog, spec, indexes, index_dir)
    for q, a in truth:
        began = time.perf_counter()
        got = evaluate(catalog, [spec], [(q, a)], indexes, stop_ratio).first()
        yield str(spec), q, a, got["rank"], time.perf_counter() - began


def summarize(results: DataFrame) -> DataFrame:
    """(name, mrr, found), by name."""
    rr = F.avg(F.when(F.col("rank").isNull(), 0.0).otherwise(1 / F.col("rank")))
    return results.groupBy("name").agg(rr.alias("mrr"), F.avg(F.col("rank").isNotNull().cast("double")).alias("found")).orderBy("name")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=RESULTS, header=True)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").csv(path, header=True)
