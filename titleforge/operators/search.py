"""Batch search: name search over the index, filters, re-ranking, and exhaustive search. A single query is a batch of one."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from titleforge.functions import scan
from titleforge.functions.analysis import counted, ngrams, normalize
from titleforge.functions.scoring import B, K1, Scorer, finish, term_score, term_weight
from titleforge.functions.similarity import Similarity, similarity
from titleforge.operators.index import NameIndex
from titleforge.query import CANDIDATES, STOP_RATIO, Query
from titleforge.sources.shared import place

#: Rows of a batch's side up to which it is broadcast. Beyond it the join is left to the optimizer.
MAX_BROADCAST = 500_000
PARAMS = "qid string, name string, size int, kinds array<string>, year_lo int, year_hi int, votes_lo long, votes_hi long, season_lo int, season_hi int, episode_lo int, episode_hi int, tvshow_id string"


def params_of(spark: SparkSession, queries: Iterable[tuple[str, Query]]) -> DataFrame:
    """Queries as rows; what they share (scorer, similarity) is an argument of the search."""
    rows = [(i, q.name, q.size, list(q.kinds) or None, q.year.low, q.year.high, q.votes.low, q.votes.high, q.season.low, q.season.high, q.episode.low, q.episode.high, q.tvshow_id) for i, q in queries]
    return spark.createDataFrame(rows, PARAMS)


def small(df: DataFrame, rows: int | None) -> DataFrame:
    """A side to broadcast if its number of rows is known and within bounds."""
    return F.broadcast(df) if rows is not None and rows <= MAX_BROADCAST else df


def query_terms(names: DataFrame, index: NameIndex) -> DataFrame:
    """(qid, ql, term, qc): the distinct grams of each query's name; ql counts all of them, with repeats."""
    lowered = names.select("qid", normalize(F.col("name")).alias("text"))
    g = counted(lowered, ngrams(F.col("text"), index.ngram, index.size), ["qid"])
    return g.select("qid", F.col("length").alias("ql"), F.explode_outer("counts").alias("t")).filter("t is not null").select("qid", "ql", F.col("t.term").alias("term"), F.col("t.tf").alias("qc"))


def split_terms(terms: DataFrame, index: NameIndex, stop_ratio: float, known: int | None = None) -> DataFrame:
    """terms with df and ``primary``: whether a term finds candidates, or only adds to the score of those found.

    A term is low if it is in less than stop_ratio of all names, which a term in none is. If a query has a low term, its
    low terms are primary; else all are.
    """
    asked = small(terms.select("term").distinct(), known)
    df = index.terms.join(asked, "term", "left_semi")
    d = terms.join(small(df, known), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)).cast("double"))
    low = F.col("df") / F.lit(float(max(1, index.n))) < F.lit(stop_ratio)
    return d.withColumn("low", low).withColumn("primary", F.col("low") | ~F.max("low").over(Window.partitionBy("qid"))).drop("low")


def score_names(terms: DataFrame, index: NameIndex, scorer: Scorer, known: int | None = None) -> DataFrame:
    """(qid, id, variant, score) of each name that has a primary term.

    Two phases: only primary terms meet the postings. The other terms, which a good part of all names have, are looked up
    in the counts of the names that were found, so no list of a frequent term is ever joined with the queries.
    """
    q = terms.filter("df > 0").withColumn("weight", term_weight(scorer, F.col("df"), index.n) * F.lit(1.0))
    hits = index.postings.join(small(q.filter("primary"), known), "term")
    s = F.col("qc") * term_score(scorer, F.col("weight"), F.col("tf"), F.col("doc_len"), index.avgdl)
    found = hits.groupBy("qid", "ql", "id", "variant", "doc_len").agg(F.sum(s).alias("p"))
    other = q.filter("not primary").groupBy("qid").agg(F.collect_list(F.struct("term", "qc", "weight")).alias("other"))
    found = found.join(small(other, known), "qid", "left")
    counts = index.docs.select("id", "variant", F.map_from_entries("counts").alias("tfs"))
    found = found.join(counts, ["id", "variant"])

    def share(x: Column) -> Column:
        tf = F.col("tfs")[x["term"]]
        return F.when(tf.isNotNull(), x["qc"] * term_score(scorer, x["weight"], tf, F.col("doc_len"), index.avgdl)).otherwise(F.lit(0.0))

    h = F.when(F.col("other").isNotNull(), F.aggregate("other", F.lit(0.0), lambda a, x: a + share(x))).otherwise(F.lit(0.0))
    part = lambda c: finish(scorer, F.col(c), F.col("ql"), F.col("doc_len"))
    return found.withColumn("h", h).select("qid", "id", "variant", (part("p") + part("h")).alias("score"))


def best_names(scored: DataFrame, dedup: str = "best") -> DataFrame:
    """One score a title: of its best name, or of its first (dedup='first')."""
    how = F.max("score") if dedup == "best" else F.min_by("score", "variant")
    return scored.groupBy("qid", "id").agg(how.alias("score"))


def normalized(scored: DataFrame) -> DataFrame:
    """Scores over the greatest of the query; left alone if that isn't positive."""
    top = F.max("score").over(Window.partitionBy("qid"))
    return scored.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(F.col("score")))


def top(scored: DataFrame, size: Column, *order: Column) -> DataFrame:
    """The first ``size`` rows of each query with their ``rank``; scores equal to nine places, as sums may differ beyond, are in the order of ids."""
    w = Window.partitionBy("qid").orderBy(*(order or (F.desc(F.round("score", 9)), F.asc("id"))))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size)


#: Scorers whose score of a name is a sum over terms that a bound can be given for.
SCANNED = (Scorer.OKAPI_BM25, Scorer.QUERY_RATIO)


def scans(scorer: Scorer, dedup: str, known: int | None) -> bool:
    """Whether a batch goes through the blocks of the index (scan_names) and not through joins: if the number of its queries has no known bound."""
    return known is None and dedup == "best" and scorer in SCANNED


def write_blocks(index: NameIndex, path: str, filters: tuple[DataFrame, DataFrame | None] | None = None) -> None:
    """The names of the index in blocks by ranges of ids (titleforge.functions.scan), with what filters ask of titles and ratings."""
    extra = {"kind": "string", "start_year": "int", "end_year": "int", "votes": "long"}

    def like(rows: DataFrame, variant: int) -> DataFrame:
        none = F.array().cast("array<string>")
        return rows.select("id", F.lit(variant).cast("long").alias("variant"), F.lit(0).alias("doc_len"), none.alias("terms"), none.cast("array<int>").alias("tfs"), *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in extra.items()])

    rows = index.docs.select("id", "variant", "doc_len", F.col("counts.term").alias("terms"), F.col("counts.tf").alias("tfs"), *[F.lit(None).cast(t).alias(c) for c, t in extra.items()])
    if filters is not None:
        titles, ratings = filters
        rows = rows.unionByName(like(titles, -2))
        if ratings is not None:
            rows = rows.unionByName(like(ratings.select("id", "votes"), -1))
    sorted_rows = rows.filter("id is not null").repartitionByRange(-(-max(1, index.n) // scan.BLOCK_NAMES), "id").sortWithinPartitions("id", "variant")
    cloudpickle.register_pickle_by_value(scan)  # executors need not have this package
    sorted_rows.mapInArrow(scan.make_blocks, scan.BLOCK).write.mode("overwrite").parquet(path)


def scan_names(queries: DataFrame, index: NameIndex, scorer: Scorer, stop_ratio: float, filters: tuple[DataFrame, DataFrame | None] | None = None) -> DataFrame:
    """(qid, id, score, rank): for each query (qid, name, size, and p_* to filter by) the best ``size`` titles by name, normalised.

    Each task goes through all blocks of the index with its share of the queries, so neither names found nor scores are
    shuffled. filters: titles and ratings; then only those of the best are returned that may pass the query's filters.
    """
    spark = queries.sparkSession
    path = place(spark, "blocks", uuid.uuid4().hex)
    write_blocks(index, path, filters)
    counts = spark.read.parquet(path).select(F.explode(F.arrays_zip("terms", "dfs")).alias("t"))
    index = replace(index, terms=counts.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df")))
    terms = split_terms(query_terms(queries.select("name").distinct().select(F.col("name").alias("qid"), "name"), index), index, stop_ratio).filter("df > 0")
    weight = F.col("qc") * term_weight(scorer, F.col("df"), index.n) if scorer is Scorer.OKAPI_BM25 else F.col("qc") / F.col("ql")
    own = terms.groupBy(F.col("qid").alias("name")).agg(F.collect_list(F.struct("term", weight.cast("double").alias("weight"), "primary", "df")).alias("terms"))
    # By a hash of its own, else the join's partitions are taken over and merged to a few.
    batch = queries.join(own, "name").repartition(2 * spark.sparkContext.defaultParallelism, F.xxhash64("name")).sortWithinPartitions("name")
    bm25 = (K1, B, index.avgdl) if scorer is Scorer.OKAPI_BM25 else None
    return batch.mapInArrow(scan.searcher(path, bm25, filters is not None), "qid string, id string, score double, rank int")


def search_names(queries: DataFrame, index: NameIndex, scorer: Scorer = Scorer.OKAPI_BM25, size: int = 30, stop_ratio: float = STOP_RATIO, dedup: str = "best", known: int | None = None) -> DataFrame:
    """(qid, id, score, rank): the best ``size`` titles for each query's name, normalised. known: the number of query terms, if a bound is known."""
    if scans(scorer, dedup, known):
        return scan_names(queries.filter("name is not null").select("qid", "name", F.lit(size).alias("size")), index, scorer, stop_ratio)
    terms = split_terms(query_terms(queries, index), index, stop_ratio, known)
    found = best_names(score_names(terms, index, scorer, known), dedup)
    return normalized(top(found, F.lit(size)))


def in_range(col: Column, low: Column, high: Column) -> Column:
    """Inclusive, open at a null end; a null value is only in the range that is open at both."""
    return F.coalesce((col >= F.coalesce(low, col)) & (col <= F.coalesce(high, col)), low.isNull() & high.isNull())


@dataclass
class Catalog:
    """The tables (schemas as in titleforge.schema) and the index of the names."""

    titles: DataFrame
    index: NameIndex | None = None
    akas: DataFrame | None = None
    episodes: DataFrame | None = None
    ratings: DataFrame | None = None
    include_adult: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.titles.sparkSession

    def visible(self) -> DataFrame:
        return self.titles if self.include_adult or "is_adult" not in self.titles.columns else self.titles.filter(~F.coalesce("is_adult", F.lit(False)))

    def with_rating(self, rows: DataFrame) -> DataFrame:
        """rows with rating and votes, null where there are none."""
        return rows.join(self.ratings.select("id", "rating", "votes"), "id", "left")

    def with_episode(self, rows: DataFrame) -> DataFrame:
        """rows with tvshow_id, season and episode of those that are episodes."""
        e = self.episodes.select(F.col("id").alias("episode_id"), F.col("tvshow_id").alias("show"), "season", "episode")
        return rows.join(e, (F.col("id") == F.col("episode_id")) & (F.col("kind") == "tvEpisode"), "left").drop("episode_id")

    def entities(self, rows: DataFrame) -> DataFrame:
        return self.with_episode(self.with_rating(rows))

    def matching(self, rows: DataFrame, need: "Need") -> DataFrame:
        """rows (with the parameters of their query as p_*) that pass the query's filters; only joins that a filter needs are made."""
        ok = [F.col("p_kinds").isNull() | F.array_contains("p_kinds", F.col("kind"))] if need.kinds else []
        if need.year:
            ok.append(in_range(F.col("start_year"), F.col("p_year_lo"), F.col("p_year_hi")) | in_range(F.col("end_year"), F.col("p_year_lo"), F.col("p_year_hi")))
        rows = rows.filter(reduce(Column.__and__, ok)) if ok else rows
        ok = []
        if need.votes:
            rows = self.with_rating(rows)
            ok.append(in_range(F.col("votes"), F.col("p_votes_lo"), F.col("p_votes_hi")))
        if need.episode:
            rows = self.with_episode(rows)
            ok += [in_range(F.col(c), F.col(f"p_{c}_lo"), F.col(f"p_{c}_hi")) for c in ("season", "episode")]
            ok.append(F.col("p_tvshow_id").isNull() | F.coalesce(F.col("show") == F.col("p_tvshow_id"), F.lit(False)))
        return rows.filter(reduce(Column.__and__, ok)) if ok else rows


@dataclass(frozen=True)
class Need:
    """Which filters any query of a batch has."""

    kinds: bool = True
    year: bool = True
    votes: bool = True
    episode: bool = True

    @classmethod
    def of(cls, queries: Iterable[Query]) -> "Need":
        qs = list(queries)
        return cls(any(q.kinds for q in qs), any(not q.year.open for q in qs), any(q.needs_rating for q in qs), any(q.needs_episode for q in qs))


def _prefixed(params: DataFrame) -> DataFrame:
    return params.select("qid", *[F.col(c).alias(f"p_{c}") for c in params.columns if c != "qid"])


def _ranked(rows: DataFrame) -> DataFrame:
    out = top(rows, F.col("p_size"), F.desc(F.round("score", 9)), F.desc(F.round("name_score", 9)), F.asc("id"))
    return normalized(out.select("qid", "rank", "id", "kind", "title", "start_year", "score"))


#: A score of one's own for re-ranking: from the columns of the query's name and of the title.
Rescore = Callable[[Column, Column], Column]


def finite(score: Column) -> Column:
    """A score, which must be a number: NaN and the infinities are errors."""
    bad = F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a score isn't finite")).cast("double")).otherwise(score)


def search_by_name(catalog: Catalog, params: DataFrame, need: Need, scorer: Scorer = Scorer.OKAPI_BM25, sim: Similarity = Similarity.NONE, stop_ratio: float = STOP_RATIO, dedup: str = "best", known: int | None = None, rescore: Rescore | None = None) -> DataFrame:
    """Candidates by name, then filters, then re-ranking by similarity (or ``rescore``), then the cut, then normalising: in this order."""
    p = _prefixed(params)
    names = params.filter("name is not null").select("qid", "name", "size")
    depth = F.greatest(F.lit(CANDIDATES), F.col("p_size"))
    if scans(scorer, dedup, known):
        asked = ["p_kinds"] * need.kinds + ["p_year_lo", "p_year_hi"] * need.year + ["p_votes_lo", "p_votes_hi"] * need.votes
        batch = p.filter("p_name is not null").select("qid", F.col("p_name").alias("name"), depth.alias("size"), *asked)
        cut = scan_names(batch, catalog.index, scorer, stop_ratio, (catalog.titles, catalog.ratings if need.votes else None)).select("qid", "id", F.col("score").alias("name_score"))
    else:
        terms = split_terms(query_terms(names, catalog.index), catalog.index, stop_ratio, None if known is None else known * 256)
        found = best_names(score_names(terms, catalog.index, scorer, None if known is None else known * 256), dedup)
        cut = normalized(top(found.join(small(p.select("qid", "p_size"), known), "qid"), depth)).select("qid", "id", F.col("score").alias("name_score"))
    found = catalog.titles.join(small(cut, None if known is None else known * CANDIDATES), "id").join(small(p, known), "qid")
    found = catalog.matching(found, need)
    if rescore is not None:
        score = finite(rescore(F.col("p_name"), F.col("title")).cast("double"))
    else:
        score = F.col("name_score") if sim is Similarity.NONE else similarity(sim, F.col("p_name"), F.col("title"))
    return _ranked(found.withColumn("score", score))


def search_all(catalog: Catalog, params: DataFrame, need: Need, sim: Similarity = Similarity.NONE, known: int | None = None, rescore: Rescore | None = None) -> DataFrame:
    """Without an index: all titles (or a show's episodes) through the filters, by similarity to the name if there is one.

    The queries are the side that is broadcast, so titles stay where they are; their number is counted if it isn't known.
    """
    known = params.count() if known is None else known
    p = _prefixed(params)
    if need.episode:
        by_show = catalog.visible().join(catalog.episodes.select("id", F.col("tvshow_id").alias("show_key")), "id").join(small(p.filter("p_tvshow_id is not null"), known), F.col("show_key") == F.col("p_tvshow_id")).drop("show_key")
        others = catalog.visible().join(small(p.filter("p_tvshow_id is null"), known))
        rows = by_show.unionByName(others)
    else:
        rows = catalog.visible().join(small(p, known))
    rows = catalog.matching(rows, need)
    if rescore is not None:
        score = finite(F.coalesce(rescore(F.col("p_name"), F.col("title")).cast("double"), F.lit(0.0)))
    elif sim is Similarity.NONE:
        score = F.when(F.col("p_name").isNotNull() | F.col("p_tvshow_id").isNotNull(), 1.0).otherwise(0.0)
    else:
        score = F.coalesce(similarity(sim, F.col("p_name"), F.col("title")), F.lit(0.0))
    return _ranked(rows.withColumn("score", score).withColumn("name_score", F.lit(0.0)))


def search(catalog: Catalog, queries: Iterable[tuple[str, Query]], stop_ratio: float = STOP_RATIO, dedup: str = "best", rescore: Rescore | None = None) -> DataFrame:
    """(qid, rank, id, kind, title, start_year, score). One plan for each scorer and similarity that the batch has; empty queries find nothing."""
    groups: dict[tuple, list[tuple[str, Query]]] = {}
    for i, q in queries:
        if not q.is_empty:
            groups.setdefault((q.by_name, q.scorer if q.by_name else None, q.similarity), []).append((i, q))
    out = None
    for (by_name, scorer, sim), own in sorted(groups.items(), key=str):
        params, need = params_of(catalog.spark, own), Need.of(q for _, q in own)
        if by_name:
            found = search_by_name(catalog, params, need, scorer, sim, stop_ratio, dedup, len(own), rescore)
        else:
            found = search_all(catalog, params, need, sim, len(own), rescore)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return catalog.spark.createDataFrame([], "qid string, rank int, id string, kind string, title string, start_year int, score double")
    return out
