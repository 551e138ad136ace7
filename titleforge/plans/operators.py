"""Queries for the operators around the search: sources and sinks, the saved index, the query language, evaluation grids, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from titleforge.errors import SearchError
from titleforge.functions import analysis as A
from titleforge.functions.analysis import NgramType
from titleforge.functions.scoring import Scorer
from titleforge.functions.similarity import Similarity
from titleforge.operators import entities as N
from titleforge.operators import evaluate as E
from titleforge.operators.index import NameIndex, title_names
from titleforge.operators.search import Catalog, search, search_names
from titleforge.plans import queries as Q
from titleforge.plans.adapters import SQL_TITLES, akas, catalog, episodes, ratings, read, saved_index, titles
from titleforge.query import Query
from titleforge.schema import parse_kind
from titleforge.sources import tsv
from titleforge.sources.shared import place


# Sources and sinks: the roles as tab-separated text, and read again.
def _raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    flat = lambda c: F.regexp_replace(c, r"[\t\r\n]", " ").alias(c)
    if name == "titles":
        t = titles(spark, sf)
        return t.select(F.col("id").alias("tconst"), F.col("kind").alias("titleType"), flat("title").alias("primaryTitle"), flat("original_title").alias("originalTitle"), F.col("is_adult").cast("int").alias("isAdult"), F.col("start_year").alias("startYear"), F.col("end_year").alias("endYear"), F.col("runtime_minutes").alias("runtimeMinutes"), "genres")
    if name == "akas":
        a = akas(spark, sf)
        return a.select(F.col("id").alias("titleId"), "ordering", flat("title"), "region", "language", F.lit(None).cast("string").alias("types"), F.lit(None).cast("string").alias("attributes"), (F.col("ordering") == 1).cast("int").alias("isOriginalTitle"))
    if name == "episodes":
        return episodes(spark, sf).select(F.col("id").alias("tconst"), F.col("tvshow_id").alias("parentTconst"), F.col("season").alias("seasonNumber"), F.col("episode").alias("episodeNumber"))
    return ratings(spark, sf).select(F.col("id").alias("tconst"), F.col("rating").alias("averageRating"), F.col("votes").alias("numVotes"))


def _through_tsv(name: str, *columns: str) -> Q.Run:
    """A table written as text twice over, so that reading has repeated lines to drop, and read as the engine reads it."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        folder = place(spark, "tsv", sf)
        raw = _raw(spark, sf, name)
        tsv.write_raw(raw.unionByName(raw), f"{folder}/{tsv.FILES[name]}")
        t = tsv.read_table(spark, folder, name)
        return t.select(*[F.col(c).cast("double").alias(c) if c == "rating" else F.coalesce(c, F.lit(-1)).alias(c) if t.schema[c].dataType.typeName() == "integer" else F.col(c) for c in columns])

    return run


_FLAT = r"regexp_replace({0}, '[\t\r\n]', ' ', 'g')"


def _saved(spark: SparkSession, sf: str) -> DataFrame:
    """The search of the flagship query over an index that is saved and loaded."""
    at = place(spark, "roundtrip", sf)
    c = catalog(spark, sf, indexed=False)
    NameIndex.build(title_names(c.titles, c.akas)).save(at)
    return search_names(Q._texts(spark), NameIndex.load(spark, at), known=Q.KNOWN).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def _saved_order(spark: SparkSession, sf: str) -> DataFrame:
    """Of the saved postings, how many there are and how many come before one of a lower term in their file."""
    p = saved_index(spark, sf).postings.select("term", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    back = F.lag("term").over(Window.partitionBy("f").orderBy("i")) > F.col("term")
    return p.withColumn("back", back).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("back").cast("long")), F.lit(0)).alias("out_of_order"))


# The query language.
LANGUAGE = {
    "homer {tvEpisode} simpson": "{scorer:okapibm25} {sim:none} {size:30} {tvEpisode} homer simpson",
    "{size:5} {votes:1000-} {year:1990-1995} x": "{scorer:okapibm25} {sim:none} {size:5} {year:1990-1995} {votes:1000-} x",
    "{show}{MOVIE}{game} a  b": "{scorer:okapibm25} {sim:none} {size:30} {movie} {tvSeries} {videoGame} a b",
    "{scorer:none} {sim:jaro-winkler} {season:3} {episode:-4}": "{scorer:none} {sim:jarowinkler} {size:30} {season:3} {episode:-4}",
    "{show:d7} { year : 1999 } {votes:-}": "{scorer:okapibm25} {sim:none} {size:30} {year:1999} {show:d7}",
    "{movie lone} braces {": "{UnknownDirective}",
    "{year:abc}": "{NumberError}",
    "{scorer:bm25}": "{UnknownScorer}",
    "{sim:cosine}": "{UnknownSimilarity}",
    "lone } brace { only": "{scorer:okapibm25} {sim:none} {size:30} lone brace only",
}


def _language(spark: SparkSession, _: str) -> DataFrame:
    """Each text parsed and printed, through JSON and back; of one that can't be parsed its error."""
    rows = []
    for text in LANGUAGE:
        try:
            printed = str(Query.from_json(Query.parse(text).to_json()))
        except SearchError as e:
            printed = "{" + type(e).__name__ + "}"
        rows.append((text, printed))
    return spark.createDataFrame(rows, "text string, canonical string")


NAMES = {"scorer": (Scorer.parse, ["okapibm25", "tfidf", "jaccard", "queryratio", "BM25"]), "similarity": (Similarity.parse, ["none", "levenshtein", "jaro", "jarowinkler", "jaro-winkler", "Jaro"]), "ngram": (NgramType.parse, ["window", "edge", "Edge"]), "kind": (parse_kind, ["Episode", "miniseries", "TVSHOW", "show", "special", "game", "tvMovie", "film"])}
_PARSED = {"BM25": "UnknownScorer", "jaro-winkler": "jarowinkler", "Jaro": "UnknownSimilarity", "Edge": "UnknownNgramType", "Episode": "tvEpisode", "miniseries": "tvMiniSeries", "TVSHOW": "tvSeries", "show": "tvSeries", "special": "tvSpecial", "game": "videoGame", "film": "UnknownTitle"}


def _parsed_names(spark: SparkSession, _: str) -> DataFrame:
    rows = []
    for what, (parse, texts) in NAMES.items():
        for t in texts:
            try:
                rows.append((what, t, str(parse(t))))
            except SearchError as e:
                rows.append((what, t, type(e).__name__))
    return spark.createDataFrame(rows, "what string, text string, parsed string")


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds by name or synonym as a column expression, over the parts' types and some names."""
    names = spark.createDataFrame([(x,) for x in NAMES["kind"][1]], "text string").unionByName(read(spark, sf, "part").select(F.col("p_type").alias("text")))
    return names.groupBy("text").agg(F.count(F.lit(1)).alias("n")).select("text", "n", A.kind_of(F.col("text")).alias("kind"))


# Evaluation over a grid of settings.
GRID = {"result_sizes": (10, 30), "similarities": (Similarity.NONE,), "scorers": (Scorer.OKAPI_BM25, Scorer.JACCARD)}


def _grid(spark: SparkSession, _: str) -> DataFrame:
    full = E.grid(ngram_sizes=(2, 3), result_sizes=(10, 30), ngram_types=(NgramType.WINDOW, NgramType.EDGE))
    return spark.createDataFrame([(i, str(s)) for i, s in enumerate(full)], "pos long, name string")


_SQL_GRID = """SELECT row_number() OVER (ORDER BY n.i, z.i, s.i, c.i, t.i) - 1 AS pos, format('size-{}_ngram-{}_ngram-type-{}_sim-{}_scorer-{}', z.v, n.v, t.v, s.v, c.v) AS name
FROM (VALUES (0, 2), (1, 3)) n(i, v), (VALUES (0, 10), (1, 30)) z(i, v), (VALUES (0, 'none'), (1, 'levenshtein'), (2, 'jaro'), (3, 'jarowinkler')) s(i, v),
     (VALUES (0, 'okapibm25'), (1, 'tfidf'), (2, 'jaccard'), (3, 'queryratio')) c(i, v), (VALUES (0, 'window'), (1, 'edge')) t(i, v)"""


def _task_results(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of the answers under each setting of a grid, written as CSV and read again."""
    c = catalog(spark, sf)
    truth = [(r["query"], r["answer"]) for r in Q._truth(spark, sf).filter("trim(query) = query and query not rlike '[{}\\\\s]{2}|[{}\\t\\n]'").orderBy("answer").select("query", "answer").limit(40).collect()]
    found = E.evaluate(c, E.grid(**GRID), truth, {E.Spec().index_name: c.index})
    at = place(spark, "results", sf)
    E.write_results(found, at)
    return E.read_results(spark, at)


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return Q.numbered(E.summarize(_task_results(spark, sf)).select("name", F.round("mrr", 6).alias("mrr"), F.round("found", 6).alias("found")))


def _sql_results(size: int, scorer: Scorer) -> str:
    truth = r"""SELECT * FROM (SELECT 'd' || doc_id AS qid, substring(substring(text, 1, 40), 3, 18) AS name FROM documents WHERE doc_id % 5 = 0 AND lang = 'en' AND doc_id % 50 <> 49)
WHERE trim(name) = name AND NOT regexp_matches(name, '[{}\s]{2}|[{}\t\n]') ORDER BY qid LIMIT 40"""
    return f"""WITH {Q.sql_scored(scorer, queries=truth)},
deep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS k FROM best) WHERE k <= {size}),
norm AS (SELECT qid, id, score / max(score) OVER (PARTITION BY qid) AS score FROM deep),
ties AS (SELECT *, count(*) OVER (PARTITION BY qid ORDER BY -score RANGE BETWEEN UNBOUNDED PRECEDING AND 1e-10 FOLLOWING) AS rank FROM norm)
SELECT 'size-{size}_ngram-3_ngram-type-window_sim-none_scorer-{scorer}' AS name, q.name AS query, q.qid AS answer, r.rank FROM qs q LEFT JOIN ties r ON r.qid = q.qid AND r.id = q.qid"""


_SQL_TASKS = "\nUNION ALL ".join(f"SELECT * FROM ({_sql_results(z, s)})" for z in GRID["result_sizes"] for s in GRID["scorers"])


# Orders and small operators.
def _rescored(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates re-ranked by a function of one's own: titles whose length is near that of the query first."""
    near = lambda name, title: 1.0 / (1.0 + F.abs(F.char_length(name) - F.char_length(title)))
    queries = [("r1", Query.parse("{movie} the erntre the this and one more")), ("r2", Query.parse("{size:12} and therhean is the"))]
    return Q.shown(search(catalog(spark, sf), queries, rescore=near))


_SQL_RESCORED = f"""WITH {Q.sql_scored(Scorer.OKAPI_BM25, queries="VALUES ('r1', 'the erntre the this and one more'), ('r2', 'and therhean is the')")},
deep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS k FROM best) WHERE k <= 1000),
cand AS (SELECT qid, id, CASE WHEN max(score) OVER (PARTITION BY qid) > 0 THEN score / max(score) OVER (PARTITION BY qid) ELSE score END AS ns FROM deep),
f AS (SELECT c.qid, t.id, t.kind, t.title, t.start_year, ns, 1.0 / (1.0 + abs(length(s.name) - length(t.title))) AS score FROM cand c JOIN titles t USING (id) JOIN qs s ON s.qid = c.qid WHERE c.qid <> 'r1' OR t.kind = 'movie'),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, round(ns, 9) DESC, id) AS INT) AS rank FROM f)
SELECT qid, rank, id, kind, title, coalesce(start_year, -1) AS start_year, round(score / max(score) OVER (PARTITION BY qid), 6) AS score FROM r WHERE rank <= CASE qid WHEN 'r1' THEN 30 ELSE 12 END"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """What a name query finds before filters: as many as it asks for, more than the query wants."""
    nq = Query.parse("{size:5} the erntre").name_query()
    q = spark.createDataFrame([("n", nq.name)], "qid string, name string")
    return search_names(q, catalog(spark, sf).index, nq.scorer, nq.size, nq.stop_word_ratio, known=100).select("id", "rank", F.round("score", 6).alias("score"))


def _adults_too(spark: SparkSession, sf: str) -> DataFrame:
    c = catalog(spark, sf, indexed=False, include_adult=True)
    return Q.shown(search(Catalog(c.titles, None, c.akas, c.episodes, c.ratings, True), [("a", Query.parse("{movie} {year:1950-1955} {size:60}"))]))


def _in_place(rows: DataFrame, *columns: str) -> DataFrame:
    return Q.numbered(rows.select(*columns))


def queries() -> dict[str, Q.Run]:
    return {
        "tsv_titles": _through_tsv("titles", "id", "kind", "title", "original_title", "is_adult", "start_year", "end_year", "runtime_minutes", "genres"),
        "tsv_akas": _through_tsv("akas", "id", "ordering", "title", "region", "is_original"),
        "tsv_episodes": _through_tsv("episodes", "id", "tvshow_id", "season", "episode"),
        "tsv_ratings": _through_tsv("ratings", "id", "rating", "votes"),
        "index_save_load": _saved,
        "index_term_order": _saved_order,
        "index_documents": lambda s, d: saved_index(s, d).docs.select("id", "variant", F.col("doc_len").cast("long").alias("doc_len"), F.size("counts").cast("long").alias("n_terms")),
        "query_language": _language,
        "names_of_settings": _parsed_names,
        "kind_synonyms": _kinds,
        "parameter_grid": _grid,
        "eval_grid_results": lambda s, d: _task_results(s, d).select("name", "query", "answer", F.coalesce("rank", F.lit(-1)).alias("rank")),
        "eval_grid_summary": _summary,
        "search_rescored": _rescored,
        "name_query_candidates": _candidates,
        "exhaustive_with_adults": _adults_too,
        "series_titles": lambda s, d: titles(s, d).filter(N.is_series(F.col("kind"))).select("id", "title"),
        "id_title_projection": lambda s, d: search(catalog(s, d, indexed=False), [("p", Query.parse("{scorer:none} {size:200} any"))]).select("id", "title", "score"),
        "episodes_in_order": lambda s, d: _in_place(N.in_order(episodes(s, d)), "id", "tvshow_id"),
        "episodes_by_id": lambda s, d: _in_place(N.by_id_order(episodes(s, d)), "id"),
        "title_lookup_batch": lambda s, d: N.by_id(ratings(s, d), episodes(s, d).select("id")).select("id", F.col("rating").cast("double").alias("rating"), "votes"),
    }


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


def oracle_sql() -> dict[str, str]:
    kinds = [(t, _PARSED.get(t, t)) for t in NAMES["kind"][1] if t != "film"]
    return {
        "tsv_titles": f"WITH {SQL_TITLES} SELECT id, kind, {_FLAT.format('title')} AS title, {_FLAT.format('original_title')} AS original_title, is_adult, coalesce(start_year, -1) AS start_year, coalesce(end_year, -1) AS end_year, runtime_minutes, genres FROM titles",
        "tsv_akas": f"WITH {SQL_TITLES} SELECT id, ordering, {_FLAT.format('title')} AS title, region, ordering = 1 AS is_original FROM akas",
        "tsv_episodes": f"WITH {SQL_TITLES} SELECT id, tvshow_id, coalesce(season, -1) AS season, coalesce(episode, -1) AS episode FROM episodes",
        "tsv_ratings": f"WITH {SQL_TITLES} SELECT id, CAST(rating AS DOUBLE) AS rating, votes FROM ratings",
        "index_save_load": Q.sql_names(Scorer.OKAPI_BM25),
        "index_term_order": f"WITH {Q.sql_scored(Scorer.OKAPI_BM25)} SELECT count(*) AS n, 0 AS out_of_order FROM posts",
        "index_documents": f"WITH {Q.sql_scored(Scorer.OKAPI_BM25)} SELECT id, CAST(variant AS BIGINT) AS variant, dl AS doc_len, CAST(len(list_distinct(g)) AS BIGINT) AS n_terms FROM docs",
        "query_language": f"SELECT * FROM (VALUES {_values(list(LANGUAGE.items()))}) v(text, canonical)",
        "names_of_settings": f"SELECT * FROM (VALUES {_values([(w, t, _PARSED.get(t, t)) for w, (_, ts) in NAMES.items() for t in ts])}) v(what, text, parsed)",
        "kind_synonyms": f"WITH k(text, kind) AS (VALUES {_values(kinds)}), n AS (SELECT p_type AS text FROM part UNION ALL SELECT * FROM (VALUES {_values([(t,) for t in NAMES['kind'][1]])}) v(text)) SELECT text, count(*) AS n, any_value(kind) AS kind FROM n LEFT JOIN k USING (text) GROUP BY text",
        "parameter_grid": _SQL_GRID,
        "eval_grid_results": f"SELECT name, query, answer, coalesce(rank, -1) AS rank FROM ({_SQL_TASKS})",
        "eval_grid_summary": f"SELECT *, row_number() OVER (ORDER BY name) - 1 AS pos FROM (SELECT name, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS found FROM ({_SQL_TASKS}) GROUP BY name)",
        "search_rescored": _SQL_RESCORED,
        "name_query_candidates": f"WITH {Q.sql_scored(Scorer.OKAPI_BM25, queries=chr(86) + 'ALUES (' + repr('n') + ', ' + repr('the erntre') + ')')}, r AS (SELECT id, score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, id) AS INT) AS rank FROM best) SELECT id, rank, round(score / max(score) OVER (), 6) AS score FROM r WHERE rank <= 1000",
        "exhaustive_with_adults": f"WITH {SQL_TITLES}, r AS (SELECT *, CAST(row_number() OVER (ORDER BY id) AS INT) AS rank FROM titles WHERE kind = 'movie' AND (coalesce(start_year BETWEEN 1950 AND 1955, FALSE) OR coalesce(end_year BETWEEN 1950 AND 1955, FALSE))) SELECT 'a' AS qid, rank, id, kind, title, coalesce(start_year, -1) AS start_year, 0.0 AS score FROM r WHERE rank <= 60",
        "series_titles": f"WITH {SQL_TITLES} SELECT id, title FROM titles WHERE kind IN ('tvSeries', 'tvMiniSeries')",
        "id_title_projection": f"WITH {SQL_TITLES} SELECT id, title, 1.0 AS score FROM shown ORDER BY id LIMIT 200",
        "episodes_in_order": f"WITH {SQL_TITLES} SELECT id, tvshow_id, row_number() OVER (ORDER BY tvshow_id, season NULLS LAST, episode NULLS LAST, id) - 1 AS pos FROM episodes",
        "episodes_by_id": f"WITH {SQL_TITLES} SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM episodes",
        "title_lookup_batch": f"WITH {SQL_TITLES} SELECT id, CAST(rating AS DOUBLE) AS rating, votes FROM ratings WHERE id IN (SELECT id FROM episodes)",
    }
