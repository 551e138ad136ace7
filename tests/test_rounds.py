"""What a reviewer's findings were about: odd rows against SQL, whole searches against the plan of joins."""

import random

import duckdb
import pytest

from titleforge.functions import scan
from titleforge.functions.scoring import Scorer
from titleforge.operators.search import search_names
from titleforge.plans import queries as Q


def rows(pdf):
    return sorted(map(repr, pdf[sorted(pdf.columns)].astype(object).where(pdf[sorted(pdf.columns)].notna(), None).values.tolist()))


def same_as_sql(spark, name, tables):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    got, want = Q.queries()[name](spark, str(tables)).toPandas(), con.sql(Q.oracle_sql()[name]).df()
    assert len(want) and rows(got) == rows(want)


def test_link_candidates_of_odd_rows(spark, tmp_path):
    texts = ["", None, "...", "Ses 12 e07", "\n\u00e9\U0001f600x", "some words of a text that is longer"]
    docs = [(3 * i + k - 3, t, "en", "web", n) for i, t in enumerate(texts) for k, n in ((0, 5), (1, 7), (1, None), (2, -9))] + [(None, "no id", "en", "web", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    same_as_sql(spark, "link_candidates", tmp_path)


def grown(spark, folder, n=900):
    """A few hundred documents of few words, so that many names share their grams and many scores are even; every other one labelled."""
    r, words = random.Random(7), "alder birch cedar elder hazel larch maple rowan willow aspen".split()
    docs = [(i, " ".join(r.choices(words, k=r.randint(3, 25))), r.choice(["en", "en", "de", "fr", "es"]), "web", r.randint(10, 400)) for i in range(n)]
    docs += [(n + i, docs[5 * i][1], *docs[5 * i][2:]) for i in range(n // 10)]  # copies
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, len(docs), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def small_blocks(monkeypatch):
    monkeypatch.setattr(scan, "BLOCK_NAMES", 150)
    monkeypatch.setattr(scan, "KEPT", 20_000)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["link_paths", "link_proposals"])
def test_links_scan_blocks(spark, tmp_path, monkeypatch, name):
    small_blocks(monkeypatch)
    folder = grown(spark, tmp_path)
    assert "MapInArrow" in plan(Q._linked(spark, str(folder)))  # no join of all queries with all postings
    same_as_sql(spark, name, folder)


@pytest.mark.parametrize("name", ["eval_answer_ranks", "eval_mrr"])
def test_evaluation_scans_blocks(spark, tmp_path, monkeypatch, name):
    small_blocks(monkeypatch)
    folder = grown(spark, tmp_path)
    assert "MapInArrow" in plan(Q._eval_ranks(spark, str(folder)))
    same_as_sql(spark, name, folder)


@pytest.mark.parametrize("scorer", [Scorer.OKAPI_BM25, Scorer.QUERY_RATIO])
def test_scan_is_the_plan_of_joins(spark, tmp_path, monkeypatch, scorer):
    small_blocks(monkeypatch)
    folder = str(grown(spark, tmp_path))
    queries = [("a", "hazel larch"), ("b", "hazel larch"), ("c", "rowan xyz"), ("d", ""), ("e", None), ("f", "zzzz"), ("g", "aspen aspen aspen willow birch")]
    names, index = spark.createDataFrame(queries, "qid string, name string"), Q.catalog(spark, folder).index
    for stop in (0.01, 0.2):
        got, want = (search_names(names, index, scorer, 40, stop, known=k).selectExpr("qid", "id", "rank", "round(score, 9) score").toPandas() for k in (None, 99))
        assert len(want) and rows(got) == rows(want)
