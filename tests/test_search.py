import math
import random

import pytest
from pyspark.sql import functions as F

from titleforge.errors import CorruptIndex, VersionMismatch
from titleforge.functions.analysis import NgramType
from titleforge.functions.scoring import Scorer
from titleforge.operators.entities import displayed, grouped_akas, in_order, season, seasons
from titleforge.operators.index import NameIndex, title_names
from titleforge.operators.search import Catalog, in_range, search, search_names
from titleforge.query import Query

SEVEN = ["Bruce Springsteen", "Bruce Kulick", "Bruce Arians", "Bruce Smith", "Bruce Willis", "Bruce Wayne", "Bruce Banner"]


def grams(s: str, n: int = 3) -> list[str]:
    s = s.lower()
    return [] if not s else [s[i : i + n] for i in range(max(1, len(s) - n + 1))]


def brute(names, query, scorer, stop, size=30):
    """names: (id, variant, name). The scoring rules restated a document at a time."""
    docs = [(i, grams(n)) for i, _, n in names]
    n, avgdl = len(docs), sum(len(g) for _, g in docs) / len(docs)
    df = {}
    for _, g in docs:
        for t in set(g):
            df[t] = df.get(t, 0) + 1
    q = grams(query)
    terms = {t: q.count(t) for t in q}
    low = {t for t in terms if df.get(t, 0) / n < stop}
    primary = low or set(terms)
    best = {}
    for i, g in docs:
        def part(ts):
            total = 0.0
            for t in ts:
                tf = min(15, g.count(t))
                if tf:
                    if scorer is Scorer.OKAPI_BM25:
                        total += terms[t] * max(0, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(g) / avgdl)) * math.log2(1 + (n - df[t] + 0.5) / (df[t] + 0.5)))
                    elif scorer is Scorer.TFIDF:
                        total += terms[t] * tf * math.log2(n / (1 + df[t]))
                    else:
                        total += terms[t]
            if not any(t in g for t in ts):
                return 0.0
            return total / (len(q) + len(g) - total) if scorer is Scorer.JACCARD else total / len(q) if scorer is Scorer.QUERY_RATIO else total
        if any(t in g for t in primary):
            s = part(primary) + part(set(terms) - primary)
            best[i] = max(best.get(i, -1e9), s)
    ranked = sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:size]
    top = ranked[0][1] if ranked else 0
    return [(i, s / top if top > 0 else s) for i, s in ranked]


def titles(spark, names):
    return spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "id string, name string").select("id", F.lit(0).cast("long").alias("variant"), "name")


def run(spark, index, text, scorer=Scorer.OKAPI_BM25, stop=0.0, **kw):
    q = spark.createDataFrame([("q", text)], "qid string, name string")
    return [(r["id"], r["score"]) for r in search_names(q, index, scorer, stop_ratio=stop, known=100, **kw).orderBy("rank").collect()]


def test_seven_names(spark):
    index = NameIndex.build(titles(spark, SEVEN))
    got = run(spark, index, "bruce")
    assert {i for i, s in got[:2]} == {"3", "5"} and got[0][1] == got[1][1] == 1.0 and len(got) == 7 and round(got[6][1], 6) == 0.800422
    assert [i for i, _ in run(spark, index, "e w")] == ["5", "4"]
    assert run(spark, index, "Springsteen") == [("0", 1.0)]
    assert len(run(spark, index, " ".join(n.split()[1] for n in SEVEN))) == 7
    assert all(s < 0 for _, s in run(spark, index, "bruce", Scorer.TFIDF))  # df = n: not normalised
    assert {round(s, 6) for _, s in run(spark, index, "bruce", Scorer.JACCARD)} == {1.0, 0.9, 0.6}
    assert {s for _, s in run(spark, index, "bruce", Scorer.QUERY_RATIO)} == {1.0}
    assert run(spark, index, "") == []


@pytest.mark.parametrize("scorer", list(Scorer))
def test_against_brute_force(spark, scorer):
    rng = random.Random(7)
    words = ["the", "star", "wars", "of", "night", "thé", "Lost", "aaa", "moon", "x"]
    rows = [(f"{i:03d}", v, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(120) for v in range(rng.randint(1, 3))]
    index = NameIndex.build(spark.createDataFrame(rows, "id string, variant long, name string"))
    for stop in (0.0, 0.05, 0.3):
        for text in ("the star", "lost moon aaa aaa", "thé x", "zzz the", "night"):
            want = brute(rows, text, scorer, stop)
            got = run(spark, index, text, scorer, stop)
            assert [i for i, _ in got] == [i for i, _ in want], (stop, text)
            assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want))


def test_out_of_vocabulary_term_is_low(spark):
    index = NameIndex.build(titles(spark, SEVEN))
    assert run(spark, index, "brucezzz", stop=0.01) == [] and len(run(spark, index, "brucezzz", stop=0.0)) == 7


def test_dedup_modes(spark):
    rows = [("a", 0, "completely different"), ("a", 1, "bruce wayne"), ("b", 0, "bruce banner")]
    index = NameIndex.build(spark.createDataFrame(rows, "id string, variant long, name string"))
    assert run(spark, index, "bruce wayne")[0][0] == "a"
    assert dict(run(spark, index, "different bruce wayne", dedup="first"))["a"] > 0


def test_save_and_load(spark, tmp_path):
    index = NameIndex.build(titles(spark, SEVEN), NgramType.EDGE, 4)
    index.save(str(tmp_path / "i"))
    again = NameIndex.load(spark, str(tmp_path / "i"))
    assert (again.n, again.avgdl, again.ngram, again.size) == (index.n, index.avgdl, index.ngram, index.size)
    assert run(spark, again, "bruce") == run(spark, index, "bruce")
    with pytest.raises(CorruptIndex):
        NameIndex.load(spark, str(tmp_path / "none"))
    spark.createDataFrame([('{"version": 99}',)], "v string").write.text(str(tmp_path / "old/config"))
    with pytest.raises(VersionMismatch):
        NameIndex.load(spark, str(tmp_path / "old"))


@pytest.fixture(scope="module")
def catalog(spark):
    t = spark.createDataFrame([
        ("t1", "movie", "Star Wars", "Star Wars", False, 1977, None), ("t2", "movie", "Star Trek", "Star Trek", False, 2009, None), ("t3", "tvSeries", "Star Show", "Stern Schau", False, 1990, 1999),
        ("t4", "tvEpisode", "Star Pilot", "Star Pilot", False, 1990, None), ("t5", "tvEpisode", "Star Second", "Star Second", False, None, None), ("t6", "movie", "Star Adult", "Star Adult", True, 1980, None),
    ], "id string, kind string, title string, original_title string, is_adult boolean, start_year int, end_year int")
    a = spark.createDataFrame([("t1", 1, "Krieg der Sterne", "DE", None), ("t1", 2, "Star Wars", "US", None), ("t2", 1, "Krieg der Sterne", "DE", None)], "id string, ordering int, title string, region string, language string")
    e = spark.createDataFrame([("t4", "t3", 1, 1), ("t5", "t3", 1, None), ("t9", "t3", None, 2)], "id string, tvshow_id string, season int, episode int")
    r = spark.createDataFrame([("t1", 8.5, 5000), ("t2", 7.0, 100)], "id string, rating float, votes long")
    return Catalog(t, NameIndex.build(title_names(t, a)), a, e, r)


def find(catalog, text, stop=0.0):
    return [(r["id"], round(r["score"], 6)) for r in search(catalog, [("q", Query.parse(text))], stop).orderBy("rank").collect()]


def test_name_union(catalog):
    got = {(r["id"], r["variant"]) for r in title_names(catalog.titles, catalog.akas).collect()}
    assert got == {("t1", 0), ("t2", 0), ("t3", 0), ("t3", 1), ("t4", 0), ("t5", 0), ("t1", 3), ("t2", 3)}


def test_filters(catalog):
    ids = lambda t: {i for i, _ in find(catalog, t)}
    assert ids("star") == {"t1", "t2", "t3", "t4", "t5"} and ids("star {movie}") == {"t1", "t2"}
    assert ids("star {year:1977}") == {"t1"} and ids("star {year:1995-2000}") == {"t3"} and ids("star {year:1991-1998}") == set()
    assert ids("star {votes:1000-}") == {"t1"} and ids("star {votes:-}") == ids("star")
    assert ids("star {season:1}") == {"t4", "t5"} and ids("star {episode:1}") == {"t4"} and ids("star {show:t3}") == {"t4", "t5"} and ids("star {show:t1}") == set()
    assert find(catalog, "{movie} star wars")[0] == ("t1", 1.0)


def test_exhaustive(catalog):
    assert find(catalog, "") == []
    assert find(catalog, "{movie}") == [("t1", 0.0), ("t2", 0.0)] and find(catalog, "{show:t3}") == [("t4", 1.0), ("t5", 1.0)]
    assert find(catalog, "{scorer:none} {sim:levenshtein} {movie} star trek")[0][0] == "t2"
    everybody = Catalog(catalog.titles, catalog.index, catalog.akas, catalog.episodes, catalog.ratings, include_adult=True)
    assert ("t6", 0.0) in find(everybody, "{movie}")
    assert search(catalog, [("a", Query(name="", kinds=("movie",)))]).count() == 0


def test_similarity_uses_the_primary_title(catalog):
    got = find(catalog, "{sim:levenshtein} {movie} Krieg der Sterne")
    assert {i for i, _ in got} == {"t1", "t2"} and got[0][1] == 1.0


def test_batch_and_display(catalog):
    found = search(catalog, [("a", Query.parse("star pilot")), ("b", Query.parse("{sim:jaro} star second")), ("c", Query.parse("{movie}"))], 0.0)
    rows = {(r["qid"], r["num"]): r for r in displayed(found, catalog).collect()}
    assert rows[("a", 1)]["tv"] == "S01E01 Star Show" and rows[("b", 1)]["id"] == "t5" and rows[("b", 1)]["year"] == "N/A" and rows[("c", 1)]["score"] == "0.000"


def test_episodes_and_akas(catalog):
    assert [r["id"] for r in seasons(catalog.episodes, "t3").collect()] == ["t4", "t5", "t9"]
    assert [r["id"] for r in season(catalog.episodes, "t3", 1).collect()] == ["t4", "t5"] and in_order(catalog.episodes).count() == 3
    assert {r["id"]: r["n"] for r in grouped_akas(catalog.akas).collect()} == {"t1": 2, "t2": 1}


def test_range_nulls(spark):
    df = spark.createDataFrame([(5, 1, 9), (None, 1, None), (None, None, None), (5, None, 4), (5, 5, 5), (7, 6, None)], "v int, a int, b int")
    assert [r[0] for r in df.select(in_range(F.col("v"), F.col("a"), F.col("b"))).collect()] == [True, False, True, False, True, True]


def test_filter_stays_above_the_cut(catalog):
    plan = search(catalog, [("q", Query.parse("star {movie}"))])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("kind#") < plan.index("row_number")
