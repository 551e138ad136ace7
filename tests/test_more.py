import gzip

import pytest
from pyspark.sql import functions as F

from titleforge.errors import ConfigError, DataError, LinkError
from titleforge.functions.analysis import NgramType
from titleforge.functions.scoring import Scorer
from titleforge.functions.similarity import Similarity
from titleforge.operators import evaluate as E
from titleforge.operators import linking as L
from titleforge.operators.index import NameIndex, title_names
from titleforge.operators.search import Catalog
from titleforge.sources.paths import collect_paths
from titleforge.sources.tsv import FILES, missing_tables, read_table
from titleforge.streaming.batch_search import search_stream

TITLES = "id string, kind string, title string, original_title string, is_adult boolean, start_year int, end_year int"


def test_tie_ranks(spark):
    rows = [("q", str(i), s) for i, s in enumerate([1.0, 1.0, 1.0, 0.9, 0.8, 0.8, 0.7])] + [("p", "0", 0.80000000005), ("p", "1", 0.8)]
    got = E.tie_ranks(spark.createDataFrame(rows, "qid string, id string, score double")).orderBy("qid", "id").collect()
    assert [r["tie_rank"] for r in got] == [2, 2, 3, 3, 3, 4, 6, 6, 7]


def test_specs():
    named = lambda *v: "_".join(f"{k}-{x}" for k, x in zip(("size", "ngram", "ngram-type", "sim", "scorer"), v))
    assert str(E.Spec()) == named(30, 3, "window", "none", "okapibm25")
    assert str(E.Spec(1, 2, NgramType.EDGE, Similarity.JARO, None)) == named(1, 2, "edge", "jaro", "none")
    assert len(E.grid()) == 16
    for bad in ({"result_size": 0}, {"ngram_size": 1}):
        with pytest.raises(ConfigError):
            E.Spec(**bad)


def test_evaluate(spark, tmp_path):
    t = spark.createDataFrame([("a", "movie", "Moon", "Moon", False, 2000, None), ("b", "movie", "Moonlight", "Moonlight", False, 2001, None), ("c", "movie", "Sun", "Sun", False, 2002, None)], TITLES)
    c = Catalog(t)
    (tmp_path / "t.toml").write_text('[[task]]\nquery = "moon"\nanswer = "a"\n[[task]]\nquery = "sun"\nanswer = "zz"\n')
    truth = E.load_truth(tmp_path / "t.toml")
    shared = {}
    got = E.evaluate(c, [E.Spec(scorer=Scorer.QUERY_RATIO), E.Spec(similarity=Similarity.LEVENSHTEIN)], truth, shared, stop_ratio=0.0)
    ranks = {(r["name"].split("_scorer-")[1], r["query"]): r["rank"] for r in got.collect()}
    assert ranks == {("queryratio", "moon"): 2, ("queryratio", "sun"): None, ("okapibm25", "moon"): 1, ("okapibm25", "sun"): None} and len(shared) == 1
    E.write_results(got, str(tmp_path / "r"))
    s = {r["name"].split("_sim-")[1]: (r["mrr"], r["found"]) for r in E.summarize(E.read_results(spark, str(tmp_path / "r"))).collect()}
    assert s == {"none_scorer-queryratio": (0.25, 0.5), "levenshtein_scorer-okapibm25": (0.5, 0.5)}
    (tmp_path / "bad.toml").write_text("x = [")
    with pytest.raises(DataError):
        E.load_truth(tmp_path / "bad.toml")
    name, query, answer, rank, seconds = next(E.timed(c, E.Spec(scorer=Scorer.QUERY_RATIO), truth, 0.0))
    assert rank == 2 and seconds > 0


def test_tsv(spark, tmp_path):
    (tmp_path / FILES["titles"]).write_text("tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres\nt2\tmovie\tA \"quoted\" \\name\t\t0\t1999\t\\N\tx12\tDrama,Comedy\nt1\ttvSeries\tB\tB\t1\t\\N\t\\N\t\\N\t\\N\nt2\tmovie\tZ later\tZ\t0\t1\t1\t1\tx\n")
    with gzip.open(tmp_path / (FILES["akas"] + ".gz"), "wt") as f:
        f.write("titleId\tordering\ttitle\tregion\tlanguage\ttypes\tattributes\tisOriginalTitle\nt1\t1\tX\tDE\t\\N\t\\N\t\\N\t0\nt1\t2\tY\tUS\t\\N\t\\N\t\\N\t1\nt1\t2\tY\tUS\t\\N\t\\N\t\\N\t\\N\n")
    (tmp_path / FILES["episodes"]).write_text("tconst\tparentTconst\tseasonNumber\tepisodeNumber\ne1\tt1\t1\t\\N\n")
    (tmp_path / FILES["ratings"]).write_text("tconst\taverageRating\tnumVotes\nt1\t5.8\t1356\n")
    t = {r["id"]: r for r in read_table(spark, str(tmp_path), "titles").collect()}
    assert set(t) == {"t1", "t2"} and t["t2"]["title"] == 'A "quoted" \\name' and t["t2"]["original_title"] == "" and t["t2"]["runtime_minutes"] is None and t["t2"]["start_year"] == 1999 and t["t1"]["is_adult"] and t["t1"]["genres"] == ""
    assert read_table(spark, str(tmp_path), "akas").count() == 2 and read_table(spark, str(tmp_path), "akas", dedup_first_column=True).count() == 1
    assert read_table(spark, str(tmp_path), "episodes").first()["episode"] is None and read_table(spark, str(tmp_path), "ratings").first()["votes"] == 1356
    assert missing_tables(str(tmp_path)) == []
    (tmp_path / FILES["ratings"]).write_text("")
    assert missing_tables(str(tmp_path)) == ["ratings"]


def test_unknown_kind_is_an_error(spark, tmp_path):
    (tmp_path / FILES["titles"]).write_text("tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres\nt2\tfilm\tA\tA\t0\t1\t1\t1\tx\n")
    with pytest.raises(Exception, match="unknown title kind"):
        read_table(spark, str(tmp_path), "titles").collect()
    assert read_table(spark, str(tmp_path), "titles", strict=False).first()["kind"] is None


def paths(spark, *names):
    return spark.createDataFrame([(n, False) for n in names], "path string, is_dir boolean")


def test_candidates(spark):
    got = {r["base"]: r for r in L.candidates(paths(spark, "/m/S18E01.mkv", "/m/Thor.Ragnarok.2017.720p.x264.mkv", "English.srt", "/m/noext")).collect()}
    e, a, u = got["S18E01.mkv"], got["Thor.Ragnarok.2017.720p.x264.mkv"], got["English.srt"]
    assert (e["form"], e["name"], e["season"], e["episode"], e["ext"], e["parent"]) == ("episode", "", 18, 1, "mkv", "/m")
    assert (a["form"], a["raw_title"], a["name"], a["year"], a["ext"]) == ("any", "Thor.Ragnarok.", "Thor Ragnarok", 2017, "mkv")
    assert (u["form"], u["parent"], u["name"]) == ("unknown", "", None) and got["noext"]["ext"] is None


@pytest.fixture(scope="module")
def catalog(spark):
    t = spark.createDataFrame([("m", "movie", "Thor: Ragnarok", "Thor: Ragnarok", False, 2017, None), ("s", "tvSeries", "The Simpsons", "The Simpsons", False, 1989, None), ("e", "tvEpisode", "Treehouse", "Treehouse", False, 1990, None), ("n", "movie", "Something Else", "Something Else", False, 2017, None)], TITLES)
    e = spark.createDataFrame([("e", "s", 2, 3)], "id string, tvshow_id string, season int, episode int")
    r = spark.createDataFrame([("m", 8.0, 5000), ("s", 9.0, 5000), ("n", 5.0, 2000)], "id string, rating float, votes long")
    return Catalog(t, NameIndex.build(title_names(t)), None, e, r)


def test_link(spark, catalog):
    linker = L.Linker(stop_ratio=0.0)
    p = paths(spark, "/d/Thor.Ragnarok.2017.mkv", "/d/The.Simpsons.S02E03.avi", "/d/The.Simpsons.S09E09.avi", "/d/English.srt")
    got = {r["path"]: (r["status"], r["id"], r["new_base"]) for r in L.link(catalog, p, linker).collect()}
    assert got == {"/d/Thor.Ragnarok.2017.mkv": ("auto", "m", "Thor: Ragnarok (2017).mkv"), "/d/The.Simpsons.S02E03.avi": ("auto", "e", "S02E03 - Treehouse.avi"), "/d/The.Simpsons.S09E09.avi": ("none", None, None), "/d/English.srt": ("none", None, None)}
    assert [tuple(r) for r in L.proposals(L.link(catalog, p, linker)).collect()] == [("/d/The.Simpsons.S02E03.avi", "/d/S02E03 - Treehouse.avi"), ("/d/Thor.Ragnarok.2017.mkv", "/d/Thor: Ragnarok (2017).mkv")]
    forced = {r["path"]: (r["status"], r["id"]) for r in L.link(catalog, paths(spark, "S02E03.mkv", "x.srt"), L.Linker(force="s")).collect()}
    assert forced == {"S02E03.mkv": ("auto", "e"), "x.srt": ("auto", "s")}
    assert L.link(catalog, paths(spark, "S02E03.mkv"), L.Linker(force="m")).first()["status"] == "none"
    with pytest.raises(LinkError):
        L.link(catalog, p, L.Linker(force="zz"))
    with pytest.raises(LinkError):
        L.proposals(L.link(catalog, paths(spark, "/d/a.srt", "/d/b.srt"), L.Linker(force="m")))


def test_choose(spark):
    rows = [("a", "x", 1.0, 1), ("a", "y", 0.75, 2), ("b", "x", 1.0, 1), ("b", "y", 0.76, 2), ("c", "x", 1.0, 1)]
    got = {r["qid"]: (r["id"], r["status"]) for r in L.choose(spark.createDataFrame(rows, "qid string, id string, score double, rank int")).collect()}
    assert got == {"a": ("x", "auto"), "b": (None, "ambiguous"), "c": ("x", "auto")}


def test_apply(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).write_text(n)
    p = spark.createDataFrame([(str(tmp_path / "a"), str(tmp_path / "c"))], "src string, dst string")
    assert L.apply_proposals(p, "hardlink") == 1 and (tmp_path / "c").read_text() == "a"
    with pytest.raises(LinkError):
        L.apply_proposals(p)
    assert collect_paths(spark, [str(tmp_path)], follow=True).count() == 4


def test_stream(spark, tmp_path):
    index = NameIndex.build(spark.createDataFrame([("1", 0, "moon light"), ("2", 0, "sun shine")], "id string, variant long, name string"))
    spark.createDataFrame([("q", "moon")], "qid string, name string").write.parquet(str(tmp_path / "in"))
    q = search_stream(spark.readStream.schema("qid string, name string").parquet(str(tmp_path / "in")), index, str(tmp_path / "out"), str(tmp_path / "ck"), stop_ratio=0.0)
    q.awaitTermination()
    assert [(r["qid"], r["id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("q", "1")]
