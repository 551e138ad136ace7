import json
import random

import pytest

from titleforge.errors import ConfigError, NumberError, UnknownDirective, UnknownScorer, UnknownSimilarity, UnknownTitle
from titleforge.functions.scoring import Scorer
from titleforge.functions.similarity import Similarity, jaro, jaro_many, jaro_winkler
from titleforge.query import Query, Range
from titleforge.schema import parse_kind


@pytest.mark.parametrize("text,want", [
    ("foo bar baz", Query(name="foo bar baz")), ("foo {movie} bar {tvshow} baz", Query(name="foo bar baz", kinds=("movie", "tvSeries"))), ("{movie}{tvshow}", Query(kinds=("movie", "tvSeries"))),
    ("{size:5}", Query(size=5)), ("{ size : 5 }", Query(size=5)), ("{year:1990}", Query(year=Range(1990, 1990))), ("{year:1990-}", Query(year=Range(1990))), ("{year:-1990}", Query(year=Range(None, 1990))),
    ("{year:-}", Query()), ("{movie", Query(name="movie")), ("movie}", Query(name="movie")), ("{sim:jaro-winkler}", Query(similarity=Similarity.JARO_WINKLER)), ("{scorer:none} a", Query(name="a", scorer=None)),
    ("{show:tt1} {season:4-5}", Query(tvshow_id="tt1", season=Range(4, 5))), ("  ", Query()),
])
def test_parse(text, want):
    assert Query.parse(text) == want


@pytest.mark.parametrize("text,error", [("{blah}", UnknownDirective), ("{size:a}", NumberError), ("{year:}", NumberError), ("{ movie }", UnknownDirective), ("{scorer:x}", UnknownScorer), ("{sim:x}", UnknownSimilarity), ("{foo:1}", UnknownDirective)])
def test_errors(text, error):
    with pytest.raises(error):
        Query.parse(text)


def test_ranges():
    assert [Range.parse(t) for t in ("5-10", "5-", "-10", "5-5", "5")] == [Range(5, 10), Range(5), Range(None, 10), Range(5, 5), Range(5, 5)]
    assert Range(1, 3).contains(3) and not Range(1, 3).contains(None) and Range().contains(None) and not Range(2).contains(1)


def test_print_round_trip():
    q = Query().named("foo bar baz").kind("tvSeries").kind("movie").sized(31).similar(Similarity.JARO).at_least(season=4).at_most(season=5)
    parts = ["scorer:okapibm25", "sim:jaro", "size:31", "movie", "tvSeries", "season:4-5"]
    assert str(q) == " ".join("{" + p + "}" for p in parts) + " foo bar baz"
    assert str(Query.parse(str(q))) == str(q) == json.loads(q.to_json()) and str(Query.from_json(q.to_json())) == str(q)
    with pytest.raises(ConfigError):
        Query.from_json('[1]')


def test_shape():
    assert Query().is_empty and not Query(name="").is_empty and Query(name="").by_name and not Query(name="a", scorer=None).by_name
    assert Query(name="a", size=5000).name_query().size == 5000 and Query(name="a").name_query().size == 1000


def test_enums_and_kinds():
    assert Scorer.parse("tfidf") is Scorer.TFIDF and parse_kind("Episode") == "tvEpisode"
    with pytest.raises(UnknownTitle):
        parse_kind("film")


def test_jaro_values():
    assert round(jaro("martha", "marhta"), 6) == 0.944444 and round(jaro_winkler("martha", "marhta"), 6) == 0.961111
    assert round(jaro("dwayne", "duane"), 6) == 0.822222 and round(jaro("dixon", "dicksonx"), 6) == 0.766667 and jaro("", "") == 1.0 and jaro("a", "") == 0.0 and jaro("abc", "xyz") == 0.0


def test_many_are_each():
    rng = random.Random(3)
    word = lambda k: "".join(rng.choices("abcé 😀", k=k))
    others = [word(rng.randint(0, 14)) for _ in range(400)] + ["", "a" * 300, "abcé"]
    for a in ["", "a", "abcé", word(9), word(30)]:
        for winkler, one in ((False, jaro), (True, jaro_winkler)):
            for cells in (50, 2_000_000):
                got = jaro_many(a, others, winkler, cells=cells)
                assert all(abs(x - one(a, b)) < 1e-12 for x, b in zip(got, others))
