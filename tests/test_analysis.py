import pytest
from pyspark.sql import functions as F

from titleforge.errors import ConfigError, UnknownNgramType
from titleforge.functions import analysis as A
from titleforge.functions.analysis import NgramType

WINDOW = [
    (2, "abcdef", "ab bc cd de ef"), (1, "abcdef", "a b c d e f"), (2, "ab", "ab"), (1, "ab", "a b"), (1, "a", "a"), (1, "", ""), (3, "abcdef", "abc bcd cde def"), (3, "abcde", "abc bcd cde"),
    (3, "abcd", "abc bcd"), (3, "abc", "abc"), (3, "ab", "ab"), (3, "a", "a"), (3, "", ""), (3, "αβγφδε", "αβγ βγφ γφδ φδε"), (0, "abc", ""), (3, "a😀bc", "a😀b 😀bc"),
]
EDGE = [(5, "homer simpson", "hom home homer sim simp simps"), (5, "h", "h"), (5, "ho", "ho"), (5, "hom", "hom"), (5, "home", "hom home"), (5, "δεαβγφδε δε", "δεα δεαβ δεαβγ δε"), (2, "abcd", "abc"), (5, "  ", "")]


@pytest.mark.parametrize("kind,cases", [(NgramType.WINDOW, WINDOW), (NgramType.EDGE, EDGE)])
def test_ngrams(spark, kind, cases):
    for n in {c[0] for c in cases}:
        own = [c for c in cases if c[0] == n]
        got = spark.createDataFrame([(t,) for _, t, _ in own], "t string").select(A.ngrams(F.col("t"), kind, n)).collect()
        assert [" ".join(r[0]) for r in got] == [w for _, _, w in own]


def test_parse_type():
    assert NgramType.parse("edge") is NgramType.EDGE
    with pytest.raises(UnknownNgramType):
        NgramType.parse("Window")


def test_counted_and_null(spark):
    d = spark.createDataFrame([(1, "aaaab"), (2, None), (3, "")], "k int, t string")
    got = {r["k"]: (r["length"], [tuple(x) for x in r["counts"]]) for r in A.counted(d, A.window_ngrams(F.col("t"), 2), ["k"]).collect()}
    assert got == {1: (4, [("aa", 3), ("ab", 1)]), 2: (0, []), 3: (0, [])}
    assert d.select(A.window_ngrams(F.col("t"), 2).isNull()).collect()[1][0]


def test_patterns(spark):
    assert A.group_index(r"(a)(?P<x>b)", "x") == 2 and A.java_pattern("(?P<x>b)") == "(?<x>b)"
    with pytest.raises(ConfigError):
        A.group_index("(?P<x>b)", "y")
    with pytest.raises(ConfigError):
        A.group_index("(?P<x>b", "x")


def test_names(spark):
    df = spark.createDataFrame([("tvEpisode", "A/B", 2000, 18, 1, "mkv"), ("movie", "T", 2017, None, None, None), ("movie", "T", None, None, None, "avi"), ("tvEpisode", "X", None, None, None, None)], "k string, t string, y int, s int, e int, x string")
    got = df.select(A.display_name(*(F.col(c) for c in "ktysex"))).collect()
    assert [r[0] for r in got] == ["S18E01 - A_B.mkv", "T (2017)", "T.avi", "S00E00 - X"]
    kinds = spark.createDataFrame([("Show",), ("TVMOVIE",), ("nope",)], "k string").select(A.kind_of(F.col("k"))).collect()
    assert [r[0] for r in kinds] == ["tvSeries", "tvMovie", None]
