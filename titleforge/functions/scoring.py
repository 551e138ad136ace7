"""Ranking formulas as column expressions. tf, df, dl, qc, ql are as usual; n and avgdl are the corpus's."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from titleforge.errors import UnknownScorer

K1, B = 1.2, 0.75


class Scorer(str, Enum):
    OKAPI_BM25 = "okapibm25"
    TFIDF = "tfidf"
    JACCARD = "jaccard"
    QUERY_RATIO = "queryratio"

    @classmethod
    def parse(cls, name: str) -> "Scorer":
        try:
            return cls(name)
        except ValueError:
            raise UnknownScorer(name) from None

    def __str__(self) -> str:
        return self.value


def term_weight(scorer: Scorer, df: Column, n: float) -> Column:
    """What depends on the query term alone, to be worked out before the join with the postings."""
    if scorer is Scorer.OKAPI_BM25:
        return F.log2(F.lit(n + 1.0) / (df + 0.5))  # 1 plus the odds of not having the term, each count raised by a half
    if scorer is Scorer.TFIDF:
        return F.log2(F.lit(float(n)) / (F.lit(1.0) + df))
    return F.lit(1.0)


def term_score(scorer: Scorer, weight: Column, tf: Column, dl: Column, avgdl: float) -> Column:
    """One term's share of a document's score, for one occurrence in the query."""
    if scorer is Scorer.OKAPI_BM25:
        length = F.lit(1 - B) + F.lit(B / avgdl if avgdl else 0.0) * dl
        return F.greatest(F.lit(0.0), tf * (K1 + 1) / (tf + F.lit(K1) * length) * weight)
    return tf * weight if scorer is Scorer.TFIDF else F.lit(1.0)


def finish(scorer: Scorer, total: Column, ql: Column, dl: Column) -> Column:
    """The score of one partition of the query's terms from the sum of its term scores."""
    if scorer is Scorer.JACCARD:
        return total / (ql + dl - total)
    return total / ql if scorer is Scorer.QUERY_RATIO else total
