"""Quality rules (operator 4): calibrated logistic regression over hashed word and character n-grams, with fixed thresholds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleforge.llm import textvec as tv
from titleforge.llm.common import labelled_sample, packed, ship
from titleforge.llm.linear import fit_logistic, gram, platt, scaled, sigmoid

BITS, SIZES = 13, (2, 3)
#: Added to a text's number of features, so that the few of a short text move its score less.
SHRINK = 60


def _parts(texts: pa.Array):
    """Character n-grams of the text as it is, and words and word pairs, in two tables of features."""
    data, offs = tv.text_bytes(texts)
    chars = tv.gram_features(data, offs, SIZES, BITS)
    pairs = (p for w in tv.words(data, offs) for p in tv.word_features(w, BITS))
    return chars, pairs, len(offs) - 1


@dataclass
class Model:
    """Weights of the character and the word table over relative frequencies, the bias, and Platt's (a, b)."""

    chars: np.ndarray
    words: np.ndarray
    bias: float
    scale: tuple[float, float]

    @classmethod
    def fit(cls, texts: list[str], y: np.ndarray) -> "Model":
        """Four of five rows train the weights, the fifth calibrates them."""
        if not len(y) or len(set(y.tolist())) < 2:
            p = (y.sum() + 1) / (len(y) + 2)
            return cls(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, (0.0, float(np.log(p / (1 - p)))))
        chars, pairs, n = _parts(pa.array(texts, pa.string()))
        x = np.concatenate([tv.frequencies(chars, n, BITS, SHRINK), tv.frequencies(pairs, n, BITS, SHRINK)], axis=1)
        held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.ones(len(y), dtype=bool)
        use = ~held if len(y) >= 50 else held
        z, factor = scaled(x[use])
        alpha, b = fit_logistic(gram(z), y[use])
        w = (alpha.astype(np.float32) @ z) * factor
        a = platt(x[held] @ w + b, y[held])
        return cls(w[: 1 << BITS].copy(), w[1 << BITS :].copy(), b, a)

    def predict(self, texts: pa.Array) -> np.ndarray:
        """The probability that each text is good; NaN for a text without any n-gram."""
        chars, pairs, n = _parts(texts)
        total, some = np.full(n, self.bias), np.zeros(n, dtype=bool)
        for parts, table in ((chars, self.chars), (pairs, self.words)):
            sums, counts = np.zeros((1, n)), np.zeros(n, dtype=np.int64)
            for p in parts:
                tv.add_sums(sums, counts, table[None], p)
            total += sums[0] / (counts + SHRINK)
            some |= counts > 0
        return np.where(some, sigmoid(self.scale[0] * total + self.scale[1]), np.nan)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1000) -> Model:
    """Fit on at most per_class labelled documents of each quality, those whose hash is least; ids may be numbers or texts.

    The ids are bounded before the join, and the rows once more after it, as an id may have many rows.
    """
    rows = labelled_sample(docs, labels, "quality", per_class, 29)
    return Model.fit([r["t"] for r in rows], np.array([r["y"] for r in rows], dtype=np.float64))


def score(docs: DataFrame, model: Model, text_col: str = "text", reject_below: float = 0.2, good_from: float = 0.8) -> DataFrame:
    """docs packed as ``row``, with p_good, grade ('good', 'fair', 'poor') and keep (p_good is at least reject_below).

    Whole texts, in Arrow batches; no shuffle. Defined cases: a text that is null or too short for a character or word
    n-gram has a null p_good, is 'poor' and isn't kept; without rows of both classes p_good is the smoothed share of
    good rows; repeated rows get equal results; extra columns are carried in ``row``; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.predict(texts), pa.float64(), from_pandas=True)

    d = packed(docs, t=F.col(f"`{text_col}`")).select("row", run.asNondeterministic()("t").alias("p_good"))
    grade = F.when(F.col("p_good") >= good_from, "good").when(F.col("p_good") >= reject_below, "fair").otherwise("poor")
    return d.select("row", "p_good", grade.alias("grade"), F.coalesce(F.col("p_good") >= reject_below, F.lit(False)).alias("keep"))


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_good, grade, keep) of every row of documents."""
    return score(docs, train(docs, labels)).select(F.col("row.doc_id").alias("doc_id"), "p_good", "grade", "keep")
