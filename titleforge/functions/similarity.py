"""String similarities for re-ranking, at least the machine epsilon."""

from __future__ import annotations

from enum import Enum
from types import FunctionType

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleforge.errors import UnknownSimilarity

EPSILON = 2.220446049250313e-16


class Similarity(str, Enum):
    NONE = "none"
    LEVENSHTEIN = "levenshtein"
    JARO = "jaro"
    JARO_WINKLER = "jarowinkler"

    @classmethod
    def parse(cls, name: str) -> "Similarity":
        try:
            return cls("jarowinkler" if name == "jaro-winkler" else name)
        except ValueError:
            raise UnknownSimilarity(name) from None

    def __str__(self) -> str:
        return self.value


def jaro(a: str, b: str) -> float:
    """Jaro (1989): matches within half the longer length; half of those out of order, rounded down as by Winkler, are transpositions."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, p: float = 0.1, longest: int = 4) -> float:
    """Winkler (1990): Jaro raised by the length of the common prefix, of at most ``longest``."""
    s, k = jaro(a, b), 0
    for x, y in zip(a[:longest], b[:longest]):
        if x != y:
            break
        k += 1
    return s + k * p * (1 - s)


def jaro_many(a: str, others: list[str], winkler: bool, p: float = 0.1, longest: int = 4, cells: int = 2_000_000) -> list[float]:
    """jaro or jaro_winkler of one text and many, a character of ``a`` at a time over a matrix of code points; texts of like length share a matrix."""
    import numpy as np

    points = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x, size = points(a), np.array([len(s) for s in others], dtype=np.int64)
    out, order, at = np.zeros(len(others)), np.argsort(size, kind="stable"), 0
    while at < len(order):
        # As many texts as keep the matrix small: at least one, however long.
        n = max(1, int(np.searchsorted(size[order[at:]] * np.arange(1, len(order) - at + 1), cells, side="right")))
        rows, at = order[at : at + n], at + n
        lens = size[rows]
        width = int(lens.max())
        if not width or not len(x):
            out[rows] = (lens == len(x)).astype(float)
            continue
        y = np.zeros((len(rows), width), dtype=np.uint32)
        y[np.arange(width) < lens[:, None]] = np.concatenate([points(others[r]) for r in rows])
        free, k = np.arange(width) < lens[:, None], np.arange(len(rows))
        reach = np.maximum(0, np.maximum(len(x), lens) // 2 - 1)
        matched = np.zeros((len(rows), len(x)), dtype=bool)
        for i, c in enumerate(x):
            lo, hi = np.maximum(0, i - reach), np.minimum(lens, i + reach + 1)
            l0, h0 = int(lo.min()), max(int(hi.max()), int(lo.min()) + 1)
            cols = np.arange(l0, h0)
            ok = (y[:, l0:h0] == c) & free[:, l0:h0] & (cols >= lo[:, None]) & (cols < hi[:, None])
            if not ok.shape[1]:
                continue
            first = ok.argmax(axis=1)
            hit = ok[k, first]
            free[k[hit], l0 + first[hit]] = False
            matched[:, i] = hit
        taken = (np.arange(width) < lens[:, None]) & ~free
        m = matched.sum(axis=1)
        left, right = np.zeros((len(rows), int(m.max()) + 1), dtype=np.uint32), np.zeros((len(rows), int(m.max()) + 1), dtype=np.uint32)
        r, c = np.nonzero(matched)
        left[r, (matched.cumsum(axis=1) - 1)[r, c]] = x[c]
        r, c = np.nonzero(taken)
        right[r, (taken.cumsum(axis=1) - 1)[r, c]] = y[r, c]
        swaps = (left != right).sum(axis=1) // 2
        safe = np.maximum(m, 1)
        s = np.where(m > 0, (m / len(x) + m / np.maximum(lens, 1) + (m - swaps) / safe) / 3, 0.0)
        if winkler:
            w = min(longest, width, len(x))
            same = (y[:, :w] == x[:w]) & (np.arange(w) < lens[:, None])
            s = s + np.logical_and.accumulate(same, axis=1).sum(axis=1) * p * (1 - s)
        out[rows] = s
    return out.tolist()


def _udf(kind: Similarity):
    """An Arrow UDF that carries its function with it by value, so that executors need not have this package."""
    winkler = kind is Similarity.JARO_WINKLER
    many = FunctionType(jaro_many.__code__, {"__builtins__": __builtins__}, "jaro_many", jaro_many.__defaults__)
    many.__module__ = "__main__"

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        import pyarrow

        of: dict = {}  # by query its titles, each once
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            if x is not None and y is not None:
                of.setdefault(x, {})[y] = 0.0
        for x, ys in of.items():
            ys.update(zip(ys, many(x, list(ys), winkler)))
        return pyarrow.array([None if x is None or y is None else of[x][y] for x, y in zip(a.to_pylist(), b.to_pylist())], pyarrow.float64())

    run.__module__ = "__main__"
    return F.arrow_udf(run, T.DoubleType())


def similarity(kind: Similarity, a: Column, b: Column) -> Column:
    """Null if a or b is null, but 1 for NONE."""
    if kind is Similarity.NONE:
        return F.lit(1.0)
    if kind is Similarity.LEVENSHTEIN:
        s = F.lit(1.0) / (F.lit(1.0) + F.levenshtein(a, b))
    else:
        s = _udf(kind)(a, b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(s, F.lit(EPSILON)))
