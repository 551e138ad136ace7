"""Vectorised text features for Arrow batches: byte n-grams, word hashes, sums of feature weights per document.

Everything works on the concatenated UTF-8 bytes of a batch, a chunk of about a quarter of a megabyte at a time, so memory doesn't
depend on how long a document is, and no Python loop runs over characters or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)  # one code point for one, so the number of characters stays
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw, offs


def doc_groups(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [d0, d1) of documents of about ``limit`` bytes; a longer document is a run of its own."""
    n, d0 = len(offs) - 1, 0
    while d0 < n:
        d1 = max(d0 + 1, int(np.searchsorted(offs, offs[d0] + limit, side="right")) - 1)
        d1 = min(d1, n, d0 + 32768)
        yield d0, d1
        d0 = d1


def _table(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        t = np.full(n, base, dtype=np.uint64)
        t[0] = 1
        _powers[name] = np.multiply.accumulate(t)
    return _powers[name]


class _Spans:
    """64-bit hashes of byte spans [s, e) of one piece, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        size = max(n + 1, 2 * CHUNK)
        self.down = _table("down", pow(_BASE, -1, 2**64), size)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table("up", _BASE, size)[:n], out=self.prefix[1:])

    def hash(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.prefix[e] - self.prefix[s]) * self.down[s] + (e - s).astype(np.uint64) * _GOLD)


def _word_spans(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and ends in one piece of bytes; starts_at: where documents start, which also ends words."""
    n = len(data)
    isw = _IS_WORD[data]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[starts_at] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = isw[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = isw[1:]
    return np.flatnonzero(isw & (~before | fresh[:-1])), np.flatnonzero(isw & (~after | fresh[1:])) + 1


def _pieces(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Pieces of a long document, cut behind a byte that no word has (else anywhere, in a word longer than the limit)."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + limit)
        if hi < n:
            gaps = np.flatnonzero(~_IS_WORD[data[lo:hi]])
            hi = lo + int(gaps[-1]) + 1 if len(gaps) else hi
        yield lo, hi
        lo = hi


class Words:
    """The words of documents d0..d1 of a batch: ``hash``, and ``offs`` of each document's words; ``prefix`` hashes if asked for."""

    def __init__(self, d0: int, d1: int, hash: np.ndarray, offs: np.ndarray, prefix: list[np.ndarray]):
        self.d0, self.d1, self.hash, self.offs, self.prefix = d0, d1, hash, offs, prefix

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.d1 - self.d0), np.diff(self.offs))


def words(data: np.ndarray, offs: np.ndarray, prefixes: tuple[int, ...] = (), limit: int = CHUNK) -> Iterator[Words]:
    """Words are runs of ASCII letters and digits and of characters beyond ASCII. prefixes: byte lengths of which each longer word's prefix is hashed too (0 for others)."""
    for d0, d1 in doc_groups(offs, limit):
        lo, hi = int(offs[d0]), int(offs[d1])
        found: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        for a, b in [(0, hi - lo)] if hi - lo <= limit else _pieces(data[lo:hi], limit):
            if b == a:
                continue
            part = data[lo + a : lo + b]
            at = offs[d0:d1] - lo - a
            s, e = _word_spans(part, at[(at >= 0) & (at < b - a)])
            spans = _Spans(part)
            h = spans.hash(s, e)
            pre = []
            for k in prefixes:
                longer = e - s > k
                x = np.zeros(len(s), dtype=np.uint64)
                x[longer] = spans.hash(s[longer], s[longer] + k) ^ np.uint64(k)
                pre.append(x)
            found.append((s + lo + a, h, pre))
        starts = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=np.int64)
        hashes = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.uint64)
        pre = [np.concatenate([f[2][k] for f in found]) if found else np.zeros(0, dtype=np.uint64) for k in range(len(prefixes))]
        yield Words(d0, d1, hashes, np.searchsorted(starts, offs[d0 : d1 + 1]).astype(np.int64), pre)


def latin_lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, byte for byte."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] |= 0x20
    if len(data) > 1:
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        second = data[after]
        up = after[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
        out[up] += 0x20
    return out


def gram_features(data: np.ndarray, offs: np.ndarray, sizes: tuple[int, ...], bits: int, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, first, last, feature): byte n-grams hashed to ``bits`` bits; a document's features in a piece are feature[first:last]."""
    for d0, d1 in doc_groups(offs, limit):
        lo, hi = int(offs[d0]), int(offs[d1])
        for a in range(lo, max(hi, lo + 1), limit if d1 - d0 == 1 else max(1, hi - lo)):
            b = min(hi, a + limit) if d1 - d0 == 1 else hi
            for n in sizes:
                end = min(hi, b + n - 1)
                if end - a < n:
                    continue
                d = data[a:end].astype(np.uint32)
                code = d[: len(d) - n + 1].copy()
                for k in range(1, n):
                    code |= d[k : len(d) - n + 1 + k] << np.uint32(8 * k)
                if n < 4:
                    code += np.uint32((0xF8 + n) << 24)
                feature = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
                first = np.maximum(offs[d0:d1], a) - a
                last = np.minimum(offs[d0 + 1 : d1 + 1] - n + 1, b) - a
                ok = last > first
                yield np.arange(d0, d1)[ok], first[ok], last[ok], feature


def word_features(w: Words, bits: int, bigrams: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As gram_features, of words and of pairs of neighbours. A pair is hashed by its difference, so all immediate repeats of a word share a feature."""
    first, last = w.offs[:-1], w.offs[1:]
    docs = np.arange(w.d0, w.d1)
    ok = last > first
    yield docs[ok], first[ok], last[ok], (mix(w.hash ^ _GOLD) >> np.uint64(64 - bits)).astype(np.int64)
    if bigrams and len(w.hash) > 1:
        pair = (mix(w.hash[1:] - w.hash[:-1] + np.uint64(7)) >> np.uint64(64 - bits)).astype(np.int64)
        ok = last - 1 > first
        yield docs[ok], first[ok], last[ok] - 1, pair


def add_sums(sums: np.ndarray, counts: np.ndarray, tables: np.ndarray, part: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Add the weights of a part's features to sums[model, document], their number to counts."""
    docs, first, last, feature = part
    if not len(docs):
        return
    counts[docs] += last - first
    for k, table in enumerate(tables):
        c = np.cumsum(table[feature], dtype=np.float64)
        sums[k, docs] += c[last - 1] - np.where(first > 0, c[np.maximum(first - 1, 0)], 0.0)


def frequencies(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], n: int, bits: int, shrink: float = 0.0) -> np.ndarray:
    """Feature counts of n documents over their total plus ``shrink``, as rows of a dense matrix (for bounded training samples)."""
    x = np.zeros((n, 1 << bits), dtype=np.float32)
    for docs, first, last, feature in parts:
        for d, a, b in zip(docs, first, last):
            x[d] += np.bincount(feature[a:b], minlength=1 << bits)
    return x / np.maximum(1, x.sum(axis=1, keepdims=True) + shrink)
