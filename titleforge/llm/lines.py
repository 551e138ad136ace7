"""Lines of the texts of an Arrow batch: where they are, their hashes, and texts without some of them. Linear in the bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from titleforge.llm import textvec as tv

#: Longer lines are hashed a line at a time.
LONG = 1 << 16
_TRIM = b" \t\r"
_INK = np.ones(256, dtype=bool)
_INK[[32, 9, 13, 10]] = False


@dataclass
class Lines:
    """Lines of documents, blank ones left out: document, place in it, where the trimmed line is, its hash."""

    doc: np.ndarray
    place: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def _pieces(data: np.ndarray, lo: int, hi: int, limit: int) -> Iterator[tuple[int, int]]:
    """Parts of a long document that end behind a line feed; a line longer than the limit is a part of its own."""
    while lo < hi:
        end = min(hi, lo + limit)
        if end < hi:
            feeds = np.flatnonzero(data[lo:end] == 10)
            if len(feeds):
                end = lo + int(feeds[-1]) + 1
            else:
                while end < hi:
                    feeds = np.flatnonzero(data[end : min(hi, end + limit)] == 10)
                    if len(feeds):
                        end += int(feeds[0]) + 1
                        break
                    end = min(hi, end + limit)
        yield lo, end
        lo = end


def _slow_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little")


def lines(data: np.ndarray, offs: np.ndarray, limit: int = tv.CHUNK) -> Iterator[Lines]:
    """All lines of all texts but blank ones, a megabyte or so at a time, in order."""
    for d0, d1 in tv.doc_groups(offs, limit):
        lo, hi = int(offs[d0]), int(offs[d1])
        if hi - lo <= limit or d1 - d0 > 1:
            yield from _lines_of(data, lo, hi, offs[d0:d1], offs[d0 + 1 : d1 + 1], np.arange(d0, d1), 0)
            continue
        before = 0
        for a, b in _pieces(data, lo, hi, limit):
            ended = data[b - 1] == 10 and b < hi  # the line feed at a part's end opens no line there, but in the next
            stop = b - 1 if ended else b
            if b - a > limit and not (data[a:stop] == 10).any():
                line = data[a:stop].tobytes()
                core = line.strip(_TRIM)
                if core:
                    s = a + len(line) - len(line.lstrip(_TRIM))
                    h = np.array([_slow_hash(core)], dtype=np.uint64)
                    yield Lines(np.array([d0]), np.array([before]), np.array([s]), np.array([s + len(core)]), h)
            else:
                yield from _lines_of(data, a, stop, np.array([a]), np.array([stop]), np.array([d0]), before)
            before += int((data[a:b] == 10).sum())


def _lines_of(data: np.ndarray, lo: int, hi: int, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, before: int) -> Iterator[Lines]:
    part = data[lo:hi]
    if not len(part):
        return
    feeds = np.flatnonzero(part == 10) + lo
    first = np.sort(np.concatenate([starts, feeds + 1]), kind="stable")
    last = np.sort(np.concatenate([feeds, ends]), kind="stable")
    count = np.searchsorted(feeds, ends) - np.searchsorted(feeds, starts) + 1
    doc = np.repeat(docs, count)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + before
    ink = np.flatnonzero(_INK[part]) + lo
    if not len(ink):
        return
    at = np.searchsorted(ink, first)
    s = ink[np.minimum(at, len(ink) - 1)]
    some = (at < len(ink)) & (s < last)
    e = ink[np.maximum(np.searchsorted(ink, last) - 1, 0)] + 1
    doc, place, s, e = doc[some], place[some], s[some], e[some]
    spans = tv._Spans(part)
    h = spans.hash(s - lo, e - lo)
    for k in np.flatnonzero(e - s > LONG):
        h[k] = _slow_hash(data[s[k] : e[k]].tobytes())
    yield Lines(doc, place, s, e, h)


def lists(values: pa.Array, doc: np.ndarray, n: int) -> pa.ListArray:
    """A list for each of n documents of the values, which are in the order of ``doc``."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), values)


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Spans of the bytes as strings."""
    size = end - start
    offs = np.concatenate([[0], np.cumsum(size)])
    if offs[-1]:
        at = np.repeat(start - offs[:-1], size) + np.arange(offs[-1])
        body = data[at]
    else:
        body = np.zeros(0, dtype=np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())]).cast(pa.string())


def without(text: str | None, gone: np.ndarray) -> str | None:
    """A text without the lines at the places ``gone``."""
    if text is None or not len(gone):
        return text
    parts = text.split("\n")
    keep = np.ones(len(parts), dtype=bool)
    keep[gone] = False
    return "\n".join(p for p, k in zip(parts, keep) if k)
