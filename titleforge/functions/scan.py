"""Searching blocks of the name index, a batch of queries at a time, in numpy: what the tasks of ``search`` run.

A block holds the names of a range of titles: postings by term, the title of each name, what filters ask of each title.
A task goes through all blocks with its queries and keeps the best of each, so nothing but the best is ever written.
Names that can't get among a query's best are passed over by bounds on what its frequent terms can add; the result is
the same as without.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs

#: Names of a block, and its postings, at most (a title's names stay together).
BLOCK_NAMES, BLOCK_POSTINGS = 65_536, 4_000_000
#: Best titles that are kept for a chunk of queries at most, and queries.
KEPT, CHUNK = 2_000_000, 8192
#: Scores equal to so many places are ties.
PLACES, MARGIN = 9, 1e-8
BLOCK = "first binary, n int, ids array<string>, title_of binary, doc_len binary, terms array<string>, dfs array<int>, starts binary, names binary, tfs binary, kinds array<string>, years binary, votes binary, known binary"
#: In ``known``: which values of a title aren't null, and whether it has several rows (which every filter lets pass here).
START, END, VOTES, SEVERAL = 1, 2, 4, 8


def _column(batches: list, name: str) -> pa.Array:
    return pa.concat_arrays([b.column(name) for b in batches])


def _block(batches: list) -> pa.RecordBatch:
    """One block of rows that are in the order of (id, variant): of a title (variant -2), its rating (-1), its names."""
    ids, variant = _column(batches, "id"), _column(batches, "variant").to_numpy(zero_copy_only=False)
    new = np.ones(len(ids), dtype=bool)
    new[1:] = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
    title = np.cumsum(new) - 1
    n = int(title[-1]) + 1
    name = np.flatnonzero(variant >= 0)
    named = pa.array(name)
    lists = _column(batches, "terms").take(named)
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    codes = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(order) else np.empty(0, np.int32)
    by = np.argsort(codes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(order)))]).astype(np.int64)
    owner = np.repeat(np.arange(len(name), dtype=np.int32), sizes)[by]
    tf = _column(batches, "tfs").take(named).flatten().to_numpy(zero_copy_only=False).astype(np.uint8)[by]
    known, years, votes = np.zeros(n, np.uint8), np.zeros((n, 2), np.int32), np.zeros(n, np.int64)
    kinds = [None] * n
    t = np.flatnonzero(variant == -2)
    for k, c in enumerate(("start_year", "end_year")):
        a = _column(batches, c).take(pa.array(t))
        years[title[t], k] = pc.fill_null(a, 0).to_numpy(zero_copy_only=False)
        known[title[t]] |= np.where(a.is_valid().to_numpy(zero_copy_only=False), (START, END)[k], 0).astype(np.uint8)
    for i, kind in zip(title[t].tolist(), _column(batches, "kind").take(pa.array(t)).to_pylist()):
        kinds[i] = kind
    r = np.flatnonzero(variant == -1)
    a = _column(batches, "votes").take(pa.array(r))
    votes[title[r]] = pc.fill_null(a, 0).to_numpy(zero_copy_only=False)
    known[title[r]] |= np.where(a.is_valid().to_numpy(zero_copy_only=False), VOTES, 0).astype(np.uint8)
    for rows in (t, r):
        known[np.bincount(title[rows], minlength=n) > 1] |= SEVERAL
    lens = _column(batches, "doc_len").take(named).to_numpy(zero_copy_only=False).astype(np.int32)
    data = [ids[0].as_py().encode(), n, ids.filter(pa.array(new)).to_pylist(), title[name].astype(np.int32).tobytes(), lens.tobytes(), coded.dictionary.take(pa.array(order)).to_pylist(), np.diff(starts).tolist(), starts.tobytes(), owner.tobytes(), tf.tobytes(), kinds, years.tobytes(), votes.tobytes(), known.tobytes()]
    types = [pa.list_(pa.string()) if "array<string>" in c else pa.list_(pa.int32()) if "array" in c else pa.int32() if c.endswith(" int") else pa.binary() for c in BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x], ty) for x, ty in zip(data, types)], names=[c.split(" ")[0] for c in BLOCK.split(", ")])


def make_blocks(batches):
    """Blocks of rows that are in the order of (id, variant). Several of a partition are cut between titles."""
    held, names, postings, last = [], 0, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        at = 0
        if names >= BLOCK_NAMES or postings >= BLOCK_POSTINGS:
            differ = pc.not_equal(b.column("id"), last).to_numpy(zero_copy_only=False)
            at = int(differ.argmax()) if differ.any() else b.num_rows
            if at:
                held.append(b.slice(0, at))
            if at < b.num_rows:
                yield _block(held)
                held, names, postings = [], 0, 0
        rest = b.slice(at)
        if rest.num_rows:
            held.append(rest)
            names += rest.num_rows
            postings += pc.sum(pc.list_value_length(rest.column("terms"))).as_py() or 0
            last = rest.column("id")[-1]
    if held:
        yield _block(held)


def _system(path: str):
    """The file system of a path or URI (local, or any that Arrow knows) and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Block:
    """A block in memory. bm25: (k1, b, mean length) of the scorer that weighs frequencies, None if a term counts as such."""

    def __init__(self, row: dict, bm25: tuple[float, float, float] | None):
        array = lambda name, kind: np.frombuffer(row[name].as_py(), dtype=kind)
        self.n, self.terms = row["n"].as_py(), row["terms"].values
        self.title_of, self.starts, self.names, self.tfs = array("title_of", np.int32), array("starts", np.int64), array("names", np.int32), array("tfs", np.uint8)
        self.size, self.dense, self.bm25 = len(self.title_of), {}, bm25
        counts = np.diff(self.starts)
        if bm25 is None:
            self.share, self.most = None, np.ones(len(counts))
        else:
            k1, b, mean = bm25
            self.length = k1 * ((1 - b) + (b / mean if mean else 0.0) * array("doc_len", np.int32))
            below = self.length[self.names]
            below += self.tfs
            self.share = self.tfs * (k1 + 1)
            self.share /= below
            self.most = np.maximum.reduceat(self.share, self.starts[:-1]) if len(counts) else np.zeros(0)
        self.counts = counts

    def add(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The sum of the terms' shares, for all names."""
        spans = [slice(a, e) for a, e in zip(self.starts[codes].tolist(), self.starts[codes + 1].tolist())]
        names = np.concatenate([self.names[s] for s in spans])
        if self.share is None:
            values = np.repeat(weights, self.counts[codes])
        else:
            values = np.concatenate([self.share[s] * w for s, w in zip(spans, weights.tolist())])
        return np.bincount(names, values, minlength=self.size)

    def look_up(self, code: int, of: np.ndarray, weight: float, length: np.ndarray | None) -> np.ndarray:
        """A term's shares of some names, which are in order and have these lengths."""
        a, e = self.starts[code], self.starts[code + 1]
        row = self.dense.get(code)
        if row is None and (e - a) * 200 >= self.size:  # frequent: a byte a name, kept for other queries
            row = self.dense[code] = np.zeros(self.size, np.uint8)
            row[self.names[a:e]] = self.tfs[a:e]
        if row is not None:
            tf = row[of]
        else:
            at = np.minimum(np.searchsorted(self.names[a:e], of), e - a - 1)
            tf = np.where(self.names[a:e][at] == of, self.tfs[a:e][at], 0)
        if length is None:
            return (tf > 0) * weight
        share = tf * (weight * (self.bm25[0] + 1))
        share /= tf + length
        return share


class Best:
    """The best titles of a query so far: scores and places in the order of ids."""

    def __init__(self, size: int):
        self.size, self.scores, self.titles, self.least = size, np.empty(0), np.empty(0, np.int64), -np.inf

    def add(self, scores: np.ndarray, titles: np.ndarray) -> None:
        s, t = np.concatenate([self.scores, scores]), np.concatenate([self.titles, titles])
        if len(s) > self.size:
            r = np.round(s, PLACES)
            least = np.partition(r, len(r) - self.size)[len(r) - self.size]
            keep, even = np.flatnonzero(r > least), np.flatnonzero(r == least)
            keep = np.concatenate([keep, even[np.argsort(t[even], kind="stable")[: self.size - len(keep)]]])
            s, t, self.least = s[keep], t[keep], least
        elif len(s) == self.size:
            self.least = np.round(s, PLACES).min()
        self.scores, self.titles = s, t

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.titles, -np.round(self.scores, PLACES)))
        s = self.scores[order]
        return s / s[0] if len(s) and s[0] > 0 else s, self.titles[order]


def search_block(block: Block, base: int, codes: np.ndarray, weights: np.ndarray, primary: np.ndarray, best: Best) -> None:
    """One query in one block. codes: its terms that the block has, primary ones first, rare ones before frequent ones."""
    least = best.least - MARGIN
    if not primary.any():
        return
    most = weights * block.most[codes]
    after = np.concatenate([np.cumsum(most[::-1])[::-1], [0.0]])  # what the terms from each on can add at most
    if after[0] < least:
        return
    # A name without the first ``e`` terms doesn't reach the least of the best; names without any primary term don't count.
    e = int(primary.sum())
    e = max(1, min(e, int(np.argmax(after < least)))) if after[-1] < least else e
    total = block.add(codes[:e], weights[:e])
    found = np.flatnonzero(total > 0) if after[e] >= least else np.flatnonzero(total >= least - after[e])
    score = total[found]
    rest = np.arange(e, len(codes))
    if len(rest) and len(found):
        if len(found) * len(rest) > 1.5 * block.counts[codes[rest]].sum() and not np.isfinite(least):
            score = score + block.add(codes[rest], weights[rest])[found]
        else:
            rest = rest[np.argsort(-most[rest], kind="stable")]
            left = np.concatenate([np.cumsum(most[rest][::-1])[::-1], [0.0]])
            length = None if block.bm25 is None else block.length[found]
            for k, i in enumerate(rest.tolist()):
                score += block.look_up(int(codes[i]), found, float(weights[i]), length)
                if np.isfinite(least) and k % 2 == 1:
                    ok = score >= least - left[k + 1]
                    n = np.count_nonzero(ok)
                    if not n:
                        return
                    if n < 0.8 * len(found):
                        found, score, length = found[ok], score[ok], None if length is None else length[ok]
    ok = score >= least
    found, score = found[ok], score[ok]
    if not len(found):
        return
    title = block.title_of[found]
    first = np.flatnonzero(np.concatenate([[True], title[1:] != title[:-1]]))
    best.add(np.maximum.reduceat(score, first), base + title[first].astype(np.int64))


def _rows(path: str, columns: list[str]):
    """The blocks below path in the order of their ids."""
    system, root = _system(path)
    files = [f.path for f in system.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")]
    at = []
    for f in sorted(files):
        for k, first in enumerate(pq.read_table(f, columns=["first"], filesystem=system).column(0).to_pylist()):
            at.append((first, f, k))
    for _, f, k in sorted(at):
        with system.open_input_file(f) as source:
            for i, b in enumerate(pq.ParquetFile(source).iter_batches(batch_size=1, columns=columns)):
                if i == k:
                    yield {c: b.column(c)[0] for c in columns}


def passes(q: dict, kinds: np.ndarray, code_of: dict[str, int], years: np.ndarray, votes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which titles may pass a query's filters; those with several rows always may."""
    ok = np.ones(len(known), dtype=bool)
    if q.get("p_kinds") is not None:
        wanted = np.zeros(len(code_of) + 1, dtype=bool)
        wanted[[code_of[k] for k in q["p_kinds"] if k in code_of]] = True
        ok &= wanted[kinds]  # the last is for null

    def within(x: np.ndarray, there: np.ndarray, low: int | None, high: int | None) -> np.ndarray:
        if low is None and high is None:
            return np.ones(len(x), dtype=bool)
        return there & (x >= (low if low is not None else x)) & (x <= (high if high is not None else x))

    lo, hi = q.get("p_year_lo"), q.get("p_year_hi")
    ok &= within(years[:, 0], known & START > 0, lo, hi) | within(years[:, 1], known & END > 0, lo, hi)
    ok &= within(votes, known & VOTES > 0, q.get("p_votes_lo"), q.get("p_votes_hi"))
    return ok | (known & SEVERAL > 0)


def search_chunk(path: str, queries: list[dict], own: list[tuple], vocabulary: dict[str, int], bm25: tuple[float, float, float] | None, filtered: bool):
    """Batches (qid, id, score, rank) of queries (qid, size, filters, and the number ``own`` of their name); own: the terms of each name, rare ones first."""
    size = [0] * len(own)
    for q in queries:
        size[q["own"]] = max(size[q["own"]], q["size"])
    best = [Best(s) for s in size]
    terms, base, bases = pa.array(list(vocabulary), pa.string()), 0, []
    for row in _rows(path, ["n", "title_of", "doc_len", "terms", "starts", "names", "tfs"]):
        block = Block(row, bm25)
        code = pc.fill_null(pc.index_in(terms, value_set=block.terms), -1).to_numpy(zero_copy_only=False)
        for b, (t, w, p) in zip(best, own):
            c = code[t]
            there = c >= 0
            search_block(block, base, c[there], w[there], p[there], b)
        bases.append(base)
        base += block.n
        del block, row
    ranked = []
    for k, b in enumerate(best):
        ranked.append(b.ranked())
        best[k] = None
    need = np.unique(np.concatenate([t for _, t in ranked])) if ranked else np.empty(0, np.int64)
    ids, kinds, code_of = np.empty(len(need), dtype=object), np.full(len(need), -1, dtype=np.int32), {}
    years, votes, known = np.zeros((len(need), 2), np.int32), np.zeros(len(need), np.int64), np.zeros(len(need), np.uint8)
    for start, row in zip(bases, _rows(path, ["n", "ids", "kinds", "years", "votes", "known"])):
        a, e = np.searchsorted(need, [start, start + row["n"].as_py()])
        at = need[a:e] - start
        ids[a:e] = row["ids"].values.take(pa.array(at)).to_numpy(zero_copy_only=False)
        if filtered:
            coded = row["kinds"].values.take(pa.array(at)).dictionary_encode()
            code = [code_of.setdefault(k, len(code_of)) for k in coded.dictionary.to_pylist()]
            kinds[a:e] = np.array([*code, -1], dtype=np.int32)[pc.fill_null(coded.indices, len(code)).to_numpy(zero_copy_only=False)]
            years[a:e] = np.frombuffer(row["years"].as_py(), np.int32).reshape(-1, 2)[at]
            votes[a:e], known[a:e] = np.frombuffer(row["votes"].as_py(), np.int64)[at], np.frombuffer(row["known"].as_py(), np.uint8)[at]
    qid, found, scores, ranks, held = [], [], [], [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(qid), pa.string()), pa.array(np.concatenate(found), pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(ranks), pa.int32())], names=["qid", "id", "score", "rank"])
    for q in queries:
        s, t = (x[: q["size"]] for x in ranked[q["own"]])
        at, r = np.searchsorted(need, t), np.arange(1, len(t) + 1)
        if filtered:
            ok = passes(q, kinds[at], code_of, years[at], votes[at], known[at])
            s, at, r = s[ok], at[ok], r[ok]
        if not len(s):
            continue
        for x, y in ((qid, np.full(len(s), q["qid"], dtype=object)), (found, ids[at]), (scores, s), (ranks, r.astype(np.int32))):
            x.append(y)
        held += len(s)
        if held >= 50_000:
            yield out()
            qid, found, scores, ranks, held = [], [], [], [], 0
    if held:
        yield out()


def searcher(path: str, bm25: tuple[float, float, float] | None, filtered: bool):
    """A function for mapInArrow: queries of a partition to their best titles. Queries of a name come one after the other."""

    def run(batches):
        held, own, vocabulary, last, kept = [], [], {}, None, 0
        for b in batches:
            for at in range(0, b.num_rows, 256):  # as Python objects terms are large
                for q in b.slice(at, 256).to_pylist():
                    terms, name = q.pop("terms"), q.pop("name")
                    if name != last or not own:
                        if len(own) >= CHUNK or kept + q["size"] > KEPT:
                            yield from search_chunk(path, held, own, vocabulary, bm25, filtered)
                            held, own, vocabulary, kept = [], [], {}, 0
                        terms.sort(key=lambda t: (not t["primary"], t["df"], t["term"]))
                        own.append((np.array([vocabulary.setdefault(t["term"], len(vocabulary)) for t in terms], dtype=np.int32), np.array([t["weight"] for t in terms], dtype=np.float64), np.array([t["primary"] for t in terms], dtype=bool)))
                        last, kept = name, kept + q["size"]
                    held.append({**q, "own": len(own) - 1})
        if held:
            yield from search_chunk(path, held, own, vocabulary, bm25, filtered)

    return run
