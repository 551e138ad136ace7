"""SimHash near-dedup (operator 6): pigeonhole blocks of 128-bit fingerprints, joined on blocks, verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleforge.llm import textvec as tv
from titleforge.llm.common import cut, doc_key, id_of, id_type, key_id, packed, ship, unpacked

#: Two fingerprints of 128 bits are close if they differ in at most MAX_BITS bits.
MAX_BITS, WIDTH = 17, 128
LANE = 60_000
_LANES = np.array([sum((v >> k & 1) << (16 * k) for k in range(4)) for v in range(16)], dtype=np.uint64)
KEY_BITS = 26
#: (parts, equal) of the block tables to choose from, and about what a row in a table and a comparison take, in seconds.
CHOICES = ((6, 3), (6, 4), (3, 4), (3, 5), (3, 6))
ROW_S, PAIR_S = 2e-6, 5e-9


class Scheme:
    """Block tables in which all close pairs meet, by the pigeonhole principle twice over.

    The bits are cut into ``parts``; two close fingerprints differ in few bits of one part at least: in at most t_i bits
    of part i for some i, as the sum of all (t_i + 1) is MAX_BITS + 1. Part i is cut into t_i + ``equal`` pieces, of which
    those bits touch t_i at most, so ``equal`` pieces are the same. Each choice of so many pieces of a part is a table.
    More equal pieces make longer keys: more tables, fewer comparisons. All schemes find the same pairs.
    """

    def __init__(self, parts: int, equal: int):
        self.parts, self.equal = parts, equal
        bound = lambda k, n, lo, hi: lo + (hi - lo) * k // n
        most = [(MAX_BITS + 1) // parts - 1 + (i < (MAX_BITS + 1) % parts) for i in range(parts)]
        self.pieces = []
        for i, t in enumerate(most):
            lo, hi = bound(i, parts, 0, WIDTH), bound(i + 1, parts, 0, WIDTH)
            self.pieces.append([(bound(k, t + equal, lo, hi), bound(k + 1, t + equal, lo, hi)) for k in range(t + equal)])
        self.tables = [(i, c) for i, p in enumerate(self.pieces) for c in combinations(range(len(p)), equal)]
        self.width = max(sum(self.pieces[i][k][1] - self.pieces[i][k][0] for k in c) for i, c in self.tables)
        self.load = sum(2.0 ** -sum(self.pieces[i][k][1] - self.pieces[i][k][0] for k in c) for i, c in self.tables)
        self.first = []
        for i, p in enumerate(self.pieces):
            masks, first = np.arange(1 << len(p)), np.full(1 << len(p), len(self.tables))
            for t, c in reversed([(t, c) for t, (j, c) in enumerate(self.tables) if j == i]):
                m = sum(1 << k for k in c)
                first[masks & m == m] = t
            self.first.append(first)

    @classmethod
    def of(cls, n: int) -> "Scheme":
        """The scheme that takes the least time for n fingerprints."""
        return min((cls(*c) for c in CHOICES), key=lambda s: n * len(s.tables) * ROW_S + n * n / 2 * s.load * PAIR_S)

    def keys(self, a, b) -> list:
        """The keys of a fingerprint, as column expressions of its halves (a: bits 0 to 63)."""

        def piece(lo: int, hi: int):
            if lo >= 64:
                x = F.shiftrightunsigned(b, lo - 64)
            elif hi <= 64:
                x = F.shiftrightunsigned(a, lo)
            else:
                x = F.shiftrightunsigned(a, lo).bitwiseOR(F.shiftleft(b, 64 - lo))
            return x.bitwiseAND(F.lit((1 << (hi - lo)) - 1))

        out = []
        for t, (i, c) in enumerate(self.tables):
            key, at = F.lit(t << KEY_BITS).cast("long"), 0
            for k in c:
                lo, hi = self.pieces[i][k]
                key = key.bitwiseOR(F.shiftleft(piece(lo, hi), at))
                at += hi - lo
            out.append(key)
        return out

    def first_table(self, xa: np.ndarray, xb: np.ndarray) -> np.ndarray:
        """The first of the tables in which a pair meets, by the differences of its halves."""
        best = np.full(len(xa), len(self.tables))
        for p, first in zip(self.pieces, self.first):
            mask = np.zeros(len(xa), dtype=np.int64)
            for k, (lo, hi) in enumerate(p):
                m = ((1 << hi) - 1) ^ ((1 << lo) - 1)
                same = ((xa & np.uint64(m & (2**64 - 1))) == 0) & ((xb & np.uint64(m >> 64)) == 0)
                mask |= same.astype(np.int64) << k
            best = np.minimum(best, first[mask])
        return best


_FP = T.StructType([T.StructField("id", T.LongType()), T.StructField("th", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_EDGE = T.StructType([T.StructField(c, T.LongType()) for c in ("a1", "b1", "a2", "b2")])


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint halves as uint64 [n, 2], whether the text has a word). Features are the distinct lower-cased words, of weight 1."""
    data, offs = tv.text_bytes(texts, lower=True)
    n = len(offs) - 1
    out, has = np.zeros((n, 2), dtype=np.uint64), np.zeros(n, dtype=bool)
    for w in tv.words(data, offs):
        if not len(w.hash):
            continue
        key = np.unique((w.doc.astype(np.uint64) << np.uint64(48)) | (w.hash >> np.uint64(16)))
        doc, word = (key >> np.uint64(48)).astype(np.int64), key << np.uint64(16)
        # Votes are added up in four 16-bit lanes of a word, so a run has at most LANE words of one document.
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        starts = np.flatnonzero(place % LANE == 0)
        size = np.bincount(doc, minlength=w.d1 - w.d0)
        some = size > 0
        for half in range(2):
            x = tv.mix(word + np.uint64(half * 0x632BE59BD9B4E019 + 1))
            value = np.zeros(w.d1 - w.d0, dtype=np.uint64)
            for nibble in range(16):
                lanes = np.add.reduceat(_LANES[((x >> np.uint64(4 * nibble)) & np.uint64(15)).astype(np.int64)], starts)
                for bit in range(4):
                    votes = np.bincount(doc[starts], weights=((lanes >> np.uint64(16 * bit)) & np.uint64(0xFFFF)).astype(np.float64), minlength=w.d1 - w.d0)
                    value |= (votes * 2 > size).astype(np.uint64) << np.uint64(4 * nibble + bit)
            out[w.d0 : w.d1, half][some] = value[some]
        has[w.d0 : w.d1] = some
    return out, has


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, has = fingerprints(batch.column(2))
        a, b = (pa.array(fp[:, k].view(np.int64), mask=~has) for k in range(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), a, b], ["id", "th", "a", "b"])


SMALL = 256


def block_edges(key: np.ndarray, a: np.ndarray, b: np.ndarray, scheme: Scheme) -> list[np.ndarray]:
    """Edges between close fingerprints within runs of equal key; of a large run, a spanning forest of its close pairs."""
    edges: list[np.ndarray] = []
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(starts, len(key)))
    # Runs of up to SMALL: all rows with the row d places on, for each d.
    left = np.repeat(size, size) - (np.arange(len(key)) - np.repeat(starts, size)) - 1
    rows = np.flatnonzero((np.repeat(size, size) <= SMALL) & (left > 0))
    d = 1
    while len(rows):
        xa, xb = a[rows] ^ a[rows + d], b[rows] ^ b[rows + d]
        hit = np.flatnonzero(np.bitwise_count(xa).astype(np.int16) + np.bitwise_count(xb) <= MAX_BITS)
        if len(hit):
            hit = hit[scheme.first_table(xa[hit], xb[hit]) == key[rows[hit]] >> KEY_BITS]  # else the pair is found in another table
            i, j = rows[hit], rows[hit] + d
            edges.append(np.stack([a[i], b[i], a[j], b[j]]))
        d += 1
        rows = rows[left[rows] >= d]
    for s, n in zip(starts[size > SMALL], size[size > SMALL]):
        rest = np.arange(s, s + n)
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                i = queue.pop()
                near = np.bitwise_count(a[rest] ^ a[i]).astype(np.int16) + np.bitwise_count(b[rest] ^ b[i]) <= MAX_BITS
                j = rest[near]
                if len(j):
                    edges.append(np.stack([np.full(len(j), a[i]), np.full(len(j), b[i]), a[j], b[j]]))
                    queue.extend(j.tolist())
                    rest = rest[~near]
    return edges


def _edge_batches(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; the last run of a batch waits for the next."""
    wait: list[list[np.ndarray]] = []

    def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        edges = block_edges(*cols, scheme)
        if edges:
            e = np.concatenate(edges, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in e], _EDGE.names)

    def gathered() -> Iterator[list[np.ndarray]]:
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(0).to_numpy().astype(np.int64), *(batch.column(k).to_numpy().view(np.uint64) for k in (1, 2))])
            n += batch.num_rows
            if n >= 20_000:
                yield [np.concatenate(x) for x in zip(*held)]
                held, n = [], 0
        if n:
            yield [np.concatenate(x) for x in zip(*held)]

    for cols in gathered():
        key = cols[0]
        at = int(np.searchsorted(key, key[-1]))
        if at == 0 and wait and wait[-1][0][0] == key[0]:
            wait.append(cols)
            continue
        full = [np.concatenate(x) for x in zip(*wait, [c[:at] for c in cols])] if wait else [c[:at] for c in cols]
        if len(full[0]):
            yield from emit(full)
        wait = [[c[at:] for c in cols]]
    if wait:
        yield from emit([np.concatenate(x) for x in zip(*wait)])


def _symmetric(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, root) of every node of an undirected graph (columns u, v of any ordered type): the least node of its component.

    Alternates large-star and small-star (Kiveris et al. 2014) until nothing changes, which takes about the logarithm of
    the longest path; each round is cut by a checkpoint.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(rounds):
        s = _symmetric(e)
        low = s.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = s.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = cut(e)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select("u", F.col("v").alias("root")).union(e.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme | None = None) -> DataFrame:
    """(key, n, kept, n_group) of every distinct (doc_id, text): its number of rows, the key that stays of its group, the group's rows.

    Groups are the connected components of "fingerprints differ in at most MAX_BITS of 128 bits"; equal fingerprints
    are one node, whatever their number. Of a group, the lowest doc_id stays. Every fingerprint is in all block tables of
    the ``scheme``, which is chosen by the number of fingerprints (counted first): the more there are, the longer the
    keys; all schemes give the same pairs. Blocks of up to SMALL fingerprints give all their close pairs, once each; larger ones a
    spanning forest, which joins the same groups without a pair for every two of thousands of copies. Nothing is capped.
    Only ids, hashes and fingerprints are shuffled, never texts.

    Defined cases: a text that is null or has no word is never a duplicate; ids may be numbers or texts; rows without
    doc_id rank after all others, by the hash of their text; rows equal in doc_id and text are copies of which one stays;
    extra columns are ignored; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    text, kind = F.col(f"`{text_col}`"), id_type(docs, id_col)
    shape = T.StructType([T.StructField("id", kind), *_FP.fields[1:]])
    fp = docs.select(id_of(docs, id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("t")).mapInArrow(_fingerprint_batches, shape)
    rows = cut(fp.groupBy("a", "b", "id", "th").agg(F.count(F.lit(1)).alias("n")))
    node = F.when(F.col("a").isNotNull(), F.struct("a", "b"))
    distinct = cut(rows.filter(F.col("a").isNotNull()).select("a", "b").distinct())
    own = scheme or Scheme.of(distinct.count())
    blocks = distinct.select(F.explode(F.array(*own.keys(F.col("a"), F.col("b")))).alias("key"), "a", "b").repartition("key").sortWithinPartitions("key")
    edges = blocks.mapInArrow(lambda batches: _edge_batches(batches, own), _EDGE).select(F.struct(F.col("a1").alias("a"), F.col("b1").alias("b")).alias("u"), F.struct(F.col("a2").alias("a"), F.col("b2").alias("b")).alias("v"))
    roots = components(edges).select(F.col("u.a").alias("ra"), F.col("u.b").alias("rb"), "root")
    joined = rows.join(roots, (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")), "left")
    key = doc_key(F.col("id"), F.col("th"), kind)
    alone = F.struct(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    keyed = joined.select(key.alias("key"), "n", F.coalesce("root", node).alias("node"), alone.alias("none"))
    group = keyed.select("key", "n", F.struct(F.coalesce("node", "none").alias("node"), F.when(F.col("node").isNull(), F.col("key")).alias("own")).alias("g"))
    heads = group.groupBy("g").agg(F.min("key").alias("kept"), F.sum("n").alias("n_group"))
    return group.join(heads.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))).select("key", "n", "kept", "n_group")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id, group_size, duplicate) of every row of documents; of rows alike in all, the first isn't a duplicate if its key stays."""
    d = near_duplicates(docs).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return d.select(key_id(F.col("key")).alias("doc_id"), key_id(F.col("kept")).alias("kept_doc_id"), F.col("n_group").alias("group_size"), ((F.col("key") != F.col("kept")) | (F.col("copy") > 1)).alias("duplicate"))


def stage(docs: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of docs of which one of each group stays. What goes is broadcast if it is at most max_broadcast keys (counted first), else joined by shuffling."""
    d = cut(near_duplicates(docs).filter((F.col("key") != F.col("kept")) | (F.col("n") > 1)))
    gone = d.filter(F.col("key") != F.col("kept")).select(F.col("key").alias("gone"))
    twins = d.filter(F.col("key") == F.col("kept")).select(F.col("key").alias("twin"))
    small = (lambda x: F.broadcast(x)) if d.count() <= max_broadcast else (lambda x: x)
    rows = packed(docs, key=doc_key(id_of(docs, "doc_id"), F.xxhash64("text"), id_type(docs, "doc_id"))).join(small(gone), F.col("key") == F.col("gone"), "left_anti")
    once = rows.join(small(twins), F.col("key") == F.col("twin"), "left_anti").select("row")
    if twins.isEmpty():
        return unpacked(rows, docs.columns)
    again = rows.join(small(twins), F.col("key") == F.col("twin"), "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row")
    return unpacked(once.unionByName(again), docs.columns)
