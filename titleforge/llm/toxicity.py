"""Toxicity (operator 8): weak supervision. Voters, a generative label model over their votes, a classifier on its posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleforge.llm import textvec as tv
from titleforge.llm.common import cut, packed, sample_by_class, ship
from titleforge.llm.linear import sigmoid

#: Lexicon voters that need no data. Each list is one voter.
LEXICONS: tuple[tuple[str, ...], ...] = (
    ("idiot", "idiots", "moron", "morons", "imbecile", "stupid", "dumb", "fool"),
    ("loser", "losers", "pathetic", "worthless", "useless"),
    ("scum", "trash", "garbage", "vermin", "disgusting", "filth"),
    ("clown", "clowns", "freak", "creep", "pig", "rat"),
    ("kill", "die", "hate", "shut"),
    ("dummkopf", "trottel", "arschloch", "schwachkopf", "versager", "abschaum", "idioten"),
    ("imbécile", "crétin", "connard", "salaud", "minable", "ordure", "débile"),
    ("imbécil", "estúpido", "estúpida", "basura", "escoria", "payaso", "inútil", "asqueroso"),
)
PREFIXES = (4, 5, 6, 7, 8)  # bytes of a word's beginning that pattern voters look at
MINED_WORDS, MINED_PREFIXES = 10, 10
BITS = 18


def _hashes(words: list[str]) -> np.ndarray:
    data, offs = tv.text_bytes(pa.array(words, pa.string()), lower=True)
    return np.concatenate([w.hash for w in tv.words(data, offs)]) if words else np.zeros(0, dtype=np.uint64)


def _doc_features(w: tv.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document, hash) of each word, and of each word's prefixes; kinds are kept apart by the hash."""
    doc = w.doc
    return [(doc, w.hash)] + [(doc[p != 0], p[p != 0]) for p in w.prefix]


def distinct_features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(d0, d1, document, feature) with each document's distinct words and prefixes, 48 bits of hash."""
    data, offs = tv.text_bytes(texts, lower=True)
    for w in tv.words(data, offs, PREFIXES):
        pairs = _doc_features(w)
        doc = np.concatenate([p[0] for p in pairs]).astype(np.uint64)
        key = np.unique((doc << np.uint64(48)) | (np.concatenate([p[1] for p in pairs]) >> np.uint64(16)))
        yield w.d0, w.d1, (key >> np.uint64(48)).astype(np.int64), key & np.uint64(0xFFFFFFFFFFFF)


def found_features(texts: pa.Array, wanted: np.ndarray) -> Iterator[tuple[tv.Words, np.ndarray, np.ndarray]]:
    """(words, document, feature) as distinct_features, but only features whose top BITS bits after mixing are ``wanted`` (a bool each), which are few."""
    data, offs = tv.text_bytes(texts, lower=True)
    for w in tv.words(data, offs, PREFIXES):
        keys = []
        for h in (w.hash, *w.prefix):
            f = h >> np.uint64(16)
            at = np.flatnonzero(wanted[(tv.mix(f) >> np.uint64(64 - BITS)).astype(np.int64)] & (h != 0))
            keys.append(((np.searchsorted(w.offs, at, side="right") - 1).astype(np.uint64) << np.uint64(48)) | f[at])
        key = np.unique(np.concatenate(keys))
        yield w, (key >> np.uint64(48)).astype(np.int64), key & np.uint64(0xFFFFFFFFFFFF)


@dataclass
class Voters:
    """A sorted array of feature hashes and, of each, the voters it speaks for, as a bit mask."""

    feature: np.ndarray
    mask: np.ndarray
    names: list[str]

    @classmethod
    def build(cls, mined: list[tuple[int, bool]] = ()) -> "Voters":
        """The fixed lexicons, and words (True) and prefixes (False) mined from labels, dealt to voters by hash, so that no voter depends on one word."""
        by: dict[int, int] = {}
        names = [f"lexicon_{k}" for k in range(len(LEXICONS))]
        for k, lex in enumerate(LEXICONS):
            for h in _hashes(list(lex)):
                by[int(h >> np.uint64(16))] = by.get(int(h >> np.uint64(16)), 0) | 1 << k
        for f, is_word in mined:
            slot = int(tv.mix(np.array([f], dtype=np.uint64))[0] % np.uint64(10))
            by[f] = by.get(f, 0) | 1 << len(LEXICONS) + (slot if is_word else MINED_WORDS + slot)
        names += [f"words_{k}" for k in range(MINED_WORDS)] + [f"prefixes_{k}" for k in range(MINED_PREFIXES)]
        order = sorted(by)
        return cls(np.array(order, dtype=np.uint64), np.array([by[f] for f in order], dtype=np.int64), names)

    def votes(self, texts: pa.Array) -> np.ndarray:
        """A bit mask a text: the voters that call it toxic. A voter without a hit votes that it isn't."""
        out = np.zeros(len(texts), dtype=np.int64)
        wanted = np.zeros(1 << BITS, dtype=bool)
        wanted[(tv.mix(self.feature) >> np.uint64(64 - BITS)).astype(np.int64)] = True
        for w, doc, f in found_features(texts, wanted):
            at = np.minimum(np.searchsorted(self.feature, f), max(0, len(self.feature) - 1))
            hit = np.flatnonzero(self.feature[at] == f) if len(self.feature) else np.zeros(0, dtype=np.int64)
            np.bitwise_or.at(out, w.d0 + doc[hit], self.mask[at[hit]])
        return out


@dataclass
class LabelModel:
    """P(toxic | votes): class-conditional hit rates of groups of voters, and exponents that discount correlated groups."""

    group: np.ndarray  # [m]: the group of each voter; voters that nearly always agree are one group, which hits if any does
    rates: np.ndarray  # [2, groups]: P(hit | clean), P(hit | toxic)
    prior: float
    weight: np.ndarray  # [groups]
    correlation: np.ndarray  # [m, m], within the classes

    @classmethod
    def fit(cls, masks: np.ndarray, counts: np.ndarray, m: int, rounds: int = 3, same: float = 0.8) -> "LabelModel":
        """EM over the table of vote patterns, in rounds, each with the correlations that the one before left.

        Correlations of voters are those of their votes within a class, weighted by the posteriors. Voters correlated
        by ``same`` or more form a group; a group's evidence counts 1 / (1 + its positive correlations with others).
        Each round starts afresh: two hits, discounted, are likely toxic, one is not.
        """
        votes = ((masks[:, None] >> np.arange(m)) & 1).astype(np.float64)
        n = counts.astype(np.float64)
        out = cls(np.arange(m), np.full((2, m), 0.5), 0.0, np.ones(m), np.zeros((m, m)))
        if not n.sum() or not votes.any():
            return cls(out.group, out.rates, 0.0, np.zeros(m), out.correlation)
        for _ in range(rounds):
            p = out._em(votes, n)
            last, corr = out, _correlations(votes, n, p)
            group = _linked(corr >= same)
            g = group.max() + 1
            own = _correlations(last._grouped(votes, group), n, p)
            out = cls(group, np.full((2, g), 0.5), 0.1, 1 / (1 + np.maximum(own, 0).sum(axis=1)), corr)
        out._em(votes, n)
        return out

    @staticmethod
    def _grouped(votes: np.ndarray, group: np.ndarray) -> np.ndarray:
        return np.stack([votes[:, group == k].max(axis=1) for k in range(group.max() + 1)], axis=1)

    def _em(self, votes: np.ndarray, n: np.ndarray, steps: int = 100) -> np.ndarray:
        """Set rates and prior; the posterior of each pattern."""
        v = self._grouped(votes, self.group)
        p = np.where(v.any(axis=1), sigmoid(3 * (v @ self.weight - 1.5)), 0.001)
        for _ in range(steps):
            w1, w0 = n * p, n * (1 - p)
            self.rates = np.stack([(w0 @ v + 0.01) / (w0.sum() + 1), (w1 @ v + 0.5) / (w1.sum() + 1)])
            self.rates[1] = np.maximum(self.rates[1], self.rates[0])  # a hit never speaks for clean
            self.prior = float(np.clip((w1.sum() + 1) / (n.sum() + 2), 1e-4, 0.5))
            q = self._posterior(v)
            done, p = np.abs(q - p).max() < 1e-6, q
            if done:
                break
        return p

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        r0, r1 = np.clip(self.rates, 1e-6, 1 - 1e-6)
        hit, miss = np.log(r1 / r0) * self.weight, np.log((1 - r1) / (1 - r0)) * self.weight
        return sigmoid(np.log(max(self.prior, 1e-9) / (1 - min(self.prior, 1 - 1e-9))) + v @ hit + (1 - v) @ miss)

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        return self._posterior(self._grouped(((masks[:, None] >> np.arange(len(self.group))) & 1).astype(np.float64), self.group))


def _correlations(v: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of the columns of v within the two classes, averaged by the classes' weights."""
    corr = np.zeros((v.shape[1], v.shape[1]))
    for w in (n * p, n * (1 - p)):
        dev = v - (w @ v) / max(w.sum(), 1e-9)
        cov = (dev * w[:, None]).T @ dev / max(w.sum(), 1e-9)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr += cov / np.outer(sd, sd) * (w.sum() / n.sum())
    np.fill_diagonal(corr, 0)
    return corr


def _linked(near: np.ndarray) -> np.ndarray:
    """Numbers of the connected groups of a symmetric relation."""
    group = np.arange(len(near))
    for _ in range(len(near)):
        group = np.minimum(group, np.where(near, group[None, :], len(near)).min(axis=1))
    return np.unique(group, return_inverse=True)[1]


@dataclass
class Classifier:
    """Sparse logistic regression on the presence of hashed words and prefixes."""

    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, texts: list[str], soft: np.ndarray, l1: float = 4e-4, steps: int = 150) -> "Classifier":
        """Proximal gradient (FISTA) with an L1 penalty: the weight of a word that says nothing is zero, so long texts gather no noise."""
        w, b = np.zeros(1 << BITS), 0.0
        if not len(soft):
            return cls(w.astype(np.float32), -10.0)
        docs, feats = [], []
        for d0, _, doc, f in distinct_features(pa.array(texts, pa.string())):
            docs.append(d0 + doc)
            feats.append((tv.mix(f) >> np.uint64(64 - BITS)).astype(np.int64))
        doc, feat = np.concatenate(docs), np.concatenate(feats)
        n = len(soft)
        used, col = np.unique(feat, return_inverse=True)
        often = np.bincount(col)
        use = often[col] >= min(4, n)
        doc, col = doc[use], col[use]
        scale = 1 / np.sqrt(np.maximum(often, 1))
        vals = scale[col] * np.sqrt(n) / 8
        pos = max(float(soft.sum()), 1e-9)
        balance = np.where(soft > 0.5, 0.5 * n / pos, 0.5 * n / max(n - pos, 1e-9)) if 0 < pos < n else np.ones(n)
        x = y = np.zeros(len(used))
        b = yb = float(np.log((pos + 1) / (n - pos + 1)))
        t = 1.0
        lip = 1.0
        u = np.ones(len(used)) / np.sqrt(max(1, len(used)))
        for _ in range(10):
            g = np.bincount(col, weights=vals * (balance * np.bincount(doc, weights=vals * u[col], minlength=n))[doc], minlength=len(used)) / n
            lip = float(np.linalg.norm(g)) or 1.0
            u = g / lip
        rate = 1 / (0.25 * lip + 0.5)
        for _ in range(steps):
            z = np.bincount(doc, weights=vals * y[col], minlength=n) + yb
            r = balance * (sigmoid(z) - soft) / n
            g = np.bincount(col, weights=vals * r[doc], minlength=len(used))
            nx = y - rate * g
            nx = np.sign(nx) * np.maximum(0, np.abs(nx) - rate * l1)
            nb = yb - rate * r.sum()
            nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
            k = (t - 1) / nt
            y, yb, x, b, t = nx + k * (nx - x), nb + k * (nb - b), nx, nb, nt
        w[used] = x * scale * np.sqrt(n) / 8
        return cls(w.astype(np.float32), float(b))

    def predict(self, texts: pa.Array) -> np.ndarray:
        """The probability that each text is toxic; 0 for a text without a word."""
        out = np.full(len(texts), -np.inf)
        for w, doc, f in found_features(texts, self.weights != 0):
            feat = (tv.mix(f) >> np.uint64(64 - BITS)).astype(np.int64)
            score = self.bias + np.bincount(doc, weights=self.weights[feat], minlength=w.d1 - w.d0)
            out[w.d0 : w.d1] = np.where(np.diff(w.offs) > 0, sigmoid(score), 0.0)
        return out


_COUNT = T.StructType([T.StructField("f", T.LongType()), T.StructField("word", T.BooleanType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts each word and prefix is, a batch at a time."""
    for b in batches:
        y = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        data, offs = tv.text_bytes(b.column(0), lower=True)
        found: dict[bool, list[list[np.ndarray]]] = {True: [[], []], False: [[], []]}
        for w in tv.words(data, offs, PREFIXES):
            pairs = _doc_features(w)
            for word, own in ((True, pairs[:1]), (False, pairs[1:])):
                doc = np.concatenate([p[0] for p in own]).astype(np.uint64)
                key = np.unique((doc << np.uint64(48)) | (np.concatenate([p[1] for p in own]) >> np.uint64(16)))
                toxic = y[w.d0 + (key >> np.uint64(48)).astype(np.int64)]
                for side in (0, 1):
                    found[word][side].append((key & np.uint64(0xFFFFFFFFFFFF))[toxic == bool(side)])
        for word, (clean, toxic) in found.items():
            if clean:
                both = [np.unique(np.concatenate(x), return_counts=True) for x in (toxic, clean)]
                f = np.union1d(both[0][0], both[1][0])
                cols = [np.zeros(len(f), dtype=np.int64) for _ in both]
                for col, (own, n) in zip(cols, both):
                    col[np.searchsorted(f, own)] = n
                yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)), pa.array(np.full(len(f), word)), *map(pa.array, cols)], _COUNT.names)


def mine(docs: DataFrame, labels: DataFrame, min_docs: int = 4, min_odds: float = 3.0, max_broadcast: int = 5_000_000) -> list[tuple[int, bool]]:
    """(feature, whether it is a word) that tell toxic documents, from counts over all labelled documents.

    A word or prefix is mined if at least min_docs toxic documents have it, its smoothed odds are min_odds or more, and
    its G statistic beats the chance of the best of as many features as toxic documents have. Labels are broadcast if they
    are at most max_broadcast (counted first), else joined by shuffling.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1)).distinct()
    known = F.broadcast(known) if known.count() <= max_broadcast else known
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).filter(F.col("t").isNotNull()).join(known, "id").select("t", "y")
    n_toxic, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    if n_toxic < min_docs or n_toxic >= n:
        return []
    counts = cut(rows.mapInArrow(_count_batches, _COUNT).groupBy("f", "word").agg(F.sum("toxic").alias("c1"), F.sum("clean").alias("c0")).filter("c1 > 0"))
    looked = counts.count()
    c1, c0, share = F.col("c1"), F.col("c0"), F.lit(n_toxic / n)
    odds = F.log((c1 + 0.1) / (n_toxic + 1)) - F.log((c0 + 0.5) / (n - n_toxic + 1))
    g = c1 * F.log(c1 / ((c1 + c0) * share)) + F.when(c0 > 0, c0 * F.log(c0 / ((c1 + c0) * (F.lit(1.0) - share)))).otherwise(0.0)
    best = counts.filter((c1 >= min_docs) & (odds >= min_odds) & (g >= float(np.log(max(1, looked)) + 1)))
    return sorted((r["f"], r["word"]) for r in best.select("f", "word").collect())


def train(docs: DataFrame, labels: DataFrame, per_posterior: int = 2000) -> tuple[Voters, LabelModel, Classifier]:
    """Voters mined from all labelled documents; the label model from the votes on all documents; the classifier from the
    posteriors of at most per_posterior documents each side of a half, those whose hash is least.

    Of the votes the driver gets the number of documents of each pattern: 16 bytes a pattern that occurs.
    """
    ship(docs.sparkSession)
    voters = Voters.build(mine(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    @F.arrow_udf(T.LongType())
    def vote(t: pa.Array) -> pa.Array:
        return pa.array(shared.value.votes(t), pa.int64())

    table = docs.select(vote(F.col("text")).alias("mask")).groupBy("mask").count().toArrow()
    masks, counts = (table.column(k).to_numpy().astype(np.int64) for k in (0, 1))
    model = LabelModel.fit(masks, counts, len(voters.names))
    toxic = model.posterior(masks) >= 0.5 if len(masks) else np.zeros(0, dtype=bool)
    n_tox, n_all = int(counts[toxic].sum()), int(counts.sum())
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def posterior(mask: pa.Array) -> pa.Array:
        return pa.array(known.value.posterior(mask.to_numpy(zero_copy_only=False).astype(np.int64)))

    share = {1: min(1.0, (2.0 * per_posterior + 50) / max(1, n_tox)), 0: min(1.0, (2.0 * per_posterior + 50) / max(1, n_all - n_tox))}
    order = F.xxhash64("t", F.lit(37))
    least = int(max(share.values()) * 1_000_000)
    near = docs.select(F.col("text").alias("t")).filter(F.col("t").isNotNull()).filter(F.pmod(order, F.lit(1_000_000)) <= least)
    voted = near.withColumn("mask", vote.asNondeterministic()(F.col("t"))).withColumn("p", posterior.asNondeterministic()(F.col("mask")))
    sided = voted.withColumn("side", (F.col("p") >= 0.5).cast("int")).filter(F.pmod(order, F.lit(1_000_000)) <= F.when(F.col("side") == 1, F.lit(share[1] * 1e6)).otherwise(F.lit(share[0] * 1e6)))
    rows = sample_by_class(sided.select("t", "p", "side"), "side", order, per_posterior).collect()
    rows.sort(key=lambda r: r["t"])
    return voters, model, Classifier.fit([r["t"] for r in rows], np.array([r["p"] for r in rows], dtype=np.float64))


def score(docs: DataFrame, classifier: Classifier, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs packed as ``row``, with p_toxic and toxic.

    Whole texts, in Arrow batches; no shuffle. Defined cases: a text that is null or has no word has p_toxic 0 and
    isn't toxic; repeated rows get equal results; extra columns are carried in ``row``; without labelled rows the fixed
    lexicons vote alone; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.predict(texts), pa.float64())

    d = packed(docs, t=F.col(f"`{text_col}`")).select("row", run.asNondeterministic()("t").alias("p_toxic"))
    return d.withColumn("toxic", F.col("p_toxic") >= threshold)


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_toxic, toxic) of every row of documents."""
    return score(docs, train(docs, labels)[2]).select(F.col("row.doc_id").alias("doc_id"), "p_toxic", "toxic")
