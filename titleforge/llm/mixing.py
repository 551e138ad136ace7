"""Mixing sources to target weights (operator 3): rake token weights to three marginals, sample by calibrated probabilities."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleforge.llm import textvec as tv
from titleforge.llm.common import count_words, cut, packed, shared_dir, ship

AXES = ("source", "lang", "topic")
NONE = "(none)"
BITS = 12


@dataclass
class Topics:
    """Clusters of texts by vocabulary: spherical k-means over hashed distinct words, weighted by their rarity."""

    rarity: np.ndarray  # [1 << BITS]
    centres: np.ndarray  # [1 << BITS, topics]

    @staticmethod
    def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document, feature) of each document's distinct hashed words, by document."""
        data, offs = tv.text_bytes(texts, lower=True)
        for w in tv.words(data, offs):
            key = np.unique((w.doc.astype(np.int64) << BITS) | (tv.mix(w.hash) >> np.uint64(64 - BITS)).astype(np.int64))
            yield w.d0 + (key >> BITS), key & ((1 << BITS) - 1)

    @classmethod
    def start(cls, rows: list[bytes], seen: np.ndarray, n: int, topics: int) -> "Topics":
        """Centres to start from: texts (their features) far from each other. seen: in how many of all n texts each feature is.

        Words in most texts weigh next to nothing, so what all texts of a language share doesn't make a cluster.
        """
        rarity = (np.log((n + 1) / np.maximum(seen, 1)) ** 2).astype(np.float32)
        x = np.zeros((len(rows), 1 << BITS), dtype=np.float32)
        for k, row in enumerate(rows):
            x[k, np.frombuffer(row, dtype=np.uint16)] = 1
        x = x[x.any(axis=1)] * rarity
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            return cls(rarity, np.zeros((1 << BITS, 0), dtype=np.float32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near, first = x @ x[0], [0]
        while len(first) < min(topics, len(x)) and near.min() < 0.999:  # each start is the text farthest from those before
            first.append(int(near.argmin()))
            near = np.maximum(near, x @ x[first[-1]])
        return cls(rarity, np.ascontiguousarray(x[first].T))

    def nearest(self, doc: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, the nearest topic of each); doc is in order."""
        if not len(doc) or not self.centres.shape[1]:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        return doc[at], np.add.reduceat(self.centres[f] * self.rarity[f, None], at, axis=0).argmax(axis=1)

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of all batches' texts (column features), the sum of the unit vectors of each topic, by topic and feature."""
        total = np.zeros((self.centres.shape[1], 1 << BITS))
        for b in batches:
            for doc, f in _flat(b.column(b.schema.get_field_index("features"))):
                which, topic = self.nearest(doc, f)
                place = np.searchsorted(which, doc)
                norm = np.sqrt(np.bincount(place, weights=self.rarity[f].astype(np.float64) ** 2))
                np.add.at(total, (topic[place], f), self.rarity[f] / np.maximum(norm[place], 1e-9))
        t, f = np.nonzero(total)
        if len(t):
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(total[t, f])], ["topic", "f", "s"])

    def assign(self, texts: pa.Array) -> pa.Array:
        """The name of the nearest topic of each text; null for a text without a word."""
        out = np.full(len(texts), -1)
        for doc, f in self.features(texts):
            which, topic = self.nearest(doc, f)
            out[which] = topic
        return self.named(out)

    def assign_features(self, rows: pa.Array) -> pa.Array:
        """As assign, of texts whose features are known."""
        out = np.full(len(rows), -1)
        for doc, f in _flat(rows):
            which, topic = self.nearest(doc, f)
            out[which] = topic
        return self.named(out)

    @staticmethod
    def named(topic: np.ndarray) -> pa.Array:
        return pa.array([f"t{k:02d}" if k >= 0 else None for k in topic.tolist()], pa.string())


def _flat(rows: pa.Array, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, feature) of an array of binary rows of 16-bit features, about ``most`` features at a time, but whole documents."""
    rows = pc.fill_null(rows.cast(pa.large_binary()), b"")
    _, offsets, data = rows.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[rows.offset : rows.offset + len(rows) + 1] // 2
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        if offs[hi] > offs[lo]:
            f = np.frombuffer(data, dtype=np.uint16)[offs[lo] : offs[hi]]
            yield np.repeat(np.arange(lo, hi), np.diff(offs[lo : hi + 1])), f.astype(np.int64)
        lo = hi


@F.arrow_udf(T.BinaryType())
def _features(texts: pa.Array) -> pa.Array:
    """Each text's distinct hashed words, 2 bytes each, in order."""
    doc, f = [], []
    for d, x in Topics.features(texts):
        doc.append(d)
        f.append(x)
    doc, f = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (doc, f))
    offs = np.searchsorted(doc, np.arange(len(texts) + 1)) * 2
    return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(f.astype(np.uint16).tobytes())]).cast(pa.binary())


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each feature is; at -1 the number of texts."""
    seen, n = np.zeros(1 << BITS, dtype=np.int64), 0
    for b in batches:
        for _, f in _flat(b.column(0)):
            seen += np.bincount(f, minlength=1 << BITS)
        n += b.num_rows
    f = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, f].astype(np.int32)), pa.array(np.r_[n, seen[f]])], ["f", "n"])


def fit_topics(rows: DataFrame, topics: int = 16, sample: int = 2000, rounds: int = 3) -> Topics:
    """Clusters of all rows (column features) by spherical k-means: rarity, and the means of each round, are over all texts.

    Only the texts to start from are of a sample bounded in number, those whose features' hash is least.
    """
    counts = {r[0]: r[1] for r in rows.select("features").mapInArrow(_seen, "f int, n long").groupBy("f").agg(F.sum("n")).collect()}
    n = counts.pop(-1, 0)
    seen = np.zeros(1 << BITS, dtype=np.int64)
    seen[list(counts)] = list(counts.values())
    order = F.pmod(F.xxhash64("features", F.lit(41)), F.lit(1 << 40))
    least = int(min(1.0, (2.0 * sample + 50) / max(1, n)) * (1 << 40))  # else each partition would send its own least
    first = rows.select("features").filter((F.octet_length("features") > 0) & (order <= least)).orderBy(order, "features").limit(sample).collect()
    model = Topics.start([bytes(r[0]) for r in first], seen, n, topics)
    for _ in range(rounds if model.centres.shape[1] else 0):
        shared = rows.sparkSession.sparkContext.broadcast(model)
        sums = rows.select("features").mapInArrow(lambda b, m=shared: m.value.sums(b), "topic int, f int, s double").groupBy("topic", "f").agg(F.sum("s").alias("s")).toArrow()
        c = model.centres.T.astype(np.float64).copy()
        t = sums.column("topic").to_numpy()
        new = np.zeros_like(c)
        new[t, sums.column("f").to_numpy()] = np.round(sums.column("s").to_numpy(), 6)  # sums come in any order
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(norm > 0, new / np.maximum(norm, 1e-9), c)
        model = Topics(model.rarity, np.ascontiguousarray(np.round(c, 6).T.astype(np.float32)))
    return model


def tempered(totals: dict[str, float], power: float) -> dict[str, float]:
    """Shares in proportion to tokens ** power: below 1, large categories shrink and small ones grow."""
    raw = {k: v**power for k, v in totals.items() if v > 0}
    s = sum(raw.values())
    return {k: v / s for k, v in raw.items()} if s else {}


def rake(cells: dict[tuple[str, ...], float], targets: list[dict[str, float]], budget: float, rounds: int = 500, tol: float = 1e-6) -> dict[tuple[str, ...], float]:
    """Tokens to keep of each cell: iterative proportional fitting to the targets' shares of the budget, no cell above what it has.

    Each round scales the cells of a category, axis by axis, to the category's share; a cell that would pass its tokens
    stays at them while the others of its category make up for it. A category without a target keeps its share of
    what the targets leave; targets of absent categories are spread over the present. Where the limits can't be met
    together the last round's weights are used; rounds end where one leaves all weights as it found them.
    """
    keys = sorted(k for k, v in cells.items() if v > 0)
    if not keys:
        return {}
    have = np.array([cells[k] for k in keys], dtype=np.float64)
    budget = min(budget, have.sum())
    axes = []
    for a, target in enumerate(targets):
        names = sorted({k[a] for k in keys})
        at = {n: i for i, n in enumerate(names)}
        idx = np.array([at[k[a]] for k in keys])
        own = np.bincount(idx, weights=have)
        known = np.array([n in target for n in names])
        share = np.array([target.get(n, 0.0) for n in names])
        left = max(0.0, 1 - share.sum())
        if (~known).any():
            share[~known] = left * own[~known] / own[~known].sum() if left > 0 else 0.0
        axes.append((idx, share / share.sum() * budget if share.sum() > 0 else own / own.sum() * budget))
    w = have * (budget / have.sum())
    for _ in range(rounds):
        worst, was = 0.0, w
        for idx, want in axes:
            now = np.bincount(idx, weights=w, minlength=len(want))
            worst = max(worst, float(np.abs(now - want).max()) / budget)
            for _ in range(20):
                full = w >= have * (1 - 1e-12)
                fixed = np.bincount(idx, weights=np.where(full, w, 0), minlength=len(want))
                free = np.bincount(idx, weights=np.where(full, 0, w), minlength=len(want))
                over = fixed + free > want
                factor = np.where(over, want / np.maximum(fixed + free, 1e-9), np.where(free > 0, np.maximum(0, want - fixed) / np.maximum(free, 1e-9), 1))
                before = w
                w = np.minimum(have, np.where(over[idx] | ~full, w * factor[idx], w))
                if np.abs(w - before).max() <= 1e-9 * budget:
                    break
        if worst < tol or np.abs(w - was).max() <= 1e-9 * budget:
            break
    return dict(zip(keys, w.tolist()))


def wanted(cells: DataFrame, axis: str, target: dict[str, float] | None, budget: float, power: float) -> DataFrame:
    """(axis, want): the tokens to keep of each category, as rake() and tempered() have them, without collecting the categories."""
    own = cut(cells.groupBy(axis).agg(F.sum("n").alias("own")))
    if target:
        named = own.sparkSession.createDataFrame([(k, float(v)) for k, v in target.items()], f"{axis} string, share double")
        own = cut(own.join(named, axis, "left"))
        known, rest = own.agg(F.coalesce(F.sum("share"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("share").isNull(), F.col("own"))), F.lit(0.0))).first()
        share = F.coalesce("share", F.lit(max(0.0, 1 - known)) * F.col("own") / F.lit(float(rest or 1)))
    else:
        share = F.pow(F.col("own"), F.lit(power))
    total = own.agg(F.sum(share)).first()[0]
    if not total:
        share, total = F.col("own"), own.agg(F.sum("own")).first()[0]
    return cut(own.select(axis, (share / F.lit(float(total)) * F.lit(budget)).alias("want")))


def rake_table(cells: DataFrame, wants: list[DataFrame], budget: float, rounds: int = 500, tol: float = 1e-6) -> DataFrame:
    """(source, lang, topic, have, w): rake() for cells and categories that the driver needn't hold, by grouped sums and joins.

    Each step is written to the shared folder and read again, and the one before it is deleted.
    """
    spark = cells.sparkSession
    at, last, jvm = f"{shared_dir(spark)}/rake-{uuid.uuid4().hex}", "", spark.sparkContext._jvm
    full = F.col("w") >= F.col("have") * (1 - 1e-12)
    total = cells.agg(F.sum("n")).first()[0]
    state = cells.select(*AXES, F.col("n").cast("double").alias("have"), (F.col("n") * F.lit(budget / total)).alias("w"))
    step = 0
    for _ in range(rounds):
        worst = 0.0
        state = state.withColumn("was", F.col("w"))
        for axis, want in zip(AXES, wants):
            for first in (True, *[False] * 19):
                sums = state.groupBy(axis).agg(F.sum(F.when(full, F.col("w")).otherwise(0.0)).alias("fixed"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("free")).join(want, axis)
                over, now = F.col("fixed") + F.col("free") > F.col("want"), F.col("fixed") + F.col("free")
                factor = F.when(over, F.col("want") / F.greatest(now, F.lit(1e-9))).when(F.col("free") > 0, F.greatest(F.lit(0.0), F.col("want") - F.col("fixed")) / F.greatest("free", F.lit(1e-9))).otherwise(1.0)
                new = F.least("have", F.when(over | ~full, F.col("w") * factor).otherwise(F.col("w")))
                state.join(sums, axis).select(*AXES, "have", "was", new.alias("w"), F.abs(new - F.col("w")).alias("moved"), F.abs(now - F.col("want")).alias("gap")).write.parquet(f"{at}/{step}")
                state = spark.read.parquet(f"{at}/{step}")
                if last:
                    path = jvm.org.apache.hadoop.fs.Path(last)
                    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
                last, step = f"{at}/{step}", step + 1
                moved, gap = state.agg(F.max("moved"), F.max("gap")).first()
                worst = max(worst, gap / budget) if first else worst
                if moved <= 1e-9 * budget:
                    break
        if worst < tol or state.agg(F.max(F.abs(F.col("w") - F.col("was")))).first()[0] <= 1e-9 * budget:
            break
    return state.select(*AXES, "have", "w")


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, power: float = 0.7, keep: float = 0.7, max_categories: int = 1000, seed: int = 11) -> DataFrame:
    """The sampled rows of docs packed as ``row``, with topic, n_tokens and probability.

    The topic is ``topic``, else docs' column of that name, else a cluster of vocabulary, fitted over all documents, that
    every document is assigned to. Tokens (runs of non-blanks) are counted over all documents by cell of source, language and topic. ``targets`` may
    give shares of any axis; an axis without is tempered from its own totals. Cells are raked to the marginals at a
    budget of ``keep`` of all tokens, and a document stays if a uniform hash of seed, doc_id and text is below its
    cell's probability, kept over present tokens: no shuffle but that of the counts, the same sample on every run.
    Every category is raked, however many there are. Up to 1,000 cells for each of max_categories (counted first) are
    raked by the driver and broadcast; more stay a table, raked by the same steps and joined by shuffling.

    Defined cases: null source or language is the category '(none)'; a text without tokens, or null, weighs nothing and
    is left out; rows equal in doc_id and text stay or go together; extra columns are carried in ``row``; an empty
    table gives an empty table; an empty target list is none; of targets that come to more than 1 each counts by its share.
    """
    targets = targets or {}
    ship(docs.sparkSession)
    text = F.col("text")
    if topic is None and "topic" in docs.columns:
        topic = F.col("topic").cast("string")
    axis = {"source": F.coalesce("source", F.lit(NONE)), "lang": F.coalesce("lang", F.lit(NONE)), "topic": F.coalesce("topic", F.lit(NONE))}
    if topic is None:
        # Texts are read once for this: what follows goes over their features, 2 bytes a distinct word, in the shared folder.
        rows = cut(docs.select("source", "lang", count_words(text).alias("n"), _features(text).alias("features")))
        shared = docs.sparkSession.sparkContext.broadcast(fit_topics(rows))

        @F.arrow_udf(T.StringType())
        def of_features(features: pa.Array) -> pa.Array:
            return shared.value.assign_features(features)

        @F.arrow_udf(T.StringType())
        def of_text(texts: pa.Array) -> pa.Array:
            return shared.value.assign(texts)

        topic = of_text.asNondeterministic()(text)  # else filters below it would run it once more
        counted = rows.select("source", "lang", of_features("features").alias("topic"), "n")
    else:
        counted = docs.select("source", "lang", topic.alias("topic"), count_words(text).alias("n"))
    raw = cut(counted.select(*[axis[a].alias(a) for a in AXES], "n").groupBy(*AXES).agg(F.sum("n").alias("n")))
    raw = raw.filter("n > 0")
    n_cells, total = raw.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_cells <= 1000 * max_categories or not n_cells:
        cells = {tuple(r[:3]): float(r[3]) for r in raw.collect()}
        goals = []
        for i, a in enumerate(AXES):
            totals: dict[str, float] = {}
            for k, v in cells.items():
                totals[k[i]] = totals.get(k[i], 0.0) + v
            goals.append(targets.get(a) or tempered(totals, power))
        weights = rake(cells, goals, keep * total)
        table = F.broadcast(docs.sparkSession.createDataFrame([(*k, w / cells[k]) for k, w in weights.items()], "c_source string, c_lang string, c_topic string, probability double"))
    else:
        budget = min(keep, 1.0) * total
        raked = rake_table(raw, [wanted(raw, a, targets.get(a), budget, power) for a in AXES], budget)
        table = raked.select(*[F.col(a).alias(f"c_{a}") for a in AXES], (F.col("w") / F.col("have")).alias("probability"))
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    d = packed(docs, n=count_words(text), u=u, source=F.col("source"), lang=F.col("lang"), topic=topic)
    d = d.select("row", "u", F.col("n").alias("n_tokens"), *[axis[a].alias(f"c_{a}") for a in AXES]).filter("n_tokens > 0")
    return d.join(table, [f"c_{a}" for a in AXES]).filter(F.col("u") < F.col("probability")).select("row", F.col("c_topic").alias("topic"), "n_tokens", "probability")


def sampled(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability) of the sampled rows of documents."""
    return mix(docs).select(*[F.col("row").getField(c).alias(c) for c in ("doc_id", "source", "lang")], "topic", "n_tokens", "probability")


def stage(docs: DataFrame) -> DataFrame:
    """The sampled rows of docs with their columns and topic, n_tokens and probability (a column of docs of such a name gives way)."""
    own = [c for c in docs.columns if c not in ("topic", "n_tokens", "probability")]
    return mix(docs).select(*[F.col("row").getField(c).alias(c) for c in own], "topic", "n_tokens", "probability")
