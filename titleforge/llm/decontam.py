"""Benchmark decontamination (operator 9): a broadcast set of the benchmark's normalised n-grams, scanned for in token windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleforge.llm import textvec as tv
from titleforge.llm.common import packed, ship, unpacked

#: Beyond ASCII: spaces, controls and punctuation of Latin-1, general and CJK punctuation, full-width forms of ASCII's; and scripts without spaces.
_GAP = "\x80-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7\u1680\u2000-\u206f\u2e00-\u2e7f\u3000-\u3004\u3008-\u3020\u3030\ufe30-\ufe6f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\ufeff"
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u302f\u3031-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(f"[{_ALONE}]|(?:[a-zA-Z0-9]|[^\x00-\x7f{_GAP}{_ALONE}])+")
_FOUND = T.StructType([T.StructField("n_hits", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("clean", T.StringType())])
_FOUND_ARROW = pa.struct([pa.field("n_hits", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("n_words", pa.int64()), pa.field("clean", pa.string())])


def normal_words(text: str | None) -> list[str]:
    """The words of a text, lower-cased character by character, so that places in both are the same."""
    return WORD.findall(pc.utf8_lower(pa.scalar(text or "")).as_py())


@F.arrow_udf(T.LongType())
def _n_words(texts: pa.Array) -> pa.Array:
    return pa.array([len(WORD.findall(t or "")) for t in texts.to_pylist()], pa.int64())


def plain(texts: pa.Array) -> pa.Array:
    """Texts whose words are runs of ASCII letters and digits and of other bytes: gaps beyond ASCII are spaces, and characters that are words have spaces around them."""
    odd = pc.fill_null(pc.match_substring_regex(texts, f"[{_re2(_GAP + _ALONE)}]"), False)
    if not pc.any(odd).as_py():
        return texts
    some = pc.replace_substring_regex(texts.filter(odd), f"[{_re2(_GAP)}]", " ")
    return pc.replace_with_mask(texts, odd, pc.replace_substring_regex(some, f"([{_re2(_ALONE)}])", r" \1 "))


def _re2(chars: str) -> str:
    return "".join(c if c == "-" else f"\\x{{{ord(c):X}}}" for c in chars)


def benchmark_grams(texts: list[str | None], n: int, least: int) -> set[tuple[str, ...]]:
    """All windows of n words; an item of fewer words, but at least ``least``, is one window as a whole."""
    out: set[tuple[str, ...]] = set()
    for t in texts:
        w = normal_words(t)
        out.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        if least <= len(w) < n:
            out.add(tuple(w))
    return out


class Scanner:
    """Finds the grams in a batch of texts: hashes of all word windows against a bitmap, then a sorted array, then word for word."""

    def __init__(self, grams: set[tuple[str, ...]]):
        self.grams = grams
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(g) for g in grams}):
            own = sorted(g for g in grams if len(g) == size)
            data, offs = tv.text_bytes(pa.array([" ".join(g) for g in own]))
            hashes = [self._windows(w, size)[w.offs[:-1]] for w in tv.words(data, offs)]
            h = np.unique(np.concatenate(hashes))
            bitmap = np.zeros(1 << 22, dtype=bool)
            bitmap[(h >> np.uint64(42)).astype(np.int64)] = True
            self.by_size[size] = bitmap, h

    @staticmethod
    def _windows(w: tv.Words, size: int) -> np.ndarray:
        m = len(w.hash) - size + 1
        if m <= 0:
            return np.zeros(0, dtype=np.uint64)
        x = w.hash[:m].copy()
        for j in range(1, size):
            x = x * np.uint64(0x9E3779B97F4A7C15) + w.hash[j : j + m]
        return tv.mix(x)

    def candidates(self, texts: pa.Array) -> np.ndarray:
        """Indexes of the texts in which some window has the hash of a gram."""
        data, offs = tv.text_bytes(plain(texts), lower=True)
        found = []
        for w in tv.words(data, offs):
            for size, (bitmap, h) in self.by_size.items():
                x = self._windows(w, size)
                at = np.flatnonzero(bitmap[(x >> np.uint64(42)).astype(np.int64)])
                at = at[np.isin(x[at], h)]
                if len(at):
                    d = np.searchsorted(w.offs, at, side="right") - 1
                    found.append(w.d0 + d[at + size <= w.offs[d + 1]])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)

    def hits(self, text: str) -> tuple[int, np.ndarray]:
        """(windows hit, places of the words in them)."""
        w = normal_words(text)
        at = [(i, size) for size in self.by_size for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in self.grams]
        return len(at), _covered(at)


def _scan_udf(spark, grams: set[tuple[str, ...]]):
    shared = spark.sparkContext.broadcast(grams)
    kept: list[Scanner] = []

    @F.arrow_udf(_FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Scanner(shared.value))
        found: list[dict | None] = [None] * len(texts)
        for i in kept[0].candidates(texts):
            text = texts[int(i)].as_py()
            n, gone = kept[0].hits(text)
            if n:
                found[int(i)] = _found(text, n, gone)
        return pa.array(found, _FOUND_ARROW)

    return scan.asNondeterministic()


_WINDOW = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("k", T.IntegerType()), T.StructField("gram", T.StringType()), T.StructField("i", T.IntegerType())])


def _windows_of(batches: Iterator[pa.RecordBatch], sizes: range) -> Iterator[pa.RecordBatch]:
    """All word windows of each text, of all sizes, a bounded number of rows at a time."""
    for b in batches:
        for key, text in zip(b.column(0), b.column(1).to_pylist()):
            w = normal_words(text)
            for k in sizes:
                for lo in range(0, len(w) - k + 1, 50_000):
                    own = range(lo, min(lo + 50_000, len(w) - k + 1))
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(own), pa.binary()), pa.array([k] * len(own), pa.int32()), pa.array([" ".join(w[i : i + k]) for i in own], pa.string()), pa.array(own, pa.int32())], _WINDOW.names)


def _by_join(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, bench_text: str, n: int, least: int) -> DataFrame:
    """The same hits by a shuffled join of windows, for a benchmark too large to broadcast: words are cut and lower-cased by the same code."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def grams(texts: pa.Array) -> pa.Array:
        return pa.array([[" ".join(g) for g in benchmark_grams([t], n, least)] for t in texts.to_pylist()], pa.list_(pa.string()))

    items = benchmark.select(F.explode(grams(F.col(bench_text))).alias("gram")).distinct()
    key = F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))  # equal texts have equal hits
    texts = docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("t")).filter(F.col("t").isNotNull()).dropDuplicates(["key"])
    windows = texts.mapInArrow(lambda batches: _windows_of(batches, range(least, n + 1)), _WINDOW)
    hit = windows.join(items, "gram", "left_semi")
    by_text = hit.groupBy("key").agg(F.count(F.lit(1)).alias("n_hits"), F.collect_set(F.struct("i", "k")).alias("at"))
    rows = packed(docs, key=key, t=F.col(f"`{text_col}`"))
    return rows.join(by_text.withColumnRenamed("key", "hit_key"), F.col("key") == F.col("hit_key"), "left").withColumn("f", _cleaned(F.col("t"), F.col("n_hits"), F.col("at")))


def _found(text: str, n_hits: int, gone: np.ndarray) -> dict:
    """A text without the words ``gone`` (places in order) and what follows each up to the next word. Linear in the text."""
    spans = [m.span() for m in WORD.finditer(text)]
    keep = np.ones(len(spans), dtype=bool)
    keep[gone] = False
    ends = [s for s, _ in spans[1:]] + [len(text)]
    lead = text[: spans[0][0]] if spans else text
    return {"n_hits": n_hits, "n_removed": len(gone), "n_words": len(spans), "clean": lead + "".join(text[s:e] for (s, _), e, k in zip(spans, ends, keep) if k)}


@F.arrow_udf(_FOUND)
def _cleaned(texts: pa.Array, n_hits: pa.Array, at: pa.Array) -> pa.Array:
    out: list[dict | None] = []
    for t, n, spans in zip(texts.to_pylist(), n_hits.to_pylist(), at.to_pylist()):
        out.append(None if n is None else _found(t, n, _covered([(x["i"], x["k"]) for x in spans])))
    return pa.array(out, _FOUND_ARROW)


def _covered(windows: list[tuple[int, int]]) -> np.ndarray:
    """The places of the words in any of the windows (first word, size), in order."""
    if not windows:
        return np.zeros(0, dtype=np.int64)
    last = max(i + k for i, k in windows)
    steps = np.zeros(last + 1, dtype=np.int64)
    for i, k in windows:
        steps[i] += 1
        steps[i + k] -= 1
    return np.flatnonzero(np.cumsum(steps) > 0)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", bench_text: str = "text", n: int = 8, least: int = 5, max_share: float = 0.5, max_broadcast: int = 10_000_000) -> DataFrame:
    """docs packed as ``row``, with clean, n_hits, n_removed, contaminated and dropped.

    n_hits counts the word windows that equal a window of n normalised words of a benchmark item; n_removed the words
    in such windows; clean is the text without them and without what follows each up to the next word. A document of
    whose words more than max_share are in hits is ``dropped`` (its clean text is still given). The set of windows is
    broadcast if the benchmark has at most max_broadcast words, which is counted first; then no document is shuffled.
    A larger benchmark is joined by shuffling windows; words are cut, lower-cased and removed by the same code, so the
    result is the same. Hash hits are verified word for word. All steps are linear in a text's words.

    Words are runs of ASCII letters and digits and of other characters that aren't spaces or punctuation; of scripts
    written without spaces (Han, kana, Thai and its neighbours) each character is a word.

    Defined cases: a null text gives null and no hits; benchmark items of fewer than n words count as one window if
    they have at least ``least``, shorter or null ones are skipped; repeated rows are treated alike, whatever their ids;
    extra columns are carried in ``row``; an empty benchmark leaves every text as it is; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    total = benchmark.select(_n_words(F.col(bench_text)).alias("n")).agg(F.sum("n")).first()[0] or 0
    if total <= max_broadcast:
        grams = benchmark_grams([r[0] for r in benchmark.select(bench_text).distinct().collect()], n, least)
        marked = packed(docs, t=F.col(f"`{text_col}`")).withColumn("f", _scan_udf(spark, grams)("t"))
    else:
        marked = _by_join(docs, benchmark, id_col, text_col, bench_text, n, least)
    hit = F.col("f").isNotNull()
    clean = F.when(hit, F.col("f.clean")).otherwise(F.col("t"))
    dropped = F.coalesce(F.col("f.n_removed") > F.lit(max_share) * F.col("f.n_words"), F.lit(False))
    return marked.select("row", clean.alias("clean"), F.coalesce("f.n_hits", F.lit(0)).cast("long").alias("n_hits"), F.coalesce("f.n_removed", F.lit(0)).cast("long").alias("n_removed"), hit.alias("contaminated"), dropped.alias("dropped"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text, n_hits, n_removed, contaminated) of every row of documents; the text of a dropped document is null."""
    d = find_leaks(docs, benchmark)
    return d.select(F.col("row.doc_id").alias("doc_id"), F.when(~F.col("dropped"), F.col("clean")).alias("text"), "n_hits", "n_removed", "contaminated")


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of docs without the dropped documents, the hit passages gone from text, n_chars set anew where they are."""
    d = find_leaks(docs, benchmark).filter(~F.col("dropped"))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("contaminated"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return unpacked(d, docs.columns, **changed)


_W = f"(?:[{_re2(_ALONE)}]|(?:[a-zA-Z0-9]|[^\\x{{0}}-\\x{{7F}}{_re2(_GAP + _ALONE)}])+)"
_NW = f"[\\x{{0}}-\\x{{2F}}:-@\\x{{5B}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}{_re2(_GAP)}]*"
ORACLE_SQL = f"""
WITH b AS (SELECT DISTINCT regexp_extract_all(lower(text), '{_W}') AS w FROM benchmark),
g AS (
  SELECT DISTINCT unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) ELSE [array_to_string(w, ' ')] END) AS gram,
         least(len(w), 8) AS k
  FROM b WHERE len(w) >= 5),
d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{_W}') AS w FROM documents),
ks AS (SELECT DISTINCT k FROM g),
x AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, ks WHERE len(w) >= k),
h AS (SELECT x.doc_id, x.k, x.i FROM x JOIN g ON g.k = x.k AND g.gram = array_to_string(x.w[x.i:x.i + x.k - 1], ' ')),
a AS (SELECT doc_id, count(*) AS n_hits, list_distinct(flatten(list(range(i, i + k)))) AS gone FROM h GROUP BY doc_id),
p AS (SELECT d.doc_id, d.text, a.n_hits, a.gone, CASE WHEN a.gone IS NOT NULL THEN regexp_extract_all(d.text, '{_W}{_NW}') END AS pieces FROM d LEFT JOIN a USING (doc_id))
SELECT doc_id,
       CASE WHEN gone IS NULL THEN text
            WHEN len(gone) > 0.5 * len(pieces) THEN NULL
            ELSE regexp_extract(text, '^{_NW}') || array_to_string(list_transform(list_filter(range(1, len(pieces) + 1), lambda i: NOT list_contains(gone, i)), lambda i: pieces[i]), '') END AS text,
       coalesce(n_hits, 0) AS n_hits, coalesce(len(gone), 0) AS n_removed, gone IS NOT NULL AS contaminated
FROM p
"""
