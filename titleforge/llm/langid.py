"""Language ID (operator 1): the family first, then one-versus-one linear SVMs among the family's languages."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleforge.llm import textvec as tv
from titleforge.llm.common import packed, sample_by_class, ship, unpacked
from titleforge.llm.linear import fit_svm, gram, scaled

FAMILY = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "af", "lb", "yi"), "germanic"),
    **dict.fromkeys(("fr", "es", "pt", "it", "ro", "ca", "gl", "oc", "la"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("hi", "bn", "ur", "mr", "ne", "fa"), "indo-iranian"),
    **dict.fromkeys(("zh", "yue"), "sinitic"),
}
BITS, SIZES = 13, (2, 3)
UNKNOWN = "und"
_ID = T.StructType([T.StructField("family", T.StringType()), T.StructField("language", T.StringType()), T.StructField("margin", T.DoubleType())])


def family_of(lang: str) -> str:
    """The family of a language code; a language that isn't listed is a family of its own."""
    return FAMILY.get(lang, lang)


def _parts(texts: pa.Array):
    data, offs = tv.text_bytes(texts)
    return tv.gram_features(tv.latin_lower(data), offs, SIZES, BITS), len(offs) - 1, np.diff(offs)


@dataclass
class Model:
    """Linear models over relative frequencies of hashed byte n-grams: one a family (if there are several), one a pair of languages of a family."""

    families: list[str]
    languages: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> "Model":
        parts, n, _ = _parts(pa.array(texts, pa.string()))
        x, y = tv.frequencies(parts, n, BITS), np.array(langs, dtype=object)
        fam = np.array([family_of(v) for v in langs], dtype=object)
        families = sorted(set(fam))
        languages = {f: sorted(set(y[fam == f])) for f in families}
        pairs = [p for f in families for p in combinations(languages[f], 2)]
        z, factor = scaled(x) if n else (x, np.zeros(1 << BITS, dtype=np.float32))
        fits = []
        for positive, own in [(fam == f, np.ones(n, dtype=bool)) for f in families if len(families) > 1] + [(y == a, (y == a) | (y == b)) for a, b in pairs]:
            alpha, bias = fit_svm(gram(z[own]), np.where(positive[own], 1, -1))
            fits.append(((alpha.astype(np.float32) @ z[own]) * factor, bias))
        return cls(families, languages, pairs, np.array([w for w, _ in fits], dtype=np.float32).reshape(len(fits), 1 << BITS), np.array([b for _, b in fits], dtype=np.float64))

    def predict(self, texts: pa.Array) -> tuple[list[str | None], list[str], np.ndarray]:
        """Family, language and margin: the least of the family's lead over the next and the language's over its closest rival.

        A text without letters, or too short for an n-gram, is UNKNOWN; so is every text if nothing was learnt.
        """
        parts, n, _ = _parts(texts)
        sums, counts = np.zeros((len(self.weights), n)), np.zeros(n, dtype=np.int64)
        for p in parts:
            tv.add_sums(sums, counts, self.weights, p)
        score = sums / np.maximum(counts, 1) + self.bias[:, None]
        nf = len(self.families) if len(self.families) > 1 else 0
        letters = _has_letters(texts)
        known = (counts > 0) & letters & (len(self.families) > 0)
        if nf:
            fam = score[:nf].argmax(axis=0)
            top = np.sort(score[:nf], axis=0)
            lead = top[-1] - top[-2]
        else:
            fam, lead = np.zeros(n, dtype=np.int64), np.full(n, 2.0)
        lang = np.empty(n, dtype=object)
        margin = lead.copy()
        for k, f in enumerate(self.families):
            own = np.flatnonzero(fam == k)
            names = self.languages[f]
            votes, least = np.zeros((len(names), len(own))), np.full((len(names), len(own)), np.inf)
            for j, (a, b) in enumerate(self.pairs):
                if a not in names:
                    continue
                s, ia, ib = score[nf + j, own], names.index(a), names.index(b)
                votes[ia] += s > 0
                votes[ib] += s <= 0
                least[ia] = np.minimum(least[ia], s)
                least[ib] = np.minimum(least[ib], -s)
            # Most wins; of equals the one whose narrowest result is best.
            best = (votes + np.where(np.isfinite(least), np.tanh(least) / 4, 0)).argmax(axis=0)
            lang[own] = np.array(names, dtype=object)[best]
            margin[own] = np.minimum(margin[own], 2 * least[best, np.arange(len(own))])
        lang[~known] = UNKNOWN
        return [self.families[k] if ok else None for k, ok in zip(fam, known)], lang.tolist(), np.where(known, margin, np.nan)


def _has_letters(texts: pa.Array) -> np.ndarray:
    data, offs = tv.text_bytes(texts)
    out = np.zeros(len(offs) - 1, dtype=bool)
    for d0, d1 in tv.doc_groups(offs):
        part = data[offs[d0] : offs[d1]]
        at = np.flatnonzero((((part | 0x20) >= 97) & ((part | 0x20) <= 122)) | (part >= 128)) + offs[d0]
        out[np.unique(np.searchsorted(offs, at, side="right") - 1)] = True
    return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 400) -> Model:
    """Fit on at most per_language rows a language, those whose hash of id and text is least; rows without text or language are left out."""
    labelled = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).filter(F.col("lang").isNotNull() & (F.col("text") != ""))
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    # A first cut by hash leaves about twice the rows wanted, so that few texts reach the exact choice.
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, (2.0 * per_language + 50) / n))) for k, n in counts.items()], F.lit(1.0)) if counts else F.lit(1.0)
    order = F.xxhash64("text", F.lit(17))
    near = labelled.filter(F.pmod(order, F.lit(1_000_000)) < share * 1_000_000)
    rows = sample_by_class(near, "lang", order, per_language).collect()
    rows.sort(key=lambda r: (r["lang"], r["text"]))
    return Model.fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model, text_col: str = "text", min_margin: float = 0.1) -> DataFrame:
    """docs packed as ``row``, with family, language, margin and accepted.

    Scores whole texts in Arrow batches; no shuffle. A document is accepted if its language is known and the margin is
    at least min_margin.

    Defined cases: a text that is null, blank or without letters is 'und', with a null family and margin, and not
    accepted; repeated rows get equal results; extra columns are carried in ``row``; with no training row everything
    is 'und'; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_ID)
    def run(texts: pa.Array) -> pa.Array:
        family, language, margin = shared.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(family, pa.string()), pa.array(language, pa.string()), pa.array(margin, pa.float64(), from_pandas=True)], ["family", "language", "margin"])

    d = packed(docs, t=F.col(f"`{text_col}`")).select("row", run.asNondeterministic()("t").alias("p")).select("row", "p.*")
    return d.withColumn("accepted", F.coalesce(F.col("margin") >= min_margin, F.lit(False)))


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, family, language, margin, accepted) of every row of documents; the models are trained on its column lang."""
    d = identify(docs, train(docs))
    return d.select(F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("lang"), "family", "language", "margin", "accepted")


def stage(docs: DataFrame) -> DataFrame:
    """The accepted rows of docs, unchanged."""
    return unpacked(identify(docs, train(docs)).filter("accepted"), docs.columns)
