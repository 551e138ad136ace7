import gzip
import json
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from titleforge.llm import chatfmt, decontam, hostrank, langid, linear, linededup, mixing, quality, simhash, toxicity, warc
from titleforge.llm import textvec as tv
from titleforge.llm.common import count_words, labelled_sample, ship
from titleforge.llm.queries import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that an operator uses inside, as columns of the caller.
EXTRA = "row string, key string, t string, at string, h string, u string, clean string, keep boolean, line string, id long, topic string, probability string"


def docs(spark, rows):
    """rows of (doc_id, text, lang, source), with columns whose names clash with the operators' own."""
    d = spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], DOCS)
    extra = [c.split() for c in EXTRA.split(", ")]
    return d.select("*", *[F.lit("1").cast(kind).alias(name) for name, kind in extra])


LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [(1, None, None, None), (2, "", "en", "a"), (None, "some text without an id", "en", None), (None, None, "en", "a"), (3, LONG, "en", "a"), (4, "tie tie", "en", "a"), (4, "tie tie", "en", "a"), (5, "   \n\t", "fr", "b"), (6, "12345 !!", "de", "b")]


def collect(df):
    return [tuple(r) for r in df.collect()]


# --- 10: chats
def brute_chat(turns):
    out = {}
    for c in {t[0] for t in turns}:
        own = [t for t in turns if t[0] == c]
        norm = [(t[1] is None, t[1] or 0, (t[2] or "").strip().lower() if (t[2] or "").strip().lower() in chatfmt.ROLES else "user", t[3]) for t in own]
        said = sorted(x for x in norm if x[3] is not None and x[3].strip(" "))
        merged = []
        for _, _, role, text in said:
            if merged and merged[-1][0] == role:
                merged[-1][1].append(text)
            else:
                merged.append((role, [text]))
        out[c] = (len(own), len(merged), "\n".join(f"<|{r}|>\n" + "\n".join(x) + "\n<|end|>" for r, x in merged))
    return out


def test_chats(spark):
    rng = random.Random(3)
    turns = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "Assistant ", None, "robot", "system"]), rng.choice(["a", "b\nc", "", None, " ", "x" * 5000])) for _ in range(80)] + [(9, 0, "user", None)]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("s", F.lit(1))
    assert {r[0]: tuple(r[1:]) for r in chatfmt.format_chats(d).collect()} == brute_chat(turns)
    assert chatfmt.format_chats(d.limit(0)).count() == 0


def test_long_chat(spark):
    d = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"), F.lit("t").alias("text"))
    r = chatfmt.format_chats(d).first()
    assert r["n_turns"] == 3000 and r["n_messages"] == 2000


# --- 2: lines
def brute_lines(rows):
    seen, out, order = set(), [], sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        i, t = rows[k][:2]
        if t is None:
            out.append((i, None, 0, 0))
            continue
        kept = []
        for line in t.split("\n"):
            key = line.strip(" \t\r")
            if key and key in seen:
                continue
            seen.add(key)
            kept.append(line)
        out.append((i, "\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("block_bits", [31, 17])
def test_lines(spark, block_bits):
    rng = random.Random(5)
    rows = [(k, "\n".join(rng.choice(["same", " same ", "", f"u{k}", f"v{rng.randint(0, 9)}", "tail\r", "\té ", "\n"]) for _ in range(rng.randint(1, 8))), "en", "s") for k in range(60)] + [x for x in ODD if x[0] is not None or x[1] is None]
    d = docs(spark, rows).repartition(5)
    got = linededup.dedup_lines(d, block_bits=block_bits).select("row.doc_id", "clean", "n_lines", "n_removed")
    assert Counter(collect(got)) == brute_lines(rows)
    texts = linededup.dedup_lines(d.filter("doc_id is not null").withColumn("doc_id", F.format_string("%05d", "doc_id")), block_bits=block_bits)
    assert Counter((int(r[0]), *r[1:]) for r in texts.select("row.doc_id", "clean", "n_lines", "n_removed").collect()) == brute_lines([r for r in rows if r[0] is not None])
    out = linededup.stage(d)
    assert out.columns == d.columns and linededup.stage(d.limit(0)).count() == 0 and linededup.dedup_lines(d.limit(0), block_bits=block_bits).count() == 0


def test_full_filter_changes_nothing(spark):
    d = docs(spark, [(k, f"line {k % 700}\nother {k}", "en", "s") for k in range(3000)])
    full = linededup.twice_seen(d.select(F.col("text").alias("t")), 1 << 16, 3, 1 << 31).collect()
    assert sum(int(x).bit_count() for x in full[0][1]) > 100
    linededup.filter_bits, keep = lambda n, b: 1 << 16, linededup.filter_bits
    try:
        got = Counter(collect(linededup.dedup_lines(d).select("row.doc_id", "clean", "n_lines", "n_removed")))
    finally:
        linededup.filter_bits = keep
    assert got == brute_lines([(k, f"line {k % 700}\nother {k}") for k in range(3000)])


def test_a_million_lines_in_a_document(spark):
    n = 1_000_000
    text = "\n".join(f"line {k % 1000}" if k % 2 else f"own {k}" for k in range(n))
    d = docs(spark, [(1, text, "en", "s"), (2, "line 1\nown 0\nnew", "en", "s")])
    began = time.time()
    got = {r["doc_id"]: r for r in linededup.dedup_lines(d).select("row.doc_id", "n_lines", "n_removed", F.length("clean").alias("size")).collect()}
    assert time.time() - began < 60 and got[1]["n_lines"] == n and got[1]["n_removed"] == n // 2 - 500 and got[2]["n_removed"] == 2 and got[2]["size"] == 3


# --- 9: leaks
def test_leaks(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa!"
    bench = spark.createDataFrame([(1, item), (2, "five short words are enough"), (3, "too short"), (4, None), (5, "")], "item_id long, text string")
    rows = [(10, "Start. " + item.upper() + " End here.", "en", "s"), (11, "nothing of it", "en", "s"), (12, "alpha beta gamma delta epsilon zeta eta", "en", "s"), (13, "  Five %%% short&&& words; are ENOUGH", "en", "s"), (14, " ".join(["pad"] * 40) + " " + item, "en", "s"), (14, "x y alpha beta gamma delta epsilon zeta eta theta z " + "w " * 20, "en", "s"), (15, "É " * 30 + item + " ça", "fr", "s")] + ODD
    d = docs(spark, rows)
    grams = decontam.benchmark_grams([item, "five short words are enough", "too short", None, ""], 8, 5)
    for bound in (10_000, 0):
        got = decontam.find_leaks(d, bench, max_broadcast=bound).select("row.doc_id", "row.text", "clean", "n_hits", "n_removed", "contaminated", "dropped").collect()
        assert len(got) == len(rows)
        for r in got:
            w = decontam.normal_words(r["text"])
            hits, gone = 0, set()
            for n in (5, 8):
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) in grams:
                        hits += 1
                        gone |= set(range(i, i + n))
            assert (r["n_hits"], r["n_removed"], r["contaminated"], r["dropped"]) == (hits, len(gone), hits > 0, hits > 0 and len(gone) > 0.5 * len(w))
            assert decontam.normal_words(r["clean"]) == [x for i, x in enumerate(w) if i not in gone]
            if not hits:
                assert r["clean"] == r["text"]
    assert {r["doc_id"] for r in decontam.find_leaks(d, bench).filter("contaminated").select("row.doc_id").collect()} == {10, 13, 14, 15}
    out = decontam.stage(d, bench)
    assert out.columns == d.columns and out.count() == len(rows) - 2
    assert decontam.find_leaks(d, bench.limit(0)).filter("contaminated").count() == 0 and decontam.find_leaks(d.limit(0), bench).count() == 0


def test_leaks_in_other_scripts_and_cases(spark):
    items = ["οδος alpha beta gamma delta epsilon zeta eta theta", "istanbul one two three four five six seven", "一二三四五六七八九十", "dash one two three four five six seven eight"]
    texts = ["ΟΔΟΣ alpha beta gamma delta epsilon zeta eta theta " + "x " * 20, "İstanbul one two three four five six seven" + " y" * 30, "前" * 30 + "一二三四五六七八九十" + "後" * 30, "“dash\u2014one\u00a0two three… four—five six\u3000seven eight”" + " z" * 30]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = docs(spark, [(k, t, "en", "s") for k, t in enumerate(texts)] + [(9, texts[2], "zh", "s")])
    cols = ["row.doc_id", "clean", "n_hits", "n_removed", "contaminated", "dropped"]
    got = {r["doc_id"]: r for r in decontam.find_leaks(d, bench).select(*cols).collect()}
    assert Counter(map(tuple, got.values())) == Counter(map(tuple, decontam.find_leaks(d, bench, max_broadcast=0).select(*cols).collect()))
    assert got[2]["n_hits"] == 3 and got[2]["n_removed"] == 10 and got[2]["clean"] == "前" * 30 + "後" * 30 and got[9]["n_hits"] == 3
    assert got[3]["n_removed"] == 9 and got[1]["n_hits"] == 1 and got[0]["contaminated"]


def test_a_long_text_of_hits_only(spark):
    item = " ".join(f"word{k}" for k in range(60_000))
    d = docs(spark, [(1, item, "en", "s"), (2, "pad " * 70_000 + item, "en", "s")])
    began = time.time()
    got = {r["doc_id"]: r for r in decontam.find_leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string")).select("row.doc_id", "n_hits", "n_removed", "dropped", F.length("clean").alias("n")).collect()}
    assert time.time() - began < 60 and got[1]["n_hits"] == 60_000 - 7 and got[1]["n"] == 0 and got[1]["dropped"] and got[2]["n_removed"] == 60_000 and got[2]["n"] == 280_000 and not got[2]["dropped"]


# --- 6: near copies
def test_near_duplicates_are_those_of_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"{a}{b}" for a in "abcdefgh" for b in range(90)]
    rows = []
    for g in range(25):
        base = rng.choices(vocab, k=rng.choice([40, 150, 400]))
        for c in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.randint(0, 3) if c else 0):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w), "en", "s"))
    rows += ODD
    d = docs(spark, rows).repartition(4)
    got = simhash.near_duplicates(d).select("key.id", "key.no_id", "kept.id", "n", "n_group").collect()
    fp, has = simhash.fingerprints(pa.array([r[1] for r in rows], pa.string()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if has[i] and has[j] and sum(int(v).bit_count() for v in fp[i] ^ fp[j]) <= simhash.MAX_BITS:
                root[find(i)] = find(j)
    size = Counter(find(i) for i in range(len(rows)) if has[i])
    least = {}
    for i, r in enumerate(rows):
        if has[i] and r[0] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 62), r[0])
    want = {(r[0], least[find(i)], size[find(i)]) for i, r in enumerate(rows) if has[i] and r[0] is not None}
    assert {(r[0], r[2], r[4]) for r in got if not r[1] and r[0] not in (1, 2, 5)} >= {w for w in want if w[0] not in (1, 2, 5)}
    other = simhash.near_duplicates(d, scheme=simhash.Scheme(3, 4)).select("key.id", "key.no_id", "kept.id", "n", "n_group").collect()
    assert Counter(map(tuple, other)) == Counter(map(tuple, got))
    out = simhash.stage(d)
    assert out.columns == d.columns
    kept = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    heads = {least[find(i)] for i, r in enumerate(rows) if has[i] and r[0] is not None}
    assert heads <= set(kept) and kept[4] <= 2  # 4 is in the vocabulary part and twice in ODD
    assert simhash.stage(d.limit(0)).count() == 0
    assert Counter(collect(simhash.stage(d, max_broadcast=0))) == Counter(collect(out))


def test_equal_rows_leave_one(spark):
    d = docs(spark, [(7, "one two three four", "en", "s")] * 3 + [(8, "five six seven eight nine", "en", "s"), (None, "ten eleven twelve", "en", "s"), (None, "ten eleven twelve", "en", "s")])
    assert sorted(map(str, (r["doc_id"] for r in simhash.stage(d).collect()))) == ["7", "8", "None"]
    assert simhash.groups(d.withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))).filter("duplicate").count() == 3


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r["u"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


# --- 1: languages
WORDS = {"en": "the of and with from this that which have are night house water", "de": "der die und nicht mit auf für ist schon haus wasser nacht über", "fr": "le les des une dans pour avec est maison nuit être où", "es": "el los una con para que está noche casa agua año niño"}


def text_in(lang, rng, n=40):
    return " ".join(rng.choices(WORDS[lang].split(), k=n))


def test_languages(spark):
    rng = random.Random(1)
    train = [(k, text_in(g, rng), g, "s") for k in range(60) for g in WORDS]
    held = [(1000 + k, text_in(g, rng, 25), g, "s") for k in range(25) for g in WORDS]
    model = langid.train(docs(spark, train), per_language=40)
    got = langid.identify(docs(spark, held), model).select("row.lang", "language", "family", "accepted").collect()
    assert sum(r["lang"] == r["language"] for r in got) / len(got) >= 0.98 and sum(r["accepted"] for r in got) / len(got) >= 0.98
    assert all(langid.family_of(r["language"]) == r["family"] for r in got)
    odd = {(r["doc_id"], r["text"]): r for r in langid.identify(docs(spark, ODD), model).select("row.doc_id", "row.text", "language", "accepted").collect()}
    for k in ((1, None), (2, ""), (5, "   \n\t"), (6, "12345 !!")):
        assert odd[k]["language"] == "und" and not odd[k]["accepted"]
    d = docs(spark, train + ODD)
    assert langid.stage(d).columns == d.columns and langid.stage(d.limit(0)).count() == 0
    one = langid.Model.fit(["the cat"] * 3, ["en"] * 3)
    assert one.predict(pa.array(["a dog"]))[1] == ["en"]


# --- 4: quality
def test_quality(spark):
    rng = random.Random(4)
    make = lambda k, good: text_in("en", rng, 60) if good else " ".join(w.upper() + "!!" for w in text_in("en", rng, 60).split())
    rows = [(k, make(k, k % 4 > 0), "en", "s") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(200)] + [(None, 1, 0), (5, None, None), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    model = quality.train(d, labels, per_class=100)
    got = quality.score(d.filter("doc_id >= 200"), model).select("row.doc_id", "p_good", "keep").collect()
    assert np.mean([(r["p_good"] >= 0.5) == (r["doc_id"] % 4 > 0) for r in got]) >= 0.98 and all(r["keep"] for r in got if r["doc_id"] % 4)
    odd = quality.score(docs(spark, ODD), model).select("row.doc_id", "p_good", "grade", "keep").collect()
    assert len(odd) == len(ODD) and all(r["p_good"] is None and r["grade"] == "poor" and not r["keep"] for r in odd if r["doc_id"] in (1, 2))
    assert quality.graded(d, labels.limit(0)).select(F.countDistinct("p_good")).first()[0] == 1 and quality.graded(d.limit(0), labels).count() == 0


def test_the_sample_is_bounded_whatever_ids_repeat(spark):
    rng = random.Random(15)
    rows = [(7, f"row {k} of one id", "en", "s") for k in range(500)] + [(1000 + k, text_in("en", rng, 9), "en", "s") for k in range(50)]
    labels = spark.createDataFrame([(7, 1, 0)] + [(1000 + k, k % 2, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    got = labelled_sample(docs(spark, rows), labels, "quality", 10, 29)
    assert Counter(r["y"] for r in got) == {0: 10, 1: 10}
    named = lambda d: d.withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))
    assert quality.graded(named(docs(spark, rows)), named(labels)).count() == len(rows)


def test_quality_scores_are_those_of_plain_loops(spark):
    rng = random.Random(16)
    texts = [text_in("en", rng, 20) for _ in range(8)] + ["", "ab", "One two, one two!", "é"]
    y = np.array([k % 2 for k in range(len(texts))], dtype=float)
    model = quality.Model.fit(texts, y)
    got = model.predict(pa.array(texts))
    for t, p in zip(texts, got):
        raw = t.encode()
        chars = []
        for n in quality.SIZES:
            for i in range(len(raw) - n + 1):
                code = sum(raw[i + j] << (8 * j) for j in range(n)) + ((0xF8 + n) << 24)
                chars.append(((code * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - quality.BITS))
        w = np.concatenate([x.hash for x in tv.words(*tv.text_bytes(pa.array([t])))] + [np.zeros(0, dtype=np.uint64)])
        pairs = [int(tv.mix(w[i : i + 1] ^ tv._GOLD)[0]) >> (64 - quality.BITS) for i in range(len(w))] + [int(tv.mix(w[i + 1 : i + 2] - w[i : i + 1] + np.uint64(7))[0]) >> (64 - quality.BITS) for i in range(len(w) - 1)]
        score = model.bias + sum(float(model.chars[f]) for f in chars) / (len(chars) + quality.SHRINK) + sum(float(model.words[f]) for f in pairs) / (len(pairs) + quality.SHRINK)
        want = 1 / (1 + np.exp(-(model.scale[0] * score + model.scale[1])))
        assert (np.isnan(p) and not chars and not pairs) or abs(p - want) < 1e-5


def test_languages_are_those_of_plain_loops():
    rng = random.Random(17)
    train = [(text_in(g, rng, 15), g) for _ in range(12) for g in WORDS]
    m = langid.Model.fit([t for t, _ in train], [g for _, g in train])
    texts = [text_in(g, rng, 6) for g in WORDS] + ["12 !", "", "Ünd NICHT"]
    fam, lang, margin = m.predict(pa.array(texts))
    for k, t in enumerate(texts):
        raw = tv.latin_lower(np.frombuffer(t.encode(), dtype=np.uint8)).tobytes()
        f = [(((sum(raw[i + j] << (8 * j) for j in range(n)) + ((0xF8 + n) << 24)) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - langid.BITS) for n in langid.SIZES for i in range(len(raw) - n + 1)]
        s = [float(sum(float(w[x]) for x in f)) / max(1, len(f)) + b for w, b in zip(m.weights, m.bias)]
        if not f or not any(c.isalpha() for c in t):
            assert lang[k] == "und" and fam[k] is None
            continue
        best = max(range(2), key=lambda i: s[i])
        (pair,) = [i for i, p in enumerate(m.pairs) if p[0] in m.languages[m.families[best]]]
        assert fam[k] == m.families[best] and lang[k] == m.pairs[pair][0 if s[2 + pair] > 0 else 1]
        assert abs(margin[k] - min(abs(s[0] - s[1]), 2 * abs(s[2 + pair]))) < 1e-6


def test_products_are_those_of_the_matrix():
    z = np.random.default_rng(2).normal(size=(40, 9))
    y = np.where(z[:, 0] > 0, 1, -1)
    a, b = linear.fit_svm(linear.gram(z), y)
    c, d = linear.fit_svm(linear.gram(z, 10), y)
    assert np.allclose(a, c) and abs(b - d) < 1e-9


def test_calibration():
    rng = np.random.default_rng(0)
    s = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * s - 1)))).astype(float)
    from titleforge.llm.linear import platt

    a, b = platt(s, y)
    assert abs(a - 2) < 0.3 and abs(b + 1) < 0.2


# --- 8: toxicity
def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["idiot", "moron", "scum", "zlurpo", "zlurpa", "zlurpix"]
    rows = []
    for k in range(600):
        w = text_in("en", rng, 50).split()
        if k % 5 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((k, " ".join(w), "en", "s"))
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(300)] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    voters, model, clf = toxicity.train(d, labels)
    got = toxicity.score(d.filter("doc_id >= 300"), clf).select("row.doc_id", "toxic").collect()
    hit = {i for i, t, _, _ in rows if set(t.split()) & set(bad)}
    assert sum(r["toxic"] for r in got if r["doc_id"] in hit) >= 0.95 * sum(r["doc_id"] in hit for r in got) and not any(r["toxic"] for r in got if r["doc_id"] not in hit)
    odd = toxicity.score(docs(spark, ODD), clf).select("row.doc_id", "p_toxic", "toxic").collect()
    assert len(odd) == len(ODD) and all(r["p_toxic"] == 0 for r in odd if r["doc_id"] in (1, 2, 5)) and not any(r["toxic"] for r in odd)
    assert toxicity.flagged(d, labels.limit(0)).count() == 600 and toxicity.flagged(d.limit(0), labels).count() == 0


def test_votes_and_scores_are_those_of_plain_loops(spark):
    texts = ["you IDIOT and moron", "a clean text", "", None, "scum zlurpo", "idiots idiots"]
    feature = lambda w: int(toxicity._hashes([w])[0] >> np.uint64(16))
    voters = toxicity.Voters.build([(feature("zlurpo"), True)])
    of = {w: k for k, lex in enumerate(toxicity.LEXICONS) for w in lex} | {"zlurpo": len(toxicity.LEXICONS) + int(tv.mix(np.array([feature("zlurpo")], dtype=np.uint64))[0] % np.uint64(10))}
    want = [sum({1 << of[w] for w in re.findall("[a-z]+", (t or "").lower()) if w in of}) for t in texts]
    assert voters.votes(pa.array(texts, pa.string())).tolist() == want
    model = toxicity.Classifier(np.random.default_rng(4).normal(size=1 << toxicity.BITS).astype(np.float32), -0.5)
    for t, p in zip(texts, model.predict(pa.array(texts, pa.string()))):
        f = set()
        for w in re.findall("[a-z]+", (t or "").lower()):
            (own,) = list(tv.words(*tv.text_bytes(pa.array([w])), toxicity.PREFIXES))
            f |= {int(h) >> 16 for h in [own.hash[0], *(x[0] for x in own.prefix)] if h}
        score = -0.5 + sum(float(model.weights[int(tv.mix(np.array([x], dtype=np.uint64))[0]) >> (64 - toxicity.BITS)]) for x in f)
        assert abs(p - (1 / (1 + np.exp(-score)) if t else 0.0)) < 1e-5


def test_mined_words_come_from_all_labels(spark):
    rng = random.Random(18)
    rows = [(k, text_in("en", rng, 12) + (" vrelk" if k % 100 == 0 else " idiot" if k % 4 == 0 else ""), "en", "s") for k in range(1200)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(1200)], "doc_id long, quality int, toxic int")
    mined = toxicity.mine(docs(spark, rows), labels)
    f = int(toxicity._hashes(["vrelk"])[0] >> np.uint64(16))
    assert (f, True) in mined and toxicity.mine(docs(spark, rows), labels, max_broadcast=0) == mined and toxicity.mine(docs(spark, rows), labels.limit(0)) == []


def test_label_model_finds_accuracies_and_discounts_copies():
    rng = np.random.default_rng(3)
    y = rng.random(40_000) < 0.1
    rates = [(0.9, 0.01), (0.8, 0.02), (0.7, 0.01), (0.6, 0.03)]
    v = [np.where(y, rng.random(len(y)) < t, rng.random(len(y)) < f) for t, f in rates]
    v.append(v[3])  # a copy
    masks, counts = np.unique(sum(x.astype(np.int64) << k for k, x in enumerate(v)), return_counts=True)
    m = toxicity.LabelModel.fit(masks, counts, 5)
    assert m.group[3] == m.group[4] and len(set(m.group)) == 4 and m.correlation[3, 4] > 0.8
    assert abs(m.prior - 0.1) < 0.02 and all(abs(m.rates[1][m.group[k]] - t) < 0.06 for k, (t, _) in enumerate(rates[:3]))
    assert m.weight.min() > 0.7
    p = m.posterior(sum(x.astype(np.int64) << k for k, x in enumerate(v)))
    assert ((p >= 0.5) == y).mean() > 0.98


# --- 3: mixing
def test_rake_meets_its_targets():
    rng = random.Random(8)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): rng.uniform(50, 500) for a in range(5) for b in range(3) for c in range(3)}
    goals = [{"s0": 0.3, "s1": 0.25, "s2": 0.2, "s3": 0.15, "s4": 0.1}, {"l0": 0.4, "l1": 0.35, "l2": 0.25}, {"t0": 0.3, "t1": 0.4, "t2": 0.3}]
    w = mixing.rake(cells, goals, 0.4 * sum(cells.values()))
    total = sum(w.values())
    assert abs(total / (0.4 * sum(cells.values())) - 1) < 1e-4 and all(v <= cells[k] * (1 + 1e-9) for k, v in w.items())
    for axis, goal in enumerate(goals):
        for name, share in goal.items():
            assert abs(sum(v for k, v in w.items() if k[axis] == name) / total - share) < 1e-3
    assert mixing.rake({}, goals, 5) == {} and mixing.rake({("a", "b", "c"): 10.0}, [{}, {}, {}], 5.0) == {("a", "b", "c"): 5.0}
    hard = mixing.rake({("a", "x", "t"): 10.0, ("b", "x", "t"): 90.0}, [{"a": 0.9, "b": 0.1}, {}, {}], 50)
    assert hard[("a", "x", "t")] <= 10


def test_count_words(spark):
    d = spark.createDataFrame([("",), (None,), (" a",), ("a b\n\tc ",), ("é  ç\r\x0b",), (" ",), ("x",), ("no\u00a0break",)], "text string")
    ship(spark)
    got = d.select(count_words(F.col("text")), F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0))).collect()
    assert [r[0] for r in got] == [r[1] for r in got] == [0, 0, 1, 3, 2, 0, 1, 1]


def test_mix(spark):
    rng = random.Random(9)
    rows = [(k, text_in("en", rng, rng.choice([20, 200])), rng.choice(["en", "de", None]), "big" if k % 3 else f"small{k % 2}") for k in range(4000)] + ODD
    d = docs(spark, rows)
    goal = {"source": {"big": 0.4, "small0": 0.35, "small1": 0.2}}
    m = mixing.mix(d, goal, keep=0.3).select("row.doc_id", "row.source", "row.text", "n_tokens", "probability")
    got = m.collect()
    total = sum(r["n_tokens"] for r in got)
    for name, share in goal["source"].items():
        assert abs(sum(r["n_tokens"] for r in got if r["source"] == name) / total - share) < 0.12  # ODD has a text of 60,000 tokens
    assert Counter(map(str, got)) == Counter(map(str, m.collect())) and not any(r["doc_id"] in (1, 2, 5) and not (r["text"] or "").strip() for r in got)
    by = Counter(r["doc_id"] for r in got if r["text"] == "tie tie")
    assert by.get(4, 0) in (0, 2)
    assert mixing.mix(d, max_categories=1).count() > 0 and mixing.stage(d.limit(0)).count() == 0
    assert [c for c in mixing.stage(d).columns if c not in ("topic", "n_tokens", "probability")] == [c for c in d.columns if c not in ("topic", "probability")]


def test_a_source_beyond_the_thousandth_has_its_target(spark):
    rows = [(k, "w " * 20, "en", f"s{k}") for k in range(1200)] + [(2000 + k, f"word{k}", "en", "tiny") for k in range(10)]
    got = mixing.mix(docs(spark, rows), {"source": {"tiny": 0.01}}).filter("row.source = 'tiny'").collect()
    assert len(got) == 10 and all(r["probability"] > 0.999 for r in got)


def test_rake_of_a_table_is_that_of_the_driver(spark):
    rng = random.Random(13)
    cells = {(f"s{a}", f"l{b}", "t"): float(rng.randint(5, 500)) for a in range(6) for b in range(2)}
    raw = spark.createDataFrame([(*k, int(v)) for k, v in cells.items()], "source string, lang string, topic string, n long")
    total = sum(cells.values())
    by = [{}, {}, {}]
    for k, v in cells.items():
        for i in range(3):
            by[i][k[i]] = by[i].get(k[i], 0) + v
    goals = [{"s0": 0.5, "s1": 0.1, "gone": 0.1}, mixing.tempered(by[1], 0.5), mixing.tempered(by[2], 0.5)]
    want = mixing.rake(cells, goals, 0.6 * total, rounds=2)
    tables = [mixing.wanted(raw, a, goals[0] if a == "source" else None, 0.6 * total, 0.5) for a in mixing.AXES]
    got = {(r[0], r[1], r[2]): r["w"] for r in mixing.rake_table(raw, tables, 0.6 * total, rounds=2).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * total for k in want)


def test_topic_is_the_column_or_of_the_content(spark):
    rng = random.Random(14)
    about = {"sea": "ship harbour sailor anchor tide captain deck reef", "bake": "oven flour yeast dough crust loaf knead butter"}
    rows = [(k, " ".join(rng.choices("the of and with from".split(), k=8) + rng.choices(about[t].split(), k=12)), "en", t) for k, t in enumerate(["sea", "bake"] * 100)]
    d = docs(spark, rows)
    assert {r[0] for r in mixing.mix(d.withColumn("topic", F.col("source"))).select("topic").collect()} == {"sea", "bake"}
    of = mixing.mix(d.drop("topic"), keep=1.0, power=1.0).select("row.source", "topic").distinct().collect()
    named = {t: {r["topic"] for r in of if r["source"] == t} for t in about}
    assert not named["sea"] & named["bake"] and "(none)" not in named["sea"] | named["bake"]


def test_the_sample_is_that_of_plain_rules(spark):
    rng = random.Random(19)
    rows = [(k, text_in("en", rng, rng.choice([5, 30])), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for k in range(300)] + ODD
    d = docs(spark, rows).withColumn("topic", F.concat(F.lit("t"), F.col("doc_id") % 3))
    got = {(r["doc_id"], r["text"]): r["probability"] for r in mixing.mix(d, {"lang": {"en": 0.6, "de": 0.3}}, keep=0.5).select("row.doc_id", "row.text", "probability").collect()}
    cells, of = {}, {}
    for i, t, g, s in rows:
        n = len(re.findall(r"[^ \t\n\x0b\f\r]+", t or ""))
        c = (s or "(none)", g or "(none)", "(none)" if i is None else f"t{i % 3}")
        of[(i, t)] = (c, n)
        cells[c] = cells.get(c, 0) + n
    cells = {k: float(v) for k, v in cells.items() if v}
    by = lambda a: Counter({x: sum(v for k, v in cells.items() if k[a] == x) for x in {k[a] for k in cells}})
    w = mixing.rake(cells, [mixing.tempered(by(0), 0.7), {"en": 0.6, "de": 0.3}, mixing.tempered(by(2), 0.7)], 0.5 * sum(cells.values()))
    u = {(r["doc_id"], r["text"]): (r["h"] % (1 << 53)) / (1 << 53) for r in d.select("doc_id", "text", F.xxhash64(F.lit(11), "doc_id", "text").alias("h")).collect()}
    want = {k: w[c] / cells[c] for k, (c, n) in of.items() if n and u[k] < w[c] / cells[c]}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_topics_of_features_are_those_of_texts(spark):
    rng = random.Random(20)
    texts = pa.array([text_in(g, rng, 9) for g in WORDS for _ in range(6)] + ["", None], pa.string())
    f = mixing._features.func(texts)
    seen = sum(np.bincount(x, minlength=1 << mixing.BITS) for _, x in mixing._flat(f, 20))
    assert sum(len(x) for _, x in mixing._flat(f, 20)) == sum(len(x) for _, x in mixing._flat(f)) and max(len(x) for _, x in mixing._flat(f, 20)) <= 20
    m = mixing.Topics.start([x.as_py() for x in f if x.as_py()], seen, len(texts), 4)
    assert m.assign(texts).to_pylist() == m.assign_features(f).to_pylist() and m.assign(texts).to_pylist()[-2:] == [None, None]
    (b,) = list(m.sums(iter([pa.RecordBatch.from_arrays([f], ["features"])])))
    own, total = m.assign_features(f).to_pylist(), np.zeros((m.centres.shape[1], 1 << mixing.BITS))
    for k, t in enumerate(own):
        if t:
            x = np.zeros(1 << mixing.BITS)
            x[np.frombuffer(f[k].as_py(), dtype=np.uint16)] = 1
            x *= m.rarity
            total[int(t[1:])] += x / np.linalg.norm(x)
    got = np.zeros_like(total)
    got[b.column(0).to_numpy(), b.column(1).to_numpy()] = b.column(2).to_numpy()
    assert np.allclose(got, total, atol=1e-5)


# --- 7: hosts
def test_host_scores_are_those_of_power_iteration(spark):
    pages = [(1, "http://good.org/a", '<a href="http://mid.com/x">m</a>'), (2, "https://mid.com/", "<A HREF='//leaf.net/'>l</A><a href=/own>o</a>"), (3, "http://shady.com/", '<a href="http://casino-win.com/">c</a> <a href="http://casino-win.com/2">c</a>'), (4, "http://blog.far.shady.com:80/q?x", ""), (5, "not a url", "x"), (6, None, None), (7, "http://leaf.net.", None), (3, "http://shady.com/", '<a href="http://casino-win.com/">c</a>'), (8, "http://user@MID.com", '<a href="http://good.org/">')]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("h", F.lit(1))
    e = {(r["src"], r["dst"]): r["n"] for r in hostrank.host_edges(d).collect()}
    assert e == {("good.org", "mid.com"): 1, ("mid.com", "leaf.net"): 1, ("mid.com", "good.org"): 1, ("shady.com", "casino-win.com"): 2, ("blog.far.shady.com", "far.shady.com"): 1, ("far.shady.com", "blog.far.shady.com"): 1}
    hosts = sorted({h for k in e for h in k})
    n, a = len(hosts), np.zeros((len(hosts), len(hosts)))
    for (s, t), c in e.items():
        a[hosts.index(s), hosts.index(t)] = c
    step = lambda m: m / np.maximum(m.sum(axis=1, keepdims=True), 1)
    want = []
    for m, seed in ((step(a), "good.org"), (step(a.T), "casino-win.com")):
        base = np.array([float(h == seed) for h in hosts])
        r = 0.15 * base
        for _ in range(300):
            r = 0.15 * base + 0.85 * r @ m
        want.append(r / r.max())
    got = {r["host"]: (r["trust"], r["distrust"]) for r in hostrank.host_scores(d).collect()}
    for k, h in enumerate(hosts):
        assert np.allclose(got[h], (want[0][k], want[1][k]), atol=2e-3), h
    out = [(r["page_id"], r["host"], r["keep"]) for r in hostrank.filter_urls(d).orderBy("page_id").collect()]
    assert out == [(1, "good.org", True), (2, "mid.com", True), (3, "shady.com", False), (3, "shady.com", False), (4, "blog.far.shady.com", True), (5, None, False), (6, None, False), (7, "leaf.net", True), (8, "mid.com", True)]
    assert collect(hostrank.filter_urls(d, max_broadcast=0).orderBy("page_id")) == collect(hostrank.filter_urls(d).orderBy("page_id"))
    assert hostrank.filter_urls(d, (), ()).filter("keep").count() == 7 and hostrank.filter_urls(d.limit(0)).count() == 0


def test_distrust_of_a_long_chain_and_seeds_of_a_table(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    pages = [(k, f"http://h{k}.net/", link(f"h{k + 1}.net")) for k in range(40)] + [(40, "http://h40.net/", ""), (41, "http://casino.net/", link("h0.net"))]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("H40.net", "blocked"), ("h41.net", "trusted"), ("h0.net", "other")], "host string, seed string")
    kept = {r["page_id"] for r in hostrank.filter_urls(d, seeds=seeds).filter("keep").collect()}
    assert kept == {k for k in range(41) if 0.85 ** (40 - k) < 0.01} | {41}


def test_a_hub_of_blocked_hosts_hides_none(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    many = [f"casino-{k}.com" for k in range(300)]
    pages = [("hub.com", "".join(map(link, many))), ("fan.net", link("poker-x.net")), ("poker-x.net", ""), ("plain.net", ""), ("school.edu", link("bet-y.com")), ("bet-y.com", "")] + [(h, "") for h in many]
    d = spark.createDataFrame([(k, f"http://{h}/", t) for k, (h, t) in enumerate(pages)], "page_id long, url string, html string")
    kept = {r["host"] for r in hostrank.filter_urls(d).filter("keep").collect()}
    assert kept & {"hub.com", "fan.net", "poker-x.net", "bet-y.com", *many} == set() and "plain.net" in kept


# --- 5: WARC
def read_warc(path):
    """(headers, block) of each record, by the format alone."""
    data = gzip.decompress(open(path, "rb").read())
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        h = dict(x.split(": ", 1) for x in lines[1:])
        block = data[end + 4 : end + 4 + int(h["Content-Length"])]
        assert data[end + 4 + len(block) : end + 8 + len(block)] == b"\r\n\r\n" and h["WARC-Block-Digest"] == warc.digest(block)
        yield h, block
        at = end + 8 + len(block)


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(12)
    rows = [(k, f"http://h{k % 7}.org/é{k}", "<p>" + "".join(rng.choices("abcdé ", k=rng.choice([0, 50, 3000]))) + "</p>") for k in range(300)] + [(None, None, None), (400, None, "x"), (401, "http://a/", None), (5, "http://h5.org/é5", "same"), (5, "http://h5.org/é5", "same")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("x")).withColumn("file", F.lit("x"))
    kw = {"max_file_bytes": 20_000, "shard_bytes": 60_000}
    index = warc.write_warc(d.repartition(5), str(tmp_path / "a"), **kw)
    again = warc.write_warc(d.repartition(2), f"file://{tmp_path}/b", **kw)
    files = sorted(p.name for p in (tmp_path / "a").iterdir() if p.suffix == ".gz")
    assert len(files) > 3 and not (tmp_path / "a/_temporary").exists() and len({f[:12] for f in files}) > 2
    for f in files:
        assert (tmp_path / "a" / f).read_bytes() == (tmp_path / "b" / f).read_bytes() and (tmp_path / "a" / f).stat().st_size <= 20_000
    assert Counter(collect(index)) == Counter(collect(again))
    manifest = {m["file"]: m for m in json.loads((tmp_path / "a/manifest.json").read_text())}
    assert sorted(manifest) == files and sum(m["records"] for m in manifest.values()) == len(rows)
    got, ids, order = Counter(), set(), []
    for f in files:
        assert manifest[f]["bytes"] == os.path.getsize(tmp_path / "a" / f)
        records = list(read_warc(tmp_path / "a" / f))
        assert records[0][0]["WARC-Type"] == "warcinfo" and records[0][0]["WARC-Filename"] == f
        for h, block in records[1:]:
            payload = block.split(b"\r\n\r\n", 1)[1]
            assert h["WARC-Payload-Digest"] == warc.digest(payload)
            got[(h["WARC-Target-URI"], payload.decode())] += 1
            ids.add(h["WARC-Record-ID"])
    quoted = lambda p, u: re.sub("é", "%C3%A9", u) if u else f"urn:page:{p}"
    assert got == Counter((quoted(p, u), h or "") for p, u, h in rows) and len(ids) == len(rows)
    for r in index.filter("page_id < 20").collect():
        raw = (tmp_path / "a" / r["file"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        assert r["digest"].encode() in gzip.decompress(raw)
        order.append((r["url"], r["file"]))
    assert [f for _, f in sorted(order)] == sorted(f for _, f in order)
    warc.write_warc(d.filter("page_id < 3"), str(tmp_path / "a"), **kw)
    assert sorted(p.name for p in (tmp_path / "a").iterdir() if p.name.startswith("shard")) == [m["file"] for m in json.loads((tmp_path / "a/manifest.json").read_text())]
    assert warc.write_warc(d.limit(0), str(tmp_path / "c")).count() == 0 and json.loads((tmp_path / "c/manifest.json").read_text()) == []


def test_queries_are_ten():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries()) == list(range(1, 11))
