import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from titleforge.llm import decontam, simhash
from titleforge.llm import textvec as tv

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBç é|!\n0Ω😀", max_size=60)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(4, 40))
def test_words_are_the_pattern(texts, limit):
    data, offs = tv.text_bytes(pa.array(texts, pa.string()))
    one: dict = {}
    for w in tv.words(data, offs, (), limit):
        for d in range(w.d0, w.d1):
            found = re.findall("[a-zA-Z0-9\x80-\U0010ffff]+", texts[d] or "")
            h = w.hash[w.offs[d - w.d0] : w.offs[d - w.d0 + 1]]
            if not any(len(x.encode()) > limit for x in found):
                assert len(h) == len(found)
                for x, y in zip(found, h.tolist()):
                    assert one.setdefault(x, y) == y
    assert len(set(one.values())) == len(one)


def test_gram_sums_in_pieces():
    texts = ["abcabcabc" * 50, "", None, "zé", "a"]
    data, offs = tv.text_bytes(pa.array(texts, pa.string()))
    table = np.random.default_rng(0).normal(size=(2, 1 << 10)).astype(np.float32)
    out = []
    for limit in (16, 64, 1 << 20):
        sums, counts = np.zeros((2, 5)), np.zeros(5, dtype=np.int64)
        for p in tv.gram_features(data, offs, (2, 3), 10, limit):
            tv.add_sums(sums, counts, table, p)
        out.append((sums, counts))
    for s, c in out[1:]:
        assert np.allclose(s, out[0][0]) and (c == out[0][1]).all()
    assert out[0][1].tolist() == [449 + 448, 0, 0, 2 + 1, 0]


def fingerprint(text: str) -> list[int]:
    words = sorted(set(re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())))
    data, offs = tv.text_bytes(pa.array(words, pa.string()))
    h = np.concatenate([w.hash for w in tv.words(data, offs)])
    h = (h >> np.uint64(16)) << np.uint64(16)
    out = []
    for half in range(2):
        x = tv.mix(h + np.uint64(half * 0x632BE59BD9B4E019 + 1))
        out.append(sum(1 << k for k in range(64) if int(((x >> np.uint64(k)) & np.uint64(1)).sum()) * 2 > len(words)))
    return out


def test_fingerprints():
    texts = ["the quick brown fox", "The, quick! brown fox the", "", None, "!!", " ".join(f"w{i}" for i in range(70_000))]
    fp, has = simhash.fingerprints(pa.array(texts, pa.string()))
    assert has.tolist() == [True, True, False, False, False, True] and (fp[0] == fp[1]).all()
    for i in (0, 5):
        assert fp[i].tolist() == fingerprint(texts[i])


@pytest.mark.parametrize("shape", [(6, 3), (3, 4), (2, 2)])
def test_block_edges_join_what_brute_force_joins(shape):
    rng = np.random.default_rng(1)
    own = simhash.Scheme(*shape)
    for small in (4, 256):
        simhash.SMALL, keep = small, simhash.SMALL
        base = rng.integers(0, 1 << 63, size=(6, 2)).astype(np.uint64)
        fp = np.repeat(base, 40, axis=0)
        for r in fp:
            for bit in rng.choice(128, size=rng.integers(0, 12), replace=False):
                r[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        fp = np.unique(fp, axis=0)
        close = {(tuple(x), tuple(y)) for i, x in enumerate(fp) for y in fp[i + 1 :] if sum(int(v).bit_count() for v in x ^ y) <= simhash.MAX_BITS}
        rows = []
        for r in fp:
            x = int(r[0]) | int(r[1]) << 64
            for t, (i, c) in enumerate(own.tables):
                key, at = t << simhash.KEY_BITS, 0
                for k in c:
                    lo, hi = own.pieces[i][k]
                    key |= (x >> lo & ((1 << (hi - lo)) - 1)) << at
                    at += hi - lo
                rows.append((key, int(r[0]), int(r[1])))
        rows.sort()
        e = simhash.block_edges(*(np.array(c, dtype=np.int64 if k == 0 else np.uint64) for k, c in enumerate(zip(*rows))), own)
        simhash.SMALL = keep
        e = np.concatenate(e, axis=1)
        found = {tuple(sorted(((int(a), int(b)), (int(c), int(d))))) for a, b, c, d in e.T}
        want = {tuple(sorted(((int(x[0]), int(x[1])), (int(y[0]), int(y[1]))))) for x, y in close}
        assert found <= want and parts(found) == parts(want)
        if small == 256:
            assert found == want and e.shape[1] == len(want)


def test_schemes_follow_the_number():
    assert [(s.parts, s.equal) for s in map(simhash.Scheme.of, (10, 10**6, 2 * 10**7, 10**8, 10**10))] == [(6, 3), (6, 3), (6, 4), (3, 4), (3, 6)]
    assert all(simhash.Scheme(*c).width <= simhash.KEY_BITS for c in simhash.CHOICES)


def parts(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    out: dict = {}
    for x in list(root):
        out.setdefault(find(x), set()).add(x)
    return {frozenset(v) for v in out.values()}
