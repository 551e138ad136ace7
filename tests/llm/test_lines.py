import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from titleforge.llm import lines as ln
from titleforge.llm import textvec as tv

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\r😀", max_size=60)), max_size=8)


@settings(max_examples=120, deadline=None)
@given(TEXTS, st.integers(3, 40))
def test_lines_are_those_of_split(texts, limit):
    data, offs = tv.text_bytes(pa.array(texts, pa.string()))
    got, of = [], {}
    for x in ln.lines(data, offs, limit):
        words = ln.strings(data, x.start, x.end).to_pylist()
        for d, i, w, h in zip(x.doc.tolist(), x.place.tolist(), words, x.hash.tolist()):
            got.append((d, i, w))
            of.setdefault(w, set()).add(h)
    want = [(d, i, line.strip(" \t\r")) for d, t in enumerate(texts) for i, line in enumerate((t or "").split("\n")) if line.strip(" \t\r")]
    assert got == want
    if limit >= 40:  # a line longer than the limit is hashed in another way, which only the limit of production keeps to itself
        assert all(len(h) == 1 for w, h in of.items() if len(w.encode()) < 20)


def test_long_lines_hash_alike():
    long = "x" * (ln.LONG + 5)
    texts = [f"a\n {long}\nb", "pad\n" * 400_000 + f"{long} \nend", long]
    data, offs = tv.text_bytes(pa.array(texts))
    seen = [h for x in ln.lines(data, offs) for h, s, e in zip(x.hash.tolist(), x.start, x.end) if e - s == len(long)]
    assert len(seen) == 3 and len(set(seen)) == 1
    one = "y" * (tv.CHUNK + 10)
    data, offs = tv.text_bytes(pa.array([f" {one}\nz", f"w\n{one}"]))
    seen = [h for x in ln.lines(data, offs) for h, s, e in zip(x.hash.tolist(), x.start, x.end) if e - s == len(one)]
    assert len(seen) == 2 and len(set(seen)) == 1


def test_without():
    import numpy as np

    assert ln.without("a\nb\nc", np.array([1])) == "a\nc" and ln.without(None, np.array([1])) is None and ln.without("a", np.array([], dtype=int)) == "a"
