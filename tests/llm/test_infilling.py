"""Fill-in-middle against a plain version, and the rank index against a scan."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import infilling


@given(st.text(alphabet="ab é€😀\n", max_size=400), st.integers(1, 126), st.sampled_from([1, 3, 50, 1 << 20]))
@settings(max_examples=200, deadline=None)
def test_rank_index(text, error, chunk):
    data = np.frombuffer(text.encode(), np.uint8)
    index = infilling.RankIndex(infilling.boundaries(data, chunk), error)
    offsets = [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert index.offset(np.arange(len(offsets))).tolist() == offsets
    assert np.abs(index.residual.astype(int)).max() <= error


def test_rank_index_needs_several_lines():
    text = "x" * 50_000 + "€" * 50_000 + "é" * 50_000
    index = infilling.RankIndex(infilling.boundaries(np.frombuffer(text.encode(), np.uint8)))
    assert 3 <= len(index.ends) < 40 and index.offset(np.array([75_000])) == [125_000]
    with pytest.raises(ValueError):
        infilling.RankIndex(iter([np.array([0])]), 200)


def plain(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def key(r):
    return tuple((v is None, v) for v in r)


def test_transform_of_odd_texts(spark, docs, odd):
    marked = docs([(i, t) for i, t in enumerate(["<P", "<S>", "a <M> b", "<", "ends <", "😀" * 100, "<P<P", "é<\n>M<", "ab"] * 12)] + [(200, "😀é" * 700_000)])
    for frame in (odd, marked):
        got = sorted((tuple(r) for r in infilling.transform(frame).collect()), key=key)
        want = sorted((plain(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()), key=key)
        assert got == want
        back = infilling.digests(frame).collect()
        sha = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in frame.collect())
        assert sorted(r.restored_sha256 for r in back) == sha
    assert {r.form for r in infilling.transform(marked).collect()} == {"plain", "psm", "spm"}


def test_empty_table(docs):
    assert infilling.digests(docs([])).count() == 0
