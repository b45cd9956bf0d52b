"""Suffix-array dedup against brute force over all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import suffixdedup


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for _ in range(1500):
        text = [rng.randrange(letters) for _ in range(rng.randrange(40))]
        assert suffixdedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    long = [rng.randrange(letters) for _ in range(3000)]
    assert suffixdedup.suffix_array(long) == sorted(range(len(long)), key=lambda i: long[i:])


def test_lyndon_groups_have_common_prefixes():
    rng = random.Random(5)
    for _ in range(300):
        text = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        of, order, before, after = suffixdedup.lyndon_groups(text)
        for i in range(len(text)):
            smaller = [j for j in range(i) if text[j:] < text[i:]]
            assert before[i] == (smaller[-1] if smaller else -1)
            assert after[i] == next((j for j in range(i + 1, len(text)) if text[j:] < text[i:]), len(text))
        words = {}
        for i, g in enumerate(of):
            words.setdefault(g, set()).add(tuple(text[i:after[i]]))
        assert all(len(w) == 1 for w in words.values())
        assert [min(words[g]) for g in order if g in words] == sorted(min(w) for w in words.values())


def brute(texts, length):
    """Byte ranges removed, per text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            at = gone.find(0, a)
            at = len(r) if at < 0 else at
            runs.append((a, at))
        out.append((runs, bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out


def test_windows_have_anchors():
    rng = np.random.default_rng(3)
    for letters in (1, 2, 20):
        data = rng.integers(97, 97 + letters, 3000).astype(np.uint8)
        bounds = np.array([0, 0, 100, 1200, 1279, 1359, 3000])
        first, windows, off = suffixdedup.stretches(data, bounds, 80)
        starts = np.concatenate([np.arange(f, f + w) for f, w in zip(first, windows, strict=True)])
        want = [i for a, b in zip(bounds, bounds[1:], strict=False) for i in range(a, b - 79)]
        assert starts.tolist() == want
        assert ((off >= windows - 1) & (off <= 80 - suffixdedup.GRAM)).all()


def corpus(seed):
    """Texts that share passages, with edits, repeats inside, period texts and many neighbours of one passage."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "été", "naïve", "gamma", "€uro", "x", "delta", "epsilon", "日本"]

    def prose(n):
        return " ".join(rng.choice(words) + str(rng.randrange(300)) for _ in range(n))

    base, passage = prose(60), prose(25)
    texts = [None, "", "a" * 500, "ab" * 300, "ab" * 200 + "c", base, base, base[:len(base) // 2] + "Z" + base[len(base) // 2:], passage * 3]
    for _ in range(40):
        texts.append(prose(rng.randrange(12)) + passage[rng.randrange(40):] + prose(rng.randrange(12)))
    for _ in range(12):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("qwz")
        texts.append("".join(t))
    return texts + [prose(rng.randrange(80)) for _ in range(10)]


@pytest.mark.parametrize("longest", [2, 8, 1000])
def test_removed_against_brute_force(spark, docs, longest):
    texts = corpus(longest)
    got = suffixdedup.removed(docs([(i, t) for i, t in enumerate(texts)]), 100, longest).collect()
    want = brute(texts, 100)
    assert len(got) == len(texts)
    for r in got:
        assert ([(s.lo, s.hi) for s in r.spans], bytes(r.kept)) == want[r.doc_id], r.doc_id
        assert r.n_bytes == len((texts[r.doc_id] or "").encode())
    assert sum(bool(w[0]) for w in want) > 40


def test_production_length_and_very_long_texts(spark, docs):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefgh \n", k=300_000))
    shared = "".join(rng.choices("abcdefgh ", k=400))
    texts = [long + shared, shared[1:], shared, long[1000:1399] + "!" + long[5000:5400], "é" * 399, "é" * 200 + "x", "é" * 200]
    got = {r.doc_id: r for r in suffixdedup.digests(docs([(i, t) for i, t in enumerate(texts)])).collect()}
    for i, (runs, kept) in enumerate(brute(texts, 400)):
        assert (got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest())


def test_text_longer_than_a_piece(spark, docs, monkeypatch):
    monkeypatch.setattr(suffixdedup, "CHUNK", 500)
    rng = random.Random(2)
    text = "".join(rng.choices("ab", k=3000))
    batch = suffixdedup.pa.RecordBatch.from_arrays([suffixdedup.pa.array([7]), suffixdedup.pa.array([text])], ["row", "text"])
    found = [r for b in suffixdedup._places(iter([batch]), 100) for r in b.to_pylist()]
    assert sorted(s for r in found for s in range(r["first"], r["first"] + r["windows"])) == list(range(2901))


def test_odd_rows(spark, docs, odd):
    got = suffixdedup.digests(odd).collect()
    assert len(got) == odd.count() and all(r.n_removed == (r.n_bytes if r.doc_id == 4 else 0) for r in got)  # 4 is periodic
    assert suffixdedup.digests(docs([])).count() == 0
    twins = docs([(1, "w " * 300), (1, "w " * 300), (None, "own text " * 60), (None, "own text " * 60)])
    assert all(r.n_removed == r.n_bytes and r.n_spans == 1 for r in suffixdedup.digests(twins).collect())
