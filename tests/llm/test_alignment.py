"""Cross-tokenizer alignment against the libraries on whole texts, and the laws of its fragments."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyframe.llm import alignment, bytelevel

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tok():
    return alignment.Tokenizers(A, B)


def plain_groups(text):
    """Groups of (A ids, B ids) of a text by its tokens' ends, or None."""
    if not text:
        return None
    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = bytelevel.alphabet()
    a = [(i, bytes(byte[c] for c in a_tok.id_to_token(i))) for i in a_tok.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()) for i in b_tok.encode(text) for p in [b_tok.id_to_piece(i)]]
    raw = (" " + text).encode()
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return None
    out, x, y, at_a, at_b, i, j = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            x.append(a[i][0])
            at_a += len(a[i][1])
            i += 1
        else:
            y.append(b[j][0])
            at_b += len(b[j][1])
            j += 1
        if at_a == at_b:
            out.append((x, y))
            x, y = [], []
    return out


def brute(texts):
    groups = [plain_groups(t) for t in texts]
    links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for g in groups]
    count = Counter(p for c in links for p in c)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for g, c in zip(groups, links, strict=True):
        if g is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                    sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


WORDS = ["the", "Haus", "über", "naïve", "123456", "don't", "日本語", "😀", "(x)", "a_b-c", "", "\n", "\t", "<|endoftext|>", "<s>", "été,", "ﬁ", "é", " ", "Wörterbuch", "xzqj" * 4]


def texts(seed, n):
    rng = random.Random(seed)
    return [None, "", " ", "\n", "  two", "a▁b", "▁", "tail ", "x y z", "\r\nx", "\x00 y", "s" * 300] + [
        rng.choice([" ", " ", " ", "\n"]).join(rng.choices(WORDS, k=rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize(("long", "fan"), [(1 << 16, 16), (40, 2), (7, 3)])
def test_report_against_the_libraries(spark, docs, long, fan):
    rows = texts(long, 60)
    got = alignment.report(docs([(i, t) for i, t in enumerate(rows)]), A, B, long, fan).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], (r, rows[r.doc_id])
    assert sum(w[0] > 0 for w in want) > 50


def test_fragments_compose_in_any_tree(tok):
    rng = random.Random(4)
    for text in texts(8, 30):
        if plain_groups(text) is None or "▁" in text:
            continue
        raw = (" " + text).encode()
        at = sorted({0, len(raw), *[rng.randrange(len(raw) + 1) for _ in range(6)]})
        parts = [alignment.fragment(tok, raw, x, y) for x, y in zip(at, at[1:], strict=False)]
        want = alignment.fragment(tok, raw, 0, len(raw))

        def tree(p):
            if len(p) == 1:
                return p[0]
            k = rng.randrange(1, len(p))
            return tree(p[:k]).then(tree(p[k:]))

        def told(f):
            return (f.ok, f.ended, f.a, f.b, f.a2, f.b2, f.n_a, f.n_b, f.n_groups, f.n_links, ";".join(f.groups), f.pairs)

        for _ in range(4):
            assert told(tree(parts)) == told(want)
        neutral = alignment.Fragment()
        assert told(neutral.then(want)) == told(want) == told(want.then(neutral))
        whole = want.whole()
        assert ";".join(whole.groups) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain_groups(text))


def test_ranges_cut_inside_tokens(tok):
    """Cuts inside a word leave open parts on both sides."""
    raw = " internationalisation".encode()
    f = alignment.fragment(tok, raw, 0, 9)
    g = alignment.fragment(tok, raw, 9, len(raw))
    assert not f.ended or f.a2 or f.b2 or g.a or g.b
    assert f.then(g).whole().n_groups == len(plain_groups(raw[1:].decode()))


def test_odd_rows(spark, docs, odd):
    got = sorted(tuple(r) for r in alignment.report(odd, A, B).fillna(-1).collect())
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = sorted((-1 if d is None else d, *w) for (d, _), w in zip(rows, brute([t for _, t in rows]), strict=True))
    assert got == want
    assert alignment.report(docs([]), A, B).count() == 0
