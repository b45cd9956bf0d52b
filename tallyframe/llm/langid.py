"""Language identification by hierarchical discrimination.

First the language family is predicted (multinomial logistic regression), then, within the family,
one-versus-one linear support vector machines part the related languages.  Features are hashed
character 1- to 4-grams of the lower-cased letters, with word ends, as relative frequencies over the
whole text, scaled by the root of their mean frequency.  All models are linear in them, so a text is
scored in one pass over its characters, whatever its length.

The models learn from a bounded sample: about ``PER_LANGUAGE`` distinct labelled texts of each language,
chosen by hash; of a text of more than ``MAX_CHARS`` characters, so many from a place given by the hash.
Nothing but text and language is used.  Margins of
the support vector machines become probabilities by Platt's sigmoid, fitted on a fifth of the
sample that they did not learn from.  The score is P(family) x the mean pairwise P(language).

Defined cases: a text that is null or has no letter is ``und`` with score 0.  Without any labelled
document every text is ``und``; with one language it is that.  Rows are scored one by one, so null,
tied or repeated ``doc_id`` values do not matter.  An empty table gives no rows.  Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Training bounds.
PER_LANGUAGE, MAX_CHARS = 300, 20_000
UNDETERMINED = "und"
DIMENSIONS = 1 << 17
ORDERS = 4
#: Families of languages by their codes; a language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "indo-aryan": "hi ur bn mr ne pa gu",
    "turkic": "tr az kk ky uz",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_PAD = ORDERS
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))
_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0][points]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hashed gram at each place and the place's text (texts side by side)."""
    pad = "\0" * _PAD
    joined = pad + pad.join(t.lower() for t in texts) + pad
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    size = [len(t.lower()) + _PAD for t in texts]
    of = np.repeat(np.arange(len(texts) + 1), [*size, _PAD])  # text of each place; the pad in front counts to it
    letter = _is_letter(points)
    # one mark for each gap between words, and the pads as they are
    gap = ~letter & np.concatenate([[True], ~letter[:-1]]) & (points != 0)
    points, of, letter = points[~gap], of[~gap], letter[~gap]
    code = np.where(letter, points, 0).astype(np.uint64)
    h = np.zeros(len(code), np.uint64)
    start = code.copy()
    for n in range(ORDERS):
        shifted = code[n:]
        h = h[:len(shifted)] * np.uint64(0x100000001B3) + shifted * _MULTIPLIERS[n] + np.uint64(n + 1)
        # a gram starts on a letter or on the mark in front of a word
        use = (start[:len(h)] != 0) if n == 0 else (shifted != 0) | (start[:len(h)] != 0)
        if n:
            use &= (code[1:1 + len(h)] != 0)
        mixed = (h ^ (h >> np.uint64(29))) * _MULTIPLIERS[1]
        yield (mixed[use] >> np.uint64(64 - 17)).astype(np.int64), of[:len(h)][use]


def _sums(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Per text the mean over each order's grams of their weights, summed over the orders."""
    out = np.zeros((len(texts), weights.shape[1]))
    for column, of in grams(texts):
        count = np.bincount(of, minlength=len(texts) + 1)[:len(texts)]
        for k in range(weights.shape[1]):
            total = np.bincount(of, weights=weights[column, k], minlength=len(texts) + 1)[:len(texts)]
            out[:, k] += total / np.maximum(count, 1)
    return out


class _Sparse:
    """Rows of relative gram frequencies."""

    def __init__(self, texts: list[str]):
        rows, cols, vals = [], [], []
        for a in range(0, len(texts), 50):
            part = texts[a:a + 50]
            for column, of in grams(part):
                key, n = np.unique(of * DIMENSIONS + column, return_counts=True)
                r = key // DIMENSIONS
                keep = r < len(part)
                total = np.bincount(r, weights=n, minlength=len(part) + 1)
                rows.append(r[keep] + a)
                cols.append(key[keep] % DIMENSIONS)
                vals.append(n[keep] / total[r[keep]])
        self.n = len(texts)
        self.rows, self.cols, self.vals = (np.concatenate(x) if x else np.empty(0, int) for x in (rows, cols, vals))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=self.vals * w[self.cols], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=self.vals * g[self.rows], minlength=DIMENSIONS)

    def only(self, keep: np.ndarray) -> _Sparse:
        out = object.__new__(_Sparse)
        at = np.cumsum(keep) - 1
        use = keep[self.rows]
        out.n, out.rows, out.cols, out.vals = int(keep.sum()), at[self.rows[use]], self.cols[use], self.vals[use]
        return out


def _minimise(gradient, size: int, rate: float, rounds: int) -> np.ndarray:
    """Accelerated gradient descent from zero."""
    w = z = np.zeros(size)
    t = 1.0
    for _ in range(rounds):
        nxt = z - rate * gradient(z)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = nxt + (t - 1) / t2 * (nxt - w), nxt, t2
    return w


def _svm(x: _Sparse, y: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Linear support vector machine with squared hinge loss; the last weight is the bias."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    top = 2 * max(1e-9, float(np.bincount(x.rows, weights=x.vals ** 2, minlength=x.n).max()) + 1)

    def gradient(w: np.ndarray) -> np.ndarray:
        slack = np.maximum(0, 1 - y * (x.times(w[:-1]) + w[-1]))
        g = -2 * weight * y * slack
        return np.append(x.back(g) + 2 * l2 * w[:-1], g.sum())

    return _minimise(gradient, DIMENSIONS + 1, 1 / (top + 2 * l2), rounds)


def _logistic(x: _Sparse, y: np.ndarray, l2: float = 1e-4, rounds: int = 80) -> np.ndarray:
    """One family against the rest; scores of all families go through one softmax."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    top = 0.25 * (float(np.bincount(x.rows, weights=x.vals ** 2, minlength=x.n).max()) + 1) + 2 * l2

    def gradient(w: np.ndarray) -> np.ndarray:
        g = -weight * y / (1 + np.exp(np.clip(y * (x.times(w[:-1]) + w[-1]), -50, 50)))
        return np.append(x.back(g) + 2 * l2 * w[:-1], g.sum())

    return _minimise(gradient, DIMENSIONS + 1, 1 / top, rounds)


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | margin), by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * w)
    return max(float(w[0]), 1e-3), float(w[1])


class Model:
    """Weights of all classifiers side by side: families first, then pairs of languages."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        family = {c: FAMILY_OF.get(c, c) for c in self.langs}
        self.families = sorted(set(family.values()))
        self.members = [[i for i, c in enumerate(self.langs) if family[c] == f] for f in self.families]
        self.pairs = [p for m in self.members for p in combinations(m, 2)]
        if not texts:
            return
        x = _Sparse(texts)
        mean = np.bincount(x.cols, weights=x.vals, minlength=DIMENSIONS) / max(1, x.n)
        scale = np.where(mean > 0, 1 / np.sqrt(mean + 1e-5), 0)
        x.vals = x.vals * scale[x.cols]
        lang = np.array([self.langs.index(c) for c in langs])
        fam = np.array([self.families.index(family[c]) for c in langs])
        held = np.arange(len(texts)) % 5 == 4
        columns, self.bias, self.sigmoid = [], [], []
        for f in range(len(self.families) if len(self.families) > 1 else 0):
            w = _logistic(x, np.where(fam == f, 1.0, -1.0))
            columns.append(w[:-1] * scale)
            self.bias.append(w[-1])
        for a, b in self.pairs:
            own = (lang == a) | (lang == b)
            y = np.where(lang == a, 1.0, -1.0)
            w = _svm(x.only(own & ~held), y[own & ~held])
            check = own & held if (own & held).any() else own
            self.sigmoid.append(_platt(x.only(check).times(w[:-1]) + w[-1], y[check]))
            columns.append(w[:-1] * scale)
            self.bias.append(w[-1])
        self.weights = np.stack(columns, axis=1) if columns else np.zeros((DIMENSIONS, 0))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text; letters are looked for first."""
        some = [i for i, t in enumerate(texts) if self.langs and any(map(str.isalpha, t))]
        out = [(UNDETERMINED, 0.0)] * len(texts)
        if not some:
            return out
        scores = _sums([texts[i] for i in some], self.weights) + np.array(self.bias)
        n = len(self.families) if len(self.families) > 1 else 0
        e = np.exp(scores[:, :n] - scores[:, :n].max(axis=1, keepdims=True)) if n else np.ones((len(some), 1))
        family = e / e.sum(axis=1, keepdims=True)
        for i, s, p in zip(some, scores[:, n:], family, strict=True):
            f = int(p.argmax())
            members = self.members[f]
            votes = dict.fromkeys(members, 0.0)
            for (a, b), margin, (slope, offset) in zip(self.pairs, s, self.sigmoid, strict=True):
                if a in votes:
                    q = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
                    votes[a] += q
                    votes[b] += 1 - q
            best = max(members, key=lambda m: (votes[m], -m))
            share = votes[best] / (len(members) - 1) if len(members) > 1 else 1.0
            out[i] = (self.langs[best], float(min(1.0, max(0.0, p[f] * share))))
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, may_learn: Column | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """Fit the models on labelled rows that satisfy ``may_learn``."""
    rows = docs if may_learn is None else docs.where(may_learn)
    rows = rows.where("lang is not null").where(F.length("text") > 0).select("text", F.col("lang").cast("string").alias("lang"))
    h = F.xxhash64("text", "lang")
    rows = rows.select("text", "lang", h.alias("h"))
    # distinct texts, so that copies do not lessen the share; one row a language
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return Model([], [])
    # twice what is needed on the average, so that the sample rarely falls short of its size
    limit = F.create_map(*[F.lit(v) for c, n in counts.items() for v in (c, min(1.0, 2 * per_language / max(1, n)))])
    over = F.length("text") - MAX_CHARS
    part = F.when(over > 0, F.col("text").substr((F.pmod("h", over + 1) + 1).cast("int"), F.lit(MAX_CHARS))).otherwise(F.col("text"))
    some = rows.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < limit[F.col("lang")]).select(part.alias("text"), "lang", "h")
    got = sorted(some.dropDuplicates(["h"]).collect(), key=lambda r: r["h"] ^ 0x5DEECE66D)
    taken: dict[str, list] = {}
    for r in got:
        if len(own := taken.setdefault(r["lang"], [])) < per_language:
            own.append(r["text"])
    texts, langs = [t for c in sorted(taken) for t in taken[c]], [c for c in sorted(taken) for _ in taken[c]]
    return Model(texts, langs)


def predict(docs: DataFrame, model: Model, chars: int = 1_000_000) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text."""
    from .wordcache import blocks

    ship(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = [p for a, b in blocks(texts, chars) for p in spread.value.predict(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in out], pa.string()), pa.array([p[1] for p in out], pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
