"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

A paragraph is a run of lines that are not blank; comment prefixes do not count, so a line of nothing
else is blank.  A template is looked for in all words of a paragraph, so that hard-wrapped notices are
found: ``MIN_COVER`` or more of its words, in order (longest common subsequence), within one window.
Of matches that overlap, the one with the largest cover (of equal ones, with the most words) that the
classifier agrees with stays.  A match is reported with the lines that it lies in.

The classifier's features are the word 1- to 3-grams of the licence templates that the words of the
match, or the lines that it lies in, contain (a sparse 0/1 vector; other words do not dilute it).  A multinomial logistic regression with
an L1 penalty, so that most weights are zero, gives scores of the families and of ``unknown``.  It is
trained on pieces and variants of the templates and, for ``unknown``, on paragraphs of at most
``NEGATIVE_DOCS`` documents and on shuffled template words.  Scores are calibrated by a temperature
fitted on the variants left out of training; a family is predicted if its probability is ``MIN_P``
or more, else ``unknown``.  A paragraph that speaks of a licence (``LIKELY``) but in which no family is
confirmed comes out as ``unknown``, with the probability of that and cover 0; it names no licence and is
not counted in ``n_paragraphs``.

Weights bound the scores from above: a paragraph without any of a few telling words (chosen from the
model so that this holds) cannot reach ``MIN_P``, so its words are not compared.

Defined cases: null and empty texts have no licence.  Rows are scanned one by one, so null, tied or
repeated ``doc_id`` values do not matter.  An empty table gives no rows (the model then trains on
templates alone).  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Training bound: so many documents, of at most so many characters, give negative paragraphs (about
#: twice as many are fetched).
NEGATIVE_DOCS, NEGATIVE_CHARS = 300, 20_000
MIN_P = 0.9
MIN_COVER = 0.8
UNKNOWN = "unknown"

# fixed values: usual notices of well-known licences
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
}

#: Words that say nothing of licences; n-grams of nothing else, or of numbers, are no features.
PLAIN = frozenset("a along also an and any are be by can could either for from general have if in is it later may not of on one only or "
                  "other person should that the this to under use used was with without work you your".split())

#: A paragraph with one of these speaks of a licence.
LIKELY = ("license", "licence", "copyright", "spdx", "public domain", "redistribut", "permission is")

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_PREFIX = re.compile(r"\s*(?:(?://+|/?\*+/?|#+|;+|--+|%+|<!--+|>+|(?:dnl|rem)\b)\s*)*", re.I)
SCHEMA = "doc_id long, licences string, n_paragraphs long, found string"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def paragraphs(text: str) -> Iterator[list[tuple[int, str]]]:
    """Runs of lines that are not blank: (offset, line) of each line, comment prefixes made blank."""
    run, at = [], 0
    for line in text.split("\n"):
        n = _PREFIX.match(line).end()
        if n < len(line):
            run.append((at, " " * n + line[n:]))
        elif run:
            yield run
            run = []
        at += len(line) + 1
    if run:
        yield run


def grams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i:i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}


class Model:
    """Weights, temperature and telling words; small enough to travel with the tasks."""

    def __init__(self, negatives: list[list[str]], seed: int = 7):
        rng = random.Random(seed)
        self.families = [*TEMPLATES, UNKNOWN]
        self.templates = {f: [words(t) for t in ts] for f, ts in TEMPLATES.items()}
        known = set().union(*(grams(t) for ts in self.templates.values() for t in ts))
        vocabulary = sorted(g for g in known if any(w not in PLAIN and not w[0].isdigit() for w in g.split()))
        self.column = {g: i for i, g in enumerate(vocabulary)}
        train, held = self._examples(rng, negatives)
        self._fit(*self._matrix(train), *self._matrix(held))
        self._telling()

    def _examples(self, rng: random.Random, negatives: list[list[str]]) -> tuple[list, list]:
        rows: list[tuple[list[str], int]] = []
        unknown = len(self.families) - 1
        common = [w for ts in self.templates.values() for t in ts for w in t]
        for y, ts in enumerate(self.templates.values()):
            for t in ts:
                rows += [(t, y)] * 4
                for _ in range(16):
                    kept = [w for w in t if rng.random() > 0.08]  # a word lost now and then
                    around = rng.choice(negatives)[:rng.randrange(40)] if negatives else []
                    rows.append((around + kept + around[::-1], y))
        for n in negatives:
            rows.append((n, unknown))
        for _ in range(600):  # words of licences, but no licence
            rows.append((rng.choices(common, k=rng.randrange(1, 25)), unknown))
        for ts in self.templates.values():
            for t in ts:
                for _ in range(5):  # short beginnings that several families share
                    rows.append((t[:rng.randrange(1, 3)], unknown))
        rng.shuffle(rows)
        cut = len(rows) * 4 // 5
        return rows[:cut], rows[cut:]

    def _features(self, tokens: list[str]) -> list[int]:
        return sorted(self.column[g] for g in grams(tokens) if g in self.column)

    def _matrix(self, rows: list) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(self.column) + 1), np.float32)
        x[:, -1] = 1  # bias
        for i, (tokens, _) in enumerate(rows):
            x[i, self._features(tokens)] = 1
        return x, np.array([y for _, y in rows])

    def _fit(self, x, y, x_held, y_held, rounds: int = 250, l1: float = 5e-4) -> None:
        target = np.eye(len(self.families), dtype=np.float32)[y]
        share = target.mean(axis=0)
        weight = (1 / np.maximum(share, 1e-3) / len(self.families))[y][:, None]
        w = np.zeros((x.shape[1], len(self.families)), np.float32)
        z, t = w.copy(), 1.0
        rate = 4 / float((x ** 2).sum(axis=1).mean() * weight.mean() * 2)
        for _ in range(rounds):  # accelerated proximal gradient
            p = _softmax(x @ z)
            nxt = z - rate * (x.T @ ((p - target) * weight)) / len(x)
            shrunk = np.sign(nxt[:-1]) * np.maximum(np.abs(nxt[:-1]) - rate * l1, 0)
            nxt = np.vstack([shrunk, nxt[-1:]])
            t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
            z, w, t = nxt + (t - 1) / t2 * (nxt - w), nxt, t2
        loss = {c: -np.log(_softmax(x_held @ w / c)[np.arange(len(y_held)), y_held] + 1e-12).mean() for c in np.geomspace(0.25, 4, 33)}
        w = w / min(loss, key=loss.get)
        self.accuracy = float(((x_held @ w).argmax(axis=1) == y_held).mean())
        self.bias = w[-1].astype(np.float64)
        self.weights = {i: row.astype(np.float64) for i, row in enumerate(w[:-1]) if row.any()}

    def _telling(self) -> None:
        """Words without any of which no family can reach ``MIN_P`` against ``unknown``."""
        names = list(self.column)
        margin = {names[i]: row[:-1] - row[-1] for i, row in self.weights.items()}
        need = np.log(MIN_P / (1 - MIN_P))
        chosen: set[str] = set()
        while True:
            best, gain = np.array(self.bias[:-1] - self.bias[-1]), defaultdict(float)
            for g, m in margin.items():
                parts = g.split()
                if not chosen.intersection(parts):
                    best += np.maximum(m, 0)
                    for p in set(parts):
                        gain[p] += float(np.maximum(m, 0).max()) / len(parts)
            if (best < need).all() or not gain:
                break
            chosen.add(max(sorted(p for p in gain if p not in PLAIN and not p[0].isdigit()), key=lambda p: gain[p]))
        self.telling = chosen
        self.long = sorted(w for w in chosen if len(w) > 4)
        short = "|".join(sorted(re.escape(w) for w in chosen if len(w) <= 4))
        self.short = re.compile(rf"(?<![a-z0-9])(?:{short})(?![a-z0-9])") if short else re.compile(r"(?!)")

    def _score(self, tokens: list[str]) -> np.ndarray:
        score = self.bias.copy()
        for i in self._features(tokens):
            if i in self.weights:
                score += self.weights[i]
        return score

    def predict(self, tokens: list[str]) -> tuple[str, float]:
        p = _softmax(self._score(tokens)[None])[0]
        k = int(p.argmax())
        return (self.families[k], float(p[k])) if k < len(p) - 1 and p[k] >= MIN_P else (UNKNOWN, float(p[-1]))

    def matches(self, tokens: list[str]) -> list[tuple[float, int, str, int, int, int]]:
        """(cover, words, family, template, first, last token) of windows that hold ``MIN_COVER`` of a template, best first."""
        found, here = [], set(tokens)
        for family, ts in self.templates.items():
            for n, t in enumerate(ts):
                need = MIN_COVER * len(t) - 1e-9
                if sum(w in here for w in t) < need:
                    continue
                present = set(t)
                at = [i for i, w in enumerate(tokens) if w in present]
                size = len(t) + len(t) // 4 + 2
                i = 0
                while i < len(at):
                    j = bisect_left(at, at[i] + size, i)
                    if j - i >= need:
                        window = [tokens[k] for k in at[i:j]]
                        common, last = _common(t, window)
                        if common >= need:
                            _, first = _common(t[::-1], window[last::-1])
                            found.append((common / len(t), common, family, n, at[i + last - first], at[i + last]))
                            if common == len(t):
                                i += last
                    i += 1
        return sorted(set(found), key=lambda f: (-f[0], -f[1], *f[2:]))

    def scan(self, text: str) -> list[tuple[str, int, int, float, int, float]]:
        """(family, start, end, probability, template, cover) of each confirmed notice or unknown paragraph, in code points."""
        low = text.lower()
        if not any(w in low for w in LIKELY) and not any(w in low for w in self.long) and not self.short.search(low):
            return []
        out = []
        for lines in paragraphs(text):
            own = [words(line) for _, line in lines]
            tokens = [w for ws in own for w in ws]
            notices = [] if self.telling.isdisjoint(tokens) else self._notices(lines, own, tokens)
            if not notices and any(w in " ".join(line for _, line in lines).lower() for w in LIKELY):
                notices = [(UNKNOWN, lines[0][0], lines[-1][0] + len(lines[-1][1]), self._unknown(tokens), -1, 0.0)]
            out += notices
        return out

    def _notices(self, lines: list[tuple[int, str]], own: list[list[str]], tokens: list[str]) -> list[tuple[str, int, int, float, int, float]]:
        firsts = [0]
        for ws in own:
            firsts.append(firsts[-1] + len(ws))
        taken: list[tuple[int, int]] = []
        notices = []
        for cover, _, family, template, a, b in self.matches(tokens):
            if any(a <= d and c <= b for c, d in taken):
                continue
            x, y = bisect_right(firsts, a) - 1, bisect_right(firsts, b) - 1
            p = max((q for f, q in (self.predict(tokens[firsts[x]:firsts[y + 1]]), self.predict(tokens[a:b + 1])) if f == family), default=0.0)
            if p:
                taken.append((a, b))
                notices.append([family, x, y, p, template, cover])
        merged: list[list] = []
        for one in sorted(notices, key=lambda f: (f[0], f[1], f[2])):  # notices of a family that share a line are one
            if merged and merged[-1][0] == one[0] and one[1] <= merged[-1][2]:
                best = max(merged[-1], one, key=lambda f: f[5])
                merged[-1] = [one[0], merged[-1][1], max(merged[-1][2], one[2]), max(merged[-1][3], one[3]), *best[4:]]
            else:
                merged.append(one)
        return [(f, lines[x][0], lines[y][0] + len(lines[y][1]), p, t, c) for f, x, y, p, t, c in sorted(merged, key=lambda f: (f[1], f[2], f[0]))]

    def _unknown(self, tokens: list[str]) -> float:
        """Probability of ``unknown``."""
        return float(_softmax(self._score(tokens)[None])[0, -1])


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _common(a: list[str], b: list[str]) -> tuple[int, int]:
    """Length of the longest common subsequence, and where in ``b`` the shortest beginning that has one ends."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            up = row[j + 1]
            row[j + 1] = left + 1 if x == y else max(up, row[j])
            left = up
    return row[-1], row.index(row[-1]) - 1


def _fours(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i:i + 4]) for i in range(len(tokens) - 3)}


def train(docs: DataFrame) -> Model:
    """Fit the classifier; the corpus gives paragraphs of at most ``NEGATIVE_DOCS`` documents."""
    some = docs.where(F.length("text").between(1, NEGATIVE_CHARS)).select("text", F.xxhash64("text").alias("h"))
    # a share by hash instead of a sort, so that what reaches the driver does not grow with the tasks
    share = min(1.0, 2 * NEGATIVE_DOCS / max(1, some.count()))
    taken = some.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < share).dropDuplicates(["h"]).collect()
    texts = [r["text"] for r in sorted(taken, key=lambda r: r["h"])][:NEGATIVE_DOCS]
    lines = sorted({line for t in texts for p in paragraphs(t) for _, line in p}, key=lambda s: hashlib.md5(s.encode()).digest())
    # a line of a wrapped notice need not name a licence, but shares a few words in a row with a template
    part = {g for ts in TEMPLATES.values() for t in ts for g in _fours(words(t))}
    return Model([w for line in lines if not any(x in line.lower() for x in LIKELY) and (w := words(line)) and part.isdisjoint(_fours(w))][:1500])


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: its licence families and the paragraphs that state them."""
    ship(docs.sparkSession)
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                found = model.scan(t or "")
                known = [f for f in found if f[0] != UNKNOWN]
                rows.append((",".join(sorted({f[0] for f in known})), len(known), ",".join(f"{f[0]}:{f[1]}:{f[2]}:{f[3]:.3f}:{f[5]:.3f}" for f in found)))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                                             ["doc_id", "licences", "n_paragraphs", "found"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)
