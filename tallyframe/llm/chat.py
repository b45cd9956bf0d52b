"""Transcript parsing: roles by a hidden Markov model, then canonical turns.

A conversation is the sequence of the lines of its rows, in the order of turn.  The hidden state of a
line is the role that speaks.  Observed are

* the speaker marker: the row's declared role on its first line, or a marker that starts a line
  ("User:", "### Assistant", "<|system|>" ...), both mapped to roles by a table of usual names.
  Names that are also usual in prose ("Context:", "Answer:") are text where the row declares its role;
  elsewhere they are trusted as far as they agree with the declared rows trained on;
* line features, of lines that open a row or have a marker: how many lines the row has, the length
  class of the line, and how it ends.  Other lines go on with their speaker, whatever they look like.

Start, transition and emission probabilities are counted over the first rows of a bounded sample of
conversations, where the declared role is a known name, with add-one smoothing.  Features of a role with
few rows are drawn to the geometric mean of the trained roles, so that no role wins by being unknown,
and every role keeps a small chance after any other.
Markers are trusted to ``TRUST``, not blindly: a misplaced or missing name yields to the sequence.  The
best path is found by Viterbi, and each row is rendered as one canonical turn per run of lines of one
role.  A marker is cut where the path agrees with it and it opens a turn; any other stays in the text.

A conversation can be of any length.  One of more than ``BLOCK`` rows is sorted by all tasks together and
cut by position into blocks of at most that many rows, whatever its turn numbers are, within a turn
too; of equal rows any order gives the same result.  A first pass
turns each block into the (max, +) product of its steps, a small matrix; the matrices of a
conversation are chained to give the best state at every block's ends; a second pass solves each
block between its two known ends.  This is the exact best path, while no task holds more than a block
of rows, and only matrices are gathered by conversation.

Defined cases: null roles and unknown names are no marker; a null text is one empty line.  Rows with
the same turn are ordered by role and text; null turns come last, in that order.
Rows with a null ``conv_id`` form a conversation.  Repeated rows are turns of their own.  An empty
table gives no rows, as does a table without any row to learn from, which falls back on uniform
features.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, runs, ship, written

ROLES = ("system", "user", "assistant", "tool")
#: Usual speaker names, in lower case, and their roles.
NAMES = {
    "system": 0, "sys": 0, "instruction": 0, "instructions": 0, "context": 0,
    "user": 1, "human": 1, "customer": 1, "client": 1, "question": 1, "q": 1, "prompter": 1, "me": 1,
    "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "model": 2, "agent": 2, "answer": 2, "a": 2, "response": 2,
    "tool": 3, "function": 3, "observation": 3, "ipython": 3,
}
TRUST = 0.97
BLOCK = 4096
#: Training bound: about so many conversations, chosen by hash, and the first (distinct) rows of each.
TRAIN_CONVERSATIONS, TRAIN_ROWS = 2000, 32
#: Names that start lines of prose as well, and the (agreeing, all) uses that their trust starts from.
ORDINARY = frozenset(("instruction", "instructions", "context", "customer", "client", "question", "q", "me", "model", "agent", "answer", "a",
                      "response", "tool", "function", "observation"))
PRIOR_USES = (3, 4)
#: Rows' worth of the mean features that every role starts from, and the share of steps to any role alike.
PRIOR_ROWS, ANY = 4, 0.1

_MARKER = re.compile(r"\s*(?:<\|(?:im_start\|>)?|\[|#{1,4}\s*|\*\*)?\s*([A-Za-z]{1,12})\s*(?:\|>|\]|:\*\*|\*\*:|\*\*|:)\s*")
_K, _ROWS, _LENGTHS, _ENDS = len(ROLES), 5, 6, 4
#: Marker codes: roles by a firm marker, no marker, and from ``_LOOSE`` on roles by an ordinary word.
_NONE, _LOOSE = _K, _K + 1

OUT = "conv_id long, turn long, part int, role string, text string, rendered string"


def marker(line: str) -> tuple[int, int]:
    """(code, characters) of a speaker marker that starts ``line``; (no marker, 0) without one."""
    m = _MARKER.match(line)
    if m and (role := NAMES.get(m.group(1).lower())) is not None and (len(m.group(1)) > 2 or ":" in m.group()):
        loose = m.group(1).lower() in ORDINARY and m.group().lstrip()[0] not in "<[#"
        return role + _LOOSE * loose, m.end()
    return _NONE, 0


def observed(role: str | None, text: str | None) -> tuple[np.ndarray, list[int], list[str]]:
    """Per line: (marker, class of the row's lines if it opens the row, length class, ending); the width of
    its own marker; the lines."""
    lines = (text or "").split("\n")
    declared = NAMES.get((role or "").strip().lower(), _NONE)
    obs, skip = np.empty((len(lines), 4), np.int64), []
    for n, line in enumerate(lines):
        said, width = marker(line)
        if said >= _LOOSE and declared != _NONE:
            said, width = _NONE, 0
        if n == 0 and declared != _NONE and said == _NONE:
            said = declared
        end = line.rstrip()[-1:]
        obs[n] = said, 0 if n else min(_ROWS - 1, len(lines).bit_length()), min(_LENGTHS - 1, len(line).bit_length() // 2), 0 if end == "?" else 1 if end in ".!" and end else 2 if end.isalnum() else 3
        skip.append(width)
    return obs, skip, lines


class Model:
    """Log probabilities of the chain."""

    def __init__(self, rows: list[tuple[object, str | None, str | None]]):
        start, across, count = np.ones(_K), np.ones((_K, _K)), np.zeros(_K)
        opens, length, end = np.ones((_K, _ROWS)), np.ones((_K, _LENGTHS)), np.ones((_K, _ENDS))
        uses = np.tile(np.array(PRIOR_USES, float), (_K, 1))
        conv, last = object(), _NONE
        for c, role, text in rows:
            s = NAMES.get((role or "").strip().lower(), _NONE)
            if s != _NONE:
                obs, _, _ = observed(None, text)
                if c != conv:
                    start[s] += 1
                elif last != _NONE:
                    across[last, s] += 1
                for said in obs[obs[:, 0] >= _LOOSE, 0] - _LOOSE:
                    uses[said] += said == s, 1
                _, o, n, e = obs[0]
                count[s] += 1
                opens[s, o] += 1
                length[s, n] += 1
                end[s, e] += 1
            conv, last = c, s
        marks = np.full((_K, _LOOSE + _K), (1 - TRUST) / (_K - 1))
        marks[np.arange(_K), np.arange(_K)] = TRUST
        marks[:, _NONE] = 1  # no marker says nothing
        trust = np.minimum(TRUST, uses[:, 0] / uses[:, 1])
        marks[:, _LOOSE:] = (1 - trust) / (_K - 1)
        marks[np.arange(_K), _LOOSE + np.arange(_K)] = np.maximum(trust, 1e-9)
        share = lambda t: t / t.sum(axis=-1, keepdims=True)
        step = lambda t: np.log((1 - ANY) * share(t) + ANY / _K)
        own = (count / (count + PRIOR_ROWS))[:, None]

        def feature(t: np.ndarray) -> np.ndarray:
            t = np.log(share(t))
            return own * t + (1 - own) * t[count > 0].mean(axis=0) if count.any() else t

        self.start, self.across = step(start), step(across)
        self.within = np.where(np.eye(_K, dtype=bool), 0.0, -1e6)  # no marker, no other speaker
        self.marks, self.opens, self.length, self.end = np.log(marks), feature(opens), feature(length), feature(end)
        self.opens[:, 0] = 0

    def emission(self, obs: np.ndarray) -> np.ndarray:
        features = self.opens[:, obs[:, 1]] + self.length[:, obs[:, 2]] + self.end[:, obs[:, 3]]
        return (self.marks[:, obs[:, 0]] + features * ((obs[:, 1] > 0) | (obs[:, 0] != _NONE))).T

    def step(self, line: np.ndarray, emission: np.ndarray) -> np.ndarray:
        """The (from, to) scores of moving onto a line; a marker inside a row can change the speaker."""
        return (self.across if line[1] or line[0] != _NONE else self.within) + emission

    def product(self, obs: np.ndarray) -> np.ndarray:
        """(max, +) product of the steps onto all lines."""
        e = self.emission(obs)
        out = self.step(obs[0], e[0])
        for line, em in zip(obs[1:], e[1:], strict=True):
            out = (out[:, :, None] + self.step(line, em)[None]).max(axis=1)
        return out

    def path(self, obs: np.ndarray, before: int | None = None, last: int | None = None) -> list[int]:
        """Best states, after state ``before`` (None: the conversation starts here) and ending in ``last``."""
        e = self.emission(obs)
        score = self.start + e[0] if before is None else self.step(obs[0], e[0])[before]
        back = []
        for line, em in zip(obs[1:], e[1:], strict=True):
            every = score[:, None] + self.step(line, em)
            back.append(every.argmax(axis=0))
            score = every.max(axis=0)
        out = [int(score.argmax()) if last is None else last]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def train(turns: DataFrame) -> Model:
    """Count the chain over a bounded share of the conversations, and of the rows of long ones, chosen by hash."""
    rows = sampled(turns).collect()
    order = lambda r: (r["conv_id"], r["turn"], r["role"] or "", r["text"] or "")
    return Model([(r["conv_id"], r["role"], r["text"]) for r in sorted(rows, key=order)])


def sampled(turns: DataFrame) -> DataFrame:
    """The distinct rows to train on."""
    known = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "text")
    share = min(1.0, TRAIN_CONVERSATIONS / max(1, known.agg(F.approx_count_distinct("conv_id")).first()[0]))
    rows = known.where(F.shiftrightunsigned(F.xxhash64("conv_id"), 11) / float(1 << 53) < share).distinct()
    # Spark keeps the first rows of a window per task before it shuffles
    first = Window.partitionBy("conv_id").orderBy(*_order())
    return rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= TRAIN_ROWS).drop("n")


def dealt(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``block``, which rises along a conversation and is alike for at most ``block`` rows of it;
    and the conversations (``of``) that have several."""
    rows = rows.select("conv_id", F.lit(0).cast("long").alias("block"), "turn", "role", "text")
    size = rows.groupBy(F.col("conv_id").alias("of")).agg(F.count("*").alias("n"))
    many = written(size.where(F.col("n") > block).select("of"), "chat-long")
    if many.isEmpty():
        return rows, many
    here = rows["conv_id"].eqNullSafe(many["of"])
    few_ = few(many)
    order = [F.col("conv_id").asc_nulls_first(), *_order(), F.col("__n").asc()]
    long = rows.join(few_, here, "left_semi").withColumn("__n", F.monotonically_increasing_id())  # splits equal rows
    long = long.repartitionByRange(*order).sortWithinPartitions(*order).drop("__n")
    # numbers rise within a partition, and leave a gap of more than a block to the next
    cut = long.withColumn("block", F.floor(F.monotonically_increasing_id() / block).cast("long"))
    return rows.join(few_, here, "left_anti").unionByName(written(cut, "chat-cut")), many


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]


def parse(turns: DataFrame, model: Model | None = None, block: int = BLOCK) -> DataFrame:
    """One row per canonical turn: ``conv_id, turn``, its part of the row, ``role``, words, rendering."""
    ship(turns.sparkSession)
    conv = F.col("conv_id").cast("long").alias("conv_id")
    rows = turns.select(conv, F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    model = model or train(rows)
    rows, many = dealt(rows, block)
    keys = ["conv_id", "block"]
    rows = rows.select(*keys, "turn", "role", "text")
    names, kinds = [*keys, "matrix"], [pa.int64(), pa.int64(), pa.list_(pa.float64())]

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block its product; the first block's steps start the chain instead of continuing it."""
        out = []
        for run in runs(batches, 2):
            obs = np.concatenate([observed(r[3], r[4])[0] for r in run])
            out.append((*run[0][:2], _entry(model, obs)))
        yield _batch(out, names, kinds)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for run in runs(batches, 1):
            out += _ends(run)
        yield _batch(out, [*keys, "before", "last"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])

    long = rows.join(few(many), rows["conv_id"].eqNullSafe(many["of"]), "left_semi")
    matrices = long.repartition(*keys).sortWithinPartitions(*keys, *_order()).mapInArrow(starts, "conv_id long, block long, matrix array<double>")
    ends = matrices.repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(chain, "conv_id long, block long, before int, last int")
    ends = written(ends, "chat-ends").withColumnsRenamed({"conv_id": "c", "block": "b"})
    known = rows.join(ends, rows["conv_id"].eqNullSafe(ends["c"]) & (rows["block"] == ends["b"]), "left").drop("c", "b")
    dealt_ = known.repartition(*keys).sortWithinPartitions(*keys, *_order())

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [c.split()[0] for c in OUT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
        out = []
        for run in runs(batches, 2):
            out += _turns(model, run)
            if len(out) >= 2000:
                yield _batch(out, cols, types)
                out = []
        yield _batch(out, cols, types)

    return dealt_.mapInArrow(solve, OUT)


def _entry(model: Model, obs: np.ndarray) -> list[float]:
    """The block's product, then its scores when the conversation starts with it."""
    product = model.product(obs)
    e = model.emission(obs)
    score = model.start + e[0]
    for line, em in zip(obs[1:], e[1:], strict=True):
        score = (score[:, None] + model.step(line, em)).max(axis=0)
    return [*product.ravel().tolist(), *score.tolist()]


def _ends(run: list[tuple]) -> list[tuple]:
    """The best states at the ends of the blocks of one conversation."""
    score, back = np.array(run[0][2][_K * _K:]), []
    for *_, flat in run[1:]:
        every = score[:, None] + np.array(flat[:_K * _K]).reshape(_K, _K)
        back.append(every.argmax(axis=0))
        score = every.max(axis=0)
    last = [int(score.argmax())]
    for b in reversed(back):
        last.append(int(b[last[-1]]))
    last.reverse()
    return [(*r[:2], last[i - 1] if i else None, last[i]) for i, r in enumerate(run)]


def _turns(model: Model, run: list[tuple]) -> list[tuple]:
    seen = [observed(r[3], r[4]) for r in run]
    states = model.path(np.concatenate([s[0] for s in seen]), run[0][5], run[0][6])
    out, at = [], 0
    for (conv, _, turn, *_), (obs, skip, lines) in zip(run, seen, strict=True):
        own = states[at:at + len(lines)]
        at += len(lines)
        first, part = 0, 0
        for n in range(1, len(lines) + 1):
            # a turn ends where the role changes, and before a firm marker of the same role
            if n == len(lines) or own[n] != own[n - 1] or obs[n, 0] == own[n]:
                agrees = own[first] in (obs[first, 0], obs[first, 0] - _LOOSE)
                said = "\n".join([lines[first][skip[first] * agrees:], *lines[first + 1:n]]).strip()
                role = ROLES[own[first]]
                out.append((conv, turn, part, role, said, f"<|{role}|>\n{said}\n<|end|>\n"))
                first, part = n, part + 1
    return out
