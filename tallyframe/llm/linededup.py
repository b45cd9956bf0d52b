"""Line deduplication by a segment-partition edit join.

All lines that hold a letter or digit, and all of ``MIN_CHARS`` characters or more (without white space at
the ends), are compared across the whole corpus.  Equal lines meet by a 128-bit digest.  Distinct lines
of ``MIN_CHARS`` or more (two edits make another word of a short one) within ``THRESHOLD`` (t) edits of
each other are found by partition: a line is split into t + 1 segments, of which one at least is
untouched by t edits.  Every line is posted under its own segments (the index) and under the
substrings of itself that could be a segment of a line of the same length or up to t shorter (the
probes); which substrings these are follows from the segment's number and the difference in length,
so a line probes at most a dozen.  Postings carry a small character-count signature, which rejects most pairs
that only share a segment; the rest are verified with a banded bit-parallel edit distance.

Links join lines to classes (connected components).  The first line of a class, by (doc_id, row,
line), stays; all others are dropped.

A segment that more than ``LIST`` distinct lines share is a hot key.  Its lines are dealt to blocks
of about ``LIST`` x 8 lines and every two blocks meet in a task, which compares signatures in arrays,
verifies only pairs of lines that are not connected yet, and hands on the connecting links only, so
what leaves the task is linear in the lines.

Defined cases: a null text has no lines and stays null.  Empty lines, and short ones of marks only, always
stay; other short lines go if they equal an earlier one.  Null ``doc_id`` values come last in the order; rows with the same ``doc_id`` are ordered as
read.  A text all of whose lines go becomes empty; its row stays.  An empty table gives no rows.
Columns other than ``doc_id``, ``text`` and ``n_chars`` pass through unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GONE, ROW, aside, few, runs, ship, with_row, written
from .components import connected, stars
from .wordcache import blocks

#: Least length of the lines that edits are allowed in.
MIN_CHARS = 24
THRESHOLD = 2
#: Longest list of lines sharing a segment whose pairs are formed at once.
LIST = 64


def segments(length: int, t: int) -> list[tuple[int, int]]:
    """(start, length) of the t + 1 segments of a line: all of even length, the longer ones last."""
    base, longer = divmod(length, t + 1)
    out, at = [], 0
    for i in range(t + 1):
        n = base + (i > t - longer)
        out.append((at, n))
        at += n
    return out


def substrings(length: int, t: int) -> list[tuple[bool, int, int, int, int]]:
    """What a line of ``length`` is posted under: (own segment?, indexed length, segment, start, size)."""
    out = []
    for gap in range(t + 1):
        if length - gap <= t:
            break
        for i, (p, n) in enumerate(segments(length - gap, t)):
            # edits left of the segment, and right of it, can shift it by so much
            low, high = max(0, p - i, p + gap - (t - i)), min(length - n, p + i, p + gap + (t - i))
            out += [(gap == 0 and at == p, length - gap, i, at, n) for at in range(low, high + 1)]
    return out


_plans: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}  # of lengths met; lengths repeat


def _plan(length: int, t: int) -> tuple[np.ndarray, ...]:
    """:func:`substrings` as arrays: probe?, number of the segment among all lengths, start, size."""
    if (length, t) not in _plans:
        if len(_plans) > 50_000:
            _plans.clear()
        own, indexed, i, at, size = np.array(substrings(length, t), np.int64).reshape(-1, 5).T
        _plans[length, t] = (1 - own, indexed * (t + 1) + i, at, size)
    return _plans[length, t]


def postings(lines: list[str], t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, line and probe mark of all postings of ``lines``.

    A key is a polynomial of the substring's code points modulo 2^64, from running sums, mixed with the segment's number.
    """
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(0x9E3779B9)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if lines else size
    power, inverse = (_powers(base, len(points) + 1) for base in (_BASE, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * power[:-1], dtype=np.uint64)])
    keys, of, probes = ([np.empty(0, k)] for k in (np.uint64, np.int64, np.int64))
    order = np.argsort(size, kind="stable")
    ends = np.flatnonzero(np.diff(size[order], append=-1)) + 1
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
        probe, number, at, n = _plan(int(size[order[a]]), t)
        start = (first[order[a:b], None] + at).ravel()
        h = (sums[start + np.tile(n, b - a)] - sums[start]) * inverse[start]
        h = (h ^ np.tile(number, b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
        keys.append(h ^ h >> np.uint64(32))
        of.append(np.repeat(order[a:b], len(at)))
        probes.append(np.tile(probe, b - a))
    return np.concatenate(keys), np.concatenate(of), np.concatenate(probes)


_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def signatures(lines: list[str]) -> np.ndarray:
    """Counts of sixteen character classes, four bits each, side by side in 64 bits."""
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32) & 15
    of = np.repeat(np.arange(len(lines), dtype=np.int64), [len(s) for s in lines])
    count = np.bincount(of * 16 + points, minlength=16 * len(lines)).reshape(-1, 16).astype(np.uint64) & np.uint64(15)
    return (count << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def may_match(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """Whether signatures allow t edits: an edit changes two counts by one at most."""
    x, y = (s.astype(np.uint64).view(np.uint8).reshape(-1, 8) for s in (a, b))
    total = np.zeros(len(x), np.int64)
    for d in ((x - y) & 15, ((x >> 4) - (y >> 4)) & 15):
        total += np.minimum(d, 16 - d).sum(axis=1, dtype=np.int64)
    return total <= 2 * t


def within(a: str, b: str, t: int) -> bool:
    """Whether the edit distance is at most t: common ends are cut off, then a band of 2t + 1 diagonals
    is carried from row to row in the bits of one integer (set bits: vertical differences)."""
    if abs(len(a) - len(b)) > t:
        return False
    n = min(len(a), len(b))
    i = _common(a, b, n)
    a, b = a[i:], b[i:]
    j = _common(a[::-1], b[::-1], min(len(a), len(b)))
    a, b = a[:len(a) - j], b[:len(b) - j]
    if len(a) > len(b):
        a, b = b, a
    if not a or len(b) <= t:
        return len(b) <= t
    # the band covers the diagonals of b's index minus a's index from -t to t
    width = 2 * t + 1
    full, top = (1 << width) - 1, 1 << width - 1
    seen: dict[str, int] = {}  # where each character of b is, as far as the band has come
    for k in range(min(t, len(b))):
        seen[b[k]] = seen.get(b[k], 0) | 1 << k + t + 1
    # vp, vn: differences +1 and -1 between neighbouring cells of the band; score: the cell on diagonal t
    vp, vn, score = full & ~((1 << t) - 1), 0, t
    last = len(b) - len(a)
    for row in range(len(a)):
        if row + t < len(b):
            seen[b[row + t]] = seen.get(b[row + t], 0) | 1 << row + 2 * t + 1
        eq = seen.get(a[row], 0) >> row + 1 & full
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp) & full, d0 & vp
        score += 0 if d0 & top else 1
        x = d0 >> 1
        vp, vn = hn | ~(x | hp) & full, x & hp
        if score > 2 * t - last:  # it never falls, and the walk below gains t - last at most
            return False
    # walk from diagonal t to the diagonal of the last cell
    for k in range(t - last):
        bit = 1 << width - 2 - k
        score += bool(vn & bit) - bool(vp & bit)
    return score <= t


def _common(a: str, b: str, n: int) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, n
    if a[:n] == b[:n]:
        return n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low if high == low or a[low:high] != b[low:high] else high


_WORD = re.compile(r"[^\W_]")


def _lines(batch: pa.RecordBatch, least: int = MIN_CHARS) -> Iterator[tuple[list[tuple], list[str]]]:
    """Blocks of ((row, doc_id, line number), ...) and their lines, from columns row, doc_id, text; of the
    lines under ``MIN_CHARS`` those of ``least`` characters with a letter or digit."""
    rows, ids, texts = (c.to_pylist() for c in batch.columns[:3])
    texts = [t or "" for t in texts]
    for a, b in blocks(texts):
        places, lines = [], []
        for r, d, t in zip(rows[a:b], ids[a:b], texts[a:b], strict=True):
            for n, line in enumerate(t.split("\n")):
                if (size := len(s := line.strip())) >= MIN_CHARS or size >= least and _WORD.search(s):
                    places.append((r, d, n))
                    lines.append(s)
        yield places, lines


def _digest(line: str) -> tuple[int, int]:
    import xxhash

    raw = xxhash.xxh3_128_digest(line.encode())
    return int.from_bytes(raw[:8], "little", signed=True) & ~1, int.from_bytes(raw[8:], "little", signed=True)


def _frame(names: str, *cols) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


_PLACES = "h1 long, h2 long, row long, doc_id long, line long"
_POSTED = "key long, id long, sig long"
_FOUND = "a long, b long, key long"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for places, lines in _lines(batch, 1):
            h = [_digest(s) for s in lines]
            yield _frame(_PLACES, [x[0] for x in h], [x[1] for x in h], [p[0] for p in places], [p[1] for p in places], [p[2] for p in places])


def _postings(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    """Postings of each distinct line of a batch; the lowest bit of the id marks a probe."""
    for batch in batches:
        seen: set[int] = set()
        for _, lines in _lines(batch):
            ids, fresh = [], []
            for s in lines:
                h = _digest(s)[0]
                if h not in seen:
                    seen.add(h)
                    ids.append(h)
                    fresh.append(s)
            keys, of, probe = postings(fresh, t)
            sig = signatures(fresh)[of] if fresh else np.empty(0, np.uint64)
            yield _frame(_POSTED, keys.view(np.int64), np.array(ids, np.int64)[of] | probe, sig.view(np.int64))


def _candidates(batches: Iterator[pa.RecordBatch], t: int, longest: int) -> Iterator[pa.RecordBatch]:
    """From postings sorted by key and id: pairs whose signatures allow a match, and the hot keys with their lines (as a)."""
    rest = [np.empty(0, np.int64)] * 3
    for batch in _ended(batches):
        now = rest if batch is None else [np.concatenate([x, c.to_numpy()]) for x, c in zip(rest, batch.columns, strict=True)]
        key, ident, sig = now
        if not len(key):
            continue
        first = np.ones(len(key), bool)  # a line posted from several tasks counts once
        first[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])
        key, ident, sig = key[first], ident[first], sig[first]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        cut = len(key)
        more = np.empty(0, np.int64)  # lines of a hot key that goes on
        if batch is not None:  # the last key may go on in the next batch
            cut, starts = starts[-1], starts[:-1]
            # of a key that is hot already, a few lines are enough to know it
            open_ = ident[cut:]
            keep = 2 * longest + 2 if len(np.unique(open_[:2 * longest + 2] & ~np.int64(1))) > longest else len(open_)
            rest = [c[cut:][:keep] for c in (key, ident, sig)]
            more = np.unique(open_[keep:] & ~np.int64(1))
        open_key = key[cut:cut + 1].repeat(len(more))
        key, ident, sig = key[:cut], ident[:cut], sig[:cut]
        if not cut:
            if len(more):
                yield _frame(_FOUND, more, [None] * len(more), open_key)
            continue
        size = np.diff(np.append(starts, cut))
        run = np.repeat(np.arange(len(starts)), size)
        line = ident & ~np.int64(1)
        distinct = np.bincount(run[np.concatenate([[True], (run[1:] != run[:-1]) | (line[1:] != line[:-1])])], minlength=len(starts))
        hot = distinct > longest
        a, b = [], []
        i = np.flatnonzero(np.repeat((size > 1) & ~hot, size))
        step = 0
        while len(i):
            step += 1
            i = i[i + step < cut]
            i = i[run[i] == run[i + step]]
            j = i + step
            # one of the two owns the segment
            use = (line[i] != line[j]) & ((ident[i] & ident[j] & 1) == 0)
            use[use] = may_match(sig[i[use]], sig[j[use]], t)
            a.append(line[i[use]])
            b.append(line[j[use]])
        pairs = np.unique(np.sort(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=1), axis=0) if a else np.empty((0, 2), np.int64)
        members = np.repeat(hot, size)
        hot_lines, hot_keys = np.concatenate([line[members], more]), np.concatenate([key[members], open_key])
        n, m = len(pairs), len(hot_keys)
        yield _frame(_FOUND, np.concatenate([pairs[:, 0], hot_lines]), [*pairs[:, 1].tolist(), *[None] * m], [*[None] * n, *hot_keys.tolist()])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, lines in _lines(batch):
            own = {_digest(s)[0]: s for s in lines}
            yield _frame("id long, line string", list(own), list(own.values()))


def _verified(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (c.to_pylist() for c in batch.columns)
        good = [within(s, u, t) for s, u in zip(x, y, strict=True)]
        p, q = (np.array([i for i, g in zip(ids, good, strict=True) if g], np.int64) for ids in (a, b))
        yield _frame("a long, b long", *stars(p, q))


def _hot_block(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    """Connecting links of two blocks of lines; rows (key, x, y, own block, id, line) sorted by key, x, y."""
    for run in runs(batches, 3):
        _, x, y = run[0][:3]
        own = {r[4]: r for r in run}
        rows = sorted(own.values(), key=lambda r: (r[3] != x, r[4]))
        lines, ids = [r[5] for r in rows], np.array([r[4] for r in rows], np.int64)
        sig, size = signatures(lines), np.array([len(s) for s in lines])
        block = np.array([r[3] for r in rows])
        root = np.arange(len(rows))
        a, b = [], []
        for i in range(len(rows)):
            if x != y and block[i] != x:
                break
            j = np.arange(i + 1, len(rows))
            if x != y:
                j = j[block[j] != x]
            j = j[(np.abs(size[j] - size[i]) <= t) & (root[j] != root[i])]
            j = j[may_match(np.broadcast_to(sig[i], j.shape).copy(), sig[j], t)] if len(j) else j
            for k in j.tolist():
                if root[k] != root[i] and within(lines[i], lines[k], t):
                    root[root == root[k]] = root[i]
                    a.append(ids[i])
                    b.append(ids[k])
        yield _frame("a long, b long", a, b)


def links(docs: DataFrame, t: int = THRESHOLD, longest: int = LIST) -> DataFrame:
    """Links between digests of distinct lines that connect all lines within t edits of each other.

    ``docs`` has the row number, ``doc_id`` and ``text``.
    """
    posted = docs.mapInArrow(lambda it: _postings(it, t), _POSTED)
    sorted_ = posted.repartition("key").sortWithinPartitions("key", "id")
    found = written(sorted_.mapInArrow(lambda it: _candidates(it, t, longest), _FOUND), "lines-found")
    pairs = written(found.where("key is null").select("a", "b").distinct(), "lines-pairs")
    lines = docs.mapInArrow(_texts, "id long, line string")

    wanted = few(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    text = written(lines.join(wanted, "id", "left_semi").dropDuplicates(["id"]), "lines-text")
    both = pairs.join(text.withColumnsRenamed({"id": "a", "line": "x"}), "a").join(text.withColumnsRenamed({"id": "b", "line": "y"}), "b")
    good = both.select("a", "b", "x", "y").mapInArrow(lambda it: _verified(it, t), "a long, b long")

    members = written(found.where("key is not null").select("key", F.col("a").alias("id")).distinct(), "lines-members")
    if members.isEmpty():
        return good
    size = members.groupBy("key").agg(F.ceil(F.count("*") / (8 * longest)).alias("n"))
    text = written(lines.join(few(members.select("id").distinct()), "id", "left_semi").dropDuplicates(["id"]), "lines-hot-text")
    own = members.join(size, "key").withColumn("own", F.pmod(F.xxhash64("id"), "n"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    met = met.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id").join(text, "id")
    met = met.select("key", "x", "y", "own", "id", "line").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")
    return good.unionAll(met.mapInArrow(lambda it: _hot_block(it, t), "a long, b long"))


def dropped(docs: DataFrame, t: int = THRESHOLD, longest: int = LIST) -> DataFrame:
    """Per row of ``docs`` (which has the row number): ``n_lines`` compared, and the lines that go with where each stays."""
    ship(docs.sparkSession)
    three = docs.select(F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    places = written(three.mapInArrow(_places, _PLACES), "lines-places")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row", "line")
    distinct = places.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    roots = connected(links(three, t, longest), "lines-cc")
    classed = distinct.join(roots, distinct["h1"] == roots["node"], "left")
    classed = classed.select("h1", "h2", "first", F.coalesce("root", "h1").alias("c1"), F.when(F.col("root").isNull(), F.col("h2")).alias("c2"))
    classed = written(classed, "lines-classes")
    first = classed.groupBy("c1", "c2").agg(F.min("first").alias("stays")).withColumnsRenamed({"c1": "d1", "c2": "d2"})
    named = classed.join(first, (F.col("c1") == F.col("d1")) & F.col("c2").eqNullSafe(F.col("d2"))).select("h1", "h2", "stays")
    all_ = places.join(named, ["h1", "h2"])
    goes = (F.col("row") != F.col("stays.row")) | (F.col("line") != F.col("stays.line"))
    gone = F.struct("line", F.col("stays.doc_id").alias("doc_id"), F.col("stays.line").alias("first_line"))
    return all_.groupBy(F.col("row").alias(ROW)).agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.when(goes, gone))).alias("gone"))


def report(docs: DataFrame, t: int = THRESHOLD, longest: int = LIST) -> DataFrame:
    """One row per document: ``n_lines`` compared, ``n_dropped``, and ``dropped``: line:staying doc_id:staying line."""
    rows = with_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = dropped(rows, t, longest)
    name = F.transform("gone", lambda g: F.concat_ws(":", g["line"], F.coalesce(g["doc_id"].cast("string"), F.lit("null")), g["first_line"]))
    return rows.select(ROW, "doc_id").join(found, ROW, "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join(name, ","), F.lit("")).alias("dropped"))


def deduplicated(docs: DataFrame, t: int = THRESHOLD, longest: int = LIST) -> DataFrame:
    """``docs`` without the lines that go; ``n_chars``, if present, follows the text."""
    plain, back = aside(docs)
    rows = with_row(plain)
    found = dropped(rows, t, longest).where(F.size("gone") > 0).select(ROW, F.transform("gone", lambda g: g["line"].cast("int")).alias(GONE))
    both = rows.join(found, ROW, "left")
    stays = F.filter(F.split("text", "\n"), lambda _, n: ~F.array_contains(GONE, n))
    text = F.when(F.col(GONE).isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(GONE).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*plain.columns).withColumnsRenamed(back)
