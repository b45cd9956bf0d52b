"""Removal of long repeated byte strings with suffix arrays built by Lyndon grouping.

A byte goes if a string of ``length`` (400) bytes that covers it also starts anywhere else in the
corpus, the same text included.  Suffixes of the whole corpus do not fit one task, so equal strings
are first brought together, and each group's suffix array is built in its own task:

1. Every window of 400 bytes has an anchor, the place of the least-hashed 64 bytes in it (leftmost of
   equals).  Equal windows have equal bytes at their anchors, at the same distance.  The windows of one
   anchor follow each other; the bytes that they cover are its *stretch*, some 570 bytes every 170.
2. Stretches are grouped by the 64 bytes at the anchor.  Those equal as a whole are one text with a weight
   (map-side aggregation), so copies of any number cost one row.  Groups of total weight 1 end here.
3. Per group, the suffix array of its distinct stretches puts equal windows side by side: those
   with an equal neighbour, or of a text of weight 2 or more, are repeated.  Equal windows lie alike
   around their anchors, so the array is over symbols of eight bytes counted from there.
4. Repeated windows go back to all rows of their stretch and are merged per text.

A group of more than ``LIST`` distinct stretches (many texts around one passage) is split without
losing pairs: windows are dealt by ranges of ``RANGE`` distances from the anchor, and the bytes that all
windows of a range share become the key; what is hot after that is dealt by whole windows, whose
groups are counted map-side.  So no task holds an unbounded group.

The suffix array (:func:`suffix_array`) is built in linear time and without recursion.  First suffixes
are grouped by their Lyndon prefix: groups are taken in descending order, the previous smaller suffix
of each member is found over the pointers of suffixes done before, and moves to a group of its own above
the one it was in.  Then the order within the groups is emitted: taking suffixes in ascending order, those
whose Lyndon prefix ends where the taken one starts get the next place of their group.

Keys and stretches are told apart by 128-bit digests; windows are compared byte by byte, except in the
last split of hot groups.  Defined cases: null counts as empty; texts under 400 bytes lose nothing; rows
are texts of their own, whatever their ``doc_id``, so tied and repeated rows remove each other wholly.  An
empty table gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, runs, ship, with_row, written
from .segments import blocks_of, text_buffer

LENGTH = 400
#: Bytes at an anchor, a power of two under the length of a window.
GRAM = 64
#: Distinct stretches of a group, at most, for one suffix array.
LIST = 128
#: Bytes of a symbol of the suffix arrays.
STEP = 8
#: Distances from the anchor that a range of a split group has.
RANGE = 16


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Groups of suffixes by Lyndon prefix: each suffix's group, the groups in ascending order, and
    per suffix the start of the previous smaller one (-1: none) and of the next smaller one."""
    n = len(text)
    members: list[list[int]] = []
    of, number = [0] * n, {}
    for c in sorted(set(text)):
        number[c] = len(members)
        members.append([])
    for i, c in enumerate(text):
        of[i] = g = number[c]
        members[g].append(i)
    size = [len(m) for m in members]
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    before, after, done = [-1] * n, [n] * n, bytearray(n)
    g = len(members) - 1
    while g >= 0:
        # those that moved to a higher group have been there already
        here = [i for i in members[g] if of[i] == g] if len(members[g]) != size[g] else members[g]
        members[g] = here
        if len(here) > 1:
            here.sort()
        times: dict[int, int] = {}  # of each previous smaller suffix, how many of this group follow it
        for i in here:
            p = i - 1
            while p >= 0 and done[p]:  # suffixes of higher groups, and of this one, end where i starts
                after[p] = i
                p = before[p]
            before[i] = p
            done[i] = 1
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        # suffixes with such followers are the largest of their group, the more followers the larger
        raised: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            raised.setdefault((k, of[p]), []).append(p)
        for k, low in sorted(raised, reverse=True) if len(raised) > 1 else raised:
            moved = raised[k, low]
            if len(moved) == size[low]:
                continue  # all that is left of the group
            new = len(members)
            members.append(moved)
            size[low] -= len(moved)
            size.append(len(moved))
            for p in moved:
                of[p] = new
            # directly above what is left; groups with more followers were put there before
            up = above[low]
            below.append(low)
            above.append(up)
            above[low] = new
            below[up] = new
        g = below[g]
    order, g = [], below.index(-1) if members else -1
    while g >= 0:
        order.append(g)
        g = above[g]
    return of, order, before, after


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order."""
    n = len(text)
    of, order, before, after = lyndon_groups(text)
    count = [0] * len(order)
    for g in of:
        count[g] += 1
    place, at = [0] * len(order), 0
    for g in order:
        place[g] = at
        at += count[g]
    out = [0] * n
    for k in range(-1, n):
        s = out[k] if k >= 0 else n  # the empty suffix is the least
        p = s - 1
        while p >= 0 and after[p] == s:
            g = of[p]
            out[place[g]] = p
            place[g] += 1
            p = before[p]
    return out


def _hashed(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling."""
    h = data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    step, factor = 1, 0xD6E8FEB86659FD93
    while step < GRAM:
        low = h[:-step] * np.uint64(factor)
        low ^= low >> np.uint64(29)
        low += h[step:]
        h = low * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        step *= 2
        factor = (factor * 0x2545F4914F6CDD1D | 1) % (1 << 64)
    return h


def stretches(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and distance from the first window to the anchor, for each stretch of the texts."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none
    # the place in the lower bits: the leftmost of equal hashes is the least
    h = _hashed(data) & ~np.uint64((1 << _PLACE) - 1) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    span, have = length - GRAM + 1, 1
    while have < span:
        step = min(have, span - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    anchor = (h & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    inner = bounds[1:-1]
    bad = np.zeros(len(anchor) + 1, np.int64)  # windows that reach over the end of a text do not count
    np.add.at(bad, np.clip(inner - length + 1, 0, len(anchor)), 1)
    np.add.at(bad, np.clip(inner, 0, len(anchor)), -1)
    good = np.cumsum(bad)[:-1] == 0
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~good[:-1]
    first = np.flatnonzero(new & good)
    stop = np.flatnonzero(good & np.append(new[1:] | ~good[1:], True))
    return first, stop - first + 1, anchor[first] - first


_PLACE = 28
#: Bytes whose windows are anchored at a time.
CHUNK = 1 << 17


def _digests(parts: Iterator[tuple[bytes, int]]) -> np.ndarray:
    """Two 64-bit halves of a digest of each (bytes, seed)."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(p, s) for p, s in parts]), "<i8").reshape(-1, 2)


def _batch(names: str, *cols) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


_PLACES = "row long, first int, windows int, off int, k long, c1 long, c2 long"
_TEXTS = "k long, c1 long, c2 long, n long, off int, windows int, text binary"
_SUBS = "k long, d1 long, d2 long, c1 long, c2 long, n long, skip int, windows int, off int"
_FOUND = "c1 long, c2 long, lo array<int>, hi array<int>"


def _pieces(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts, and pieces of a text that is longer: number of the first text, place in it, bytes and bounds."""
    for a, b in blocks_of(bounds, CHUNK):
        if b > a + 1 or bounds[b] - bounds[a] <= 2 * CHUNK:
            yield a, 0, data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a]
        else:
            for s in range(0, int(bounds[b] - bounds[a]) - length + 1, CHUNK):
                part = data[bounds[a] + s:min(bounds[b], bounds[a] + s + CHUNK + length - 1)]
                yield a, s, part, np.array([0, len(part)])


def _places(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(0).to_numpy()
        data, bounds = text_buffer(batch.column(1))
        for a, at, part, inner in _pieces(data, bounds, length):
            first, windows, off = stretches(part, inner, length)
            raw = part.tobytes()
            where = list(zip(first.tolist(), windows.tolist(), off.tolist(), strict=True))
            whole = _digests((raw[f:f + w + length - 1], o) for f, w, o in where)
            gram = _digests((raw[f + o:f + o + GRAM], 0) for f, w, o in where)
            text = np.searchsorted(inner, first, "right") - 1
            yield _batch(_PLACES, rows[a + text], first - inner[text] + at, windows, off, gram[:, 0], whole[:, 0], whole[:, 1])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of stretches; columns text and a list of structs (k, c1, c2, n, off, windows, first)."""
    for batch in batches:
        data, bounds = text_buffer(batch.column(0))
        wanted = batch.column(1)
        lists = wanted.offsets.to_numpy()
        of = np.repeat(np.arange(len(wanted)), np.diff(lists))
        fields = wanted.flatten()
        cols = {name: fields.field(i).to_numpy() for i, name in enumerate(("k", "c1", "c2", "n", "off", "windows", "first"))}
        start = bounds[of] + cols["first"]
        size = cols["windows"] + length - 1
        step = max(1, (1 << 21) // length)
        for a in range(0, len(of), step):
            s = slice(a, a + step)
            text = [data[x:x + w].tobytes() for x, w in zip(start[s].tolist(), size[s].tolist(), strict=True)]
            yield _batch(_TEXTS, *[cols[c][s] for c in ("k", "c1", "c2", "n", "off", "windows")], text)


def _grouped(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Byte ranges of repeated windows, per stretch of a group; rows sorted by k."""
    for run in runs(batches, 1):
        out = [[], [], [], []]
        for (_, c1, c2, *_), starts in zip(run, repeated([(r[6], r[5], r[4], r[3]) for r in run], length), strict=True):
            if len(starts):
                s = np.array(starts)
                new = np.flatnonzero(np.diff(s) > length) + 1  # windows further apart leave bytes between them
                lo, hi = s[np.concatenate([[0], new])], s[np.concatenate([new - 1, [-1]])] + length
                for column, v in zip(out, (c1, c2, lo.tolist(), hi.tolist()), strict=True):
                    column.append(v)
        if out[0]:
            yield _batch(_FOUND, *out)


def repeated(texts: list[tuple[bytes, int, int, int]], length: int) -> list[list[int]]:
    """For stretches given as (bytes, number of windows, place of the anchor, weight): the starts of
    windows that occur twice or more, weights counted.

    The suffix array is over symbols of ``STEP`` bytes, counted from the anchor.  A window belongs to the
    first symbol that starts in it; those of equal windows are neighbours that share ``core`` bytes.
    """
    core = (length - STEP + 1) // STEP * STEP
    blocks = [[text[p:p + STEP] for p in range(off % STEP, len(text) - STEP + 1, STEP)] for text, _, off, _ in texts]
    number = {b: n for n, b in enumerate(sorted({b for part in blocks for b in part}), 1)}
    joined: list[int] = []
    owner: list[tuple[int, int]] = []  # of each symbol, its text and place
    for t, part in enumerate(blocks):
        owner += [(t, texts[t][2] % STEP + STEP * z) for z in range(len(part) + 1)]
        joined += [number[b] for b in part]
        joined.append(0)
    found: list[list[int]] = [[] for _ in texts]
    near: list[tuple[int, int]] = []  # symbols that share a core
    last = None
    for i in suffix_array(joined):
        t, p = owner[i]
        text, windows = texts[t][:2]
        if p - STEP >= windows - 1 or len(text) < p + core:
            continue
        if (now := text[p:p + core]) != last:
            _equal_windows(near, texts, length, core, found)
            near, last = [], now
        near.append((t, p))
    _equal_windows(near, texts, length, core, found)
    return [sorted(set(f)) for f in found]


def _equal_windows(near: list[tuple[int, int]], texts: list[tuple[bytes, int, int, int]], length: int, core: int, found: list[list[int]]) -> None:
    """Adds the repeated ones of the windows that belong to symbols sharing a core."""
    alike: dict[tuple[int, bytes], list[tuple[int, int]]] = {}  # symbols all of whose windows are equal
    for t, p in near:
        text, windows = texts[t][:2]
        low = max(0, p - STEP + 1)
        alike.setdefault((p - low, text[low:min(windows, p + 1) - 1 + length]), []).append((t, p))
    lone = []
    for (back, _), of in alike.items():
        if len(of) > 1 or texts[of[0][0]][3] > 1:
            for t, p in of:
                found[t].extend(range(p - back, min(texts[t][1], p + 1)))
        else:
            lone.append(of[0])
    if not lone or len(alike) == 1:
        return
    same: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}  # windows, by what they have beside the core
    for of in alike.values():
        t, p = of[0]
        text, windows = texts[t][:2]
        for j in range(max(0, p - STEP + 1), min(windows, p + 1)):
            same.setdefault((text[j:p], text[p + core:j + length]), []).append((t, j))
    single = {t for t, _ in lone}
    for equal in same.values():
        if len(equal) > 1:
            for t, j in equal:
                if t in single:
                    found[t].append(j)


def _split(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Stretches cut into ranges of ``width`` distances from the anchor; the bytes that a range's windows share are the key."""
    for batch in batches:
        cols = [[] for _ in range(7)]
        cores, wholes = [], []
        for _, c1, c2, n, off, windows, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for r in range((off - windows + 1) // width, off // width + 1):
                j = max(0, off - r * width - width + 1)
                end = min(windows, off - r * width + 1)
                core = off - r * width
                cores.append((text[core:core + length - width + 1], r))
                wholes.append((text[j:end + length - 1], off - j))
                for column, v in zip(cols, (c1, c2, n, j, end - j, off - j), strict=False):
                    column.append(v)
        core, whole = _digests(cores), _digests(wholes)
        yield _batch(_SUBS, core[:, 0], whole[:, 0], whole[:, 1], *cols[:6])


def _repeated_windows(texts: DataFrame, length: int, widths: tuple[int, ...], longest: int) -> DataFrame:
    """(c1, c2, lo, hi) for the stretches ``texts`` that have repeated windows.  ``texts`` is a written table."""
    sizes = texts.groupBy("k").agg(F.count("*").alias("m")).where(F.col("m") > longest)
    hot = written(sizes.select("k"), "suffix-hot")
    cold = texts if hot.isEmpty() else texts.join(hot, "k", "left_anti").select(*texts.columns)
    found = cold.repartition("k").sortWithinPartitions("k").mapInArrow(lambda it: _grouped(it, length), _FOUND)
    if hot.isEmpty():
        return found
    held = written(texts.join(hot, "k", "left_semi").select(*texts.columns), "suffix-held")
    width = widths[0]
    subs = written(held.mapInArrow(lambda it: _split(it, length, width), _SUBS), "suffix-subs")
    merged = subs.groupBy("k", "d1", "d2").agg(F.sum("n").alias("n"), F.min(F.struct("c1", "c2", "skip", "windows", "off")).alias("one"))
    if width == 1:  # a range is a window
        again = merged.where("n > 1").select("d1", "d2", F.array(F.lit(0)).alias("lo"), F.array(F.lit(length)).alias("hi"))
    else:
        merged = written(merged, "suffix-merged")
        twice = merged.groupBy("k").agg(F.sum("n").alias("total")).where("total > 1").select("k")
        wanted = merged.join(twice, "k", "left_semi").select("k", "d1", "d2", "n", "one.*")
        finer = wanted.join(held.select("c1", "c2", F.col("text").alias("whole")), ["c1", "c2"]).select(
            "k", F.col("d1").alias("c1"), F.col("d2").alias("c2"), "n", "off", "windows",
            F.expr(f"substring(whole, skip + 1, windows + {length - 1})").alias("text"))
        again = _repeated_windows(written(finer, "suffix-finer"), length, widths[1:], longest).withColumnsRenamed({"c1": "d1", "c2": "d2"})
    moved = [F.transform(c, lambda x: x + F.col("skip")).alias(c) for c in ("lo", "hi")]
    return found.unionAll(subs.join(again, ["d1", "d2"]).select("c1", "c2", *moved))


def spans(rows: DataFrame, length: int = LENGTH, longest: int = LIST) -> DataFrame:
    """Per row number with anything to remove: ``cuts``, byte ranges (lo, hi) of repeated windows in the order of places.

    ``rows`` has the row number and ``text``; ranges may touch or overlap.
    """
    if length < GRAM:
        raise ValueError(f"strings of {GRAM} bytes or more")
    ship(rows.sparkSession)
    two = rows.select(F.col(ROW).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long_ = two.where(F.octet_length("text") >= length)
    places = written(long_.mapInArrow(lambda it: _places(it, length), _PLACES), "suffix-places")
    twice = places.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    kept = written(places.join(twice, "k", "left_semi"), "suffix-kept")
    one = F.min(F.struct("row", "first", "windows", "off")).alias("one")
    distinct = kept.groupBy("k", "c1", "c2").agg(F.count("*").alias("n"), one)
    wanted = F.collect_list(F.struct("k", "c1", "c2", "n", "one.off", "one.windows", "one.first")).alias("wanted")
    texts = long_.join(distinct.groupBy(F.col("one.row").alias("row")).agg(wanted), "row").select("text", "wanted")
    texts = written(texts.mapInArrow(lambda it: _cut(it, length), _TEXTS), "suffix-texts")
    found = written(_repeated_windows(texts, length, (RANGE, 1), longest), "suffix-found")
    whole = found.groupBy("c1", "c2").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))
    ranges = F.arrays_zip(*[F.transform(c, lambda x: x + F.col("first")).alias(c) for c in ("lo", "hi")])
    cuts = kept.join(whole, ["c1", "c2"]).select("row", ranges.alias("cuts"))
    return cuts.groupBy(F.col("row").alias(ROW)).agg(F.sort_array(F.flatten(F.collect_list("cuts"))).alias("cuts"))


_KEPT = "doc_id long, n_bytes long, spans array<struct<lo:long,hi:long>>, kept binary"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    for batch in batches:
        data, bounds = text_buffer(batch.column(1))
        out, kept = [], []
        for i, cuts in enumerate(batch.column(2)):
            text, merged = data[bounds[i]:bounds[i + 1]].tobytes(), []
            if cuts.is_valid:
                lo, hi = (cuts.values.field(f).to_numpy().astype(np.int64) for f in (0, 1))
                high = np.maximum.accumulate(hi)
                new = np.concatenate([[True], lo[1:] > high[:-1]])
                merged = list(zip(lo[new].tolist(), high[np.append(np.flatnonzero(new)[1:] - 1, -1)].tolist(), strict=True))
            parts, at = [], 0
            for a, b in merged:
                parts.append(text[at:a])
                at = b
            kept.append(b"".join([*parts, text[at:]]))
            out.append([{"lo": a, "hi": b} for a, b in merged])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(out, kind), pa.array(kept, pa.binary())],
                                         ["doc_id", "n_bytes", "spans", "kept"])


def removed(docs: DataFrame, length: int = LENGTH, longest: int = LIST) -> DataFrame:
    """Per text: ``n_bytes``, the maximal removed ``spans`` (byte ranges, end exclusive) and the ``kept`` bytes."""
    rows = with_row(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")))
    both = rows.join(spans(rows, length, longest), ROW, "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "cuts")
    return both.mapInArrow(_removed, _KEPT)


def digests(docs: DataFrame, length: int = LENGTH, longest: int = LIST) -> DataFrame:
    """:func:`removed` as counts and the SHA-256 of the kept bytes."""
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"])
    return removed(docs, length, longest).select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                                                 F.sha2("kept", 256).alias("kept_sha256"))
