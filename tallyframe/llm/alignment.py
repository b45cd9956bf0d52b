"""Alignment of two tokenisers' tokens: a byte-level one (A) and a piece one (B).

Both are taken as byte strings over a space and the text.  Where a token of A and a token of B end at
the same offset a group ends; tokens of one group are linked, each of A with each of B.

A range of bytes is summed up by a *fragment*: the tokens that end in it up to its first common end
(the open prefix, which closes a group begun before), its closed groups, and the tokens after its last
common end (the open suffix).  Fragments of neighbouring ranges compose (:meth:`Fragment.then`);
composition is associative and has a neutral element, so any tree over the ranges of a text gives the
same result.  A text over ``LONG`` bytes is cut into ranges of that size, anywhere, also inside tokens
and groups; the ranges go to different tasks with the bytes of the segments that they cut through, and are
reduced ``FAN`` at a time, in rounds of shuffles, until one fragment is left.

Tokens are made by the libraries, for the distinct segments (see :mod:`segments`) that a worker has not
met lately; one whole text per block is checked against the libraries.

A pair of ids counts once per document that links it.  Counts and each A id's highest one are
aggregated over all documents; see :func:`scored`.

Defined cases: texts that are null, empty, or whose joined token bytes are not the space and the text
(for example with U+2581) have no tokens and no groups.  Special tokens' strings are ordinary text.  Rows
are documents of their own, whatever their ``doc_id``.  An empty table gives no rows.  Other columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytelevel import ByteLevel, ids_of
from .common import ROW, few, runs, ship, with_row, written
from .segments import Segmented, blocks_of, cuts, gathered, text_buffer

MARK = "▁"
#: Texts of more bytes than this are cut into ranges.
LONG = 1 << 16
#: Fragments that are composed in one task of a round.
FAN = 16
#: Bytes of texts that are cut into segments at a time.
BLOCK = 1 << 21
#: Bytes of segments, with what is known of them, that a worker keeps from block to block.
WORDS = 100_000_000
#: A pair of ids in one number.
SHIFT = 20

_lexicons: dict[tuple[str, str], Lexicon] = {}  # one per worker and files


class Tokenizers:
    """The two libraries, and the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a = ByteLevel(a, special_is_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if max(len(self.a.bytes), len(pieces)) >= 1 << SHIFT:
            raise ValueError("vocabularies of more ids than a pair can hold")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)
        self.mark = self.b.piece_to_id(MARK)

    def _b_whole(self, text: str) -> list[int]:
        """Ids of a text that starts with a space, which the library adds itself, or with a line end, which has none before it."""
        ids = self.b.encode(text[1:] if text[0] == " " else text)
        return ids[1:] if text[0] != " " and ids[0] == self.mark else ids

    def ids(self, segments: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids of segments that start with a space or a line end, by A and by B, each end to end with offsets."""
        return self.a.ids(segments), ids_of(segments, self._b_whole, lambda each: [self._b_whole(s.decode()) for s in each], self.b_size)


@dataclass
class Fragment:
    """What a range of a text says: ``a`` and ``b`` up to its first common end, closed groups, ``a2`` and ``b2`` after the last.

    Without a common end all tokens are in ``a`` and ``b``.
    """

    ok: bool = True
    ended: bool = False
    a: list[int] = field(default_factory=list)
    b: list[int] = field(default_factory=list)
    a2: list[int] = field(default_factory=list)
    b2: list[int] = field(default_factory=list)
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    groups: list[str] = field(default_factory=list)  # runs of closed groups as text
    pairs: Counter[int] = field(default_factory=Counter)

    def close(self, a: list[int], b: list[int]) -> None:
        """Add a closed group at the end."""
        self.n_a += len(a)
        self.n_b += len(b)
        self.n_groups += 1
        self.n_links += len(a) * len(b)
        self.groups.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
        many_a, many_b = Counter(a), Counter(b)
        for x, n in many_a.items():
            for y, m in many_b.items():
                self.pairs[x << SHIFT | y] += n * m

    def add(self, other: Fragment) -> None:
        """Add the closed groups of ``other`` at the end."""
        self.n_a += other.n_a
        self.n_b += other.n_b
        self.n_groups += other.n_groups
        self.n_links += other.n_links
        self.groups += other.groups
        self.pairs.update(other.pairs)

    def then(self, other: Fragment) -> Fragment:
        """The fragment of this range and the one after it."""
        out = Fragment(self.ok and other.ok, self.ended or other.ended)
        if not self.ended:
            out.a, out.b = self.a + other.a, self.b + other.b
            out.a2, out.b2 = other.a2, other.b2
            out.add(other)
            return out
        out.a, out.b = self.a, self.b
        out.add(self)
        if not other.ended:
            out.a2, out.b2 = self.a2 + other.a, self.b2 + other.b
            return out
        out.close(self.a2 + other.a, self.b2 + other.b)
        out.add(other)
        out.a2, out.b2 = other.a2, other.b2
        return out

    def whole(self) -> Fragment:
        """The fragment of a whole text, whose open prefix is its first group."""
        out = Fragment(self.ok and self.ended and not (self.a2 or self.b2))
        if out.ok:
            out.close(self.a, self.b)
            out.add(self)
        return out


def composed(fragments: Iterable[Fragment]) -> Fragment:
    out = Fragment()
    for f in fragments:
        out = out.then(f)
    return out


@dataclass
class _Aligned:
    """Tokens of segments end to end, with the common ends: arrays over tokens, groups and segments."""

    segments: list[bytes]
    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    common: np.ndarray  # offsets where groups end
    ends: np.ndarray  # offsets where segments end
    ok: np.ndarray  # per segment

    @classmethod
    def of(cls, tok: Tokenizers, segments: list[bytes]) -> _Aligned:
        (a, first_a), (b, first_b) = tok.ids(segments)
        ok = np.ones(len(segments), bool)
        if not (_spell(tok.a.bytes, a) == _spell(tok.b_bytes, b) == b"".join(segments)):
            for n, s in enumerate(segments):
                ok[n] = _spell(tok.a.bytes, a[first_a[n]:first_a[n + 1]]) == _spell(tok.b_bytes, b[first_b[n]:first_b[n + 1]]) == s
            a, b = a[np.repeat(ok, np.diff(first_a))], b[np.repeat(ok, np.diff(first_b))]
        a_end, b_end = np.cumsum(tok.a.size[a]), np.cumsum(tok.b_size[b])
        size = np.fromiter(map(len, segments), np.int64, len(segments)) * ok
        common = a_end[b_end[np.minimum(np.searchsorted(b_end, a_end), max(0, len(b_end) - 1))] == a_end] if len(b_end) else a_end[:0]
        return cls(segments, a, b, a_end, b_end, common, np.cumsum(size), ok)


def _spell(tokens: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def _text(ids_a: np.ndarray, ids_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, n: int) -> list[str]:
    """Groups 0 to n - 1 as text; ``of_a`` and ``of_b`` are the rising group numbers of the tokens."""
    a, b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
    x, y = (np.searchsorted(of, np.arange(n + 1)).tolist() for of in (of_a, of_b))
    return [(a[x[g]] if x[g + 1] == x[g] + 1 else ",".join(a[x[g]:x[g + 1]])) + "|"
            + (b[y[g]] if y[g + 1] == y[g] + 1 else ",".join(b[y[g]:y[g + 1]])) for g in range(n)]


def _links(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ids of each group as (group, pair, number of links).

    Ids are counted per group before they are paired, so a group costs its distinct ids of A times those of B."""
    out = []
    for ids, of in ((a, of_a), (b, of_b)):
        key, count = np.unique(of << SHIFT | ids, return_counts=True)
        out.append((key & (1 << SHIFT) - 1, count, np.searchsorted(key >> SHIFT, np.arange(n + 1))))
    (ids_a, many_a, first_a), (ids_b, many_b, first_b) = out
    group = np.repeat(np.arange(n), np.diff(first_a))
    y, at = gathered(np.arange(len(ids_b)), first_b, group)
    x = np.repeat(np.arange(len(ids_a)), np.diff(at))
    return group[x], ids_a[x] << SHIFT | ids_b[y], many_a[x] * many_b[y]


_DONE = "row long, ok boolean, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, links array<long>"
_RANGES = "row long, part long, low long, high long, bytes binary"
_OPEN = ("row long, part long, ok boolean, ended boolean, a array<int>, b array<int>, a2 array<int>, b2 array<int>, "
         "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, links array<long>")
_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
          "array<long>": pa.list_(pa.int64())}


def _batch(names: str, cols: Iterable) -> pa.RecordBatch:
    fields = [f.split() for f in names.split(", ")]
    made = [c if isinstance(c, pa.Array) else pa.array(c, _KINDS[k]) for c, (_, k) in zip(cols, fields, strict=True)]
    return pa.RecordBatch.from_arrays(made, [n for n, _ in fields])


class Lexicon:
    """Segments that a worker has met, aligned: counts, groups as text and pairs of each, by number.

    It is emptied after a block that makes it larger than ``WORDS`` bytes, so memory is bounded whatever the segments.
    """

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.text: list[str] = []
        self.ok = np.empty(0, bool)
        self.per = np.empty((4, 0), np.int64)  # tokens of A and of B, groups, links
        self.first = np.zeros(1, np.int64)
        self.pair, self.many = np.empty(0, np.int64), np.empty(0, np.int64)
        self.size = 0

    def numbers(self, segments: list[bytes]) -> np.ndarray:
        new = [s for s in segments if s not in self.number]
        if new:
            self._add(new)
        return np.fromiter(map(self.number.__getitem__, segments), np.int64, len(segments))

    def _add(self, new: list[bytes]) -> None:
        found = _Aligned.of(self.tok, new)
        n = len(found.common)
        of_a, of_b = np.searchsorted(found.common, found.a_end), np.searchsorted(found.common, found.b_end)
        # groups never reach over a segment's end
        groups = np.searchsorted(found.common, np.concatenate([[0], found.ends]), "right")
        text = _text(found.a, found.b, of_a, of_b, n)
        group, pair, many = _links(found.a, found.b, of_a, of_b, n)
        first = np.searchsorted(group, groups)
        per = [*(np.diff(np.searchsorted(of, groups)) for of in (of_a, of_b)), np.diff(groups), np.diff(np.concatenate([[0], np.cumsum(many)])[first])]
        self.number.update(zip(new, range(len(self.text), len(self.text) + len(new)), strict=True))
        self.text += [";".join(text[x:y]) for x, y in zip(groups.tolist(), groups[1:].tolist(), strict=False)]
        self.ok = np.append(self.ok, found.ok)
        self.per = np.concatenate([self.per, per], axis=1)
        self.first = np.append(self.first, self.first[-1] + first[1:])
        self.pair, self.many = np.append(self.pair, pair), np.append(self.many, many)
        self.size += sum(map(len, new)) + sum(map(len, self.text[-len(new):])) + 16 * len(pair) + 250 * len(new)


def _lexicon(paths: tuple[str, str]) -> Lexicon:
    if paths not in _lexicons:
        _lexicons[paths] = Lexicon(Tokenizers(*paths))
    return _lexicons[paths]


def _short(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Whole texts (with a space in front), all segments of a block at once."""
    words = _lexicon(paths)
    for batch in batches:
        data, bounds = text_buffer(batch.column(1))
        for first, last in blocks_of(bounds, BLOCK):
            texts, n = Segmented(data[bounds[first]:bounds[last]], bounds[first:last + 1]), last - first
            codes = words.numbers(texts.distinct)[texts.codes]
            doc = np.repeat(np.arange(n), np.diff(texts.first))
            bad = (np.bincount(doc, ~words.ok[codes], n) > 0) | (np.diff(texts.first) == 0)
            sums = [np.bincount(doc, x[codes], n).astype(np.int64) * ~bad for x in words.per]
            # distinct segments of a text, then its distinct pairs
            key, times = np.unique(doc * len(words.text) + codes, return_counts=True)
            d, code = key // len(words.text), key % len(words.text)
            index, at = gathered(np.arange(len(words.pair)), words.first, code)
            key = np.repeat(d, np.diff(at)) << 2 * SHIFT | words.pair[index]
            many = np.repeat(times, np.diff(at)) * words.many[index]
            use = ~bad[key >> 2 * SHIFT]
            key, many = key[use], many[use]
            order = np.argsort(key)
            key, many = key[order], many[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            many = np.add.reduceat(many, start) if len(start) else many
            key = key[start]
            lists = pa.array(np.searchsorted(key >> 2 * SHIFT, np.arange(n + 1)), pa.int32())
            flat_codes, at = codes.tolist(), texts.first.tolist()
            strings = [None if bad[i] else ";".join(map(words.text.__getitem__, flat_codes[at[i]:at[i + 1]])) for i in range(n)]
            if not bad[0]:
                _check(words.tok, data[bounds[first]:bounds[first + 1]].tobytes(), strings[0])
            yield _batch(_DONE, [batch.column(0).slice(first, n), ~bad, *sums, strings,
                                 pa.ListArray.from_arrays(lists, pa.array(key & (1 << 2 * SHIFT) - 1, pa.int64())),
                                 pa.ListArray.from_arrays(lists, pa.array(many, pa.int64()))])
            if words.size > WORDS:
                words.clear()


def _check(tok: Tokenizers, text: bytes, groups: str) -> None:
    """Compare the tokens of a text that is shown as ``groups`` with the libraries' for the whole text."""
    whole = text.decode()
    halves = [g.split("|") for g in groups.split(";")]
    for side, ids in ((0, tok.a.whole(whole)), (1, tok.b.encode(whole[1:]))):
        if ",".join(h[side] for h in halves) != ",".join(map(str, ids)):
            raise AssertionError(f"the libraries split {whole[:200]!r} differently")


def _ranges(batches: Iterator[pa.RecordBatch], long: int) -> Iterator[pa.RecordBatch]:
    """Ranges of ``long`` bytes of each text, with the bytes of the segments that they cut through.

    A range's end that falls in a segment longer than a range is moved to the end of that segment.
    """
    for batch in batches:
        data, bounds = text_buffer(batch.column(1))
        for i, row in enumerate(batch.column(0).to_pylist()):
            text = data[bounds[i]:bounds[i + 1]]
            starts = np.concatenate([[0], cuts(text), [len(text)]])
            ends = np.arange(long, len(text) + long, long).clip(max=len(text))
            after = np.searchsorted(starts, ends, "left")
            far = starts[after] - starts[np.maximum(after - 1, 0)] > long
            ends = np.unique(np.where(far, starts[after], ends))
            low = np.concatenate([[0], ends[:-1]])
            left, right = starts[np.searchsorted(starts, low, "right") - 1], starts[np.searchsorted(starts, ends, "left")]
            for p, (x, y, a, b) in enumerate(zip(low.tolist(), ends.tolist(), left.tolist(), right.tolist(), strict=True)):
                yield _batch(_RANGES, [[row], [p], [x - a], [y - a], [text[a:b].tobytes()]])


def fragment(tok: Tokenizers, raw: bytes, low: int, high: int) -> Fragment:
    """The fragment of the bytes low to high of ``raw``, which starts and ends with segments."""
    data = np.frombuffer(raw, np.uint8)
    texts = Segmented(data, np.array([0, len(data)]))
    found = _Aligned.of(tok, [texts.distinct[c] for c in texts.codes.tolist()])
    out = Fragment(bool(found.ok.all()))
    if not out.ok:
        return out
    a, b = (slice(*np.searchsorted(e, [low, high], "right")) for e in (found.a_end, found.b_end))
    common = found.common[slice(*np.searchsorted(found.common, [low, high], "right"))]
    of_a, of_b = np.searchsorted(common, found.a_end[a]), np.searchsorted(common, found.b_end[b])
    a, b, n = found.a[a], found.b[b], len(common)
    out.ended = n > 0
    out.a, out.b = a[of_a == 0].tolist(), b[of_b == 0].tolist()
    if n:
        out.a2, out.b2 = a[of_a == n].tolist(), b[of_b == n].tolist()
        in_a, in_b = (of_a > 0) & (of_a < n), (of_b > 0) & (of_b < n)
        a, b, of_a, of_b = a[in_a], b[in_b], of_a[in_a] - 1, of_b[in_b] - 1
        out.n_a, out.n_b, out.n_groups = len(a), len(b), n - 1
        _, pair, many = _links(a, b, of_a, of_b, n - 1)
        out.n_links = int(many.sum())
        key, at = np.unique(pair, return_inverse=True)
        out.pairs = Counter(dict(zip(key.tolist(), np.bincount(at, many).astype(np.int64).tolist(), strict=True)))
        if n > 1:
            out.groups = [";".join(_text(a, b, of_a, of_b, n - 1))]
    return out


def _row(row: int, part: int, f: Fragment) -> tuple:
    return (row, part, f.ok, f.ended, f.a, f.b, f.a2, f.b2, f.n_a, f.n_b, f.n_groups, f.n_links, ";".join(f.groups), list(f.pairs), list(f.pairs.values()))


def _fragment_of(r: tuple) -> Fragment:
    return Fragment(*r[2:12], [r[12]] if r[12] else [], Counter(dict(zip(r[13], r[14], strict=True))))


def _fragments(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    tok = _lexicon(paths).tok
    for batch in batches:
        for row, part, low, high, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            yield _batch(_OPEN, [[x] for x in _row(row, part, fragment(tok, raw, low, high))])


def _reduced(batches: Iterator[pa.RecordBatch], fan: int) -> Iterator[pa.RecordBatch]:
    """One fragment for ``fan`` neighbouring ones; rows sorted by text and part."""
    numbered = (_with_group(b, fan) for b in batches)
    for run in runs(numbered, 2):
        yield _batch(_OPEN, [[x] for x in _row(run[0][0], run[0][1], composed(_fragment_of((r[0], *r[2:])) for r in run))])


def _with_group(batch: pa.RecordBatch, fan: int) -> pa.RecordBatch:
    group = pa.array(batch.column(1).to_numpy() // fan, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0), group, *batch.columns[1:]], ["row", "group", *batch.schema.names[1:]])


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            f = _fragment_of(r).whole()
            yield _batch(_DONE, [[r[0]], [f.ok], [f.n_a], [f.n_b], [f.n_groups], [f.n_links], [";".join(f.groups) if f.ok else None],
                                 [sorted(f.pairs)], [[f.pairs[p] for p in sorted(f.pairs)]]])


def aligned(rows: DataFrame, a: str, b: str, long: int = LONG, fan: int = FAN) -> DataFrame:
    """Per row number (column ``row``): ``ok``, counts of tokens, groups and links, ``groups`` as text (null without
    tokens), and the distinct ``pairs`` of ids (A id << SHIFT | B id) with their ``links``."""
    ship(rows.sparkSession)
    two = rows.select(F.col(ROW).alias("row"), F.concat(F.lit(" "), F.col("text").cast("string")).alias("text"))
    paths = (a, b)
    size = F.octet_length("text")
    short = two.where((size > 1) & (size <= long)).mapInArrow(lambda it: _short(it, paths), _DONE)
    ranges = two.where(size > long).mapInArrow(lambda it: _ranges(it, long), _RANGES)
    # ranges of one text go to different tasks
    parts = written(ranges.repartition("row", "part").mapInArrow(lambda it: _fragments(it, paths), _OPEN), "align-parts")
    last = parts.agg(F.max("part")).first()[0] or 0
    while last:
        ordered = parts.repartition(F.col("row"), F.floor(F.col("part") / fan)).sortWithinPartitions("row", "part")
        parts = written(ordered.mapInArrow(lambda it: _reduced(it, fan), _OPEN), "align-parts")
        last //= fan
    return short.unionAll(parts.mapInArrow(_wholes, _DONE))


def scored(rows: DataFrame, a: str, b: str, long: int = LONG, fan: int = FAN) -> DataFrame:
    """:func:`aligned` without pairs, with ``groups_sha256`` ('' without tokens), ``n_best`` and ``count_sum``.

    A pair's count is the number of documents that link it.  ``n_best`` are the links whose pair has the highest
    count of its A id, ``count_sum`` sums the counts over all links.  Pairs are counted map-side first; a
    frequent pair is a hot key of the joins' larger side only.
    """
    found = aligned(rows, a, b, long, fan)
    found = written(found.select("*", F.sha2("groups", 256).alias("groups_sha256")).drop("groups"), "align-rows")
    links = found.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("n"))
    counts = written(links.groupBy("pair").agg(F.count("*").alias("count")), "align-counts")
    id_a = F.shiftright("pair", SHIFT)
    best = counts.groupBy(id_a.alias("id_a")).agg(F.max("count").alias("best"))
    judged = written(counts.join(best, id_a == F.col("id_a")).select("pair", "count", (F.col("count") == F.col("best")).alias("is_best")), "align-judged")
    sums = links.join(few(judged), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    return found.join(sums, "row", "left").select(
        F.col("row").alias(ROW), "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def report(docs: DataFrame, a: str, b: str, long: int = LONG, fan: int = FAN) -> DataFrame:
    """One row per document, texts without tokens included; see :func:`scored`."""
    rows = with_row(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")))
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return rows.select(ROW, "doc_id").join(scored(rows, a, b, long, fan), ROW, "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
