"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the merged piece (ties:
leftmost first).  The best pair is merged, pairs that it invalidates are skipped when they come up,
and pairs with the new neighbours join the agenda.  Symbols that are no piece fall back to bytes.
Decoding joins pieces, turns byte runs into text and drops the dummy prefix.

The text is processed by segments (a run of spaces and what follows): no piece of the vocabulary
has a space mark after another character, so no merge crosses a segment's start.  A worker keeps
the segments it has met.  Every segment that is new to a worker is checked against the
sentencepiece library, in blocks of an Arrow batch, as is one whole text per block; a difference
fails the task.

Defined cases: null and empty texts have no ids and decode to the empty text.  Rows are encoded
one by one, so repeated, tied or null ``doc_id`` values do not matter.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship
from .wordcache import SegmentCache, blocks, key_of, plain_keys

MARK = "▁"
#: Bytes of segments kept per worker (words take about 400 each, segments without spaces much more).
CACHE = 200_000_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Up to so many characters a plain list serves as the agenda.
SHORT = 24

_NEVER = float("inf")
_SEGMENT = re.compile(r" *[^ \n]+| +|\n")
_codecs: dict[str, Codec] = {}  # one per worker and model file


class Codec:
    """Encoder and decoder of one BPE model file (identity normaliser, dummy prefix, byte fallback)."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.cost = {self.pieces[i]: -lib.get_score(i) for i in plain}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = {i: b for b, i in enumerate(self.byte_ids)}
        if any(lib.is_unknown(i) for i in self.byte_ids):
            raise ValueError("the model has no byte fallback")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a space mark after another character")
        if any("\n" in p for p in self.ids):
            raise ValueError("a piece holds a line end")
        self.cache = SegmentCache(self._checked, CACHE)

    def merge(self, text: str) -> list[str]:
        """The symbols of ``text`` after all merges, by the agenda."""
        return self._merge_short(text) if len(text) <= SHORT else self._merge_long(text)

    def _merge_short(self, text: str) -> list[str]:
        """A short text's agenda is a list of the costs of its adjacent pairs."""
        symbols, cost = list(text), self.cost.get
        agenda = [cost(a + b, _NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := min(agenda)) < _NEVER:
            i = agenda.index(best)
            merged = symbols[i] + symbols[i + 1]
            symbols[i:i + 2] = [merged]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(merged + symbols[i + 1], _NEVER)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + merged, _NEVER)
        return symbols

    def _merge_long(self, text: str) -> list[str]:
        """A long text's agenda is a heap; pairs that a merge has changed are skipped when they come up."""
        symbols, cost = list(text), self.cost
        n = len(symbols)
        agenda = [(cost[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in cost]
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, merged = heappop(agenda)
            j = after[i]
            # a pair is stale if either symbol has been merged since
            if not (left := symbols[i]) or j >= n or left + symbols[j] != merged:
                continue
            symbols[i], symbols[j] = merged, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := merged + symbols[k]) in cost:
                    heappush(agenda, (cost[p], i, p))
            if (h := before[i]) >= 0 and (p := symbols[h] + merged) in cost:
                heappush(agenda, (cost[p], h, p))
        return [s for s in symbols if s]

    def to_ids(self, segment: str) -> list[int]:
        out: list[int] = []
        for s in self.merge(segment):
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in s.encode())
        return out

    def to_text(self, ids: list[int]) -> str:
        """Text of pieces in the middle of a text (no dummy prefix to drop)."""
        if not any(i in self.bytes for i in ids):
            return "".join(map(self.pieces.__getitem__, ids)).replace(MARK, " ")
        raw = b"".join(bytes([self.bytes[i]]) if i in self.bytes else self.pieces[i].replace(MARK, " ").encode() for i in ids)
        return raw.decode("utf-8", "replace")

    def _checked(self, segments: list[str]) -> list[tuple[str, str]]:
        """Ids and text of segments, after comparing their ids with the library's.

        Segments are compared many at a time, joined by line ends, which are one byte each.
        """
        marked = [s.replace(" ", MARK) for s in segments]
        ours = [self.to_ids(s) for s in marked]
        line_end = self.byte_ids[10]
        for a in range(0, len(segments), 1000):
            expected = [self.ids[MARK]]
            for i in ours[a:a + 1000]:
                expected += [line_end, *i]
            if (theirs := self.lib.encode("\n" + "\n".join(segments[a:a + 1000]))) != expected:
                raise AssertionError(f"the library encodes segments from {segments[a]!r} on differently: {theirs[:50]}")
        return [(",".join(map(str, a)), self.to_text(a)) for a in ours]

    def keys(self, text: str) -> list[str]:
        text = text.replace(MARK, " ")
        if (keys := plain_keys(text)) is None:
            return [key_of(s) for s in _SEGMENT.findall(" " + text)]
        return keys

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids, as decimals joined by commas, and the text they decode to."""
        for a, b in blocks(texts):
            part = texts[a:b]
            rows = [self.keys(t) if t else [] for t in part]
            for n, (t, values) in enumerate(zip(part, self.cache.lookup(rows), strict=True)):
                ids = ",".join([v[0] for v in values])
                decoded = "".join([v[1] for v in values])[1:]
                if n == 0:
                    theirs = self.lib.encode(t)
                    if ids != ",".join(map(str, theirs)) or decoded != self.lib.decode(theirs):
                        raise AssertionError(f"the library encodes or decodes {t[:200]!r} differently")
                yield ids, decoded


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    for batch in batches:
        n, ids_sha, text_sha = [], [], []
        for ids, decoded in _codecs[path].encode([t or "" for t in batch.column(1).to_pylist()]):
            n.append(ids.count(",") + 1 if ids else 0)
            ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
            text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                         ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    for batch in batches:
        out = list(_codecs[path].encode([t or "" for t in batch.column(1).to_pylist()]))
        ids = [[int(x) for x in i.split(",")] if i else [] for i, _ in out]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([d for _, d in out], pa.string())],
                                         ["doc_id", "ids", "decoded"])


def _two(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every whole text; ``model`` is a path that every executor has."""
    return _two(docs).mapInArrow(lambda it: _texts(it, model), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """As :func:`encode`, with the number of ids and SHA-256 digests instead of ids and text."""
    return _two(docs).mapInArrow(lambda it: _encode(it, model), SCHEMA)
