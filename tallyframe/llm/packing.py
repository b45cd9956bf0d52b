"""Hierarchical multi-length packing.

Documents are tokenised and routed to context-size tiers (256, 512, 1024, 2048 tokens): full
2048-token windows are cut off first, the rest goes to the smallest tier that holds it.  Each tier
is packed from the longest down; the gap that a long piece leaves in its window is filled with the
best-fitting pieces of shorter tiers, and the last piece of a window is cut to end it exactly.  So
every window is full, whatever its tier.  Windows of one tier are dealt to steps of an equal number
of tokens (``step_tokens``), so that steps cost the same.

Packing needs no shuffle: each task packs the documents of its own input split, and only the pieces
at the very end of a task (under 256 tokens in all) become windows of smaller powers of two.
``sequence_id`` carries the partition in its upper bits, so ids are unique and a recomputed task
gives the same rows.

Defined cases: a null or empty text has one token, the end id.  Null, repeated and tied ``doc_id``
values are packed row by row.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bytelevel import ByteLevel
from .common import ship
from .segments import SegmentIds, Segmented, blocks_of, text_buffer

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Bytes of segments and their ids that a worker keeps.
KEPT = 100_000_000
#: Bytes of texts that are cut into segments at a time.
BLOCK = 1 << 22
#: Short pieces a task holds before it packs them.
BUFFER = 4096

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier int, step_id long")

_encoders: dict[str, _Encoder] = {}  # one per worker and vocabulary file


class _Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, from those of their segments.

    One whole text per block is compared with the library's ids.
    """

    def __init__(self, path: str):
        self.tok = ByteLevel(path, special_is_text=False)
        self.known = SegmentIds(self.tok.ids, KEPT)

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        data, bounds = text_buffer(column)
        for a, b in blocks_of(bounds, BLOCK):
            part = data[bounds[a]:bounds[b]]
            plain = not any(t in part.tobytes() for t in self.tok.added)
            ids, at = self.known.of(Segmented(part, bounds[a:b + 1], fine=plain))
            raw, at = ids.astype("<u4").tobytes(), (4 * at).tolist()
            whole = data[bounds[a]:bounds[a + 1]].tobytes().decode()
            if raw[:at[1]] != np.array(self.tok.whole(whole), "<u4").tobytes():
                raise AssertionError(f"the library splits {whole[:200]!r} differently")
            for x, y in zip(at, at[1:], strict=False):
                yield raw[x:y]
            self.known.trim()


class _Packer:
    """Packs the pieces of one task; ``out`` holds finished rows."""

    def __init__(self, partition: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.next_id = partition << 33
        self.next_step, self.steps = partition << 33, {}
        self.out: list[tuple] = []
        self.pool: list[tuple] = []  # (length, arrival, doc_id, start, doc_tokens, ids)
        self.arrivals = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, most = len(ids) // 4, self.tiers[-1]
        whole = n - n % most
        for at in range(0, whole, most):
            self.window([(most, 0, doc_id, at, n, ids[4 * at:4 * (at + most)])])
        if n > whole:
            self.put(n - whole, doc_id, whole, n, ids[4 * whole:])
        if len(self.pool) >= BUFFER:
            self.pack(last=False)

    def put(self, length: int, *rest) -> None:
        self.arrivals += 1
        bisect.insort(self.pool, (length, self.arrivals, *rest), key=lambda p: p[:2])

    def window(self, pieces: list[tuple]) -> None:
        size, at = sum(p[0] for p in pieces), 0
        used, step = self.steps.get(size, (self.step_tokens, 0))
        if used + size > self.step_tokens:
            used, step = 0, self.next_step
            self.next_step += 1
        self.steps[size] = (used + size, step)
        for length, _, doc_id, start, n, ids in pieces:
            self.out.append((doc_id, start, length, zlib.crc32(ids), n, self.next_id, at, size, step))
            at += length
        self.next_id += 1

    def take(self, most: int) -> tuple:
        """The longest waiting piece of at most ``most`` tokens, or the shortest one cut to ``most``."""
        i = bisect.bisect_right(self.pool, most, key=lambda p: p[0])
        if i:
            return self.pool.pop(i - 1)
        length, arrival, doc_id, start, n, ids = self.pool.pop(0)
        self.put(length - most, doc_id, start + most, n, ids[4 * most:])
        return (most, arrival, doc_id, start, n, ids[:4 * most])

    def pack(self, last: bool) -> None:
        left = sum(p[0] for p in self.pool)
        # while more documents come, short pieces stay to fill the gaps of later windows
        while left >= self.tiers[0] and (last or len(self.pool) > BUFFER // 4):
            longest = self.pool[-1][0]
            size = next(t for t in self.tiers if t >= longest)
            while size > left:  # the end of a task
                size //= 2
            self.fill(size)
            left -= size
        while last and left:  # under the smallest tier: windows of smaller powers of two
            size = 1 << left.bit_length() - 1
            self.fill(size)
            left -= size

    def fill(self, size: int) -> None:
        pieces, gap = [], size
        while gap:
            pieces.append(p := self.take(gap))
            gap -= p[0]
        self.window(pieces)


def _pack(batches: Iterator[pa.RecordBatch], path: str, tiers: tuple[int, ...], step_tokens: int, end_id: int) -> Iterator[pa.RecordBatch]:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    end = end_id.to_bytes(4, "little")
    packer = _Packer(TaskContext.get().partitionId(), tiers, step_tokens)

    def rows() -> pa.RecordBatch:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int32() if n == "tier" else pa.int64() for n in names]
        cols = list(zip(*packer.out, strict=True)) or [()] * len(names)
        packer.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), _encoders[path].encode(batch.column(1)), strict=True):
            packer.add(doc_id, ids + end)
            if len(packer.out) >= 20_000:
                yield rows()
    packer.pack(last=True)
    yield rows()


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = 16 * 2048, end_id: int = END_ID) -> DataFrame:
    """One row per piece: document, token range, checksum of its ids, sequence, offset, tier, step.

    ``tokenizer`` is the path of a byte-level ``tokenizers`` file that every executor has.
    """
    if any(t & t - 1 for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers are rising powers of two")
    ship(docs.sparkSession)
    two = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return two.mapInArrow(lambda it: _pack(it, tokenizer, tiers, step_tokens, end_id), SCHEMA)
