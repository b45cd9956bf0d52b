"""Texts as dictionary-encoded segments: the unit in which tokenisers see a corpus.

A segment starts at a text's start or at a single space or line end between two characters that are
no white space.  Neither a byte-level pre-tokeniser nor a piece vocabulary without inner space marks
joins anything across such a start, so ids of a text are those of its segments.  A block of
an Arrow batch is cut into segments in arrays and only its distinct ones are handed on, so nothing is
kept from batch to batch and memory is bounded by the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# Kinds of bytes: printable ASCII; first bytes of the two-byte characters from U+00C0 on, none of which
# is white space; following bytes.  All others make a cut beside them unsafe, which only costs repeats.
_GRAPH, _LEAD, _NEXT = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _GRAPH
_KIND[0xC3:0xE0] = _LEAD
_KIND[0x80:0xC0] = _NEXT


def cuts(data: np.ndarray) -> np.ndarray:
    """Offsets in ``data`` (bytes) where a segment may start inside a text."""
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at + 1 < len(data))]
    before, after = _KIND[data[at - 1]], _KIND[data[at + 1]]
    wide = (before == _NEXT) & (at > 1) & (_KIND[data[at - 2]] == _LEAD)
    return at[((before == _GRAPH) | wide) & ((after == _GRAPH) | (after == _LEAD))]


def word_ends(data: np.ndarray) -> np.ndarray:
    """Offsets in ``data`` where a word (of ASCII letters and digits) ends and a mark other than an apostrophe follows.

    A byte-level pre-tokeniser ends a token there, a piece vocabulary need not.
    """
    return np.flatnonzero(_WORD[data[:-1]] & _POINT[data[1:]]) + 1


_WORD = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])
_POINT = np.array([0x20 < b < 0x7F and not _WORD[b] and b != 0x27 for b in range(256)])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and the offsets of its texts in them."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def blocks_of(bounds: np.ndarray, most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together (one text at least)."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1))
        yield first, last
        first = last


class Segmented:
    """Texts, given by ``data`` and ``bounds``, as numbers of ``distinct`` segments.

    ``codes[first[i]:first[i + 1]]`` are the segments of text i.  ``fine``: segments end at :func:`word_ends` too.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, fine: bool = False):
        bounds = bounds - bounds[0]
        start = np.zeros(len(data) + 1, bool)
        start[cuts(data)] = True
        if fine:
            start[word_ends(data)] = True
        start[bounds] = True
        at = np.flatnonzero(start)
        starts = at[:-1]
        array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
        encoded = array.dictionary_encode()
        self.distinct: list[bytes] = encoded.dictionary.to_pylist()
        self.codes = encoded.indices.to_numpy(zero_copy_only=False)
        self.first = np.searchsorted(starts, bounds, "left")


def gathered(values: np.ndarray, first: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``values[first[c]:first[c + 1]]`` for each c of ``codes`` end to end, and the offsets of the lists."""
    size = np.diff(first)[codes]
    at = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(at[-1]) + np.repeat(first[:-1][codes] - at[:-1], size)
    return values[index], at


class SegmentIds:
    """Ids of the segments that a worker has met: those of segment n are ``values[first[n]:first[n + 1]]``.

    Emptied by :meth:`trim` when it holds more than ``most`` bytes, whatever the segments' lengths.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.values, self.first, self.size = np.empty(0, np.uint32), np.zeros(1, np.int64), 0

    def of(self, texts: Segmented) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of the texts in them."""
        if new := [s for s in texts.distinct if s not in self.number]:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            values, first = self.encode(new)
            self.values, self.first = np.append(self.values, values.astype(np.uint32)), np.append(self.first, self.first[-1] + first[1:])
            self.size += sum(map(len, new)) + 4 * len(values) + 200 * len(new)
        codes = np.fromiter(map(self.number.__getitem__, texts.distinct), np.int64, len(texts.distinct))[texts.codes]
        ids, at = gathered(self.values, self.first, codes)
        return ids, at[texts.first]

    def trim(self) -> None:
        if self.size > self.most:
            self.clear()
