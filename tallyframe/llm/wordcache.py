"""A per-worker cache from text segments to encoded values.

Tokenisers work segment by segment (a run of white space and the word after it), and most segments
of a corpus are repeats.  A Python worker lives through many tasks, so the cache is kept on the
module.  ``capacity`` bounds its memory only, in bytes of keys and values: segments beyond it are
encoded again when met.

Segments are held as short keys: ``word`` stands for a space and the word, ``\\nword`` for itself,
and ``\\r`` followed by anything for that text as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from sys import getsizeof

#: White space other than single spaces and line ends, in the widest sense.
_OTHER_SPACE = re.compile(r"[^\S \n]")


def plain_keys(text: str) -> list[str] | None:
    """Keys of ``text`` when its words are parted by single spaces or line ends only, else None.

    The first key is the first word, without a separator in front.
    """
    if _OTHER_SPACE.search(text):
        return None
    keys = text.replace("\n", " \n").split(" ")
    return None if "" in keys or "\n" in keys else keys


def key_of(segment: str) -> str:
    if segment[0] == " " and segment[1:2] not in ("", " ", "\n", "\r"):
        return segment[1:]
    if segment[0] == "\n" and len(segment) > 1:
        return segment
    return "\r" + segment


def segment_of(key: str) -> str:
    return key[1:] if key[0] == "\r" else key if key[0] == "\n" else " " + key


#: Bytes of an entry besides its strings: the tuple and its place in the table.
_ENTRY = 160


class SegmentCache:
    def __init__(self, encode: Callable[[list[str]], list[tuple[str, ...]]], capacity: int):
        self.encode, self.capacity, self.known, self.size = encode, capacity, {}, 0

    def lookup(self, rows: list[list[str]]) -> Iterator[list]:
        """The values of each row's keys; segments not known yet are encoded in one call."""
        known = self.known
        missing: set[str] = set()
        for row in rows:
            missing.update(set(row).difference(known))
        new = list(missing)
        known.update(zip(new, self.encode([segment_of(k) for k in new]), strict=True))
        for row in rows:
            yield [known[k] for k in row]
        for k in new:
            size = _ENTRY + getsizeof(k) + sum(map(getsizeof, known[k]))
            if self.size + size > self.capacity:
                del known[k]
            else:
                self.size += size


def blocks(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``chars`` characters (one text at least), to bound memory."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
