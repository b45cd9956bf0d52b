"""Byte-level tokenisers of the ``tokenizers`` library, applied to segments (see :mod:`segments`)."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

#: Bytes of segments that go to a library in one text.
JOINED = 1 << 16


def alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


_MARK = "▁".encode()  # a space to a piece tokeniser


def _plain(s: bytes) -> bool:
    """Whether a segment can stand between others without changing their tokens."""
    return s[0] in b" \n" and 0x20 < s[-1] < 0x7F and s[1] not in b" \n" and _MARK not in s


def ids_of(segments: list[bytes], encode: Callable[[str], list[int]], encode_each: Callable[[list[bytes]], list[list[int]]],
           size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of segments end to end and their offsets.

    Segments that can stand beside each other are encoded as one text, which is cut again by the ``size`` of tokens in
    bytes; if a token reaches over a segment's end, and for all others, each segment is encoded by itself.
    """
    out: list[np.ndarray | None] = [None] * len(segments)
    each: list[int] = []
    some, total = [], 0
    for n, s in enumerate(segments):
        if len(s) < 3 or not _plain(s):
            each.append(n)
            continue
        some.append(n)
        total += len(s)
        if total >= JOINED:
            each += _joined(segments, some, encode, size, out)
            some, total = [], 0
    each += _joined(segments, some, encode, size, out)
    for at in range(0, len(each), 10_000):
        for n, ids in zip(each[at:at + 10_000], encode_each([segments[n] for n in each[at:at + 10_000]]), strict=True):
            out[n] = np.array(ids, np.int64)
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, out), np.int64, len(out)))])
    return np.concatenate([np.empty(0, np.int64), *out]), first


def _joined(segments: list[bytes], some: list[int], encode: Callable[[str], list[int]], size: np.ndarray, out: list) -> list[int]:
    """Sets ``out`` for the segments ``some``; returns those for which that is not possible."""
    if not some:
        return []
    ids = np.array(encode(b"".join([segments[n] for n in some]).decode()), np.int64)
    ends = np.cumsum(size[ids])
    want = np.cumsum([len(segments[n]) for n in some])
    at = np.searchsorted(ends, want)
    if at[-1] != len(ends) - 1 or (ends[at] != want).any():
        return some
    first = 0
    for n, last in zip(some, (at + 1).tolist(), strict=True):
        out[n] = ids[first:last]
        first = last
    return []


class ByteLevel:
    """A byte-level tokeniser whose tokens never reach from a non-space into a following space."""

    def __init__(self, path: str, special_is_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        split = self.tok.pre_tokenizer
        if not isinstance(split, pre_tokenizers.ByteLevel) or split.add_prefix_space or not split.use_regex or self.tok.normalizer is not None:
            raise ValueError("not a plain byte-level tokeniser")
        added = self.tok.get_added_tokens_decoder()
        for t in added.values():
            if t.lstrip or t.rstrip or t.single_word or t.normalized or any(c.isspace() for c in t.content):
                raise ValueError(f"the added token {t.content!r} reaches over a segment")
        self.added = [t.content.encode() for t in added.values()]
        self.tok.encode_special_tokens = special_is_text
        byte, n = alphabet(), self.tok.get_vocab_size()
        self.bytes = [b""] * n
        for i in range(n):
            t = self.tok.id_to_token(i)
            self.bytes[i] = t.encode() if i in added else bytes(byte[c] for c in t)
        self.size = np.array([len(t) for t in self.bytes], np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def each(self, segments: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast([s.decode() for s in segments], add_special_tokens=False)]

    def ids(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments end to end, and their offsets."""
        return ids_of(segments, self.whole, self.each, self.size)
