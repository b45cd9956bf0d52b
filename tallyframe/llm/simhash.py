"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint holds a bit for each of 64 positions: set if more than half of the document's shingle
hashes (XXH64, seed 42) have it.  Documents are linked when fingerprints differ in ``max_bits`` (2)
bits or fewer, so of the 8 positional bytes at least 6 agree.

* Equal fingerprints are one node, so groups of exact copies cost one row after a partial
  aggregation.
* Index: the byte positions form four couples.  Two differing bytes touch two couples at most, so a
  linked pair agrees on two whole couples; each fingerprint is posted under its 6 pairs of couples
  (4 positional bytes and which ones they are).
* Within a posting list the equal positional bytes of each pair are tallied, pairs with 6 or more are
  kept, and their differing bits are counted.
* Posting lists above ``LIST`` fingerprints are posted anew under 2 more bytes of the remaining
  4: again every linked pair agrees on such a set.  Six fixed bytes leave at most 65,536
  fingerprints in a list; its pairs are found by looking up each fingerprint with one or two of its
  16 free bits flipped, which is linear in the list.
* Only the connected links of a list leave its task (one per fingerprint at most); components then
  follow from :func:`components.connected`.

Defined cases: null and empty texts have no words and fingerprint zero, which links like any other.
Texts of fewer than three words are one shingle.  A null ``doc_id`` never names a component unless
all of its documents have none; then it is null.  Repeated rows come out once each.  An empty table
gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, written
from .components import connected, stars

SHINGLE = 3
MAX_BITS = 2
#: Longest posting list whose pairs are tallied; longer ones take the second index.
LIST = 512
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    first = (ends - size)[:max(1, len(words) - shingle + 1)].tolist()
    last = ends[min(shingle, len(words)) - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(first), 8192):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[i:i + 8192], last[i:i + 8192], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(len(keep)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(fp)], [*keep, "fp"])

    two = docs.select(*[docs[c].cast("long") for c in keep], docs["text"].cast("string"))
    return two.mapInArrow(run, ", ".join(f"`{c}` long" for c in keep) + ", fp long")


def _bytes(fp: Column, positions: tuple[int, ...]) -> Column:
    """The positional bytes ``positions`` of ``fp`` side by side."""
    out = F.lit(0).cast("long")
    for n, p in enumerate(positions):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)), 8 * n))
    return out


_COUPLES = ((0, 1), (2, 3), (4, 5), (6, 7))
#: The position sets of the first index.
SETS = tuple(a + b for a, b in combinations(_COUPLES, 2))


def _lists(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start of each run, fingerprints) of whole posting lists; rows come sorted by the key columns."""
    rest: list[np.ndarray] = []
    for b in batches:
        now = [c.to_numpy() for c in b.columns]
        if not len(now[0]):
            continue
        if rest:
            now = [np.concatenate([x, y]) for x, y in zip(rest, now, strict=True)]
        new = np.zeros(len(now[0]), bool)
        for k in now[:n_keys]:
            new[1:] |= k[1:] != k[:-1]
        new[0] = True
        starts = np.flatnonzero(new)
        cut = starts[-1]  # the last list may go on in the next batch
        rest = [c[cut:] for c in now]
        if cut:
            yield starts[:-1], now[n_keys][:cut]
    if rest and len(rest[0]):
        yield np.zeros(1, np.int64), rest[n_keys]


def _out(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = stars(np.concatenate(a) if a else np.empty(0, np.int64), np.concatenate(b) if b else np.empty(0, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def _tallied(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links within posting lists: pairs with enough equal positional bytes, then enough equal bits."""
    for starts, fp in _lists(batches, 1):
        size = np.diff(np.append(starts, len(fp)))
        run = np.repeat(np.arange(len(starts)), size)
        a, b = [], []
        i = np.flatnonzero(np.repeat(size > 1, size))
        step = 0
        while len(i):
            step += 1
            i = i[i + step < len(fp)]
            i = i[run[i] == run[i + step]]
            differing = fp[i] ^ fp[i + step]
            matches = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            hit = matches >= 8 - max_bits
            hit[hit] = np.bitwise_count(differing[hit].view(np.uint64)) <= max_bits
            a.append(fp[i[hit]])
            b.append(fp[i[hit] + step])
        yield _out(a, b)


def _flipped(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links within lists whose fingerprints share six bytes: looks up each with few free bits flipped."""
    for starts, fp in _lists(batches, 2):
        a, b = [], []
        for one in np.split(fp, starts[1:]):
            free = 0
            for p in range(8):
                byte = (one >> np.int64(8 * p)) & 255
                if (byte != byte[0]).any():
                    free |= 0xFF << 8 * p
            bits = [k for k in range(64) if free >> k & 1]
            one = np.sort(one)
            for n in range(1, max_bits + 1):
                for some in combinations(bits, n):
                    mask = np.array([sum(1 << k for k in some)], np.uint64).view(np.int64)[0]
                    other = one ^ mask
                    at = np.searchsorted(one, other)
                    hit = (at < len(one)) & (one[np.minimum(at, len(one) - 1)] == other) & (one < other)
                    a.append(one[hit])
                    b.append(other[hit])
        yield _out(a, b)


def links(nodes: DataFrame, max_bits: int = MAX_BITS, longest: int = LIST) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints ``fp`` within ``max_bits`` of each other."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the index guarantees links of up to two differing bits")
    fp = F.col("fp")
    keys = F.array(*[F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(_bytes(fp, s)) for n, s in enumerate(SETS)])
    posted = nodes.select(F.explode(keys).alias("key"), "fp")
    hot = written(posted.groupBy("key").count().where(F.col("count") > longest).select("key"), "simhash-hot")
    short = posted.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    found = short.mapInArrow(lambda it: _tallied(it, max_bits), "a long, b long")
    # two of the four bytes that the first key leaves open
    again = []
    for n, s in enumerate(SETS):
        more = list(combinations([p for p in range(8) if p not in s], 2))
        again.append(F.when(F.shiftright("key", 32) == n, F.array(*[
            F.shiftleft(F.lit(m).cast("long"), 16).bitwiseOR(_bytes(fp, two)) for m, two in enumerate(more)])))
    long = posted.join(hot, "key", "left_semi").select("key", F.explode(F.coalesce(*again)).alias("key2"), "fp")
    long = long.repartition("key", "key2").sortWithinPartitions("key", "key2")
    return found.unionAll(long.mapInArrow(lambda it: _flipped(it, max_bits), "a long, b long"))


def components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, longest: int = LIST,
               keep: tuple[str, ...] = ("doc_id",), root: bool = False) -> DataFrame:
    """The columns ``keep`` (``doc_id`` first), ``fp`` and ``component_id``, the smallest ``doc_id`` reachable.

    With ``root``, also the smallest fingerprint of the component.
    """
    fps = written(fingerprints(docs, shingle, keep), "simhash-fp")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = connected(links(nodes, max_bits, longest), "simhash-cc")
    of = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = of.join(least, "root").select("fp", "component_id", "root")
    return fps.join(named, "fp").select(*keep, "fp", "component_id", *["root"][:root])
