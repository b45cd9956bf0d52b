"""Fill-in-middle transformation over a learned rank index.

Cuts are positions in code points, texts are UTF-8, so each cut needs the byte offset of a code
point.  A text's boundary offsets (where each code point starts, and the end) are a rising function
of their rank.  Line segments are fitted to all of them: a segment runs through its two end points
and is halved while any offset in it lies more than ``ERROR`` bytes off the line.  What the lines miss
is stored as one signed byte per boundary.  A cut is predicted by the line of its segment and set
right with its stored residual, which gives the exact offset without a search.

Prefix, middle and suffix follow from two hash numbers of the document, the order of the parts from
two others; see :func:`plan`.  Parts are put together as ``<P>prefix<S>suffix<M>middle`` (psm) or
``<S>suffix<P>prefix<M>middle`` (spm).  A text that holds one of the marks stays as it is (plain).

Defined cases: null and empty texts are plain, with empty output.  A null ``doc_id`` counts as the
empty string in the hash.  Rows are transformed one by one, so repeated and tied rows give equal
results.  Very long texts are held once, with one byte per code point.  An empty table gives no rows.
Columns other than ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .segments import blocks_of, text_buffer

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Largest distance, in bytes, between an offset and its line; it has to fit a signed byte.
ERROR = 100
#: Share of documents that are cut, and share of those with the suffix first, in hundredths.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes whose boundaries are fitted at a time.
CHUNK = 1 << 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class RankIndex:
    """Byte offsets of code points, by rank: lines with bounded error and residuals.

    ``chunks`` give the rising offsets, some at a time; beside a chunk only lines and residuals are kept.
    ``ends`` are the ranks at which lines end, the first being 0, and ``at`` the offsets there.
    """

    def __init__(self, chunks: Iterable[np.ndarray], error: int = ERROR):
        if not 0 < error < 127:
            raise ValueError("the error has to fit a signed byte")
        ends, at, residual, first = [], [], [], 0
        for offsets in chunks:
            self.ends = _line_ends(offsets, error)
            self.at = offsets[self.ends]
            residual.append((offsets - self.predicted(np.arange(len(offsets)))).astype(np.int8))
            ends.append(self.ends + first)
            at.append(self.at)
            first += len(offsets)
        self.ends, self.at, self.residual = np.concatenate(ends), np.concatenate(at), np.concatenate(residual)

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.ends, ranks, "right") - 1
        j = np.minimum(i + 1, len(self.ends) - 1)
        return _line(self.ends[i], self.ends[j], self.at[i], self.at[j], ranks)

    def offset(self, ranks: np.ndarray) -> np.ndarray:
        return self.predicted(ranks) + self.residual[ranks]


def _line(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whole-number height at ``rank`` of the line from (a, low) to (b, high)."""
    return low + (rank - a) * (high - low) // np.maximum(b - a, 1)


def _line_ends(offsets: np.ndarray, error: int) -> np.ndarray:
    """Ranks at which the lines end: segments that are not close enough are halved, all of a round at once."""
    last = len(offsets) - 1
    ends = np.array([0, last] if last else [0], np.int64)
    open_ = ends[:-1]  # segments, by their first rank, that are not known to be close
    while len(open_):
        stops = ends[np.searchsorted(ends, open_, "right")]
        size = stops - open_ + 1
        base = np.concatenate([[0], np.cumsum(size)])
        rank = np.arange(base[-1]) - np.repeat(base[:-1] - open_, size)
        line = _line(np.repeat(open_, size), np.repeat(stops, size), np.repeat(offsets[open_], size), np.repeat(offsets[stops], size), rank)
        far = np.maximum.reduceat(np.abs(offsets[rank] - line), base[:-1]) > error
        middle = (open_[far] + stops[far]) // 2
        ends = np.union1d(ends, middle)
        open_ = np.union1d(open_[far], middle)
    return ends


def boundaries(data: np.ndarray, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """Offsets at which code points of ``data`` (UTF-8) start, and its end."""
    for a in range(0, len(data), chunk):
        at = np.flatnonzero((data[a:a + chunk] & 0xC0) != 0x80) + a
        if len(at):
            yield at
    yield np.array([len(data)])


def plan(doc_id: Column, text: Column) -> dict[str, Column]:
    """Hash numbers of a document and what they and its text decide, as columns."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (h[2] % 100 >= CUT), "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    return {"h1": h[0], "h2": h[1], "form": form}


def _transformed(batches: Iterator[pa.RecordBatch], error: int) -> Iterator[pa.RecordBatch]:
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        data, bounds = text_buffer(batch.column(1))
        form = batch.column(4).to_pylist()
        h = [batch.column(i).to_numpy() for i in (2, 3)]
        for a, b in blocks_of(bounds, 2 * CHUNK):
            part = data[bounds[a]:bounds[b]]
            at = bounds[a:b + 1] - bounds[a]
            # one index over the boundaries of all texts of the block; a text's first rank is first[i]
            index = RankIndex(boundaries(part), error)
            n = np.array([np.count_nonzero((part[s:e] & 0xC0) != 0x80) for s, e in zip(at, at[1:], strict=False)], np.int64)
            first = np.concatenate([[0], np.cumsum(n)])
            x, y = h[0][a:b] % (n + 1), h[1][a:b] % (n + 1)
            x, y = np.minimum(x, y), np.maximum(x, y)
            p, q = index.offset(first[:-1] + x), index.offset(first[:-1] + y)
            raw = part.tobytes()
            out = []
            for i, f in enumerate(form[a:b]):
                s, e = at[i], at[i + 1]
                if f == "plain":
                    out.append(raw[s:e])
                elif f == "psm":
                    out.append(b"".join([marks[0], raw[s:p[i]], marks[1], raw[q[i]:e], marks[2], raw[p[i]:q[i]]]))
                else:
                    out.append(b"".join([marks[1], raw[q[i]:e], marks[0], raw[s:p[i]], marks[2], raw[p[i]:q[i]]]))
            plain = np.array([f == "plain" for f in form[a:b]], bool)
            cols = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), batch.column(4).slice(a, b - a), pa.array(x, pa.int64(), mask=plain),
                    pa.array(y - x, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in cols], names)


def transform(docs: DataFrame, error: int = ERROR) -> DataFrame:
    """``doc_id, n`` (code points), ``form``, ``prefix_chars, middle_chars`` (null if plain) and ``output`` of every text."""
    ship(docs.sparkSession)
    two = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    planned = two.select("doc_id", "text", *[c.alias(name) for name, c in plan(F.col("doc_id"), F.col("text")).items()])
    return planned.mapInArrow(lambda it: _transformed(it, error), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from.  No part holds a mark, so marks are found by splitting."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))

    def parts(mark: str) -> tuple[Column, Column, Column]:
        first, rest = F.split_part(body, F.lit(mark), F.lit(1)), F.split_part(body, F.lit(mark), F.lit(2))
        return first, F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))

    prefix, suffix, middle = parts(SUFFIX)
    suffix2, prefix2, middle2 = parts(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix2, middle2, suffix2))


def digests(docs: DataFrame) -> DataFrame:
    """:func:`transform` with SHA-256 of the output and of the text rebuilt from it."""
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                  F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {CUT} THEN 'plain'
                  WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
