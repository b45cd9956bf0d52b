"""Text expressions: trimming, multi-line address assembly, code decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.numeric import try_int

ColumnOrName = Column | str

# Fixed value: address line separator (blank, carriage return, line feed).
LINE_SEP = " \r\n"


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_end(col: ColumnOrName) -> Column:
    """M ``Text.TrimEnd``: remove all trailing whitespace."""
    return F.regexp_replace(_c(col), r"\s+$", "")


def concat_lines(*cols: ColumnOrName, sep: str = LINE_SEP) -> Column:
    """Multi-line address: each line right-trimmed; a separator precedes every non-null line after
    the first.  Nulls count as empty text, and a null *first* line still leaves the separator
    before line two."""
    trimmed = [F.rtrim(_c(c)) for c in cols]
    parts = [F.coalesce(trimmed[0], F.lit(""))]
    for t in trimmed[1:]:
        parts.append(F.when(t.isNull(), F.lit("")).otherwise(F.concat(F.lit(sep), t)))
    return F.concat(*parts)


def rate_class(ratetype: ColumnOrName) -> Column:
    """Dwelling class: the third character of the rate type (``S`` single, ``M`` multi)."""
    return F.substring(_c(ratetype), 3, 1)


def rate_bin_type(ratetype: ColumnOrName) -> Column:
    """Bin type: characters 4-6 of the rate type, upper-cased."""
    return F.upper(F.substring(_c(ratetype), 4, 3))


def rate_frequency(ratetype: ColumnOrName) -> Column:
    """Collection frequency: the last two characters (after right-trim) as an integer, or null."""
    return try_int(F.right(F.rtrim(_c(ratetype)), F.lit(2)))


def decode_rate_type(df, col: str = "ratetype"):
    """Add ``rate_bin_type`` and ``rate_frequency`` decoded from the rate type code."""
    return df.withColumns({"rate_bin_type": rate_bin_type(col), "rate_frequency": rate_frequency(col)})
