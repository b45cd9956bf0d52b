"""Integer and decimal arithmetic with the truncating rules of the source reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def try_int(text: ColumnOrName, blank_as_zero: bool = False) -> Column:
    """Text to int, null when malformed.  ``blank_as_zero`` maps the empty string to 0, as
    ``try_convert(int, '')`` does in the source system."""
    t = _c(text)
    out = t.try_cast("int")
    if blank_as_zero:
        out = F.when(t == "", F.lit(0)).otherwise(out)
    return out


def int_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Integer division truncating toward zero (SQL ``div``); null on a zero divisor."""
    b = _c(b)
    return F.when(b != 0, F.call_function("div", _c(a), b))


def int_avg(x: ColumnOrName) -> Column:
    """Average of an integer column that truncates to an integer (``sum div count``)."""
    return int_div(F.sum(_c(x)), F.count(_c(x)))


def dec_avg(x: ColumnOrName, scale: int = 6) -> Column:
    """Average of ``cast(x as decimal)`` (``decimal(18,0)``) keeping ``scale`` decimals.

    Spark's ``avg`` adds four decimals to the input scale, so the input is widened first.
    """
    return F.avg(_c(x).cast("decimal(18,0)").cast(f"decimal(18,{scale - 4})"))
