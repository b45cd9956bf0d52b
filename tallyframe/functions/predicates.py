"""Row predicates and Yes/No flags with the null logic of the source reports.

All functions return ``Column`` expressions, so they stay inside whole-stage codegen and push down
to the parquet scan where Catalyst can.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def instant(as_of: datetime | Column | None) -> Column:
    """The report instant: an explicit timestamp, or the wall clock when ``None``."""
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, Column):
        return as_of
    return ts_lit(as_of)


def ts_lit(as_of: datetime | str) -> Column:
    """Timestamp literal without time zone, built from text (independent of the host zone)."""
    text = as_of.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(as_of, datetime) else as_of
    return F.lit(text).cast("timestamp_ntz")


def active_any(status: ColumnOrName, end: ColumnOrName, as_of=None, current: str = "C") -> Column:
    """"Or" form of an active record: current status, or an end date still in the future.

    A null end date is unknown, so only the status decides for it.
    """
    return (_c(status) == current) | (_c(end) > instant(as_of))


def active_all(status: ColumnOrName, end: ColumnOrName, as_of=None, current: str = "C") -> Column:
    """"And" form: current status and an end date that is open or in the future."""
    return (_c(status) == current) & not_ended(end, as_of)


def not_ended(end: ColumnOrName, as_of=None) -> Column:
    """Open-ended validity: no end date, or an end date after ``as_of``."""
    return _c(end).isNull() | (_c(end) > instant(as_of))


def mismatch_flag(a: ColumnOrName, b: ColumnOrName, default=0) -> Column:
    """'Yes' when the null-defaulted values differ, else 'No'.

    The default takes the type of the compared columns: ``'0'`` for text columns (so a null equals a
    literal "0"), ``0`` for numbers.
    """
    d = F.lit(default)
    return F.when(F.coalesce(_c(a), d) != F.coalesce(_c(b), d), "Yes").otherwise("No")


def code_flag(code: ColumnOrName, pos: int, expected: str, length: int = 1) -> Column:
    """'Yes' when the code's character(s) at 1-based ``pos`` differ from ``expected``.

    A null code is unknown and falls to 'No'.
    """
    return F.when(F.substring(_c(code), pos, length) != expected, "Yes").otherwise("No")


def all_no(*flags: ColumnOrName) -> Column:
    """Negated disjunction ``not (f1 = 'Yes' or f2 = 'Yes' ...)`` with three-valued logic."""
    anyyes = None
    for f in flags:
        t = _c(f) == "Yes"
        anyyes = t if anyyes is None else (anyyes | t)
    return ~anyyes


def any_yes(*flags: ColumnOrName) -> Column:
    out = None
    for f in flags:
        t = _c(f) == "Yes"
        out = t if out is None else (out | t)
    return out


def m_eq(a: ColumnOrName, b) -> Column:
    """Two-valued equality of the M language: null equals null, null differs from any value."""
    return _c(a).eqNullSafe(b if isinstance(b, Column) else F.lit(b))


def m_ne(a: ColumnOrName, b) -> Column:
    return ~m_eq(a, b)


def m_filter(cond: Column) -> Column:
    """A row filter whose null outcome drops the row (M ``Table.SelectRows``)."""
    return F.coalesce(cond, F.lit(False))


def not_contains(text: ColumnOrName, part: ColumnOrName, pattern: bool = True,
                 case_insensitive: bool = True) -> Column:
    """``text not like '%' + part + '%'``.

    As in the source's LIKE, ``%``, ``_`` and ``[...]`` inside ``part`` are a pattern (see
    ``like_regex``); parts without them take a plain search.  ``pattern=False`` reads every part as
    plain characters.  Either way a null text or part gives null, which drops the row in a filter.
    """
    t, p = _c(text), _c(part)
    if case_insensitive:
        t, p = F.lower(t), F.lower(p)
    plain = F.contains(t, p)
    if not pattern:
        return ~plain
    return ~F.when(p.rlike(r"[%_\[]"), F.regexp_like(t, F.concat(F.lit("(?s)"), like_regex(p)))).otherwise(plain)


def like_regex(part: ColumnOrName) -> Column:
    """The regular expression of a LIKE pattern without escape character: ``%`` any text, ``_`` any
    character, ``[set]`` and ``[^set]`` one character of (not of) the set.  A bracket that is never
    closed, and an empty set, match nothing.  All other characters stand for themselves."""
    tokens = F.regexp_extract_all(_c(part), F.lit(r"\[[^\]]*\]|[\s\S]"), F.lit(0))

    def one(t: Column) -> Column:
        negated = F.substring(t, 2, 1) == "^"
        inner = F.when(negated, F.substr(t, F.lit(3), F.length(t) - 3)).otherwise(F.substr(t, F.lit(2), F.length(t) - 2))
        inner = F.regexp_replace(inner, r"([\\^\[&])", r"\\$1")
        some = F.when(inner == "", F.when(negated, ".").otherwise("(?!)")).otherwise(
            F.concat(F.when(negated, "[^").otherwise("["), inner, F.lit("]")))
        return (F.when(t == "%", ".*").when(t == "_", ".").when(t == "[", "(?!)")
                .when(F.length(t) > 1, some).otherwise(F.concat(F.lit("\\Q"), t, F.lit("\\E"))))

    return F.array_join(F.transform(tokens, one), "")


def filter_optional(key: ColumnOrName, pred: Column) -> Column:
    """Preserved-side filter after a left join: no partner row, or the partner satisfies ``pred``."""
    return _c(key).isNull() | pred


def starts(col: ColumnOrName, prefix: str) -> Column:
    """``left(col, n) = prefix`` written so that it pushes down to parquet as a prefix filter."""
    return _c(col).startswith(prefix)
