"""Reconciliation of two registers paired by key.

``pair_by_key`` pairs every left row with every right row of the same key (a left join: a left row
without partner keeps nulls).  ``add_flags`` adds one Yes/No column per compared attribute.
``add_pair_counts`` counts, per partition key, the pairs whose chosen attribute agrees and
disagrees.  ``reconcile_matches`` keeps rows without any "Yes"; ``reconcile_nonmatches`` keeps rows
with a "Yes" unless the key's rows form a *perfect pairing* (n left groups against n right rows
whose codes match one to one), which is not a real mismatch.

Scale: the left side is pre-aggregated to a bounded number of groups per key (one per distinct
code combination) before pairing, so the pair count per key is (groups x right rows), linear in
the right side.  The per-key pair counts are partial aggregates joined back (``over_keys``), so a
hot key is never gathered into one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.predicates import all_no, any_yes, code_flag, mismatch_flag
from tallyframe.operators.aggregates import over_keys, sum_if
from tallyframe.operators.joins import left_join_skew_safe


def pair_by_key(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                how: str = "left") -> DataFrame:
    """All left x right rows of the same key (many-to-many), preserving unpaired left rows.

    The right side (e.g. all rates of one property) may be heavily skewed; the left join is
    planned as inner join + anti-join so that AQE can split a hot key on either side.
    """
    if how == "left":
        return left_join_skew_safe(left, right, left_key, right_key)
    return left.join(right, F.col(left_key) == F.col(right_key), how)


def add_flags(df: DataFrame, compare: Mapping[str, tuple] | None = None,
              codes: Mapping[str, tuple] | None = None) -> DataFrame:
    """``compare``: name -> (left col, right col, null default) gives ``mismatch_flag``;
    ``codes``: name -> (code col, 1-based position, expected text) gives ``code_flag``."""
    cols: dict[str, Column] = {}
    for name, (a, b, default) in (compare or {}).items():
        cols[name] = mismatch_flag(a, b, default)
    for name, (c, pos, expected) in (codes or {}).items():
        cols[name] = code_flag(c, pos, expected)
    return df.withColumns(cols)


def add_pair_counts(df: DataFrame, keys: Sequence[str], a: str, b: str,
                    matched: str = "number_matched", mismatched: str = "number_mismatched",
                    how: str = "aggregate", null_safe: bool = True) -> DataFrame:
    """Per key: number of rows where ``a = b`` and where ``a != b`` (nulls count in neither)."""
    return over_keys(df, keys, {matched: sum_if(F.col(a) == F.col(b)),
                                mismatched: sum_if(F.col(a) != F.col(b))}, how=how,
                     null_safe=null_safe)


def is_perfect_pairing(matched: Column | str, mismatched: Column | str) -> Column:
    """True when m matched and x mismatched pairs are what an n x n one-to-one pairing gives
    (m = n, x = n*n - n)."""
    m = F.col(matched) if isinstance(matched, str) else matched
    x = F.col(mismatched) if isinstance(mismatched, str) else mismatched
    return (m * m - m) == x


def reconcile(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
              compare: Mapping[str, tuple], codes: Mapping[str, tuple] | None = None,
              pair_on: tuple[str, str] | None = None, partition: Sequence[str] | None = None,
              matched: str = "number_matched", mismatched: str = "number_mismatched") -> DataFrame:
    """Pair, flag and count in one call (for callers with no joins between pairing and flags)."""
    out = add_flags(pair_by_key(left, right, left_key, right_key), compare, codes)
    if pair_on:
        out = add_pair_counts(out, list(partition or [left_key]), pair_on[0], pair_on[1],
                              matched, mismatched)
    return out


def reconcile_matches(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows where no flag says "Yes"."""
    return df.where(all_no(*flags))


def reconcile_nonmatches(df: DataFrame, flags: Sequence[str], lead_flag: str | None = None,
                         n_left: str | None = None, n_right: str | None = None,
                         matched: str | None = None, mismatched: str | None = None) -> DataFrame:
    """Rows with a "Yes" flag; with ``lead_flag`` etc. given, perfect pairings are suppressed:
    a row is kept when its lead flag is "No", the side sizes differ, or the key's pair counts are
    not those of a one-to-one pairing."""
    cond = any_yes(*flags)
    if lead_flag is not None:
        cond = cond & ((F.col(lead_flag) == "No") | (F.col(n_left) != F.col(n_right))
                       | ~is_perfect_pairing(matched, mismatched))
    return df.where(cond)
