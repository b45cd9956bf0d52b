"""Keyed aggregates: conditional sums, "any No" flags, service categories and per-key totals
attached to every row (the unordered whole-partition windows of the source reports)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sum_if(cond: Column, x: ColumnOrName | int = 1) -> Column:
    """``sum(case when cond then x else 0 end)``."""
    val = F.lit(x) if isinstance(x, int) else _c(x)
    return F.sum(F.when(cond, val).otherwise(F.lit(0)))


def zero_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def min_flag(col: ColumnOrName) -> Column:
    """Minimum of a Yes/No text column: 'No' when any row says No, null when all are null."""
    return F.min(_c(col))


def service_category(is_active: ColumnOrName, n_services: ColumnOrName,
                     child_services: ColumnOrName | None = None,
                     labels: Mapping[str, str] | None = None) -> Column:
    """Searched CASE classifying a property's services.

    Order: a child with services, a missing code, zero services, an active code, an old code.
    """
    lab = {"child": "Child Has Service", "missing": "Missing Service", "zero": "Zero Service",
           "has": "Has Service", "old": "Old Service Code", "unknown": "Unknown"}
    lab.update(labels or {})
    act = _c(is_active)
    expr = F
    if child_services is not None:
        expr = expr.when(_c(child_services) > 0, lab["child"])
    expr = (expr.when(act.isNull(), lab["missing"])
            .when(_c(n_services) == 0, lab["zero"])
            .when(act == "Yes", lab["has"])
            .when(act == "No", lab["old"])
            .otherwise(lab["unknown"]))
    return expr


def over_keys(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column],
              how: str = "aggregate", null_safe: bool = True) -> DataFrame:
    """Attach per-key aggregates to every row, like ``agg(...) over (partition by keys)``.

    ``how="aggregate"`` (default) computes the aggregate with partial (map-side) aggregation and
    joins it back on the key.  Unlike a ``Window``, no task ever has to hold all rows of one key:
    a key holding a third of the data is pre-aggregated before the shuffle, and the join back is a
    skew-splittable join (AQE) or a broadcast when the per-key table is small.  Null keys form one
    group, as in a window partition.  ``null_safe=True`` joins back null-safely; ``null_safe=False``
    joins on plain key equality, so the result keeps the key's hash partitioning for neighbouring
    joins, and (for a single key) serves the null-key group, at most one row, from a broadcast.
    ``how="window"`` uses a Window instead.
    """
    if how == "window":
        w = Window.partitionBy(*keys)
        return df.withColumns({name: agg.over(w) for name, agg in aggs.items()})
    tmp = [f"__key_{i}" for i in range(len(keys))]
    per_key = (df.groupBy(*[F.col(k).alias(t) for k, t in zip(keys, tmp)])
               .agg(*[agg.alias(name) for name, agg in aggs.items()]))
    if null_safe or len(keys) != 1:
        cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(keys, tmp)])
        return df.join(per_key, cond, "left").drop(*tmp)
    key, tkey = keys[0], tmp[0]
    out = df.join(per_key, F.col(key) == F.col(tkey), "left").drop(tkey)
    # the null-key group: one row at most, attached to the null-key rows by an equi-join
    nulls = per_key.where(F.col(tkey).isNull()).select(
        F.when(F.col(tkey).isNull(), F.lit(1)).alias("__null_key"),   # data-derived: not folded
        *[F.col(n).alias(f"__null_{n}") for n in aggs])
    out = out.join(F.broadcast(nulls),
                   F.when(F.col(key).isNull(), F.lit(1)) == F.col("__null_key"), "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.col(f"__null_{n}")) for n in aggs}).drop(
        "__null_key", *[f"__null_{n}" for n in aggs])


def count_over(df: DataFrame, col: ColumnOrName, keys: Sequence[str], name: str, **kw) -> DataFrame:
    return over_keys(df, keys, {name: F.count(_c(col))}, **kw)


def sum_over(df: DataFrame, col: ColumnOrName, keys: Sequence[str], name: str,
             default_zero: bool = False, **kw) -> DataFrame:
    out = over_keys(df, keys, {name: F.sum(_c(col))}, **kw)
    return out.withColumn(name, zero_if_null(F.col(name))) if default_zero else out


def sum_if_over(df: DataFrame, cond: Column, keys: Sequence[str], name: str, **kw) -> DataFrame:
    return over_keys(df, keys, {name: sum_if(cond)}, **kw)


def flag_any_over(df: DataFrame, col: ColumnOrName, keys: Sequence[str], name: str, **kw) -> DataFrame:
    """'Yes' when the per-key sum of ``col`` is positive, else 'No'."""
    tmp = f"__sum_{name}"
    out = over_keys(df, keys, {tmp: F.sum(_c(col))}, **kw)
    return out.withColumn(name, F.when(F.col(tmp) > 0, "Yes").otherwise("No")).drop(tmp)
