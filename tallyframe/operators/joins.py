"""Join operators of the reconciliation workload.

Physical strategy is left to Catalyst and AQE: broadcast below the size threshold, sort-merge with
skew splitting above it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _and(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


# ----------------------------------------------------------------------------- M style joins
def nested_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str],
                expand: Mapping[str, str] | Sequence[str], how: str = "left",
                null_keys: bool = True) -> DataFrame:
    """Join then expand selected right columns (M ``Table.NestedJoin`` + ``ExpandTableColumn``).

    Keys match null to null.  A side whose keys are never null (a primary key) has nothing to match a
    null with, so plain equality gives the same rows: ``null_keys=False`` says so, and the join then
    shares the key's hash partitioning with its neighbours and never gathers null keys.  ``expand`` maps right column -> output name (or lists names kept as
    they are).  ``how="left_semi"`` keeps left rows that have a partner, once each (a nested join
    that is never expanded).
    """
    tmp = [f"__rk_{i}" for i in range(len(right_on))]
    cond = _and([F.col(lk).eqNullSafe(F.col(t)) if null_keys else F.col(lk) == F.col(t)
                 for lk, t in zip(left_on, tmp)])
    if how in ("left_semi", "semi", "left_anti", "anti"):
        r = right.select(*[F.col(rk).alias(t) for rk, t in zip(right_on, tmp)])
        return left.join(r, cond, how)
    mapping = dict(expand) if isinstance(expand, Mapping) else {c: c for c in expand}
    r = right.select(*[F.col(rk).alias(t) for rk, t in zip(right_on, tmp)],
                     *[F.col(src).alias(dst) for src, dst in mapping.items()])
    return left.join(r, cond, how).drop(*tmp)


def join_where(left: DataFrame, right: DataFrame, on, right_pred: Column | None = None,
               how: str = "left") -> DataFrame:
    """Join with constant predicates on the right side inside ``ON``: the right side is filtered
    first (so a left join still keeps every left row)."""
    r = right.where(right_pred) if right_pred is not None else right
    return left.join(r, on, how)


def left_join_skew_safe(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``left LEFT JOIN right ON left_key = right_key`` for a right side with hot keys.

    A left outer join can only have its *left* side split by AQE's skew handling, so one key
    holding a third of the right side would land in one task.  Written as the inner join (either
    side splittable) plus the left rows whose key has no partner (anti-join against the right's
    distinct keys, partially aggregated before the shuffle), the result is the same rows.
    """
    matched = left.join(right, F.col(left_key) == F.col(right_key), "inner")
    keys = right.select(F.col(right_key).alias("__rk")).where(F.col("__rk").isNotNull()).distinct()
    unmatched = left.join(keys, F.col(left_key) == F.col("__rk"), "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


# ----------------------------------------------------------------------------- hierarchy
def with_children(parents: DataFrame, props: DataFrame, key: str = "property_key",
                  parent_key: str = "parent_property_key",
                  cols: Mapping[str, str] | None = None, how: str = "left") -> DataFrame:
    """Parent rows joined to their children (one level); child columns renamed by ``cols``."""
    cols = dict(cols or {key: f"child_{key}"})
    kids = props.select(F.col(parent_key).alias("__parent"),
                        *[F.col(src).alias(dst) for src, dst in cols.items()])
    if how == "left":
        # one parent may hold a large share of all children
        return left_join_skew_safe(parents, kids, key, "__parent").drop("__parent")
    return parents.join(kids, F.col(key) == F.col("__parent"), how).drop("__parent")


def with_parent(children: DataFrame, parents: DataFrame, key: str = "property_key",
                parent_key: str = "parent_property_key",
                cols: Mapping[str, str] | None = None, how: str = "inner") -> DataFrame:
    """Child rows joined to their parent on the child's foreign key."""
    cols = dict(cols or {})
    par = parents.select(F.col(key).alias("__pk"), *[F.col(s).alias(d) for s, d in cols.items()])
    return children.join(par, F.col(parent_key) == F.col("__pk"), how).drop("__pk")


def leaf_parents(parents: DataFrame, props: DataFrame, key: str = "property_key",
                 parent_key: str = "parent_property_key") -> DataFrame:
    """Parents without any child row (anti-join on the children's parent key)."""
    kids = props.where(F.col(parent_key).isNotNull()).select(F.col(parent_key).alias("__parent"))
    return parents.join(kids, F.col(key) == F.col("__parent"), "left_anti")


def branch_parents(parents: DataFrame, props: DataFrame, key: str = "property_key",
                   parent_key: str = "parent_property_key",
                   cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct parents that have at least one child (semi-join, then distinct on ``cols``)."""
    kids = props.select(F.col(parent_key).alias("__parent"))
    out = parents.join(kids, F.col(key) == F.col("__parent"), "left_semi")
    if cols:
        out = out.select(*cols)
    return out.distinct()


# ----------------------------------------------------------------------------- lookups
def band_lookup(df: DataFrame, bands: DataFrame, value: ColumnOrName, out: str,
                lo: str = "c_minimum_value", hi: str = "c_maximum_value", code: str = "c_code",
                by: tuple[str, ColumnOrName] | None = None,
                band_filter: Column | None = None, upper: bool = True) -> DataFrame:
    """Add the code of the band holding ``value`` (``lo <= value <= hi``), or null.

    ``by=(band_column, row_column)`` adds an equality condition (same calculation method).  More
    than one matching band is an error, raised at run time, as a scalar subquery would.

    One plan for band tables of any size: a band of width up to 2^n is listed under the one to three
    multiples of 2^n that it touches, and a value is looked up under its own multiple of each 2^n
    that occurs among the bands (64 at most, one scalar subquery).  That turns the range into an
    equi-join.  Only the distinct values are looked up, after partial aggregation; their codes are
    joined back to the rows, which may be skewed: the lookup side is unique per value.
    """
    b = bands.where(band_filter) if band_filter is not None else bands
    level = F.ceil(F.log2((F.col(hi) - F.col(lo) + 1).cast("double"))).cast("int")
    listed = b.where(F.col(lo) <= F.col(hi)).select(
        F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), level.alias("__level"),
        (F.upper(code) if upper else F.col(code)).alias("__code"),
        (F.col(by[0]) if by else F.lit(0)).alias("__band_by"))
    multiple = lambda v: F.floor(v.cast("double") / F.pow(F.lit(2.0), F.col("__level")))
    listed = listed.withColumn("__multiple", F.explode(F.sequence(multiple(F.col("__lo")), multiple(F.col("__hi")))))
    levels = listed.agg(F.collect_set("__level")).scalar()

    row_by = _c(by[1]) if by else F.lit(0)
    wanted = df.select(_c(value).alias("__value"), row_by.alias("__by")).where(F.col("__value").isNotNull()).distinct()
    wanted = wanted.withColumn("__levels", levels).withColumn("__level", F.explode("__levels")).drop("__levels")
    wanted = wanted.withColumn("__multiple", multiple(F.col("__value"))).withColumnRenamed("__level", "__own_level")
    hit = wanted.join(listed.withColumnRenamed("__multiple", "__band_multiple"),
                      (F.col("__by") == F.col("__band_by")) & (F.col("__own_level") == F.col("__level"))
                      & (F.col("__multiple") == F.col("__band_multiple"))
                      & F.col("__value").between(F.col("__lo"), F.col("__hi")))
    found = hit.groupBy("__value", "__by").agg(F.count(F.lit(1)).alias("__n"), F.min("__code").alias("__code"))
    found = found.select("__value", "__by", F.when(
        F.col("__n") > 1, F.raise_error(F.lit(f"band lookup for {out}: more than one band")).cast("string"))
        .otherwise(F.col("__code")).alias(out))
    on = _c(value) == F.col("__value")
    if by:
        on = on & (row_by == F.col("__by"))
    return df.join(found, on, "left").drop("__value", "__by")


def join_text_key(left: DataFrame, right: DataFrame, text_col: str, key_col: str,
                  how: str = "left") -> DataFrame:
    """Join a text column holding numbers to a numeric key; malformed text matches nothing."""
    return left.join(right, F.col(text_col).try_cast("bigint") == F.col(key_col), how)


def missing(left: DataFrame, right: DataFrame, on, col: str) -> DataFrame:
    """Left join then keep rows whose joined ``col`` is null: no partner, or a partner with a null
    ``col`` (kept as a left join, which is not the same as an anti-join)."""
    return left.join(right, on, "left").where(F.col(col).isNull())


def no_current(df: DataFrame, facts: DataFrame, key: str, facts_key: str, current: Column,
               unless: Column | None = None) -> DataFrame:
    """Rows whose key has no row in ``facts`` that is ``current`` (``unless or not exists (...)``).

    Rows that satisfy ``unless`` stay whatever the facts say; so do rows with a null key, which
    equals none.  The current facts are reduced to distinct keys before the shuffle, so a fact key
    with very many rows is one row there, and a hot key on the row side can be split.
    """
    keys = facts.where(current).select(F.col(facts_key).alias("__current")).distinct()
    out = df.join(keys, F.col(key) == F.col("__current"), "left")
    stays = F.col("__current").isNull()
    if unless is not None:
        stays = F.coalesce(unless, F.lit(False)) | stays
    return out.where(stays).drop("__current")


# ----------------------------------------------------------------------------- effective dating
def latest_effective(df: DataFrame, keys: Sequence[str], eff: str) -> DataFrame:
    """Rows with no later row of the same key (``not exists later``): ties are all kept, rows with
    a null date are kept, rows with a null key are kept.

    Computed as a per-key maximum joined back (partial aggregation before the shuffle), so a key
    holding a large share of the rows is never gathered into one task.
    """
    tmp = [f"__lk_{i}" for i in range(len(keys))]
    mx = (df.where(_and([F.col(k).isNotNull() for k in keys]))
          .groupBy(*[F.col(k).alias(t) for k, t in zip(keys, tmp)])
          .agg(F.max(eff).alias("__max_eff")))
    joined = df.join(mx, _and([F.col(k) == F.col(t) for k, t in zip(keys, tmp)]), "left")
    keep = F.col(eff).isNull() | F.col("__max_eff").isNull() | (F.col(eff) >= F.col("__max_eff"))
    return joined.where(keep).drop(*tmp, "__max_eff")


# ----------------------------------------------------------------------------- attribute-value rows
def eav_join(df: DataFrame, entity: str, attr: str, value: str,
             anchor: Column, other: Column, anchor_name: str, other_name: str) -> DataFrame:
    """Pair each anchor attribute row with the matching other attribute row(s) of the same entity
    (left join: an anchor without the other attribute gets null).  An entity with very many rows of either
    attribute is split; where an entity has one row of each, :func:`eav_pivot` needs one pass."""
    a = df.where(anchor).select(F.col(entity).alias("__e"), F.col(value).alias(anchor_name))
    o = df.where(other).select(F.col(entity).alias("__o"), F.col(value).alias(other_name))
    return left_join_skew_safe(a, o, "__e", "__o").select(F.col("__e").alias(entity), anchor_name, other_name)


def eav_pivot(df: DataFrame, entity: str, attr: str, value: str, names: Mapping[str, str],
              unique: bool = True) -> DataFrame:
    """One row per entity with a column per attribute of ``names`` (attribute -> column), null where it has none.

    One conditional aggregation in one pass and one shuffle of partial rows, so an entity with a large
    share of all rows is one row per task before it.  An attribute is expected once per entity: two different values
    are an error, raised at run time; with ``unique=False`` the greatest is taken, and ``<column>_rows`` says
    how many rows there were.  Rows with a null entity form one; rows of other attributes only keep their
    entity in the result.
    """
    found = {c: F.when(F.col(attr) == a, F.col(value)) for a, c in names.items()}
    if not unique:
        rows = {f"{c}_rows": F.count_if(F.coalesce(F.col(attr) == a, F.lit(False))) for a, c in names.items()}
        return df.groupBy(entity).agg(*[F.max(x).alias(c) for c, x in found.items()], *[x.alias(c) for c, x in rows.items()])
    both = df.groupBy(entity).agg(*[f(x).alias(f"{p}{c}") for c, x in found.items() for p, f in (("__min_", F.min), ("__max_", F.max))])
    return both.select(entity, *[
        F.when(F.col(f"__min_{c}") < F.col(f"__max_{c}"), F.raise_error(F.lit(f"attribute {c}: more than one value")).cast(df.schema[value].dataType))
        .otherwise(F.col(f"__min_{c}")).alias(c) for c in found])


def eav_count(df: DataFrame, entity: str, value: str, anchor: Column, other: Column,
              anchor_name: str, count_name: str) -> DataFrame:
    """``count(other.value)`` per anchor value over the anchor-other pairs of the same entity,
    computed without forming the pairs: other rows are counted per entity first (partial
    aggregation), the count is joined to the anchor rows and summed per anchor value."""
    per_entity = (df.where(other).groupBy(F.col(entity).alias("__o"))
                  .agg(F.count(F.col(value)).alias("__n")))
    a = df.where(anchor).select(F.col(entity).alias("__e"), F.col(value).alias(anchor_name))
    return (a.join(per_entity, F.col("__e") == F.col("__o"), "left")
            .groupBy(anchor_name).agg(F.sum(F.coalesce(F.col("__n"), F.lit(0))).alias(count_name)))


def join_codes(left: DataFrame, right: DataFrame, left_code: str, right_code: str, how: str = "inner",
               collation: str = "UTF8_LCASE_RTRIM") -> DataFrame:
    """Join on code columns as a case-insensitive, blank-padding server collation compares them.

    Both columns are compared under ``collation`` and stay as they are in the result; a code column that was
    loaded with that collation (``normalise_codes``) needs no cast.  It remains a hash-partitioned equi-join.
    """
    a, b = (F.collate(F.col(c), collation) for c in (left_code, right_code))
    return left.join(right, a == b, how)
