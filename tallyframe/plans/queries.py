"""Query registry: one named DataFrame job per operator and report.

Operator keys run a single operator over the driver tables (whole tables, no row caps); domain
and report keys run over the register views derived from them.  Every computed column is aliased
so that its name matches the SQL oracle in ``tallyframe.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.numeric import dec_avg, int_avg, int_div, try_int
from tallyframe.functions.predicates import (active_all, active_any, code_flag, filter_optional,
                                             m_ne, mismatch_flag, not_contains, not_ended, ts_lit)
from tallyframe.functions.text import (concat_lines, rate_bin_type, rate_class, rate_frequency,
                                       trim_end)
from tallyframe.operators.aggregates import (count_over, flag_any_over, min_flag, over_keys,
                                             service_category, sum_if, sum_if_over, sum_over)
from tallyframe.operators.joins import (band_lookup, branch_parents, eav_join, eav_pivot, join_codes, join_text_key,
                                        join_where, latest_effective, leaf_parents, missing,
                                        nested_join, no_current, with_children, with_parent)
from tallyframe.operators.reconcile import (is_perfect_pairing, pair_by_key, reconcile, reconcile_matches,
                                            reconcile_nonmatches)
from tallyframe.plans import datasets as ds
from tallyframe.plans import reports as R
from tallyframe.session import AS_OF, checkpoint_dir
from tallyframe.sources.domain import Domain, domain
from tallyframe.sources.tables import load, normalise_codes, publish_report, read_report, write_report

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Part-size bands for the band lookup operator (code, minimum, maximum).
SIZE_BANDS = [("XS", 1, 10), ("S", 11, 20), ("M", 21, 35), ("L", 36, 50)]


def register(key: str):
    def deco(fn: Query) -> Query:
        REGISTRY[key] = fn
        return fn
    return deco


def _t(spark, sf, name):
    return load(spark, sf, name)


def _d(spark, sf) -> Domain:
    return domain(spark, sf)


def _report(spark, sf, build: Callable[[Domain], DataFrame],
            tables: tuple[str, ...] = ("property", "property_services_facts", "rate_type_facts")) -> DataFrame:
    """A report over the register views; the written ones are written together on their first use."""
    d = _d(spark, sf)
    d.prepare(*tables)
    return build(d)


def _end():
    """Line end date, open (null) while the line status is O."""
    return F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))


def _orders_keyed(spark, sf):
    """All orders; the key of every fifth customer's orders is null, so that those customers have no
    partner and those orders match nobody."""
    return _t(spark, sf, "orders").withColumn(
        "o_custkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")))


# ============================================================================ 2.A sources
@register("scan_table")
def q_scan_table(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@register("normalise_codes")
def q_normalise_codes(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", F.rpad("p_type", 12, " ").alias("p_type_norm"))
    return normalise_codes(p, ["p_type_norm"])


# ============================================================================ 2.B projection / filters
@register("project_alias")
def q_project_alias(spark, sf):
    return _t(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
        F.col("c_nationkey").alias("nation_id"), F.col("c_name").alias("name_copy"))


@register("project_star")
def q_project_star(spark, sf):
    o = _t(spark, sf, "orders")
    c = _t(spark, sf, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(o["*"], c["c_name"])


@register("drop_columns")
def q_drop_columns(spark, sf):
    return _t(spark, sf, "customer").drop("c_acctbal", "c_mktsegment")


@register("rename_columns")
def q_rename_columns(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey").withColumnsRenamed(
        {"c_custkey": "custkey", "c_name": "name", "c_nationkey": "nationkey"})


@register("literal_column")
def q_literal_column(spark, sf):
    return _t(spark, sf, "customer").select(
        "c_custkey", F.lit("No").alias("has_n0000ua"), F.lit("Child Has Service").alias("category"))


@register("cast_columns")
def q_cast_columns(spark, sf):
    return _t(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("bigint").alias("size_big"),
        F.col("p_partkey").cast("string").alias("partkey_text"))


@register("try_cast_int")
def q_try_cast_int(spark, sf):
    return _t(spark, sf, "part").select(
        "p_partkey", try_int(F.right(F.col("p_brand"), F.lit(2))).alias("brand_no"),
        try_int(F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.col("p_size").cast("string")),
                blank_as_zero=True).alias("size_or_zero"))


@register("fill_nulls")
def q_fill_nulls(spark, sf):
    o = _orders_keyed(spark, sf).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.max("o_orderstatus").alias("last_status"))
    j = _t(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", "n_orders", "last_status").fillna(
        {"n_orders": 0, "last_status": "none"})


@register("coalesce_default")
def q_coalesce_default(spark, sf):
    o = _orders_keyed(spark, sf).groupBy("o_custkey").agg(F.max("o_orderpriority").alias("prio"))
    j = _t(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce("prio", F.lit("0")).alias("prio_or_zero"))


@register("filter_eq")
def q_filter_eq(spark, sf):
    return _t(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")


@register("filter_in")
def q_filter_in(spark, sf):
    return _t(spark, sf, "orders").where(F.col("o_orderstatus").isin("O", "P")).select(
        "o_orderkey", "o_orderstatus")


@register("filter_prefix")
def q_filter_prefix(spark, sf):
    return _t(spark, sf, "part").where(F.col("p_type").startswith("SMALL")).select("p_partkey", "p_type")


@register("filter_not_prefix")
def q_filter_not_prefix(spark, sf):
    return _t(spark, sf, "part").where(~F.col("p_name").startswith("red")
                                       & ~F.col("p_name").startswith("blue")).select("p_partkey", "p_name")


@register("filter_null")
def q_filter_null(spark, sf):
    o = _orders_keyed(spark, sf).select("o_custkey", "o_orderkey")
    j = _t(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.where(F.col("o_orderkey").isNull()).select("c_custkey")


@register("filter_not_contains")
def q_filter_not_contains(spark, sf):
    name = F.col("p_name")
    part = (F.when(F.col("p_partkey") % 4 == 0, F.concat(F.substring(name, 1, 1), F.lit("%"), F.right(name, F.lit(1))))
            .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("_"), F.substring(name, 2, 3)))
            .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("[a-m]"), F.substring(name, 2, 3)))
            .otherwise(F.col("p_type")))
    return _t(spark, sf, "part").select("p_partkey", "p_name", part.alias("pattern")).where(
        not_contains("p_name", "pattern"))


@register("filter_not_compound")
def q_filter_not_compound(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.where(~((F.col("l_returnflag") == "R") | (_end() > ts_lit(AS_OF)))).select(
        "l_orderkey", "l_linenumber", "l_returnflag")


@register("left_join_optional_filter")
def q_left_join_optional_filter(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    j = _t(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.where(filter_optional("o_custkey", F.col("o_orderstatus") == "O")).select(
        "c_custkey", "o_orderkey")


def _lines_with_end(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus",
                                            _end().alias("end_date"))


@register("active_or")
def q_active_or(spark, sf):
    li = _lines_with_end(spark, sf)
    return li.where(active_any("l_linestatus", "end_date", AS_OF, current="O")).select(
        "l_orderkey", "l_linenumber")


@register("active_and")
def q_active_and(spark, sf):
    li = _lines_with_end(spark, sf)
    return li.where(active_all("l_linestatus", "end_date", AS_OF, current="F")).select(
        "l_orderkey", "l_linenumber")


@register("open_ended_filter")
def q_open_ended_filter(spark, sf):
    li = _lines_with_end(spark, sf)
    return li.where(not_ended("end_date", AS_OF)).select("l_orderkey", "l_linenumber")


def _orders_customer(spark, sf):
    o = _t(spark, sf, "orders")
    c = _t(spark, sf, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"))


@register("mismatch_flag")
def q_mismatch_flag(spark, sf):
    j = _orders_customer(spark, sf)
    a_txt = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    b_txt = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("F")).when(
        F.col("o_orderpriority") == "2-HIGH", F.lit("O"))
    a_num = F.when(F.col("c_nationkey") != 0, F.col("c_nationkey"))
    b_num = F.when(F.col("o_orderkey") % 25 != 3, F.col("o_orderkey") % 25)
    return j.select("o_orderkey", mismatch_flag(a_txt, b_txt, "0").alias("status_mismatch"),
                    mismatch_flag(a_num, b_num, 0).alias("nation_mismatch"))


@register("code_flag")
def q_code_flag(spark, sf):
    c = _t(spark, sf, "customer")
    seg = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return c.select("c_custkey", code_flag(seg, 3, "U").alias("segment_mismatch"))


@register("case_when")
def q_case_when(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.when(F.col("l_returnflag") == "R", "red").otherwise("other").alias("stream"))


@register("case_category")
def q_case_category(spark, sf):
    li = _t(spark, sf, "lineitem")
    g = li.groupBy("l_orderkey").agg(
        F.min(F.when(F.col("l_returnflag") == "R", "Yes").when(F.col("l_returnflag") == "A", "No"))
        .alias("is_active"),
        F.sum(F.col("l_quantity").cast("int") % 3).alias("n_services"),
        sum_if((F.col("l_linestatus") == "O") & (F.col("l_linenumber") >= 6)).alias("child_services"))
    return g.select("l_orderkey", service_category("is_active", "n_services", "child_services")
                    .alias("service_category"))


@register("null_safe_ne")
def q_null_safe_ne(spark, sf):
    c = _t(spark, sf, "customer")
    a = F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey") % 5)
    b = F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 5)
    return c.where(m_ne(a, b)).select("c_custkey")


@register("join_null_safe")
def q_join_null_safe(spark, sf):
    c = _t(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_nationkey") != 0, F.col("c_nationkey")).alias("nk"))
    n = _t(spark, sf, "nation").select(
        F.when(F.col("n_nationkey") != 0, F.col("n_nationkey")).alias("nk"), "n_name")
    return nested_join(c, n, ["nk"], ["nk"], {"n_name": "n_name"}, how="left").select(
        "c_custkey", "n_name")


# ============================================================================ 2.C joins
@register("join_inner")
def q_join_inner(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = _t(spark, sf, "part").select("p_partkey", "p_name")
    s = _t(spark, sf, "supplier").select("s_suppkey", "s_name")
    return (o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
            .join(p, F.col("l_partkey") == F.col("p_partkey"))
            .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
            .select("o_orderkey", "l_linenumber", "p_name", "s_name"))


@register("join_left")
def q_join_left(spark, sf):
    o = _orders_keyed(spark, sf).select("o_custkey", "o_orderkey")
    return _t(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "o_orderkey")


@register("join_composite")
def q_join_composite(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return o.join(li, (F.col("o_orderkey") == F.col("l_orderkey"))
                  & (F.col("o_orderstatus") == F.col("l_linestatus"))).select("o_orderkey", "l_linenumber")


@register("join_left_on_filter")
def q_join_left_on_filter(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    j = join_where(_t(spark, sf, "customer"), o, F.col("c_custkey") == F.col("o_custkey"),
                   F.col("o_orderpriority") == "1-URGENT")
    return j.select("c_custkey", "o_orderkey")


@register("join_left_agg")
def q_join_left_agg(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    per_cust = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey")
                .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("total_qty")))
    return _t(spark, sf, "customer").join(per_cust, F.col("c_custkey") == F.col("o_custkey"), "left") \
        .select("c_custkey", "total_qty")


@register("join_inner_agg")
def q_join_inner_agg(spark, sf):
    per_cust = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return _t(spark, sf, "customer").join(per_cust, F.col("c_custkey") == F.col("o_custkey")) \
        .select("c_custkey", "n_orders")


@register("hierarchy_children")
def q_hierarchy_children(spark, sf):
    d = _d(spark, sf)
    parents = d.property.where(F.col("parent_property_key").isNull()).select("property_key", "tpklpaprop")
    j = with_children(parents, d.property, cols={"property_key": "child_property_key",
                                                 "tpklpaprop": "child_tpklpaprop"})
    return j.select("property_key", "tpklpaprop", "child_property_key",
                    F.coalesce("child_tpklpaprop", "tpklpaprop").alias("effective_tpklpaprop"))


@register("hierarchy_parent")
def q_hierarchy_parent(spark, sf):
    d = _d(spark, sf)
    kids = d.property.where(F.col("parent_property_key").isNotNull()).select(
        "property_key", "parent_property_key")
    return with_parent(kids, d.property, cols={"tpklpaprop": "parent_tpklpaprop",
                                               "suburb": "parent_suburb"})


@register("join_left_anti")
def q_join_left_anti(spark, sf):
    d = _d(spark, sf)
    parents = d.property.where(F.col("parent_property_key").isNull())
    return leaf_parents(parents, d.property).select("property_key", "tpklpaprop")


@register("join_left_semi")
def q_join_left_semi(spark, sf):
    d = _d(spark, sf)
    parents = d.property.where(F.col("parent_property_key").isNull())
    return branch_parents(parents, d.property, cols=["property_key", "tpklpaprop", "suburb"])


@register("family_totals")
def q_family_totals(spark, sf):
    return ds.m_child_rates_totals(_d(spark, sf), AS_OF)


@register("band_lookup")
def q_band_lookup(spark, sf):
    bands = spark.createDataFrame(SIZE_BANDS, "c_code string, c_minimum_value int, c_maximum_value int")
    p = _t(spark, sf, "part").select("p_partkey", "p_size")
    return band_lookup(p, bands, "p_size", "size_band")


@register("register_totals")
def q_register_totals(spark, sf):
    """Service records and totals per property, kept beside the written register."""
    return _d(spark, sf).totals("property_services_facts", "property_key", "number_of_services", "number_of_collections")


@register("eav_pivot")
def q_eav_pivot(spark, sf):
    """Requests as one row each: property key and case status, which every request has at most once."""
    orq = _d(spark, sf).onecrm_request_questions
    return eav_pivot(orq, "request_facts_key", "question", "answer", {"PropertyKey": "propertykey", "CaseStatus": "case_status"})


@register("eav_join")
def q_eav_join(spark, sf):
    orq = _d(spark, sf).onecrm_request_questions
    return eav_join(orq, "request_facts_key", "question", "answer",
                    anchor=F.col("question") == "PropertyKey", other=F.col("question") == "CaseStatus",
                    anchor_name="propertykey", other_name="case_status")


@register("request_counts")
def q_request_counts(spark, sf):
    return ds.request_counts(_d(spark, sf))


@register("task_counts")
def q_task_counts(spark, sf):
    return ds.task_counts(_d(spark, sf), ds.TASK_RATES_IMPACT, "number_rates_impact")


@register("join_text_key")
def q_join_text_key(spark, sf):
    ev = _t(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("user_text"))
    c = _t(spark, sf, "customer").select("c_custkey", "c_name")
    return join_text_key(ev, c, "user_text", "c_custkey", how="left").select("event_id", "c_name")


@register("join_left_null_test")
def q_join_left_null_test(spark, sf):
    o = _orders_keyed(spark, sf).select(
        "o_custkey", "o_orderkey",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("prio"))
    j = missing(_t(spark, sf, "customer"), o, F.col("c_custkey") == F.col("o_custkey"), "prio")
    return j.select("c_custkey", "o_orderkey")


@register("not_exists_or")
def q_not_exists_or(spark, sf):
    o = _orders_keyed(spark, sf).select("o_custkey", "o_orderkey")
    j = _t(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return no_current(j, _t(spark, sf, "orders"), "o_custkey", "o_custkey", F.col("o_orderstatus") == "O",
                      unless=F.col("o_orderkey").isNull()).select("c_custkey", "o_orderkey")


@register("latest_effective")
def q_latest_effective(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return latest_effective(o, ["o_custkey"], "o_orderdate")


@register("effective_address")
def q_effective_address(spark, sf):
    return ds.effective_address(_d(spark, sf))


@register("join_pairing")
def q_join_pairing(spark, sf):
    d = _d(spark, sf)
    s = ds.single_property_services(d, AS_OF)
    r = ds.rates_with_counts(d, AS_OF)
    return pair_by_key(s, r, "property_key", "rate_property_key").select(
        "property_key", "service_bin_type", "service_frequency", "rate_type_key", "rate_bin_type")


# ============================================================================ 2.D aggregates
@register("agg_sum")
def q_agg_sum(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("sum_qty"), F.count(F.lit(1)).alias("count_order"))


@register("agg_count_col")
def q_agg_count_col(spark, sf):
    o = _t(spark, sf, "orders")
    return o.groupBy("o_orderstatus").agg(
        F.count(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))).alias("n_prio"))


@register("agg_count_rows")
def q_agg_count_rows(spark, sf):
    return _t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_rows"))


@register("agg_int_avg")
def q_agg_int_avg(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        int_avg(F.col("l_quantity").cast("int")).alias("avg_qty"))


@register("agg_decimal_avg")
def q_agg_decimal_avg(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        dec_avg("l_quantity").alias("avg_qty"))


@register("agg_sum_product")
def q_agg_sum_product(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(
        F.sum(F.col("l_quantity").cast("bigint") * F.col("l_linenumber") * (F.col("l_partkey") % 3))
        .alias("volume"))


@register("agg_sum_if")
def q_agg_sum_if(spark, sf):
    o = _t(spark, sf, "orders")
    return o.groupBy("o_orderstatus").agg(
        (F.coalesce(sum_if(F.col("o_orderpriority") == "1-URGENT"), F.lit(0))
         + F.coalesce(sum_if(F.col("o_orderpriority") == "2-HIGH"), F.lit(0))).alias("n_high"))


@register("agg_min_text")
def q_agg_min_text(spark, sf):
    o = _t(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(
        min_flag(F.when(F.col("o_orderstatus") == "F", "No").when(F.col("o_orderstatus") == "O", "Yes"))
        .alias("all_open"))


@register("distinct_keys")
def q_distinct_keys(spark, sf):
    return _t(spark, sf, "orders").select("o_custkey", "o_orderstatus").distinct()


@register("agg_null_keys")
def q_agg_null_keys(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.groupBy(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"),
                      F.when(F.col("l_linestatus") != "O", F.col("l_linestatus")).alias("status")) \
        .agg(F.count(F.lit(1)).alias("n_rows"))


@register("int_division")
def q_int_division(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     int_div(F.col("l_quantity").cast("int"), F.col("l_linenumber")).alias("qty_per_line"))


# ============================================================================ 2.E keyed totals
@register("window_count")
def q_window_count(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return count_over(o, "o_orderkey", ["o_custkey"], "orders_of_customer")


@register("window_sum")
def q_window_sum(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                          F.col("l_quantity").cast("bigint").alias("qty"))
    return sum_over(li, "qty", ["l_orderkey"], "order_qty", default_zero=True)


@register("window_sum_if")
def q_window_sum_if(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return sum_if_over(li, F.col("l_returnflag") == "R", ["l_orderkey"], "n_red")


@register("window_over_group")
def q_window_over_group(spark, sf):
    g = _t(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return count_over(g, "o_orderstatus", ["o_custkey"], "n_status_groups")


@register("window_flag")
def q_window_flag(spark, sf):
    o = _t(spark, sf, "orders").select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("urgent"))
    return flag_any_over(o, "urgent", ["o_custkey"], "has_urgent").drop("urgent")


@register("window_over_union")
def q_window_over_union(spark, sf):
    a = _t(spark, sf, "orders").select(
        F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("n"))
    b = _t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit(2).alias("n"))
    return sum_over(a.union(b), "n", ["k"], "total_n")


@register("pairing_test")
def q_pairing_test(spark, sf):
    pairs = R._single_pairs(_d(spark, sf), AS_OF, contacts=False)
    g = pairs.select("tpklpaprop", "number_bin_matched", "number_bin_mismatched").distinct()
    return g.withColumn("perfect_pairing", is_perfect_pairing("number_bin_matched",
                                                              "number_bin_mismatched"))


# ============================================================================ 2.F / 2.G
@register("sort_two_keys")
def q_sort_two_keys(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return R.sorted_report(o, "o_custkey", "o_orderdate")


@register("select_distinct")
def q_select_distinct(spark, sf):
    return _t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


def _nation_keys(spark, sf):
    return (_t(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey")),
            _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey")))


@register("union_all")
def q_union_all(spark, sf):
    a, b = _nation_keys(spark, sf)
    return a.union(b)


@register("union_distinct")
def q_union_distinct(spark, sf):
    a, b = _nation_keys(spark, sf)
    return a.union(b).distinct()


@register("union_by_name")
def q_union_by_name(spark, sf):
    a = _t(spark, sf, "customer").select(F.col("c_name").alias("name"),
                                         F.col("c_nationkey").alias("nationkey"),
                                         F.col("c_mktsegment").alias("segment"))
    b = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"),
                                         F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


# ============================================================================ 2.H scalar
@register("scalar_left")
def q_scalar_left(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", F.left("c_name", F.lit(8)).alias("name_head"))


@register("scalar_right")
def q_scalar_right(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", F.right("c_name", F.lit(3)).alias("name_tail"))


@register("scalar_substring")
def q_scalar_substring(spark, sf):
    return _t(spark, sf, "customer").select(
        "c_custkey", F.substring("c_mktsegment", 4, 3).alias("segment_mid"))


@register("scalar_upper")
def q_scalar_upper(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("name_upper"))


@register("scalar_rtrim")
def q_scalar_rtrim(spark, sf):
    return _t(spark, sf, "part").select(
        "p_partkey", F.rtrim(F.concat("p_name", F.lit("   "))).alias("name_trimmed"))


@register("scalar_trim_end")
def q_scalar_trim_end(spark, sf):
    return _t(spark, sf, "part").select(
        "p_partkey", trim_end(F.concat("p_name", F.lit(" \t\r\n "))).alias("name_trimmed"))


@register("concat_lines")
def q_concat_lines(spark, sf):
    c = _t(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey", concat_lines(
        F.when(k % 7 != 0, F.col("c_name")),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")),
        F.when(k % 3 == 0, F.lit("PO Box  ")), F.lit(None).cast("string"),
        F.when(k % 5 == 0, F.col("c_nationkey").cast("string"))).alias("address"))


@register("decode_code")
def q_decode_code(spark, sf):
    d = _d(spark, sf)
    j = d.rate_type_facts.join(d.rate_type, "ratetype_key")
    return j.select("rate_type_key", "ratetype", rate_class("ratetype").alias("rate_class"),
                    rate_bin_type("ratetype").alias("rate_bin_type"),
                    rate_frequency("ratetype").alias("rate_frequency"))


# ============================================================================ 2.I composites
@register("current_rates")
def q_current_rates(spark, sf):
    return ds.current_rates(_d(spark, sf), AS_OF).select(
        "property_key", "rate_type_key", "units", "ratetype", "rate_bin_type", "rate_frequency",
        "assessment", "vgnumber")


@register("current_services")
def q_current_services(spark, sf):
    return ds.current_services(_d(spark, sf), AS_OF).select(
        "property_key", "service_code", "number_of_services", "is_active")


@register("classify_and_group")
def q_classify_and_group(spark, sf):
    return ds.single_service_groups(_d(spark, sf), AS_OF)


@register("shared_allocation")
def q_shared_allocation(spark, sf):
    return ds.shared_volume(_d(spark, sf), AS_OF).select(
        "parent_key", "property_key", "total_volume", "avg_frequency", "eligible_properties",
        "avg_bin_size", "service_bin_type")


@register("contact_lines")
def q_contact_lines(spark, sf):
    c = ds.ratepayer_contact(_d(spark, sf))
    return c.select("c_tpk", "c_asmt", ds.contact_columns()["ratepayer_address"].alias("ratepayer_address"),
                    "ratepayer_email")


def _generic_reconcile(spark, sf):
    d = _d(spark, sf)
    s = ds.single_property_services(d, AS_OF, with_assessment_key=False)
    r = ds.rates_with_counts(d, AS_OF)
    return reconcile(s, r, "property_key", "rate_property_key",
                     compare={"bin_type_mismatch": ("service_bin_type", "rate_bin_type", "0"),
                              "frequency_mismatch": ("service_frequency", "rate_frequency", 0)},
                     pair_on=("service_bin_type", "rate_bin_type"), partition=["tpklpaprop"],
                     matched="number_bin_matched", mismatched="number_bin_mismatched")


_RECON_COLS = ["property_key", "tpklpaprop", "service_bin_type", "service_frequency",
               "number_service_records", "rate_type_key", "rate_bin_type", "rate_frequency",
               "number_rate_records", "bin_type_mismatch", "frequency_mismatch",
               "number_bin_matched", "number_bin_mismatched"]


@register("reconcile_pairs")
def q_reconcile_pairs(spark, sf):
    return _generic_reconcile(spark, sf).select(*_RECON_COLS)


@register("reconcile_match")
def q_reconcile_match(spark, sf):
    return reconcile_matches(_generic_reconcile(spark, sf),
                             ["bin_type_mismatch", "frequency_mismatch"]).select(*_RECON_COLS)


@register("reconcile_nonmatch")
def q_reconcile_nonmatch(spark, sf):
    return reconcile_nonmatches(
        _generic_reconcile(spark, sf), ["bin_type_mismatch", "frequency_mismatch"],
        lead_flag="bin_type_mismatch", n_left="number_service_records",
        n_right="number_rate_records", matched="number_bin_matched",
        mismatched="number_bin_mismatched").select(*_RECON_COLS)


# ============================================================================ 2.K named datasets
@register("dataset_property_services")
def q_dataset_property_services(spark, sf):
    return ds.m_property_services(_d(spark, sf), AS_OF)


@register("dataset_property_rates")
def q_dataset_property_rates(spark, sf):
    return ds.m_property_rates(_d(spark, sf), AS_OF)


@register("dataset_parent_child_services")
def q_dataset_parent_child_services(spark, sf):
    return ds.m_parent_child_service_aggregation(_d(spark, sf), AS_OF)


@register("dataset_property")
def q_dataset_property(spark, sf):
    return ds.m_property(_d(spark, sf))


@register("dataset_sud_properties")
def q_dataset_sud_properties(spark, sf):
    return ds.m_sud_properties(_d(spark, sf))


@register("dataset_mud_parent_properties")
def q_dataset_mud_parent_properties(spark, sf):
    return ds.m_mud_parent_properties(_d(spark, sf))


@register("dataset_sud_services")
def q_dataset_sud_services(spark, sf):
    return ds.m_sud_services(_d(spark, sf), AS_OF)


@register("dataset_bin_services_info")
def q_dataset_bin_services_info(spark, sf):
    return ds.m_bin_services_info(_d(spark, sf))


@register("dataset_sud_rates")
def q_dataset_sud_rates(spark, sf):
    return ds.m_sud_rates(_d(spark, sf), AS_OF)


@register("dataset_child_rates")
def q_dataset_child_rates(spark, sf):
    return ds.m_child_rates(_d(spark, sf), AS_OF)


@register("dataset_parent_rates")
def q_dataset_parent_rates(spark, sf):
    return ds.m_parent_rates(_d(spark, sf), AS_OF)


@register("dataset_sud_audit")
def q_dataset_sud_audit(spark, sf):
    return R.m_sud_audit(_d(spark, sf), AS_OF)


@register("dataset_mud_audit")
def q_dataset_mud_audit(spark, sf):
    return R.m_mud_audit(_d(spark, sf), AS_OF)


@register("dataset_mud_special_n0000ua")
def q_dataset_mud_special(spark, sf):
    return R.m_mud_special(_d(spark, sf), AS_OF)


_SINGLE_SOURCE = {
    "dataset_parent_properties": lambda d: ds.m_parent_properties(d),
    "dataset_child_properties": lambda d: ds.m_child_properties(d),
    "dataset_rate_assessment": lambda d: d.rate_assessment,
    "dataset_assessment_info": lambda d: ds.m_assessment_info(d),
    "dataset_property_services_facts": lambda d: ds.m_services_facts(d),
    "dataset_property_service_codes_custom": lambda d: d.property_service_codes_custom,
    "dataset_bin_services": lambda d: d.reg_bserv_bin_services,
    "dataset_rate_type_facts": lambda d: d.rate_type_facts,
    "dataset_rate_type": lambda d: d.rate_type,
    "dataset_current_rate_types": lambda d: ds.m_current_rate_types(d),
}
for _key, _build in _SINGLE_SOURCE.items():
    register(_key)(lambda spark, sf, build=_build: build(_d(spark, sf)))


@register("write_report")
def q_write_report(spark, sf):
    """J7 through the sink, with display headings, read back."""
    path = f"{checkpoint_dir(spark)}/tallyframe-reports/{uuid.uuid4().hex}"
    write_report(R.historic_services(_d(spark, sf), AS_OF), path,
                 headings={"tpklpaprop": "TPK", "number_of_services": "Number of services"})
    return spark.read.parquet(path)


def _mixed_codes(spark, sf):
    """Customers with their segment as a padded code in mixed case."""
    k = F.col("c_custkey")
    code = F.when(k % 3 == 0, F.lower("c_mktsegment")).when(k % 3 == 1, F.initcap("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return _t(spark, sf, "customer").select(k.alias("custkey"), F.col("c_acctbal").cast("decimal(18,2)").alias("balance"), F.concat(code, F.repeat(F.lit(" "), (k % 4).cast("int"))).alias("code"))


@register("group_collated")
def q_group_collated(spark, sf):
    """Codes loaded with a collation group whatever their case and padding."""
    rows = normalise_codes(_mixed_codes(spark, sf), ["code"], collation="UTF8_LCASE_RTRIM")
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.sum("balance").alias("balance")).select(
        F.lower(F.collate("code", "UTF8_BINARY")).alias("code"), "n", F.col("balance").cast("decimal(18,2)").alias("balance"))


@register("join_collated")
def q_join_collated(spark, sf):
    """Codes join per-code totals, and filter, whatever their case and padding."""
    rows = normalise_codes(_mixed_codes(spark, sf), ["code"], collation="UTF8_LCASE_RTRIM")
    totals = rows.where(F.col("code").isin("building", "Household")).groupBy(F.col("code").alias("total_code")).agg(F.count("*").alias("n"))
    return join_codes(rows, totals, "code", "total_code", "left").select("custkey", "n")


@register("publish_report")
def q_publish_report(spark, sf):
    """J7 published twice for one instant with a manifest; the second is what readers get."""
    path = f"{checkpoint_dir(spark)}/tallyframe-reports/{uuid.uuid4().hex}"
    report, as_of = R.historic_services(_d(spark, sf), AS_OF), AS_OF.isoformat(" ")
    publish_report(report.limit(0), path, as_of=as_of)
    publish_report(report, path, {"tpklpaprop": "TPK", "number_of_services": "Number of services"}, as_of=as_of)
    return read_report(spark, path, as_of)


# ============================================================================ 2.J reports
@register("report_single_nonmatch")
def q_report_single_nonmatch(spark, sf):
    return _report(spark, sf, lambda d: R.single_nonmatches(d, AS_OF), ("property",))


@register("report_single_match")
def q_report_single_match(spark, sf):
    return _report(spark, sf, lambda d: R.single_matches(d, AS_OF), ("property",))


@register("report_shared_nonmatch")
def q_report_shared_nonmatch(spark, sf):
    return _report(spark, sf, lambda d: R.shared_nonmatches(d, AS_OF), ("property",))


@register("report_shared_match")
def q_report_shared_match(spark, sf):
    return _report(spark, sf, lambda d: R.shared_matches(d, AS_OF), ("property",))


@register("report_rates_without_services")
def q_report_rates_without_services(spark, sf):
    return _report(spark, sf, lambda d: R.rates_without_services(d, AS_OF))


@register("report_services_without_rates")
def q_report_services_without_rates(spark, sf):
    return _report(spark, sf, lambda d: R.services_without_rates(d, AS_OF), ("property", "property_services_facts"))


@register("report_historic_services")
def q_report_historic_services(spark, sf):
    return _report(spark, sf, lambda d: R.historic_services(d, AS_OF), ("property",))


@register("report_mailing_audit")
def q_report_mailing_audit(spark, sf):
    return _report(spark, sf, lambda d: R.mailing_audit(d), ("cnaaddr",))


@register("report_services_without_rates_v2")
def q_report_services_without_rates_v2(spark, sf):
    return _report(spark, sf, lambda d: R.services_without_rates_m(d, AS_OF), ("property",))


@register("report_rates_without_services_v2")
def q_report_rates_without_services_v2(spark, sf):
    return _report(spark, sf, lambda d: R.rates_without_services_m(d, AS_OF), ("property",))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
