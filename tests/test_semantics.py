"""Micro-fixtures for the null, truncation and multiplicity rules of the source reports."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.numeric import dec_avg, int_avg, int_div, try_int
from tallyframe.functions.predicates import (active_all, active_any, code_flag, m_eq, m_ne,
                                             mismatch_flag, not_contains, not_ended)
from tallyframe.functions.text import concat_lines, rate_bin_type, rate_frequency, trim_end
from tallyframe.operators.joins import band_lookup, latest_effective, missing, nested_join

AS_OF = datetime(1998, 6, 1)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect()) if cols else \
        sorted(tuple(r) for r in df.collect())


def test_integer_average_and_division_truncate(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, -7)], "k int, x int")
    got = dict(df.groupBy("k").agg(int_avg("x").alias("a")).collect())
    assert got == {1: 1, 2: -7}
    r = df.select(int_div(F.col("x") * 0 - 7, F.lit(2)).alias("q"), int_div("x", F.lit(0)).alias("z")).first()
    assert r.q == -3 and r.z is None


def test_decimal_average_keeps_six_decimals(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "n int")
    v = df.agg(dec_avg("n").alias("a")).first().a
    assert str(v) == "1.666667"


def test_try_int_blank_as_zero(spark):
    df = spark.createDataFrame([("12",), ("",), ("BULK",), (None,)], "t string")
    assert [r[0] for r in df.select(try_int("t")).collect()] == [12, None, None, None]
    assert [r[0] for r in df.select(try_int("t", blank_as_zero=True)).collect()] == [12, 0, None, None]


def test_mismatch_flag_defaults_take_column_type(spark):
    df = spark.createDataFrame([(None, "0"), (None, None), ("SML", None), (None, "MED")], "a string, b string")
    assert [r[0] for r in df.select(mismatch_flag("a", "b", "0")).collect()] == ["No", "No", "Yes", "Yes"]


def test_code_flag_unknown_is_no(spark):
    df = spark.createDataFrame([("DWSSML01",), ("DWMSML01",), (None,)], "c string")
    assert [r[0] for r in df.select(code_flag("c", 3, "S")).collect()] == ["No", "Yes", "No"]


def test_active_forms(spark):
    df = spark.createDataFrame(
        [("C", None), ("H", None), ("H", datetime(1999, 1, 1)), ("C", datetime(1990, 1, 1))],
        "s string, e timestamp_ntz")
    assert [r[0] for r in df.select(active_any("s", "e", AS_OF)).collect()] == [True, None, True, True]
    assert [r[0] for r in df.select(active_all("s", "e", AS_OF)).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(not_ended("e", AS_OF)).collect()] == [True, True, True, False]


def test_concat_lines_null_first_line_keeps_separator(spark):
    df = spark.createDataFrame([(None, "b  ", None), ("a", None, "c"), (None, None, None)],
                               "a string, b string, c string")
    got = [r[0] for r in df.select(concat_lines("a", "b", "c")).collect()]
    assert got == [" \r\nb", "a \r\nc", ""]


def test_not_contains_literal_and_pattern(spark):
    df = spark.createDataFrame([("Level 1 ACME", "level 1 acme"), ("Level 1 X", "L%1"),
                                (None, "a")], "t string, p string")
    lit_ = [r[0] for r in df.select(not_contains("t", "p", pattern=False)).collect()]
    pat = [r[0] for r in df.select(not_contains("t", "p")).collect()]
    assert lit_ == [False, True, None]
    assert pat == [False, False, None]


def test_trim_end_and_rate_decoding(spark):
    df = spark.createDataFrame([("DWMmed02  ",), ("N0000UA",)], "r string")
    assert [r[0] for r in df.select(rate_bin_type("r")).collect()] == ["MED", "00U"]
    assert [r[0] for r in df.select(rate_frequency("r")).collect()] == [2, None]
    assert df.select(trim_end(F.lit("ab \t\r\n"))).first()[0] == "ab"


def test_m_equality_is_two_valued(spark):
    df = spark.createDataFrame([(None, None), (None, "x"), ("x", "x")], "a string, b string")
    assert [r[0] for r in df.select(m_eq("a", F.col("b"))).collect()] == [True, False, True]
    assert [r[0] for r in df.select(m_ne("a", F.col("b"))).collect()] == [False, True, False]


def test_nested_join_matches_null_keys(spark):
    left = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    right = spark.createDataFrame([(None, "n"), (2, "two")], "k int, name string")
    got = rows(nested_join(left, right, ["k"], ["k"], {"name": "name"}), "v", "name")
    assert got == [(1, "n"), (2, "two")]


def test_missing_keeps_matched_rows_with_null_column(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(2, None), (3, "x")], "k2 int, c string")
    got = rows(missing(left, right, F.col("k") == F.col("k2"), "c"), "k")
    assert got == [(1,), (2,)]


BANDS = [("sml", 0, 100, "SNG1"), ("med", 101, 200, "SNG1"), ("big", 0, 1000, "SHA1")]


def test_band_lookup(spark):
    bands = spark.createDataFrame(BANDS, "c_code string, c_minimum_value int, c_maximum_value int, "
                                         "c_calculation_method string")
    df = spark.createDataFrame([(80, "SNG1"), (150, "SNG1"), (150, "SHA1"), (None, "SNG1"), (999, "SNG1")],
                               "v int, m string")
    out = band_lookup(df, bands, "v", "band", by=("c_calculation_method", "m"))
    got = {(r.v, r.m): r.band for r in out.collect()}
    assert got == {(80, "SNG1"): "SML", (150, "SNG1"): "MED", (150, "SHA1"): "BIG",
                   (None, "SNG1"): None, (999, "SNG1"): None}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_band_lookup_overlap_is_an_error(spark):
    bands = spark.createDataFrame([("a", 0, 100), ("b", 50, 200)],
                                  "c_code string, c_minimum_value int, c_maximum_value int")
    df = spark.createDataFrame([(10,), (75,)], "v int")
    out = band_lookup(df, bands, "v", "band")
    with pytest.raises(Exception, match="more than one band"):
        out.collect()
    # a value outside the overlap is fine
    assert band_lookup(df.where("v = 10"), bands, "v", "band").first().band == "A"


def test_latest_effective_keeps_ties_nulls_and_null_keys(spark):
    df = spark.createDataFrame(
        [(1, "a", datetime(1995, 1, 1)), (1, "b", datetime(1997, 1, 1)), (1, "c", datetime(1997, 1, 1)),
         (1, "d", None), (2, "e", None), (None, "f", datetime(1990, 1, 1))],
        "k int, v string, d timestamp_ntz")
    got = sorted(r.v for r in latest_effective(df, ["k"], "d").collect())
    assert got == ["b", "c", "d", "e", "f"]
    again = latest_effective(latest_effective(df, ["k"], "d"), ["k"], "d")
    assert sorted(r.v for r in again.collect()) == got


def test_normalise_codes_with_case_insensitive_collation(spark):
    from tallyframe.sources.tables import normalise_codes
    df = spark.createDataFrame([("c   ",), ("C",), ("h",)], "status string")
    plain = normalise_codes(df, ["status"])
    assert plain.where(F.col("status") == "C").count() == 1
    ci = normalise_codes(df, ["status"], collation="UTF8_LCASE_RTRIM")
    assert ci.where(F.col("status") == "C").count() == 2


def test_eav_count_equals_counting_pairs(spark):
    from tallyframe.operators.joins import eav_count, eav_join
    df = spark.createDataFrame(
        [(1, "P", "k1"), (1, "S", "open"), (1, "S", "open"), (2, "P", "k1"), (2, "S", None),
         (3, "P", "k2"), (4, "S", "open"), (5, "P", None)], "e int, q string, v string")
    anchor, other = F.col("q") == "P", F.col("q") == "S"
    pairs = eav_join(df, "e", "q", "v", anchor, other, "key", "status")
    want = {r.key: r.n for r in pairs.groupBy("key").agg(F.count("status").alias("n")).collect()}
    got = {r.key: r.n for r in eav_count(df, "e", "v", anchor, other, "key", "n").collect()}
    assert got == want == {"k1": 2, "k2": 0, None: 0}


def test_left_join_skew_safe_keeps_null_keys_once(spark):
    from tallyframe.operators.joins import left_join_skew_safe
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (3, "d")], "k int, lv string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (3, None)], "rk int, rv string")
    got = sorted(map(tuple, left_join_skew_safe(left, right, "k", "rk").select("lv", "rk", "rv").collect()),
                 key=str)
    want = sorted(map(tuple, left.join(right, F.col("k") == F.col("rk"), "left")
                      .select("lv", "rk", "rv").collect()), key=str)
    assert got == want
