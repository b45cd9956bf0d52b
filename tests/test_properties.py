"""Properties of the reconciliation operators and plan-shape checks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe import AS_OF, refresh, update
from tallyframe.functions.predicates import not_contains
from tallyframe.operators.aggregates import over_keys, sum_if
from tallyframe.operators.joins import band_lookup, no_current
from tallyframe.operators.reconcile import (add_pair_counts, is_perfect_pairing, pair_by_key,
                                            reconcile, reconcile_matches, reconcile_nonmatches)
from tallyframe.plans import datasets as ds
from tallyframe.plans import reports as R
from tallyframe.plans.queries import REGISTRY
from tallyframe.sources.domain import Domain, domain


def test_perfect_pairing_rule(spark):
    codes = ["a", "b", "c", "d", "e"]
    for n in range(1, 6):
        left = spark.createDataFrame([(1, b) for b in codes[:n]], "k int, lb string")
        right = spark.createDataFrame([(1, b) for b in codes[:n]], "rk int, rb string")
        pairs = add_pair_counts(pair_by_key(left, right, "k", "rk"), ["k"], "lb", "rb")
        r = pairs.select(is_perfect_pairing("number_matched", "number_mismatched")).distinct().collect()
        assert [x[0] for x in r] == [True], n
    n = 3
    left = spark.createDataFrame([(1, b) for b in codes[:n]], "k int, lb string")
    right2 = spark.createDataFrame([(1, "a"), (1, "b"), (1, "x")], "rk int, rb string")
    pairs2 = add_pair_counts(pair_by_key(left, right2, "k", "rk"), ["k"], "lb", "rb")
    assert [x[0] for x in pairs2.select(is_perfect_pairing("number_matched", "number_mismatched"))
            .distinct().collect()] == [False]


def test_matches_and_nonmatches_are_disjoint(spark):
    left = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (3, None, 1)],
                                 "k int, lb string, lf int")
    right = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "b", 1)], "rk int, rb string, rf int")
    df = reconcile(left, right, "k", "rk",
                   compare={"f1": ("lb", "rb", "0"), "f2": ("lf", "rf", 0)}, pair_on=("lb", "rb"))
    m = {tuple(r) for r in reconcile_matches(df, ["f1", "f2"]).select("k", "lb", "rb").collect()}
    x = {tuple(r) for r in reconcile_nonmatches(df, ["f1", "f2"]).select("k", "lb", "rb").collect()}
    assert m and x and not (m & x)


def test_single_dwelling_reports_are_disjoint(spark, sf_small):
    d = domain(spark, sf_small)
    key = ["property_key", "service_bin_type", "service_frequency", "rate_type_key"]
    m = {tuple(r) for r in R.single_matches(d, AS_OF).select(*key).collect()}
    x = {tuple(r) for r in R.single_nonmatches(d, AS_OF).select(*key).collect()}
    assert m and x and not (m & x)


def test_over_keys_equals_window_under_skew(spark):
    rnd = random.Random(7)
    data = [(0 if rnd.random() < 0.34 else rnd.choice([1, 2, 3, None]), rnd.randint(0, 5))
            for _ in range(3000)]
    df = spark.createDataFrame(data, "k int, v int").withColumn("id", F.monotonically_increasing_id())
    aggs = {"n": F.count("v"), "s": sum_if(F.col("v") > 2), "t": F.sum("v")}
    w = Window.partitionBy("k")
    b = df.withColumns({k: v.over(w) for k, v in aggs.items()})
    cols = ["id", "k", "v", "n", "s", "t"]
    want = sorted(map(tuple, b.select(*cols).collect()), key=str)
    for null_safe in (True, False):
        a = over_keys(df, ["k"], aggs, null_safe=null_safe)
        assert sorted(map(tuple, a.select(*cols).collect()), key=str) == want
        plan = a._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "NestedLoop" not in plan


def test_union_by_name_is_column_order_invariant(spark, sf_small):
    df = REGISTRY["union_by_name"](spark, sf_small)
    a = sorted(map(tuple, df.select("name", "nationkey", "segment").collect()), key=str)
    b = sorted(map(tuple, df.select("segment", "name", "nationkey").select("name", "nationkey", "segment")
                   .collect()), key=str)
    assert a == b


def test_no_cartesian_products_in_reports(spark, sf_small):
    for key in [k for k in REGISTRY if k.startswith("report_")]:
        plan = REGISTRY[key](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, key
        assert "BroadcastNestedLoopJoin" not in plan, key
        assert "Window" not in plan, key


def test_reports_scan_materialised_registers(spark, sf_small):
    df = REGISTRY["report_single_nonmatch"](spark, sf_small)
    files = df.inputFiles()
    # tables with a join are read from the store, columns of one driver table are derived in the scan
    assert any("tallyframe-domain" in f for f in files)
    assert not any("lineitem" in f or "orders" in f for f in files)


def test_reports_non_empty(spark, sf_small):
    for key in [k for k in REGISTRY if k.startswith("report_")]:
        assert REGISTRY[key](spark, sf_small).count() > 0, key


def test_pairing_splits_a_hot_right_key(spark):
    """One key holds a third of the right side: the pairing must equal a plain left join, and AQE
    must be able to split the hot partition (it cannot for the right side of a left join)."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        left = spark.range(0, 200).select((F.col("id") % 100).alias("k"), F.col("id").alias("lv"))
        hot = spark.range(0, 3000).select(F.lit(7).alias("rk"), F.col("id").alias("rv"))
        cold = spark.range(0, 6000).select((F.col("id") % 150).alias("rk"), (F.col("id") + 10 ** 6).alias("rv"))
        right = hot.unionByName(cold)
        got = pair_by_key(left, right, "k", "rk")
        want = left.join(right, F.col("k") == F.col("rk"), "left")
        a = sorted(map(tuple, got.select("k", "lv", "rk", "rv").collect()), key=str)
        b = sorted(map(tuple, want.select("k", "lv", "rk", "rv").collect()), key=str)
        assert a == b
        got.collect()
        final = got._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in final and "skew=true" in final
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_dedupe_owners_counts_pairs_once(spark, sf_small):
    d = domain(spark, sf_small)
    base = R._single_pairs(d, AS_OF, contacts=False)
    want = {r.tpklpaprop: (r.number_bin_matched, r.number_bin_mismatched)
            for r in base.select("tpklpaprop", "number_bin_matched", "number_bin_mismatched").collect()}
    dedup = R.single_nonmatches(d, AS_OF, dedupe_owners=True)
    got = {r.tpklpaprop: (r.number_bin_matched, r.number_bin_mismatched)
           for r in dedup.select("tpklpaprop", "number_bin_matched", "number_bin_mismatched").collect()}
    assert got and all(want[k] == v for k, v in got.items())
    parity = R.single_nonmatches(d, AS_OF)
    joint = {r.property_key for r in d.property_owners.where("owner_seq = 2").collect()}
    doubled = [r for r in parity.select("property_key", "tpklpaprop", "number_bin_matched").collect()
               if r.property_key in joint and want[r.tpklpaprop][0] > 0]
    assert all(r.number_bin_matched >= 2 * want[r.tpklpaprop][0] for r in doubled)


def test_write_report_with_headings(spark, sf_small, tmp_path):
    from tallyframe.sources.tables import write_report
    df = REGISTRY["report_historic_services"](spark, sf_small)
    out = str(tmp_path / "historic")
    write_report(df, out, headings={"tpklpaprop": "TPK", "number_of_services": "Number of services"})
    back = spark.read.parquet(out)
    assert "TPK" in back.columns and "Number of services" in back.columns
    assert back.count() == df.count()


def test_filters_and_columns_reach_the_scan(spark, sf_small):
    plan = REGISTRY["filter_prefix"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_type), StringStartsWith(p_type,SMALL)]" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string>" in plan
    plan = REGISTRY["active_and"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_linestatus,F)" in plan


def test_scale_plans_at_sf01(spark):
    """J1 and J10 at sf0.1: no Cartesian product or nested-loop join, per-key totals without Window
    operators."""
    sf = "/root/testdata/sf0.1"
    for key in ["report_single_nonmatch", "report_rates_without_services_v2"]:
        df = REGISTRY[key](spark, sf)
        assert df.count() > 0
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, key
        assert "Window" not in plan, key


BANDS = "c_code string, c_minimum_value int, c_maximum_value int, c_calculation_method string"


def _bands(n, methods):
    """n bands of widths 1, 2, 3 ... 40, 1, ... side by side, with a gap after every seventh."""
    out, at = [], -50
    for i in range(n):
        out.append((f"b{i}", at, at + i % 40, methods[i % len(methods)]))
        at += i % 40 + 1 + (i % 7 == 6)
    return out


@pytest.mark.parametrize("n", [0, 4, 300, 10_000])
@pytest.mark.parametrize("keyed", [False, True])
def test_band_lookup_is_one_plan_at_any_size(spark, n, keyed):
    bands = _bands(n, ["X1", "Y2"])
    rnd = random.Random(n)
    top = max([100, *[b[2] for b in bands]])
    rows = [(i, rnd.choice([None, 7, rnd.randint(-60, top + 20)]), rnd.choice(["X1", "Y2", "Z", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v int, m string")
    got = band_lookup(df, spark.createDataFrame(bands, BANDS), "v", "band", by=("c_calculation_method", "m") if keyed else None)
    at = {(v, m): c.upper() for c, lo, hi, m in bands for v in range(lo, hi + 1)}
    any_at = {v: c for (v, _), c in at.items()}
    want = [(i, v, m, at.get((v, m)) if keyed else any_at.get(v)) for i, v, m in rows]
    assert sorted(map(tuple, got.collect())) == sorted(want, key=lambda r: r[0])


@pytest.mark.parametrize("n", [2, 10_000])
def test_two_bands_are_an_error(spark, n):
    bands = spark.createDataFrame([*_bands(n, ["X1"]), ("twice", 5000000, 5000100, "X1"), ("again", 5000050, 5000060, "X1")], BANDS)
    ok = spark.createDataFrame([(5000010,), (None,)], "v int")
    assert [r.band for r in band_lookup(ok, bands, "v", "band").orderBy("v").collect()] == [None, "TWICE"]
    bad = spark.createDataFrame([(5000055,)], "v int")
    for by in (None, ("c_calculation_method", F.lit("X1"))):
        with pytest.raises(Exception, match="more than one band"):
            band_lookup(bad, bands, "v", "band", by=by).collect()


def test_reports_are_ordered(spark, sf_small):
    for key, by in {"report_single_nonmatch": ["tpklpaprop"], "report_single_match": ["tpklpaprop"],
                    "report_shared_nonmatch": ["parent_tpklpaprop", "tpklpaprop"],
                    "report_shared_match": ["parent_tpklpaprop", "tpklpaprop"],
                    "report_rates_without_services": ["tpklpaprop"],
                    "report_services_without_rates": ["parent_tpklpaprop", "child_tpklpaprop"],
                    "report_historic_services": ["tpklpaprop"]}.items():
        rows = [tuple((v is not None, v) for v in r) for r in REGISTRY[key](spark, sf_small).select(*by).collect()]
        assert rows == sorted(rows) and rows, key


def _small_folder(spark, sf_small, path, customers):
    for t in ("customer", "nation", "orders", "lineitem", "events", "supplier"):
        df = spark.read.parquet(f"{sf_small}/{t}.parquet")
        (df.where(F.col("c_custkey") < customers) if t == "customer" else df).write.parquet(f"{path}/{t}.parquet")
    return str(path)


def test_folders_of_the_same_name_do_not_share_registers(spark, sf_small, tmp_path):
    a, b = (_small_folder(spark, sf_small, tmp_path / x / "sfx", n) for x, n in (("a", 20), ("b", 30)))
    assert domain(spark, a).property.count() == 20 and domain(spark, b).property.count() == 30
    assert domain(spark, a).property.count() == 20


def test_registers_are_written_on_first_use_and_refreshed(spark, sf_small, tmp_path):
    import os
    path = _small_folder(spark, sf_small, tmp_path / "sf", 20)
    REGISTRY["hierarchy_parent"](spark, path).collect()
    store = domain(spark, path).store.removeprefix("file:")
    assert os.listdir(store) == ["property"]
    spark.read.parquet(f"{sf_small}/customer.parquet").where("c_custkey >= 20").write.mode("append").parquet(f"{path}/customer.parquet")
    assert domain(spark, path).property.count() == 20
    refresh(spark, path)
    assert not os.path.exists(store)
    assert domain(spark, path).property.count() == spark.read.parquet(f"{sf_small}/customer.parquet").count()
    refresh(spark, path)


@pytest.mark.parametrize("bucketed", [False, True])
def test_added_files_are_added_to_the_registers(spark, sf_small, tmp_path, monkeypatch, bucketed):
    """After files are added only what follows from them is derived, and all is as if derived anew."""
    monkeypatch.setattr(Domain, "BUCKETED_ROWS", 0 if bucketed else 10**9)
    monkeypatch.setattr(Domain, "HOT", 10**9)
    whole = {t: spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("customer", "nation", "orders", "lineitem", "events", "supplier")}
    path = str(tmp_path / "sf")
    split = {"orders": F.col("o_orderkey") % 3, "lineitem": F.col("l_orderkey") % 5, "customer": F.floor(F.col("c_custkey") / 100)}
    for t, df in whole.items():
        (df.where(split[t] == 0) if t in split else df).write.parquet(f"{path}/{t}.parquet")
    add = lambda t, n: whole[t].where(split[t] == n).write.mode("append").parquet(f"{path}/{t}.parquet")
    keys = ["register_totals", "report_single_nonmatch", "report_rates_without_services", "report_mailing_audit"]
    views = ["property", "property_services_facts", "rate_type_facts", "cnaaddr"]

    def rows(df):
        return sorted(map(repr, df.collect()))

    def check(expected, tables):
        d = domain(spark, path)
        start = len(d.log)
        assert update(spark, path) == expected
        got = {v: rows(d.view(v)) for v in views} | {k: rows(REGISTRY[k](spark, path)) for k in keys}
        log = [t for t in d.log[start:] if not t.startswith("datasets/")]
        assert sorted(log) == sorted(tables)
        assert all(bool(d._buckets.get(v)) == bucketed for v in views)
        anew = Domain(spark, path)
        assert got | {v: rows(anew.view(v)) for v in views} == got
        totals = anew.totals("property_services_facts", "property_key", "number_of_services", "number_of_collections")
        assert got["register_totals"] == rows(totals)
        return len(d.log) - start

    for k in keys:
        REGISTRY[k](spark, path).collect()
    assert check(dict.fromkeys(views, "kept"), []) == 0  # datasets stay too
    add("lineitem", 1)
    kept = dict.fromkeys(views, "kept")
    assert check({**kept, "property_services_facts": "added"}, ["property_services_facts+", "totals of property_services_facts+"]) > 2
    add("lineitem", 2)
    add("orders", 1)  # new lines of old orders, old lines of new orders, new lines of new orders
    check({**kept, "property_services_facts": "added", "rate_type_facts": "added"},
          ["property_services_facts+", "totals of property_services_facts+", "rate_type_facts+"])
    add("customer", 1)  # old orders' rates depend on the customer
    check({**dict.fromkeys(views, "added"), "rate_type_facts": "dropped"},
          ["property+", "cnaaddr+", "property_services_facts+", "totals of property_services_facts+", "rate_type_facts"])
    refresh(spark, path)


def _exchanges(df) -> int:
    from tallyframe.plans.check import plan_summary
    return plan_summary(df)["ShuffleExchange"]


def test_bucketed_registers_save_shuffles(spark, sf_small, tmp_path, monkeypatch):
    """Tables in buckets of the property key give the same reports with fewer shuffles."""
    from tallyframe.sources.domain import Domain
    path = str(tmp_path / "sf")
    for name in ("customer", "orders", "lineitem", "supplier", "nation", "events"):
        spark.read.parquet(f"{sf_small}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    keys = ("report_single_nonmatch", "report_rates_without_services", "report_historic_services")
    try:
        found = {}
        for rows in (10**9, 0):
            monkeypatch.setattr(Domain, "BUCKETED_ROWS", rows)
            refresh(spark, path)
            frames = {k: REGISTRY[k](spark, path) for k in keys}
            found[rows] = {k: (df.collect(), _exchanges(df)) for k, df in frames.items()}
            tables = list(domain(spark, path)._tables)
            assert bool(tables) == (rows == 0)
        for k in keys:
            assert found[0][k][0] == found[10**9][k][0] and found[0][k][1] < found[10**9][k][1], k
        assert found[0]["report_historic_services"][1] <= 1  # the sort
        refresh(spark, path)
        assert tables and not any(spark.catalog.tableExists(t) for t in tables)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_hot_key_is_not_bucketed(spark, sf_small, tmp_path, monkeypatch):
    from tallyframe.sources.domain import Domain
    monkeypatch.setattr(Domain, "BUCKETED_ROWS", 0)
    path = _small_folder(spark, sf_small, tmp_path / "sf", 20)
    d = domain(spark, path)
    hot = spark.range(3000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("k"))
    assert not any("buckets" in f for f in d.keep("hot", hot, "k").inputFiles())
    even = d.keep("even", spark.range(3000).withColumnRenamed("id", "k"), "k")
    assert all("buckets" in f for f in even.inputFiles()) and even.count() == 3000
    refresh(spark, path)


def test_reconciliation_moves_current_facts_only(spark, sf_small, tmp_path):
    """Facts that ended are neither written nor joined for a reconciliation; written registers give the same rows."""
    path = str(tmp_path / "sf")
    for name in ("customer", "orders", "lineitem", "nation", "events"):
        spark.read.parquet(f"{sf_small}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    rows = lambda df: sorted(map(repr, df.collect()))
    try:
        got = rows(REGISTRY["reconcile_nonmatch"](spark, path))
        d = domain(spark, path)
        assert got and all(t.startswith("datasets/") for t in d.log)
        for key in ("report_services_without_rates_v2", "report_historic_services", "report_shared_nonmatch", "current_services"):
            REGISTRY[key](spark, path).collect()
        assert {t for t in d.log if not t.startswith("datasets/")} == {"property"}
        services, rates = ds.active_red_services(d, AS_OF), ds.current_rate_facts(d, AS_OF)
        assert 0 < services.count() < d.property_services_facts.count() / 2 and 0 < rates.count() < d.rate_type_facts.count() / 2
        # now that the registers are written, datasets are derived from them
        was = rows(services), rows(rates)
        d.__dict__.pop("_dataset_memo")
        assert (rows(ds.active_red_services(d, AS_OF)), rows(ds.current_rate_facts(d, AS_OF))) == was
        assert d.property.count() and rows(REGISTRY["reconcile_nonmatch"](spark, path)) == got
        # the filters of a dataset stand below the join with the orders
        anew = Domain(spark, path)
        plan = anew.derived("property_services_facts").where((F.col("status") == "C") & (F.col("service_code") == "R0002"))
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "l_returnflag" in text.split("Join", 1)[1] and "Filter" not in text.split("Join", 1)[0]
    finally:
        refresh(spark, path)


def test_report_order_splits_a_hot_key(spark):
    """A property with a third of all rows spreads over many sort tasks; the order is total."""
    from tallyframe.plans.reports import sorted_report
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 42).otherwise(F.col("id")).alias("tpklpaprop"),
                                      (F.col("id") * 7919 % 60_000).alias("ratetype"), F.when(F.col("id") % 5 > 0, "x").alias("suburb"))
    # adaptive coalescing would join small parts again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = sorted_report(rows.repartition(8), "tpklpaprop").withColumn("task", F.spark_partition_id())
        hot = out.where("tpklpaprop = 42").groupBy("task").count().collect()
        assert len(hot) >= 2 and max(r["count"] for r in hot) < 12_000
        got = [(r.tpklpaprop, r.ratetype, r.suburb is not None, r.suburb) for r in out.collect()]
        assert got == sorted(got)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_folder_no_cluster_run():
    from types import SimpleNamespace as N
    from tallyframe.session import checkpoint_dir
    conf = N(get=lambda *a: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(N(sparkContext=N(getConf=lambda: conf, getCheckpointDir=lambda: None, master="yarn")))


def test_wall_clock_means_the_same_everywhere(spark):
    """``as_of=None``: an end date in the future keeps a rate or service in SQL and M datasets alike."""
    from datetime import datetime, timedelta

    from tests_fixture import build
    future, past = datetime.now() + timedelta(days=900), datetime(1999, 1, 1)
    d = build(spark, 1)
    for end, n in ((future, 1), (past, 0)):
        d.__dict__.pop("_dataset_memo", None)
        d._views["rate_type_facts"] = spark.createDataFrame([(1, 1, 2, 0, 501, end)], d._views["rate_type_facts"].schema)
        assert ds.m_property_rates(d, None).count() == ds.current_rates(d, None).count() == n
        assert ds.m_sud_rates(d, None).count() == n


HOT = {"spark.sql.autoBroadcastJoinThreshold": "-1",
       "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
       "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
       "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
       "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture()
def hot_conf(spark):
    old = {k: spark.conf.get(k, None) for k in HOT}
    for k, v in HOT.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _hot_registers(spark):
    """A third of all children and rates hang on one parent."""
    from tests_fixture import SCHEMAS, build
    d = build(spark, 2)
    day = None
    p = spark.range(200, 3200).selectExpr("id", "if(id % 3 = 0, 41, 100 + id % 97) parent").selectExpr(
        "id property_key", "1000 + id tpklpaprop", "cast(parent as bigint) parent_property_key", "1000 + parent parent_property_tpklpaprop",
        "'C' status", "'RESIDENCE' property_type", *[f"concat('{c} ', id) {c}" for c in ("formatted_address", "address", "suburb", "street",
        "parent_property_address", "formatted_owner_name")], *[f"cast(null as string) owners_na_slab_{i}" for i in range(1, 6)],
        "500 + id assessment_key", "700 + id assessment")
    r = spark.range(200, 3200).selectExpr("id property_key", "id rate_type_key", "1 units", "cast(9 as bigint) ratetype_key",
                                          "500 + id assessment_key", "cast(null as timestamp_ntz) suspended_date")
    a = spark.range(200, 3200).selectExpr("500 + id assessment_key", "700 + id assessment", "string(id) vgnumber", "1000 + id tfklpaprop",
                                          *[f"'line' ratepayer_address_{i}" for i in range(1, 6)])
    d._views["property"] = d._views["property"].unionByName(p.select(*d._views["property"].columns))
    d._views["rate_type_facts"] = d._views["rate_type_facts"].unionByName(r)
    d._views["rate_assessment"] = d._views["rate_assessment"].unionByName(a)
    d.__dict__.pop("_dataset_memo", None)
    assert SCHEMAS and day is None
    return d


@pytest.mark.parametrize("case", ["shared", "sud"])
def test_hot_parents_are_split(spark, hot_conf, case):
    """J3 and the single-dwelling properties with a third of all children under one parent: the final
    plan splits the hot key or leaves it out, and the rows equal the plain form's."""
    d = _hot_registers(spark)
    if case == "shared":
        got = ds.shared_volume(d, AS_OF)
        parents, rates = ds.shared_parents(d, AS_OF), ds.shared_child_rates(d, AS_OF)
        want = parents.join(rates, F.col("parent_key") == F.col("parent_property_key"), "left")
        cols = ["parent_key", "property_key", "rate_type_key"]
    else:
        got = ds.m_sud_properties(d)
        kids = {r[0] for r in ds.m_property(d).select("parent_property_key").collect()}
        want = ds.m_parent_properties(d).where(~F.col("property_key").isin([k for k in kids if k is not None]))
        cols = ["property_key"]
    rows = sorted(map(tuple, got.select(*cols).collect()), key=str)
    assert rows == sorted(map(tuple, want.select(*cols).collect()), key=str) and rows
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    if case == "shared":
        assert "skew=true" in final
    else:  # children without a parent, more than half of the register, are not dealt out at all
        assert "coalesce(parent_property_key" not in final and "isnotnull(parent_property_key" in final


def test_services_of_a_hot_property_are_summed_first(spark, hot_conf):
    """J5, J6 and the family aggregation meet a property's services as a row per code activity."""
    d = _hot_registers(spark)
    facts = d._views["property_services_facts"]
    one = facts.where("service_code IS NOT NULL").first()
    hot = spark.range(6000).selectExpr("if(id % 3 = 0, 41L, 200 + id % 900) property_key").select(
        "property_key", *[F.lit(one[f.name]).cast(f.dataType).alias(f.name) for f in facts.schema if f.name != "property_key"])
    d._views["property_services_facts"] = facts.unionByName(hot)
    sums = R._sums_per_activity(d, F.lit(True), "active", {"n": F.col("ps_n")})
    assert sums.groupBy("__ps_key").count().agg({"count": "max"}).first()[0] <= 4
    assert sums.agg({"ps_rows": "sum"}).first()[0] == d.property_services_facts.where("property_key IS NOT NULL").count()
    for report in (R.rates_without_services, R.services_without_rates, ds.m_parent_child_service_aggregation):
        plan = report(d, AS_OF)
        plan.collect()
        final = plan._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in final and "BroadcastNestedLoopJoin" not in final


def test_attributes_of_a_hot_entity(spark, hot_conf):
    from tallyframe.operators.joins import eav_join, eav_pivot
    df = spark.range(9000).selectExpr("if(id % 3 = 0, 7, id) e", "if(id % 2 = 0 AND id <> 6, 'S', if(id % 9 = 1 OR id = 6, 'P', 'X')) q", "string(id) v")
    anchor, other = F.col("q") == "P", F.col("q") == "S"
    got = eav_join(df, "e", "q", "v", anchor, other, "p", "s")
    a, o = df.where(anchor).select("e", F.col("v").alias("p")), df.where(other).select("e", F.col("v").alias("s"))
    want = a.join(o, "e", "left")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "skew=true" in final
    wide = eav_pivot(df, "e", "q", "v", {"P": "p", "S": "s"}, unique=False)
    assert wide.count() == df.select("e").distinct().count()
    assert wide.where("e = 7").select("s_rows").first()[0] == df.where("e = 7 AND q = 'S'").count()
    plain = df.where("e <> 7")
    one = {r["e"]: (r["p"], r["s"]) for r in eav_pivot(plain, "e", "q", "v", {"P": "p", "S": "s"}).collect()}
    assert one == {r["e"]: (r["v"] if r["q"] == "P" else None, r["v"] if r["q"] == "S" else None) for r in plain.collect()}
    with pytest.raises(Exception, match="more than one value"):
        eav_pivot(df, "e", "q", "v", {"S": "s"}).collect()


def test_no_current_matches_not_exists(spark):
    left = spark.createDataFrame([(1, None), (2, "x"), (3, None), (None, "y"), (4, "z")], "k int, code string")
    facts = spark.createDataFrame([(2, "C"), (2, "C"), (3, "C"), (4, "H"), (4, None), (None, "C")], "fk int, status string")
    plain = no_current(left, facts, "k", "fk", F.col("status") == "C")
    assert sorted((r.k is None, r.k) for r in plain.collect()) == [(False, 1), (False, 4), (True, None)]
    unless = no_current(left, facts, "k", "fk", F.col("status") == "C", unless=F.col("code").isNull())
    assert {r.k for r in unless.collect()} == {1, 3, 4, None}


def test_like_patterns(spark):
    cases = [("Level 1 North", "LEVEL 1", True), ("Level 1", "L%1", True), ("Level 1", "Level _", True), ("Level", "Level_", False),
             ("a[b", "[", False), ("a[b", "[[]b", True), ("a]b", "]b", True), ("abc", "[^b]c", False), ("axc", "[^b]c", True),
             ("a5", "a[0-9]", True), ("a^", "a[x^]", True), ("a.b", "a.b", True), ("axb", "a.b", False), ("a\\b", "\\b", True),
             ("a\nb", "a%b", True), ("(x)", "(x)", True), ("a$", "$", True), ("ab", "[]", False), ("a&&b", "a[&]", True), ("abc", "", True)]
    df = spark.createDataFrame(cases, "t string, p string, hit boolean")
    for r in df.withColumn("no", not_contains("t", "p")).collect():
        assert r.no == (not r.hit), r
    assert df.select(not_contains(F.lit("50% off"), F.lit("0% o"), pattern=False)).first()[0] is False


def test_published_report_survives_a_failed_write(spark, tmp_path):
    """A job that fails leaves the former report; instants are kept apart; superseded data is deleted."""
    import os

    from tallyframe.sources.tables import publish_report, read_report, report_instants
    path = str(tmp_path / "report")
    with pytest.raises(FileNotFoundError):
        read_report(spark, path)
    first = spark.range(5).select("id", F.lit("a").alias("v"))
    publish_report(first, path, {"v": "Display heading"})
    assert read_report(spark, path).columns == ["id", "Display heading"]
    failing = spark.range(5).select("id", F.when(F.col("id") == 4, F.raise_error(F.lit("lost"))).cast("string").alias("v"))
    with pytest.raises(Exception, match="lost"):
        publish_report(failing, path)
    assert read_report(spark, path).count() == 5 and len(os.listdir(f"{path}/_data")) >= 1
    publish_report(spark.range(7).toDF("n"), path)
    assert read_report(spark, path).columns == ["n"] and read_report(spark, path).count() == 7
    assert len([d for d in os.listdir(f"{path}/_data") if not d.startswith(".")]) == 1  # the failed one and the former one are gone
    for as_of, n in (("1998-06-01 00:00:00", 2), ("1998-07-01 00:00:00", 3), ("1998-06-01 00:00:00", 4)):
        publish_report(spark.range(n), path, as_of=as_of)
    assert report_instants(spark, path) == ["1998-06-01 00:00:00", "1998-07-01 00:00:00"]
    assert read_report(spark, path, "1998-06-01 00:00:00").count() == 4
    assert read_report(spark, path, "1998-07-01 00:00:00").count() == 3 and read_report(spark, path).count() == 7
    publish_report(spark.range(0), path)
    assert read_report(spark, path).count() == 0
