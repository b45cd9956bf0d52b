"""Side-by-side check of a Spark query against its DuckDB oracle (row count, column names and an
order-insensitive hash of the values), as the correctness gate does."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os

from tallyframe.sources.tables import DRIVER_TABLES


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return "b" + str(int(v))
    if isinstance(v, int):
        return "n" + str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return "n" + (str(int(v)) if v.is_integer() else repr(round(v, 6)))
    if isinstance(v, decimal.Decimal):
        return "n" + (str(int(v)) if v == v.to_integral_value() else format(v.normalize(), "f"))
    if isinstance(v, (dt.datetime, dt.date)):
        return "t" + v.isoformat()
    return "s" + str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, con, key, query, sql, sf_dir):
    df = query(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    out = {"key": key, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": sorted(c.lower() for c in s_cols) == sorted(c.lower() for c in d_cols)}
    out["values_match"] = out["columns_match"] and digest(s_cols, s_rows) == digest(d_cols, d_rows)
    out["ok"] = out["values_match"] and len(s_rows) == len(d_rows)
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = sorted(s_cols), sorted(d_cols)
    return out


def plan_summary(df) -> dict:
    """Operator counts of the executed (adaptive, after one run) physical plan of ``df``."""
    import re
    qe = df._jdf.queryExecution()
    qe.toRdd().count()                      # run this very plan (JVM side) so AQE finalises it
    plan = qe.executedPlan()
    text = (plan.executedPlan() if "Adaptive" in plan.nodeName() else plan).toString()
    text = re.sub(r"== Initial Plan ==.*?(?=\n\S|\Z)", "", text, flags=re.S)   # of subqueries
    ops = ["ShuffleExchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin",
           "ShuffledHashJoin", "HashAggregate", "Window", "CartesianProduct", "BroadcastNestedLoopJoin",
           "FileScan", "ReusedExchange"]
    count = {op: len(re.findall(op, text)) for op in ops}
    count["ShuffleExchange"] = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|"
                                              r"Exchange SinglePartition|Exchange RoundRobin", text))
    count["PushedFilters"] = len(re.findall(r"PushedFilters: \[[^\]]+\]", text))
    return count


def main(argv: list[str] | None = None) -> int:
    """``python -m tallyframe.plans.check SF_DIR [KEY ...]``: run queries against their oracle and
    print one JSON line per key; exit status 1 when any key differs."""
    import json
    import sys
    import time

    from tallyframe import build_session
    from tallyframe.plans.oracle import oracle_sql
    from tallyframe.plans.queries import queries

    args = sys.argv[1:] if argv is None else argv
    sf_dir, only = args[0], set(args[1:])
    spark = build_session("local[*]", 8)
    con = duck_connection(sf_dir)
    qs, sql = queries(), oracle_sql()
    failed = 0
    for key in qs:
        if only and key not in only:
            continue
        t0 = time.perf_counter()
        try:
            res = compare(spark, con, key, qs[key], sql[key], sf_dir)
        except Exception as exc:  # report and continue with the other keys
            res = {"key": key, "ok": False, "error": str(exc).splitlines()[0][:300]}
        res["sec"] = round(time.perf_counter() - t0, 2)
        failed += not res["ok"]
        print(json.dumps(res), flush=True)
    print(json.dumps({"failed": failed}))
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
