"""Benchmark: runs the headline reconciliation reports at $BENCH_SF_DIR on local[$BENCH_CPUS] and
prints one JSON line.

Each query is executed to completion through the ``noop`` sink (the whole plan runs, nothing is
collected to the driver).  Every query runs once to warm the JVM, then ``BENCH_REPS`` more times; the
recorded time is the best of those runs.  ``value`` is the sum of the recorded times and of
``register_write``, the time to derive and write all register tables and shared datasets that the
queries read, once.  ``shuffled`` holds the times of one more run of each report with
broadcast joins off, which is how the joins run on large registers; it is not part of ``value``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyframe import build_session  # noqa: E402
from tallyframe.plans.queries import REGISTRY  # noqa: E402
from tallyframe.sources.domain import refresh  # noqa: E402

HEADLINE = [
    "report_single_nonmatch", "report_single_match", "report_shared_nonmatch", "report_shared_match",
    "report_rates_without_services", "report_services_without_rates", "report_historic_services",
    "report_mailing_audit", "report_services_without_rates_v2", "report_rates_without_services_v2",
    "reconcile_pairs", "latest_effective", "join_inner", "window_sum_if", "agg_sum",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "2"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(f"local[{cpus}]", int(cpus) * 2)
    run = lambda name: REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(names[0])  # warms the JVM; the register tables are then written anew, with a clock
    refresh(spark, sf_dir)
    t0 = time.perf_counter()
    for name in names:  # building a query writes the register tables and datasets it needs
        REGISTRY[name](spark, sf_dir)
    times: dict[str, float] = {"register_write": round(time.perf_counter() - t0, 3)}
    for name in names:
        run(name)
        best = float("inf")
        for _ in range(reps):
            t0 = time.perf_counter()
            run(name)
            best = min(best, time.perf_counter() - t0)
        times[name] = round(best, 3)
    shuffled: dict[str, float] = {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name in [n for n in names if n.startswith("report_")]:
        t0 = time.perf_counter()
        run(name)
        shuffled[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus), "shuffled": shuffled}))
    refresh(spark, sf_dir)
    spark.stop()


if __name__ == "__main__":
    main()
