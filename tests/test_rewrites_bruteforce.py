"""The reports and pre-aggregated rewrites (J5 branches, J6, M parent x child aggregation) against the
SQL oracle, which pairs rows, on small random registers full of nulls, evaluated by DuckDB."""

import os
import random
from datetime import datetime

import pytest

from tallyframe import AS_OF
from tallyframe.plans import datasets as ds
from tallyframe.plans import oracle as O
from tallyframe.plans import reports as R
from tallyframe.plans.check import digest

from tests_fixture import SCHEMAS, FixtureDomain, build

def duck_for(d):
    import duckdb
    con = duckdb.connect()
    for name in list(SCHEMAS) + ["rate_type", "property_service_codes_custom", "reg_bband_bin_bands"]:
        con.register(name, d.view(name).toArrow())
    return con


def shared_sql(body: str, names: list[str]) -> str:
    return O._prefixed([f"{n} AS ({O.SHARED_CTES[n]})" for n in names], body)


CASES = {
    "pcsa": (lambda d: ds.m_parent_child_service_aggregation(d, AS_OF),
             shared_sql("SELECT * FROM m_pcsa", O.M_BASE[:O.M_BASE.index("m_pcsa") + 1])),
    "mud_audit": (lambda d: R.m_mud_audit(d, AS_OF), shared_sql("SELECT * FROM m_mud_audit", O.M_BASE)),
}
for _key, _fn in [("report_single_nonmatch", R.single_nonmatches), ("report_single_match", R.single_matches),
                  ("report_shared_nonmatch", R.shared_nonmatches), ("report_shared_match", R.shared_matches),
                  ("report_historic_services", R.historic_services),
                  ("report_rates_without_services", R.rates_without_services),
                  ("report_services_without_rates", R.services_without_rates),
                  ("report_services_without_rates_v2", R.services_without_rates_m),
                  ("report_rates_without_services_v2", R.rates_without_services_m)]:
    # the registered oracle without its register views: the fixture tables are read instead
    CASES[_key] = (lambda d, f=_fn: f(d, AS_OF), _key)


SEEDS = [int(x) for x in os.environ.get("BRUTE_SEEDS", "1,2,3,4").split(",")]
NONEMPTY: dict[str, int] = {}


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("case", sorted(CASES))
def test_rewrite_matches_literal_sql(spark, seed, case):
    d = build(spark, seed)
    con = duck_for(d)
    job, sql = CASES[case]
    if sql in O.ORACLE:
        sql = O.oracle_over_registers(sql)
    df = job(d)
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    assert sorted(c.lower() for c in df.columns) == sorted(c.lower() for c in d_cols)
    assert len(s_rows) == len(d_rows)
    assert digest(df.columns, s_rows) == digest(d_cols, d_rows)
    NONEMPTY[case] = NONEMPTY.get(case, 0) + (1 if s_rows else 0)


def test_fixtures_exercise_every_case():
    """Runs after the parametrised cases: each one produced rows for at least one seed."""
    assert set(NONEMPTY) == set(CASES) and all(NONEMPTY.values()), NONEMPTY


FINANCE = {
    "crgntry": "tpkcrgntry bigint, tfkcrgregs int, keyval string",
    "crgregv": "tpkcrgregv bigint, tfkcrgntry bigint, tfkcrgfeld int, regfldvalu string",
    "crgrole": "tfklocl bigint, fkcrgrolta string, fkcrgroltn int, status string, tfkappl bigint",
    "cnaidty": "tpkcnaidty bigint, formatname string",
    "cnaaddr": "tpkcnaaddr bigint, formataddr string",
    "cnaidta": "tfkcnaidty bigint, tfkcnaaddr bigint, dateeffect timestamp_ntz",
    "lrantgp": "tpklrantgp bigint, ntgpcode string",
    "lraassm": "tpklraassm bigint, tfklrantgp bigint, assmnumber string, status string",
    "cnarole": "tpkcnarole bigint, tfkappl bigint, fkcnarolta string, fkcnaroltn int, status string, "
               "tfkcnaidty bigint",
    "cnarola": "tfkcnarole bigint, tfkcnaaddr bigint, isactive int, dateeffect timestamp_ntz",
}


def random_finance(seed: int) -> dict[str, list[tuple]]:
    rnd = random.Random(seed)
    pick = rnd.choice
    dates = [None, datetime(1995, 1, 1), datetime(1997, 1, 1), datetime(1997, 1, 1)]
    entries = [(s, pick([84, 84, 85]), f"E{s}") for s in range(1, 9)]
    regv = [(2 * s, s, 953, pick([f"NG{s % 4}", None])) for s in range(1, 9)]
    regv += [(2 * s + 1, s, 954, None) for s in range(1, 9)]
    roles = [(2 * s + 1, pick(["cna", "cna", "x"]), 1, pick(["c", "c", "h"]), -s) for s in range(1, 9)]
    idty = [(-s, f"agent {s}") for s in range(1, 9)] + [(k, f"payer {k}") for k in range(1, 31)]
    addr = [(-s, pick([f"Level {s}", f"Level {s}%", None])) for s in range(1, 9)]
    addr += [(100 + k, pick([f"c/o Level {k % 8}", f"{k} Main St", None, f"C/O LEVEL {k % 8}"]))
             for k in range(1, 61)]
    idta = [(-s, -s, pick(dates)) for s in range(1, 9)]
    idta += [(rnd.randint(1, 30), 100 + rnd.randint(1, 60), pick(dates)) for _ in range(70)]
    groups = [(g, f"NG{g}") for g in range(0, 4)]
    assm = [(k, rnd.randint(0, 4), str(k), pick(["c", "c", "h"])) for k in range(1, 31)]
    prole = [(k, k, "lra", pick([0, 0, 1]), "c", rnd.randint(1, 30)) for k in range(1, 31)]
    rola = [(rnd.randint(1, 30), 100 + rnd.randint(1, 60), pick([0, 1, 1]), pick(dates)) for _ in range(30)]
    return {"crgntry": entries, "crgregv": regv, "crgrole": roles, "cnaidty": idty, "cnaaddr": addr,
            "cnaidta": idta, "lrantgp": groups, "lraassm": assm, "cnarole": prole, "cnarola": rola}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_mailing_audit_matches_literal_sql(spark, seed):
    import duckdb
    rows = random_finance(seed)
    tables = {n: spark.createDataFrame(rows[n], FINANCE[n]) for n in FINANCE}
    d = FixtureDomain(spark, tables)
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    df = R.mailing_audit(d)
    res = con.execute(O.oracle_over_registers("report_mailing_audit"))
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    s_rows = [tuple(r) for r in df.collect()]
    assert len(s_rows) == len(d_rows)
    assert digest(df.columns, s_rows) == digest(d_cols, d_rows)
