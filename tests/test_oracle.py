"""Every registered query against its SQL oracle (row count, columns, order-insensitive values)."""

import pytest

import __spark_entry__ as E
from tallyframe.plans import oracle, queries
from tallyframe.plans.check import compare

KEYS = sorted(queries.queries())


def test_every_query_has_an_oracle():
    assert set(queries.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, sf_small, key):
    r = compare(spark, duck, key, E.queries()[key], E.oracle_sql()[key], sf_small)
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == E.entry(spark).columns
