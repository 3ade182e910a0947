"""Every registered query that has SQL, value for value at the smallest scale."""

import os

import pytest
from conftest import SF

import __spark_entry__ as entry
from checks.compare import compare, duck, run_sql

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Whole grids of fits, minutes each: run with LONG=1, or by checks.compare.
LONG = {"experiment_ledger", "halving_rungs", "fitted_baseline_runs"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    if name in LONG and not os.environ.get("LONG"):
        pytest.skip("takes minutes")
    df = QUERIES[name](spark, SF)
    assert compare((df.columns, df.collect()), run_sql(con, SQL[name])) == "ok"
