"""Every registered query against its DuckDB oracle on the smallest tables,
plus the driver contract (entry, registry, oracle keys)."""

import pytest

from ledgerlint.plans.oracles import oracle_sql
from ledgerlint.plans.queries import queries
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck

SLOW_NO_ORACLE = {"select_model", "compare_by_recall", "compare_regressors", "grid_rmse"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF_SMALL, con)
    assert r["ok"], r


@pytest.mark.parametrize("name", [n for n in queries() if n not in oracle_sql() and n not in SLOW_NO_ORACLE])
def test_query_without_oracle_runs(spark, name):
    df = queries()[name](spark, SF_SMALL)
    assert df.count() >= 0 and df.columns


def test_oracle_keys_are_registered():
    assert set(oracle_sql()) <= set(queries())


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert len(df.columns) == 39 and df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
