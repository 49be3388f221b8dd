"""Every registered query against its DuckDB oracle at sf0.01 (the driver's
correctness gate, run locally)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF01
from tests.oracle import compare
from tests.test_plans import plan

NAMES = sorted(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con01, name):
    df = E.queries()[name](spark, SF01)
    p = plan(df)   # no query pairs rows without a join key
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
        return
    compare(df, con01, sql)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert rows[0]["n_run_queries"] == 500
