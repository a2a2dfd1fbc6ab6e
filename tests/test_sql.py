"""Every query with SQL gives the rows DuckDB computes from the same tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_points

ORACLES = entry_points.oracle_sql()
TABLES = (
    "region", "nation", "customer", "supplier", "orders", "lineitem", "events", "embeddings", "documents", "labels",
    "pages", "benchmark", "conversations",
)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small}/{name}.parquet')")
    return con


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, small, name):
    result = entry_points.queries()[name](spark, small)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    ours = result.toPandas()
    theirs = duck.execute(ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    ours = ours[columns].sort_values(columns).reset_index(drop=True)
    theirs = theirs[columns].sort_values(columns).reset_index(drop=True)
    for c in columns:
        if ours[c].dtype.kind == "f":
            assert theirs[c].dtype.kind == "f"
            np.testing.assert_allclose(ours[c], theirs[c], rtol=0, atol=2e-6 * max(1.0, ours[c].abs().max()))
        else:
            assert ours[c].astype(str).tolist() == theirs[c].astype(str).tolist()


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0
