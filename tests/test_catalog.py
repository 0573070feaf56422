"""Every registered query against its oracle in DuckDB, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from treeshift import fixtures as fx

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(name, spark, duck):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(shown, row)) for row in df.select(*columns).collect())
    assert got
    oracle = entry.oracle_sql().get(name)
    if oracle is None:
        return
    result = duck.execute(oracle)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(shown(row[i]) for i in order) for row in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_commit_log_broadcasts_no_orders(spark):
    log = fx.view(spark, SF, "commit_log")
    assert "Broadcast" not in log._jdf.queryExecution().executedPlan().toString()
