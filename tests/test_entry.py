import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import queries as G
from tests.conftest import SMALL


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["size", "n_components"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("events", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(G.QUERIES))
def test_against_duckdb(spark, duck, name):
    got = G.QUERIES[name](spark, SMALL)
    want = duck.execute(G.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect())))
    assert rows and rows == sorted(map(str, want.fetchall()))
