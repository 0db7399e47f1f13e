"""Every query that has SQL, on the given tables, against DuckDB."""

import os

import pytest

import __spark_entry__ as entry  # must import without a session

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    shown = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    want = shown([[row[names.index(c)] for c in columns] for row in result.fetchall()])
    assert shown(df.select(*(f"`{c}`" for c in columns)).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
