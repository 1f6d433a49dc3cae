"""Every query with SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from groundsearch.plans import oracle
from jobs import queries as jobs

SF = "/root/testdata/sf0.001"
SQL = oracle.SQL | jobs.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    """Values that can be sorted: nulls first, and no negative zero."""
    return (v is not None, round(v, 6) + 0.0 if isinstance(v, float) else v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    want = sorted((tuple(map(plain, r)) for r in found.select(", ".join(f'"{c}"' for c in columns)).fetchall()))
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect())) == want


def test_entry(spark):
    assert entry.entry(spark).take(1)
