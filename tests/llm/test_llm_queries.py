"""Every query of the subpackage with SQL is held against it on the smallest tables."""

import os

import duckdb
import pytest

from cladeflow.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = duck.execute(queries.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(dict(zip(names, row))[c]) for c in columns) for row in found.fetchall())
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got == want and got
