"""Every query that SQL can tell, side by side with DuckDB."""

import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, list) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not re.match(r"p\d+_", n)])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    sql = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    at = [sql.columns.index(c) for c in df.columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in sql.fetchall())
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
