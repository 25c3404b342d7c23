"""Every query with SQL gives the SQL's rows on the smallest tables; every other query runs."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return float(x) if hasattr(x, "as_tuple") else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(repr(tuple(cell(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    data = [tuple(r) for r in got.collect()]
    if sql := catalogue.ORACLE_SQL.get(name):
        want = duck.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows(got.columns, data) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "line", "text"]
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
