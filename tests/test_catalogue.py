"""Every query with SQL is held against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from strataforge.plans import catalogue


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, duck, name):
    got = catalogue.QUERIES[name](spark, small)
    names = sorted(got.columns)
    mine = Counter(tuple(normal(r[c]) for c in names) for r in got.collect())
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert mine == Counter(tuple(normal(r[i]) for i in order) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
