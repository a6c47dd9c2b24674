"""Every registered query of the history engine against DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from chronolith import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    rows = [tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    if name not in registry.SQL:
        assert len(set(got.columns)) == len(got.columns)
        return
    want = duck.sql(registry.SQL[name])
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(rows, key=str) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_names_have_sql():
    assert set(registry.SQL) <= set(registry.QUERIES) and len(registry.SQL) > 60
