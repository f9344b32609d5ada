"""Every catalogue query against its DuckDB form."""

import os

import duckdb
import pytest

from tessera.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    want = con.sql(catalog.SQL[name])
    got = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(tuple(plain(v) for v in r) for r in got.select(columns).collect())
    assert rows == sorted(tuple(plain(v) for v in r) for r in want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
