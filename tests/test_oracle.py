"""Every registered query against the SQL that says the same, run by DuckDB on the same small tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from tabsift import plans

TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


def plain(x):
    if x is None or x != x:
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.6g}"
    return str(x)[:19] if isinstance(x, datetime.date) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf)
    want = duck.execute(plans.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLE)
