"""Registered queries against an independent engine on the same tables."""

import datetime
import decimal

import duckdb
import pytest

from tessera import registry

QUERIES, ORACLE = registry.collect()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for name in registry.TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if v != v else repr(round(float(v), 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows_of(want.columns, want.fetchall())
    else:
        assert got


def test_names_agree():
    assert set(ORACLE) <= set(QUERIES)
