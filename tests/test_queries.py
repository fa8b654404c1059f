"""Every registered query runs; those with SQL agree with DuckDB row by row."""

import datetime
import decimal
import math

import duckdb
import pytest

from lectern.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return plain(float(v)) if v % 1 else int(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def sort_key(row):
    return [(v is None, str(v)) for v in row]


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.select(sorted(got.columns)).collect()
    if name not in registry.ORACLE:
        return
    want = duck.sql(registry.ORACLE[name])
    assert sorted(want.columns) == sorted(got.columns)
    other = want.select(*[duckdb.ColumnExpression(c) for c in sorted(want.columns)]).fetchall()
    a, b = (sorted((tuple(plain(v) for v in r) for r in x), key=sort_key) for x in (rows, other))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y
