"""Every registered query with an SQL twin against DuckDB on the smallest tables, and the others for shape."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402

SQL = entry.oracle_sql()
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    got = duck.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())


def test_every_sql_has_its_query():
    assert set(SQL) <= set(NAMES)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["unit", "lag", "correlation", "pairs"] and df.count() > 0
