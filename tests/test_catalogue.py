"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(e.catalogue.ORACLES))
def test_same_rows(spark, sf, duck, name):
    df = e.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(e.oracle_sql()[name])
    want_cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(want_cols)
    assert got == rows(want_cols, cur.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(e.catalogue.QUERIES) - set(e.catalogue.ORACLES)))
def test_runs(spark, sf, name):
    assert e.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert e.entry(spark).columns == ["key", "value", "seq"]
