"""Every registered query with SQL against DuckDB over the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom import catalog

NAMES = sorted(n for n in entry.oracle_sql() if n in catalog.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def close(a, b):
    if isinstance(a, float) and b is not None and not isinstance(b, str):
        return math.isclose(a, float(b), rel_tol=1e-8, abs_tol=1e-8)
    return a == b


@pytest.mark.parametrize("name", NAMES)
def test_against_duckdb(name, spark, sf_dir, duck):
    df = catalog.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted([tuple(r[c] for c in cols) for r in df.collect()], key=str)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted([tuple(r[i] for i in at) for r in rel.fetchall()], key=str)
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
