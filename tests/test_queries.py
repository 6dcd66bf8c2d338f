"""Every registered query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tests.conftest import SF
from tidemark.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    data = [tuple(r) for r in got.collect()]
    assert len(data) == len(set(range(len(data))))
    expected = want.fetchall()
    norm = lambda x: x.replace(".0,", ",").replace(".0]", "]")  # noqa: E731  whole numbers are equal whatever their type
    assert [norm(r) for r in rows(got.columns, data)] == [norm(r) for r in rows(want.columns, expected)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
