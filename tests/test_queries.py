"""Every registered query against its SQL in DuckDB, on the smallest driver tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

import __spark_entry__ as entrypoint

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def text(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def test_registries_agree():
    assert set(entrypoint.oracle_sql()) <= set(entrypoint.queries())
    assert len(entrypoint.queries()) > 150


@pytest.mark.parametrize("name", sorted(entrypoint.queries()))
def test_query(spark, con, name):
    df = entrypoint.queries()[name](spark, str(FOLDER))
    got = df.collect()
    sql = entrypoint.oracle_sql().get(name)
    if sql is None:
        return
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(df.columns)
    mine = sorted(tuple(text(r[c]) for c in order) for r in got)
    theirs = sorted(tuple(text(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert mine == theirs
