"""Checked queries against their SQL in DuckDB, on the given tables where they are present."""

import math
import os

import pytest

from airtrail import checks

FOLDER = os.environ.get("AIRTRAIL_TABLES", "/root/testdata/sf0.001")
NAMES = sorted(checks.all_oracles())

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no given tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = checks.all_queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    cursor = duck.execute(checks.all_oracles()[name])
    at = [d[0] for d in cursor.description]
    assert sorted(at) == columns
    assert got == sorted(tuple(plain(row[at.index(c)]) for c in columns) for row in cursor.fetchall())
