"""Every query with SQL gives the same rows as that SQL in DuckDB."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    found = entry.queries()[name](spark, FOLDER)
    expected = duck.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, found.collect()) == rows(expected.columns, expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
