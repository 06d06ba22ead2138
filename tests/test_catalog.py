"""Registered queries against their SQL twins on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import TABLES, compare

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="session")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    out = compare(spark, con, FOLDER, name, QUERIES[name], SQL[name])
    assert out.startswith("ok"), out


def test_entry(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    made = entry_point.entry(spark)
    assert made.columns[0] == "row" and made.count() == 150
