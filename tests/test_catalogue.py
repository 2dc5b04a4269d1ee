"""Every registered query that has an SQL twin gives the twin's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from evidara.plans import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.sql(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    wanted = oracle.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    columns = df.columns
    places = [wanted.columns.index(c) for c in columns]
    ours = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=str)
    theirs = sorted((tuple(plain(row[i]) for i in places) for row in wanted.fetchall()), key=str)
    assert ours == theirs
