"""Every registered query gives the rows of its SQL."""

import math

import duckdb
import pytest

from vecclimb import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(value + 0.0) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf)
    columns = sorted(got.columns)
    wanted = duck.sql(catalog.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    place = [wanted.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in place) for r in wanted.fetchall())


def test_every_query_without_sql_is_known():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"knn_approx", "run_job"}
