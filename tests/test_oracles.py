"""Every registered query against its SQL on the same tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from registered import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.sql(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return connection


def by_column(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= queries().keys() and ORACLES.keys() <= oracle_sql().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, tables, name):
    result = queries()[name](spark, FOLDER)
    expected = tables.sql(oracle_sql()[name])
    assert by_column(result.columns, result.collect()) == by_column(expected.columns, expected.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
