"""Every registered query against its SQL, on the smallest of the given tables."""

import os

import pytest

import __spark_entry__ as entry
from pagemill.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    import duckdb

    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        table = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{file}')")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    from checks.compare import compare

    line = compare(spark, db, FOLDER, name)
    assert not line.startswith("FAIL"), line
    assert " types " not in line, line


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["document_id", "chunk_index", "chunk_text", "chunk_hash", "token_count"]
