"""Queries with SQL against their SQL, on the smallest of the given tables."""

import os

import pytest

from checks.compare import bag
from pagemill.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    import duckdb

    db = duckdb.connect()
    for file in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{file}')")
    frame = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in frame.collect()]
    result = db.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert bag(frame.columns, rows) == bag(columns, result.fetchall())


def test_one_query_of_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
