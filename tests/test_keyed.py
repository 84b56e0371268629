"""Keyed tables of a base and changes."""

import os

import pytest
from pyspark.sql import functions as F

from pagemill.sources.keyed import KeyedTable


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "table"), "k")


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k string, n int, t string")


def seen(table):
    return sorted((r.k or "", r.n, r.t) for r in table.read().collect())


def files_of(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names}


def test_the_latest_write_of_a_key_counts(spark, table):
    assert table.read().collect() == []
    table.write(rows(spark, ("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), (None, 0, "no key")))
    table.write(rows(spark, ("a", 0, "new"), ("c", 0, "w")))
    assert seen(table) == [("", 0, "no key"), ("a", 0, "new"), ("b", 0, "z"), ("c", 0, "w")]
    table.write(rows(spark, (None, 1, "again")), gone=rows(spark, ("b", 0, ""), ("never", 0, ""), (None, 0, "")))
    expected = [("", 1, "again"), ("a", 0, "new"), ("c", 0, "w")]
    assert seen(table) == expected
    for _ in range(2):
        table.compact(share=0)
        assert seen(table) == expected
    table.write(rows(spark, ("b", 5, "back")), gone=rows(spark, ("a", 0, "")))
    assert seen(table) == [("", 1, "again"), ("b", 5, "back"), ("c", 0, "w")]
    table.compact(share=0)
    table.drop_old()
    assert seen(table) == [("", 1, "again"), ("b", 5, "back"), ("c", 0, "w")]
    assert len(table._folders("base")) == 1 and table._folders("changes") == []


def test_a_named_write_counts_once(spark, table):
    table.write(rows(spark, ("a", 0, "x")), name="one")
    table.write(rows(spark, ("a", 1, "y")), name="two")
    table.write(rows(spark, ("a", 0, "x")), name="one")
    assert seen(table) == [("a", 1, "y")]


def test_a_small_write_costs_its_rows(spark, table):
    table.write(spark.range(200_000).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("t")))
    table.compact()
    before = files_of(table.path)
    table.write(rows(spark, *((str(k), 1, "new") for k in range(10))))
    assert not table.compact()
    after = files_of(table.path)
    assert before.items() <= after.items()
    assert sum(after.values()) - sum(before.values()) < 0.01 * sum(before.values())
    view = table.read()
    assert view.count() == 200_000 and view.filter("n = 1").count() == 10


def test_an_unfinished_write_does_not_count(spark, table):
    table.write(rows(spark, ("a", 0, "x")))
    table.write(rows(spark, ("a", 1, "broken")))
    folder = table._folders("changes")[-1][1]
    os.remove(f"{table.path}/{folder}/_SUCCESS")
    assert seen(table) == [("a", 0, "x")]
    table.write(rows(spark, ("a", 2, "next")))
    assert seen(table) == [("a", 2, "next")]


def test_numbers_are_claimed_once(table):
    assert [table._claim() for _ in range(3)] == [1, 2, 3]


def test_many_folders_are_compacted_and_columns_may_be_added(spark, table):
    for k in range(4):
        table.write(rows(spark, (str(k), k, "x")))
    table.write(rows(spark, ("9", 9, "x")).withColumn("more", F.lit(1)))
    assert table.compact(folders=5)
    assert sorted((r.k, r.more) for r in table.read().collect()) == [("0", None), ("1", None), ("2", None), ("3", None), ("9", 1)]


def test_changes_are_put_in_one_pass(spark, table):
    changes = lambda *values: spark.createDataFrame(list(values), "k string, n int, t string, away boolean")
    table.put(changes(("a", 0, "x", False), ("b", 0, "y", False), (None, 0, "z", False), ("never", None, None, True)), "away", name="one")
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # one write has all rows of its keys
    assert seen(table) == [("", 0, "z"), ("a", 0, "x"), ("b", 0, "y")]
    table.compact()
    for _ in range(2):
        table.put(changes(("a", None, None, True), ("c", 1, "w", False), (None, 1, "again", False)), "away", name="two")
    expected = [("", 1, "again"), ("b", 0, "y"), ("c", 1, "w")]
    assert seen(table) == expected and len(table._state()[1]) == 1
    table.write(rows(spark, ("b", 2, "new")))
    expected[1] = ("b", 2, "new")
    assert seen(table) == expected
    table.compact(share=0)
    assert seen(table) == expected
