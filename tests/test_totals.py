"""Maintained totals against full counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.operators.totals import Totals
from pagemill.sources.keyed import KeyedTable

KIND = "id long, user_id long, status string, size long"


def full(state):
    out = {}
    for _, user, status, size in state.values():
        n, s = out.get((user, status), (0, 0))
        out[user, status] = (n + 1, s + (size or 0))
    return out


def seen(totals):
    return {(r.user_id, r.status): (r.cnt, r["size"]) for r in totals.read().collect()}


@pytest.fixture
def totals(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "table"), "id")
    return Totals(table, str(tmp_path / "totals"), ["user_id", "status"], {"size": F.col("size")})


def test_inserts_updates_and_deletes(spark, totals):
    rng, state = random.Random(5), {}
    for step in range(5):
        ids = {rng.choice([None, *range(60)]) for _ in range(25)}
        rows = [(i, rng.choice([None, 1, 2]), rng.choice(["ready", "failed"]), rng.choice([None, 0, 10, 25])) for i in ids]
        gone = [(i,) for i in {rng.randrange(80) for _ in range(8)}]
        for _ in range(rng.choice([1, 2])):
            totals.write(spark.createDataFrame(rows, KIND), gone=spark.createDataFrame(gone, "id long"), name=f"step-{step}")
        for (i,) in gone:
            state.pop(i, None)
        state.update({r[0]: r for r in rows})
        assert seen(totals) == full(state)
        if step % 2:
            totals.table.compact(share=0)
            totals.fold(f"fold-{step}")
            totals.fold(f"fold-{step}")
            assert seen(totals) == full(state)
    assert Counter(r.status for r in totals.table.read().collect()) == Counter(r[2] for r in state.values())


def test_a_write_that_was_ended_half_way(spark, totals, monkeypatch):
    rows = spark.createDataFrame([(1, 1, "ready", 5)], KIND)
    totals.write(rows, name="one")
    change = spark.createDataFrame([(1, 2, "ready", 7), (2, 2, "ready", 1)], KIND)
    with monkeypatch.context() as m:
        m.setattr(totals.table, "write", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            totals.write(change, name="two")
    totals.write(change, name="two")
    assert seen(totals) == {(2, "ready"): (2, 8)}


def test_a_lookup_passes_over_most_of_the_base(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k")
    table.write(spark.range(50_000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v")))
    table.compact()
    found = table.rows_of(spark.createDataFrame([(7,), (40_000,), (10**9,)], "k long"))
    assert sorted((r.k, r.v) for r in found.collect()) == [(7, 1), (40_000, 1)]
    assert "PushedFilters: [In(k" in found._jdf.queryExecution().toString() or "In(k" in found._jdf.queryExecution().executedPlan().toString()
    many = table.rows_of(spark.range(0, 50_000, 10).select(F.col("id").alias("k")))
    assert many.count() == 5_000
