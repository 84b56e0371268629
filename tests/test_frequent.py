"""Frequent items of ranges of time against full counts."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.operators import frequent as fr
from pagemill.sources.keyed import KeyedTable
from pagemill.streaming import jobs as sj

START = datetime.datetime(2026, 8, 3)
KIND = "doc_id long, ts timestamp_ntz"


def log_of(seed, n, items, power):
    rng = random.Random(seed)
    weights = [1 / (k + 1) ** power for k in range(items)]
    picked = rng.choices(range(items), weights, k=n)
    return [(i, START + datetime.timedelta(seconds=rng.randrange(48 * 3600))) for i in picked] + [(None, START), (3, None)]


def hours(a, b):
    return tuple(F.lit(START + datetime.timedelta(hours=h)).cast("timestamp_ntz") for h in (a, b))


def counts_of(rows, a, b):
    low, high = START + datetime.timedelta(hours=a), START + datetime.timedelta(hours=b)
    return Counter(i for i, t in rows if i is not None and t is not None and low <= t < high)


@pytest.mark.parametrize(("power", "capacity"), [(1.6, 60), (0.2, 60), (1.1, 100_000)])
def test_ranges_are_exact(spark, power, capacity):
    rows = log_of(1, 20_000, 3000, power)
    log = spark.createDataFrame(rows, KIND).repartition(5).cache()
    parts = fr.sketches(log, "doc_id", capacity=capacity).cache()
    assert parts.count() == 48 and max(len(r["items"]) for r in parts.collect()) <= capacity
    for a, b in ((0, 48), (5, 17), (7, 8), (60, 70)):
        wanted = sorted(counts_of(rows, a, b).items(), key=lambda x: (-x[1], -x[0]))[:20]
        got = fr.top_of_range(log, parts, *hours(a, b), 20, "doc_id", capacity=capacity).collect()
        assert [(r["item"], r.score) for r in got] == wanted


@pytest.mark.parametrize("capacity", [5, 40])
def test_bounds_hold_after_any_merge(spark, capacity):
    rows = log_of(2, 8_000, 500, 1.2)
    parts = fr.sketches(spark.createDataFrame(rows, KIND), "doc_id", capacity=capacity)
    halves = fr.merged(parts, capacity, F.hour("period") < 12)
    for sketch in (parts.filter(F.hour("period") == 3).limit(1), fr.merged(parts, capacity), fr.merged(halves, capacity)):
        row = sketch.withColumn("at", F.col("period").cast("string")).first()
        low = next((h for h in range(48) if str(START + datetime.timedelta(hours=h)) == row.at), None)
        true = counts_of(rows, low, low + 1) if low is not None else counts_of(rows, 0, 48)
        held = {x["item"]: x.n for x in row["items"]}
        assert row.total == sum(true.values()) and len(held) <= capacity
        assert all(held.get(i, 0) <= n <= held.get(i, 0) + row.error for i, n in true.items())
        assert row.error <= row.total / capacity


def test_a_stream_folds_to_a_sketch_an_hour(spark, tmp_path):
    rows = log_of(3, 6_000, 800, 1.5)
    table = KeyedTable(spark, str(tmp_path / "sketches"), "id")
    for k in range(3):  # three restarts
        part = spark.createDataFrame(rows[k::3], KIND).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
        sj.sketches_into(stream, "doc_id", table, str(tmp_path / "cp"), 50).awaitTermination()
        sj.fold_sketches(table, 50)
    log = spark.createDataFrame(rows, KIND)
    assert table.read().count() == 48 and table.read().agg(F.sum("total")).first()[0] == 6_000
    got = fr.top_of_range(log, table.read(), *hours(3, 30), 10, "doc_id", capacity=50).collect()
    assert [(r["item"], r.score) for r in got] == sorted(counts_of(rows, 3, 30).items(), key=lambda x: (-x[1], -x[0]))[:10]


def test_nothing(spark):
    log = spark.createDataFrame([], KIND)
    parts = fr.sketches(log, "doc_id")
    assert parts.collect() == [] and fr.top_of_range(log, parts, *hours(0, 9), 5, "doc_id").collect() == []
