"""The cell index against the exact search."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import cells
from pagemill.operators import vectors as vc

FOLDER = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>"


def pairs(frame):
    return {(r.query_id, r.vec_id, r.similarity, r["rank"]) for r in frame.collect()}


def asked(table, step):
    return table.filter(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12 if i % 3 else 0] + 0.2 * rng.normal(size=24)).astype("float32").tolist()) for i in range(1500)]
    rows += [(1500 + i, rows[7][1]) for i in range(5)]
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [1.0] * 8), (2003, [float("nan")] * 24), (2004, [])]
    return spark.createDataFrame(rows, KIND).repartition(5).cache()


@pytest.mark.parametrize("piece", [50_000, 40])
def test_exact_search_and_recall(clustered, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(cells, "LIST_ROWS", piece)  # a cell holds a third of the rows
    monkeypatch.setattr(cells, "LIST_QUERIES", 2048 if piece > 100 else 7)
    cells.build(clustered, str(tmp_path), cells=12)
    queries = asked(clustered, 20)
    wanted = pairs(vc.cosine_top_k_batch(clustered, queries, 10))
    assert pairs(cells.search(str(tmp_path), clustered, queries, 10, probes=1, exact=True)) == wanted
    found = pairs(cells.search(str(tmp_path), clustered, queries, 10))
    ids = lambda rows: {r[:2] for r in rows}
    assert len(ids(found) & ids(wanted)) >= 0.9 * len(wanted)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_recall_on_the_given_vectors(spark, tmp_path):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    cells.build(table, str(tmp_path))
    queries = asked(table, 5)
    wanted = {(r.query_id, r.vec_id) for r in vc.cosine_top_k_batch(table, queries, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in cells.search(str(tmp_path), table, queries, 10).collect()}
    assert len(found) == len(wanted) and len(found & wanted) >= 0.9 * len(wanted)


def test_every_sound_row_is_in_a_list(clustered, tmp_path):
    cells.build(clustered, str(tmp_path))
    ids = sorted(r.id for r in clustered.sparkSession.read.parquet(f"{tmp_path}/{cells.LISTS}").collect())
    assert ids == [*range(1505)]


def test_few_rows_and_none(spark, tmp_path):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], KIND)
    cells.build(few, f"{tmp_path}/few")
    got = cells.search(f"{tmp_path}/few", few, asked(few, 1), 2, exact=True)
    assert pairs(got) == pairs(vc.cosine_top_k_batch(few, asked(few, 1), 2))
    none = few.limit(0)
    cells.build(none, f"{tmp_path}/none")
    assert cells.search(f"{tmp_path}/none", none, asked(few, 1), 2, exact=True).collect() == []
