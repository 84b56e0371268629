import numpy as np
import pytest

from pagemill.operators import vectors as vc


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).astype("float32").tolist()) for i in range(500)]
    rows += [(500, rows[3][1]), (501, None), (502, [0.0] * 16), (503, [1.0] * 8), (504, [float("nan")] + [1.0] * 15)]
    rows += [(505, [None] + [1.0] * 15), (506, [float("inf")] + [1.0] * 15), (507, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7).cache()


def asked(table, ids):
    return table.filter(table.vec_id.isin(*ids)).withColumnRenamed("vec_id", "query_id")


def nearest(table, query, k):
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in table.filter("vec_id <= 500").collect()]
    q = np.array(query, dtype=float)
    scored = [(-float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), i) for i, v in rows]
    return [(i, round(-s, 6)) for s, i in sorted(scored)[:k]]


def test_one_query_is_exact(table):
    query = table.filter("vec_id = 3").first().embedding
    got = vc.cosine_top_k(table, table.filter("vec_id = 3"), 6).collect()
    assert sorted((-r.similarity, r.vec_id) for r in got) == sorted((-s, i) for i, s in nearest(table, query, 6))
    assert {r.vec_id for r in got[:2]} == {3, 500}


@pytest.mark.parametrize("block", [2048, 2])
def test_many_queries(table, monkeypatch, block):
    monkeypatch.setattr(vc, "QUERY_BLOCK", block)
    monkeypatch.setattr(vc, "ROW_BLOCK", 37)
    ids = (77, 400, 12, 13, 14, 501, 502, 504)
    got = vc.cosine_top_k_batch(table, asked(table, ids), 5).collect()
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    assert {r.query_id for r in got} == {77, 400, 12, 13, 14}
    for i in {r.query_id for r in got}:
        mine = sorted((r.rank, r.vec_id, r.similarity) for r in got if r.query_id == i)
        assert [(v, s) for _, v, s in mine] == nearest(table, vectors[i], 5)


def test_ranks_are_by_the_unrounded_similarity(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0001]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    query = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [r.vec_id for r in vc.cosine_top_k(rows, query, 1).collect()] == [2]


def test_rejects(table):
    got = {r.vec_id: r.reject_reason for r in vc.vector_rejects(table, 16).collect()}
    assert got == {501: "no vector", 502: "no direction", 503: "another width", 504: "no direction",
                   505: "no direction", 506: "no direction", 507: "another width"}


def test_no_queries(table):
    assert vc.cosine_top_k_batch(table, asked(table, (501,)), 3).collect() == []
