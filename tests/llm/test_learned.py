"""Held-out accuracy of the trained models, and their defined cases."""

import os
import zlib

import numpy as np
import pytest

from pagemill.llm import language, quality_cnn, queries, toxicity
from pagemill.llm.labelled import fold, labelled_sample

FOLDER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def area(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


def held(divisor, rest):
    return lambda doc: zlib.crc32(str(doc).encode()) % divisor == rest


@tables
def test_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = queries.QUERIES["op2_language"](spark, FOLDER).collect()
    assert len(got) == len(truth) and all(r.held_out == held(4, 2)(r.doc_id) for r in got)
    mine = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in mine]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


@tables
@pytest.mark.parametrize(
    ("name", "label", "divisor", "rest", "least"),
    [("op4_toxicity", "toxic", 4, 2, 0.75), ("op10_quality_cnn", "quality", 5, 0, 0.95)],  # 37 toxic texts to learn from
)
def test_classifiers(spark, name, label, divisor, rest, least):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = queries.QUERIES[name](spark, FOLDER).collect()
    assert all(r.held_out == held(divisor, rest)(r.doc_id) and r.predicted == int(r.score >= 0.3) for r in got)
    mine = [r for r in got if r.held_out and r.doc_id in truth]
    assert area(np.array([r.score for r in mine]), np.array([truth[r.doc_id] for r in mine])) >= least


def test_language_cases(documents, prose):
    rows = [(i, prose(i, 30), "aa") for i in range(40)] + [(100 + i, prose(i, 30, ["xy", "zw", "qé"]), "bb") for i in range(40)]
    odd = [(1000, None), (1001, ""), (1002, "12 34 !?"), (1003, "x"), (1000, None), (None, prose(3, 9), "aa"), (1004, prose(1, 60_000), None)]
    model = language.train(documents(rows), fold(4) != 9)
    got = language.predict(documents(rows + odd), model).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert found[1000] == [("und", 0.0)] * 2 and found[1001] == found[1002] == [("und", 0.0)]
    assert found[1003][0][0] in ("aa", "bb") and found[1004][0][0] == "aa" and found[None][0][0] == "aa"
    assert np.mean([found[i][0][0] == lang for i, _, lang in rows]) == 1.0
    nothing = language.train(documents([]), fold(4) != 9)
    assert [tuple(r) for r in language.predict(documents([(1, "abc")]), nothing).collect()] == [(1, "und", 0.0)]
    assert language.predict(documents([]), model).collect() == []


def test_language_pieces(prose, monkeypatch):
    text = prose(5, 400) + " Éß 12"
    whole = language.counts(text)
    monkeypatch.setattr(language, "PIECE", 37)
    assert (language.counts(text) == whole).all()


@pytest.mark.parametrize(("module", "label"), [(quality_cnn, "quality"), (toxicity, "toxic")])
def test_classifier_cases(spark, documents, prose, module, label):
    bad = [(i, prose(i, 40) + " stupid stupid###") for i in range(30)]
    good = [(100 + i, prose(50 + i, 40)) for i in range(30)]
    labels = [(i, 1) for i, _ in bad] + [(i, 0) for i, _ in good] + [(5, 1), (None, 1), (7, None), (9999, 0)]
    table = spark.createDataFrame(labels, f"doc_id bigint, {label} int").selectExpr("*", "'x' as text", "'y' as label")
    docs = documents(bad + good + [(500, None), (501, ""), (502, " "), (None, "x"), (5, bad[5][1]), (503, prose(9, 20_000))])
    net = module.train(docs, table, label, fold(4) != 9)
    got = module.score(docs, net).collect()
    assert len(got) == 66 and all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id == 5]
    assert same[0] == pytest.approx(same[1], abs=1e-6)
    empty = [r.score for r in got if r.doc_id in (500, 501)]
    assert empty[0] == pytest.approx(empty[1], abs=1e-6)
    none = module.train(docs, table.where("false"), label, fold(4) != 9)
    assert {round(r.score, 3) for r in module.score(docs, none).collect()} == {0.5}
    assert module.score(documents([]), net).collect() == []


def test_sample_is_bounded(spark, documents, prose):
    docs = documents([(i, prose(i, 5)) for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, toxic int")
    got = labelled_sample(docs, labels, "toxic", fold(4) != 2, 5).collect()
    assert sorted(r.label for r in got) == [0] * 5 + [1] * 5
    assert all(not held(4, 2)(r.doc_id) for r in got)


def test_samples_of_one_id_are_bounded(spark, documents, prose):
    rows = [(5, prose(k % 700, 6), "aa") for k in range(2000)] + [(5, prose(3, 9), "bb")] * 300 + [(None, "only here", "cc")]
    docs = documents(rows)
    got = language.sample(docs, fold(4) != 9).collect()
    assert {x: sum(r.lang == x for r in got) for x in ("aa", "bb", "cc")} == {"aa": 300, "bb": 1, "cc": 1}
    assert language.train(docs, fold(4) != 9).languages == ["aa", "bb", "cc"]
    labels = spark.createDataFrame([(5, 1), (5, 1)], "doc_id bigint, toxic int")
    assert len(labelled_sample(docs, labels, "toxic", fold(4) != 9, 10).collect()) == 1


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network({"a": 2, "b": 3})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes = np.array([[0, 0, 0, 0, 0], [2, 1, 2, 3, 4], [3, 5, 6, 7, 8], [1, 9, 9, 3, 1]])
    windows, wanted, weight = rng.integers(0, 4, (5, toxicity.WINDOW)), np.array([0, 1, 0, 1, 1.0]), np.ones(5) / 5
    grads = net.gradients(windows, codes, wanted, weight)

    def loss():
        x = net.logits(windows, net.tables(codes))
        return float((weight * (np.logaddexp(0, x) - x * wanted)).sum())

    for name, values in net.p.items():
        flat, at = values.reshape(-1), int(np.abs(grads[name]).argmax())
        old = flat[at]
        flat[at] = old + 1e-2
        up = loss()
        flat[at] = old - 1e-2
        down = loss()
        flat[at] = old
        assert (up - down) / 2e-2 == pytest.approx(grads[name].reshape(-1)[at], rel=2e-2, abs=2e-5)


def test_windows_and_chunks_cover_everything():
    for n in (0, 1, 31, 32, 33, 57, 100):
        at = toxicity.starts(n)
        assert set().union(*(range(a, a + toxicity.WINDOW) for a in at)) >= set(range(n))
    for n in (0, 1, 511, 512, 513, 960, 961, 3000):
        raw = bytes(k % 251 for k in range(n))
        cut = quality_cnn.chunks_of(raw)
        whole = b"".join(c[: quality_cnn.STEP].tobytes() for c in cut[:-1]) + cut[-1].tobytes()
        assert whole[:n] == raw and not any(whole[n:])


def test_every_byte_of_a_word_counts():
    net = toxicity.Network({})
    score = lambda text: toxicity.score_texts(net, [text], toxicity.Words(net))[0]
    for run in ("abcdefghij" * 30, "好坏学生老师天地" * 40, "x_y." * 200, "é" * 99, "\U0001f600a" * 60, "short", "a" * 20, "a" * 21):
        cut = toxicity.units(run)
        assert max(len(c.encode()) for c in cut) <= toxicity.LONG
        raw = run.encode()
        assert {raw[k : k + 3] for k in range(len(raw) - 2)} == {c.encode()[k : k + 3] for c in cut for k in range(len(c.encode()) - 2)}
    long = "abcdefghij" * 30
    for k in (5, 17, 101, 149, 298):
        assert score(long) != score(long[:k] + "Q9" + long[k + 2 :])
    assert score("abcdefghijklmno") != score("abXdefghijklmno") and toxicity.units(" a  b ") == ["a", "b"]


def test_the_curve_is_fitted_on_whole_texts(spark, documents, prose):
    bad = [(i, prose(i, 40) + " stupid stupid###") for i in range(20)]
    long = [(100 + i, prose(50 + i, 3000)) for i in range(8)]  # more than SAMPLE_WINDOWS windows
    labels = spark.createDataFrame([(i, 1) for i, _ in bad] + [(i, 0) for i, _ in long], "doc_id bigint, toxic int")
    docs = documents(bad + long)
    net = toxicity.train(docs, labels, "toxic", fold(4) != 9)
    worst = toxicity.worst_of(net, [t for _, t in bad + long], toxicity.Words(net))
    classes = np.array([1.0] * len(bad) + [0.0] * len(long))
    order = np.lexsort((classes, worst))
    wanted = toxicity._curve(worst[order], classes[order], len(bad) / len(bad + long))
    assert (net.slope, net.shift) == pytest.approx(wanted, abs=1e-4)


def test_every_language_is_learned(spark, documents):
    word = lambda k: chr(0x4E00 + 7 * k) * 3 + chr(0x6E00 + 11 * k) * 3
    rows = [(10 * k + j, f"{word(k)} {word(k)}" * (j + 1), f"l{k:03d}") for k in range(70) for j in range(1 if k > 66 else 3)]
    docs = documents(rows)
    model = language.train(docs, fold(4) != 9)
    assert model.languages == [f"l{k:03d}" for k in range(70)]
    assert (np.abs(model.weights).sum(0) > 0).all()
    small = language.sample(docs, fold(4) != 9, total=70).groupBy("lang").count().collect()
    assert len(small) == 70 and {r["count"] for r in small} == {1}
    some = language.train(docs, fold(4) != 9, 1)  # frequencies are of all documents, not of the sample
    there = np.sum([language.counts(t) > 0 for _, t, _ in rows], 0)
    assert some.idf == pytest.approx(np.log((1 + len(rows)) / (1 + there)) + 1, rel=1e-5)
