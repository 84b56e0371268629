import random

import numpy as np
import pytest

from pagemill.llm import decontaminate


@pytest.fixture
def items(prose):
    return [(i, prose(700 + i, 30).capitalize() + ". " + prose(800 + i, 8) + ".") for i in range(40)]


@pytest.mark.parametrize("threshold", [0.05, 0.15, 0.4])
def test_search_finds_what_a_full_scan_finds(items, prose, threshold):
    index = decontaminate.Index([(i, t.encode()) for i, t in items])
    rng = random.Random(2)
    for k in range(60):
        words = prose(k, 60).split() + rng.choice(items)[1].split()[: rng.randint(0, 38)]
        text = " ".join(words).lower().encode()
        terms = np.unique(index.numbers(decontaminate.words([text])[0]))
        terms = terms[terms >= 0].tolist()
        scores = np.zeros(len(index.owner))
        for t in terms:
            for part, impact in zip(index.lists[t].parts, index.lists[t].impacts):
                scores[part] += impact
        found = dict(index.search(terms, threshold))
        assert {p for p in np.flatnonzero(scores >= threshold + 1e-9)} <= set(found)
        assert all(found[p] == pytest.approx(scores[p]) and scores[p] >= threshold - 1e-9 for p in found)


def test_leaks(spark, documents, items, prose):
    words = items[5][1].split()
    changed = words[:10] + ["other"] + words[11:]
    rows = [(i, prose(i, 200)) for i in range(20)]
    rows += [(100, prose(50, 90) + " " + items[3][1] + " " + prose(51, 300)), (101, " ".join(changed).upper()), (102, None), (103, "")]
    rows += [(104, prose(52, 1000) + "\n" + items[7][1]), (None, items[8][1]), (100, rows[0][1]), (105, " ".join(words[:12]))]
    bench = spark.createDataFrame([*items, (None, None), (77, ""), (5, items[5][1])], "item_id bigint, text string")
    got = decontaminate.leaks(documents(rows), bench).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in got) == [(-1, 8), (100, 3), (101, 5), (104, 7)]
    assert all(0.6 <= r.score <= 1.0001 for r in got)


def test_items_longer_than_a_part(spark, documents, prose):
    item = prose(1, 200) + ". " + prose(2, 20) + "."
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = decontaminate.leaks(documents([(1, prose(3, 333) + " " + item), (2, prose(4, 500))]), bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)]


def test_shards_change_nothing(spark, documents, items, prose, monkeypatch):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(i, prose(i, 70) + " " + items[i][1]) for i in range(10)]
    monkeypatch.setattr(decontaminate, "SHARD", 7)
    got = decontaminate.leaks(documents(rows), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(10)]


def test_empty_tables(spark, documents, items):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.leaks(documents([(1, items[0][1])]), none).collect() == []
    assert decontaminate.leaks(documents([]), spark.createDataFrame(items, "item_id bigint, text string")).collect() == []


def test_scores_do_not_depend_on_shards(spark, documents, items, prose, monkeypatch):
    long = (99, prose(1, 200) + ". " + prose(2, 20) + ".")
    bench = spark.createDataFrame([*items, long, (77, ""), (5, items[5][1])], "item_id bigint, text string")
    rows = [(i, prose(i, 70) + " " + " ".join(items[i][1].split()[: 38 - i % 14])) for i in range(30)] + [(200, long[1])]
    whole = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(documents(rows), bench).collect()}
    monkeypatch.setattr(decontaminate, "SHARD", 7)
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(documents(rows), bench).collect()}
    assert len(whole) > 20 and got == pytest.approx(whole)
