import random

import pytest

from pagemill.llm import jaccard
from pagemill.llm.components import components


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def by_hand(rows):
    sets = {i: shingles(t) for i, t in rows}
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


@pytest.fixture
def rows(prose):
    rng = random.Random(9)
    out = [(i, prose(i, rng.randint(1, 150))) for i in range(40)]
    for k in range(12):  # chains of copies with more and more changed words
        words = prose(500 + k, rng.choice([8, 12, 40, 90])).split()
        for step in range(8):
            out.append((1000 + 10 * k + step, " ".join(words)))
            words[rng.randrange(len(words))] = f"new{k}x{step}"
    out += [(2000, "Two Words"), (2001, "two  words\n"), (2002, "two"), (2003, None), (2004, ""), (2005, " \t")]
    out += [(2006, "a b c d e"), (2007, "A B C D E"), (2008, out[3][1]), (2009, out[3][1].upper())]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("meeting", "routes", "often"), [(2048, 3, 2048), (3, 1, 8)])
def test_components(documents, rows, monkeypatch, meeting, routes, often):
    monkeypatch.setattr(jaccard, "MEETING", meeting)
    monkeypatch.setattr(jaccard, "POINTED", meeting)
    monkeypatch.setattr(jaccard, "ROUTES", routes)
    monkeypatch.setattr("pagemill.llm.repeats.FREQUENT", often)
    monkeypatch.setattr("pagemill.llm.repeats.SAMPLED", 2)
    got = jaccard.similar_texts(documents(rows).repartition(3)).collect()
    assert sorted(map(tuple, got)) == by_hand(rows)


def test_repeated_rows_and_null_ids(documents, prose):
    a = prose(1, 50)
    got = jaccard.similar_texts(documents([(4, a), (4, a), (9, a), (None, a), (None, None), (2, "")])).collect()
    found = sorted((r.doc_id if r.doc_id is not None else 99, r.n_shingles, r.component_id) for r in got)
    assert found == [(2, 0, 2), (4, 46, 4), (4, 46, 4), (9, 46, 4), (99, 0, None), (99, 46, 4)]


def test_many_texts_under_one_id(documents, prose):
    """Texts without an id are told apart by more than a short checksum."""
    rows = [(None, prose(k, 30)) for k in range(1000)] + [(k, prose(k, 30) + " more") for k in range(20)]
    got = jaccard.similar_texts(documents(rows)).collect()
    assert sum(r.component_id is None for r in got) == 980
    assert {(r.component_id, r.doc_id) for r in got if r.component_id is not None} == {(k, d) for k in range(20) for d in (k, None)}


def test_largest_id(documents, prose):
    a = prose(1, 50)
    got = jaccard.similar_texts(documents([(2**63 - 1, a), (None, prose(2, 50))])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(2**63 - 1, 2**63 - 1), (None, None)}


def test_empty_table(documents):
    assert jaccard.similar_texts(documents([])).collect() == []


def test_bound_never_loses_a_pair():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, 30, dtype=np.uint64)) for _ in range(30)]
    sets += [np.unique(np.concatenate([s[: 30 - k % 9], rng.integers(0, 2**63, k % 9, dtype=np.uint64)])) for k, s in enumerate(sets)]
    n, points = np.array([len(s) for s in sets]), jaccard.points(sets)
    tree = jaccard.Tree(points, n)
    for i, s in enumerate(sets):
        near = set(tree.near(points[i], int(n[i]), np.ones(len(sets), bool))[0].tolist())
        assert {j for j, t in enumerate(sets) if jaccard.linked(s, t)} <= near


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (103, 101), (200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, 101: 100, 103: 100}
