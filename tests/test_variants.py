"""Near-equal header groups against all pairs."""

import random

import pytest

from pagemill.operators import variants as va


def left_of(text):
    return {text} | {text[:k] + text[k + 1 :] for k in range(len(text))}


def by_hand(rows):
    """(doc_id, region, variant) to the norm of its merged group, by trying all pairs."""
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if a[:2] == b[:2] and left_of(a[2]) & left_of(b[2]):
                parent[root(i)] = root(j)
    out = {}
    for i, a in enumerate(rows):
        mates = [rows[j] for j in range(len(rows)) if root(j) == root(i)]
        out[a[:3]] = min(mates, key=lambda r: (-r[5], r[2]))[2]
    return out


def made(rng, n):
    seen = {}
    bases = ["Report # draft", "Annual report", "第#章 概述", "Page # of #", "", "x", "confidential"]
    for _ in range(n):
        text = rng.choice(bases)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            k = rng.randrange(len(text) + 1)
            text = rng.choice([text[:k] + rng.choice("ab#é") + text[k:], text[: max(k - 1, 0)] + text[k:]])
        key = (rng.choice(["d1", "d2"]), rng.choice(["header", "footer"]), text)
        seen[key] = (*key, text.upper(), rng.randrange(100), rng.randrange(1, 5))
    return list(seen.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = made(random.Random(seed), 220)
    frame = spark.createDataFrame(rows, "doc_id string, region string, norm string, text string, first_page long, page_count long")
    variants = va.hf_variants(frame.repartition(3))
    got = {(r.doc_id, r.region, r.variant): r.norm for r in variants.collect()}
    wanted = by_hand(rows)
    assert got == wanted
    groups = {(r.doc_id, r.region, r.norm): r for r in va.hf_similar_groups(variants).collect()}
    assert set(groups) == {(d, s, n) for (d, s, _), n in wanted.items()}
    for key, group in groups.items():
        mine = [r for r in rows if (*r[:2], wanted[r[:3]]) == key]
        assert (group.page_count, group.first_page, group.n_variants) == (sum(r[5] for r in mine), min(r[4] for r in mine), len(mine))
        assert group.text == key[2].upper()


def test_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 300)] + [(500, 400), (500, 450)], "a long, b long")
    got = {r.node: r.least for r in va.connected(links).collect()}
    assert got == {**{k: 1 for k in range(1, 301)}, 400: 400, 450: 400, 500: 400}


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id string, region string, norm string, text string, first_page long, page_count long")
    assert va.hf_similar_groups(va.hf_variants(none)).collect() == []
