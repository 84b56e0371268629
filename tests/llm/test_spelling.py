"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import spelling


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def _expected(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            check = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if check % 97 == 0:
                run = run[: check % len(run)] + run[check % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form, out = {}, {}
    near = {w: [v for v in words if _near(w, v)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def _found(frame):
    found = spelling.variants(frame)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return {r.word: tuple(r)[1:] for r in found.collect()}


def _noisy(rng, words):
    word = rng.choice(words)
    for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
        k = rng.randrange(len(word))
        word = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("abeé") + word[k:], word[:k] + rng.choice("abeé") + word[k + 1 :]]) or "x"
    return word


def test_against_all_pairs(documents):
    rng = random.Random(6)
    words = ["banana", "abababab", "cabana", "Éaaaaa", "aaaaaa", "bandana", "beebeebee", "ababa×÷", "abcdefghijklmnopqrstuvwxyzabcdefghijkl"]
    rows = [(k, " ".join(_noisy(rng, words) for _ in range(150))) for k in range(25)]
    rows += [(None, "orphan Orphan orphans orphans; orphans orphan"), (30, None), (31, ""), (31, "12 --"), (5, rows[5][1]), (2**63 - 1, "ÀÉÎõü àéîõü ÀÉÎõü ÀÉÎõü")]
    found, expected = _found(documents(rows)), _expected(rows)
    assert len(expected) > 150
    assert found == expected


def test_long_words_and_texts(documents, monkeypatch):
    rng = random.Random(7)
    long = "".join(rng.choices("abcdefgh", k=3000))
    rows = [(1, f"{long} {long} {long} {long[:1500]}{long[1501:]} " * 3), (2, f"x{long} " * 4), (3, f"{long[:40]} {long[:20]}z{long[21:40]} " * 3)]
    assert _found(documents(rows)) == _expected(rows)
    monkeypatch.setattr(spelling, "PIECE", 100)
    for doc_id, text in rows:
        words = Counter()
        for word, count in spelling.document_words(doc_id, text):
            words[word] += count
        assert {w: n for w, n in words.items() if n >= 3} == {w: v[2] for w, v in _expected([(doc_id, text)]).items()}


def test_empty_table(documents):
    assert _found(documents([])) == {}


@settings(max_examples=400, deadline=None)
@given(st.text("abé", min_size=5, max_size=14), st.integers(0, 2), st.integers(0, 13), st.sampled_from("abé"), st.lists(st.integers(1, 50), min_size=9, max_size=9))
def test_near_words_share_a_key(word, kind, place, letter, counts):
    """Whatever the frequencies of the grams, a pivot of one word meets the prefix of the other."""
    place %= len(word)
    other = [word[:place] + word[place + 1 :], word[:place] + letter + word[place:], word[:place] + letter + word[place + 1 :]][kind]
    if len(other) < 5 or other == word:
        return
    all_counts = np.zeros(spelling.LETTERS**2, np.int64)
    letters = [0, 1, 26 + 0xE9 - 0xC0]
    for k, n in enumerate(counts):
        all_counts[letters[k // 3] * spelling.LETTERS + letters[k % 3]] = n

    def of(text, pivots):
        code = spelling.codes([text])
        prefix, pair = spelling.prefix_and_pivots(code, all_counts)
        assert pair[0, 1] - pair[0, 0] >= 2
        places = pair[0] if pivots else np.flatnonzero(prefix[0])
        return set(spelling.keys(code, np.zeros(len(places), np.int64), places, pivots)[1].tolist())

    assert of(word, True) & of(other, False) or of(other, True) & of(word, False)


def test_tables_of_words_are_not_broadcast(spark, tmp_path, monkeypatch):
    from pagemill.sources import tables

    plans = []

    def kept(df, purpose):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return tables.stored(df, purpose)

    monkeypatch.setattr(spelling, "stored", kept)
    docs = spark.createDataFrame([(k, "garden gardon gardens window windows") for k in range(4)] + [(9, "gardon garden garden")], "doc_id long, text string")
    found = spelling.variants(docs)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {r.word: r.n_near for r in found.collect()}["garden"] == 2
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
