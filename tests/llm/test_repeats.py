import hashlib
import random
import zlib

import pytest

from pagemill.llm import packs, passages, repeats, suffixes


def bytes_by_hand(rows):
    first, out = {}, {}
    for i, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - 49):
            s = raw[p : p + 50]
            first[s] = min(first.get(s, i), i)
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (i, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return sorted(out.values())


def words_by_hand(rows):
    seen, out = set(), []
    for i, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - 19):
            window = tuple(words[p : p + 20])
            if window in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(window)
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.fixture
def rows(prose):
    rng = random.Random(4)
    shared = [prose(900 + k, 45) for k in range(5)]
    out = []
    for i in range(60):
        parts = [prose(i, rng.randint(0, 120))]
        if i % 2:
            parts.insert(rng.randint(0, 1), shared[i % 5])
        if i % 7 == 0:
            parts.append("la la " * 60)
        out.append((i * 3 + 1, rng.choice([" ", "\n", "  "]).join(parts)))
    near = out[11][1].split()
    near[30:31] = ["changed", "here"]
    out += [(400, out[10][1]), (401, out[10][1]), (402, " ".join(near)), (403, None), (404, ""), (405, "short"), (406, "é" * 200)]
    out += [(407, "é" * 120 + "x"), (408, "\t \n"), (409, shared[0] + " " + shared[0])]
    return out


@pytest.mark.parametrize("often", [2048, 32])
@pytest.mark.parametrize("pieces", [300_000, 100])
def test_bytes(documents, rows, monkeypatch, often, pieces):
    monkeypatch.setattr(repeats, "FREQUENT", often)
    monkeypatch.setattr(repeats, "COMPARED", pieces)
    monkeypatch.setattr(repeats, "SAMPLED", 4)
    got = suffixes.remove_repeated_bytes(documents(rows).repartition(3)).collect()
    assert sorted(map(tuple, got)) == bytes_by_hand(rows)


@pytest.mark.parametrize("often", [2048, 32])
def test_words(documents, rows, monkeypatch, often):
    monkeypatch.setattr(repeats, "FREQUENT", often)
    monkeypatch.setattr(repeats, "SAMPLED", 4)
    got = passages.remove_repeated_passages(documents(rows).repartition(3)).collect()
    assert sorted(map(tuple, got)) == words_by_hand(rows)


def test_rows_that_share_an_id(documents, prose):
    a, b = prose(1, 60), prose(2, 60)
    got = suffixes.remove_repeated_bytes(documents([(5, a), (5, a), (5, b), (None, a), (7, b)])).collect()
    removed = sorted(((r.doc_id is None, r.doc_id or 0), r.n_removed) for r in got)
    size = {t: len(t.encode()) for t in (a, b)}
    assert removed == sorted([((False, 5), 0)] * 3 + [((False, 7), size[b]), ((True, 0), size[a])])


def _same_checksum(text, like):
    want = zlib.crc32(like.encode()) & 0xFFFF
    return next(t for t in (f"{text} {k}" for k in range(10**7)) if zlib.crc32(t.encode()) & 0xFFFF == want)


@pytest.mark.parametrize("short", [False, True])
def test_texts_of_one_id_with_equal_checksums(documents, prose, short):
    a = prose(1, 80)
    tail = a + " tail of another kind"
    other = _same_checksum("brief" if short else prose(2, 80), tail)
    frame = documents([(1, a), (7, tail), (7, other)])
    for result in (suffixes.remove_repeated_bytes(frame), passages.remove_repeated_passages(frame)):
        rows = result.collect()
        sizes = {r[1]: r.n_removed for r in rows}
        assert sorted(r.doc_id for r in rows) == [1, 7, 7]
        assert sorted(r.n_removed == 0 for r in rows) == [False, True, True]
        assert max(sizes, key=sizes.get) == (len(tail.encode()) if "n_bytes" in result.columns else len(tail.split()))


def test_many_texts_without_an_id(documents, prose):
    rows = [(None, prose(k, 40)) for k in range(1000)] + [(3, prose(5, 40)), (2**63 - 1, prose(2000, 40))]
    got = suffixes.remove_repeated_bytes(documents(rows)).collect()
    assert sorted(r.n_removed for r in got)[-2:] == [0, len(prose(5, 40).encode())]
    assert sorted((r.doc_id for r in got if r.doc_id is not None)) == [3, 2**63 - 1]


def test_empty_table(documents):
    assert suffixes.remove_repeated_bytes(documents([])).collect() == []
    assert passages.remove_repeated_passages(documents([])).collect() == []


def test_deep_shallow_orders_suffixes():
    import numpy as np

    rng = random.Random(7)
    base = bytes(rng.choices(b"ab", k=400))
    data = np.frombuffer(base * 3 + bytes(rng.choices(b"abc", k=300)), np.uint8)
    at = np.arange(len(data) - 49)
    chars = suffixes.characters(data, at)
    order, tie = suffixes.multikey_quicksort(chars, np.zeros(len(at), int), suffixes.SHALLOW)
    order, tie = suffixes.blind_tries(chars, order, tie, suffixes.SHALLOW)
    sorted_ = [data[p : p + 50].tobytes() for p in order]
    assert sorted_ == sorted(sorted_)
    assert all((x == y) == (s == t) for x, y, s, t in zip(sorted_, sorted_[1:], tie, tie[1:]))


def test_packed_arrays_round_trip():
    import numpy as np

    values = np.array([1, 2**40, 77, 0], np.int64)
    assert packs.values_of(packs.planes(values), np.int64).tolist() == values.tolist()
    assert len(packs.values_of(None, np.uint16)) == 0


def test_inner_nodes_of_subtrees():
    import numpy as np

    rng = random.Random(11)
    words = [rng.randrange(3) for _ in range(60)]
    words = words * 2 + [rng.randrange(2) for _ in range(150)] + words[:50]
    data = np.array(words, np.uint64)
    at = np.arange(len(words) - 19)
    group = np.array([rng.randrange(2) for _ in at])
    tree = passages.suffix_tree(data, at, group)
    leaves = [(int(group[k]), tuple(words[at[k] : at[k] + 20])) for k in tree.leaves]
    assert leaves == sorted(leaves)
    wanted = set()
    for depth in range(1, 21):
        prefixes = {}
        for k, (g, w) in enumerate(leaves):
            prefixes.setdefault((g, w[:depth]), []).append(k)
        for mine in prefixes.values():  # a node: at least two leaves that share no more than this, or all 20 words
            deeper = {leaves[k][1][: depth + 1] for k in mine}
            if len(mine) > 1 and (depth == 20 or len(deeper) > 1):
                wanted.add((depth, mine[0], mine[-1]))
    assert {tuple(map(int, n)) for n in zip(*tree.nodes())} == wanted
    assert {tuple(map(int, n)) for n in zip(*tree.nodes(20))} == {n for n in wanted if n[0] == 20}
    assert [len(x) for x in passages.Subtree(np.zeros(0, int), np.zeros(0, int)).nodes()] == [0, 0, 0]
