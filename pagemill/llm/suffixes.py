"""Removal of bytes whose 50-byte neighbourhood stands in an earlier document, by deep-shallow sorting.

The routes of :mod:`pagemill.llm.repeats` bring suffixes that may share 50 bytes
into one group. A group is sorted to a shallow depth by multikey quicksort on
8-byte characters; the groups of suffixes that still tie share a long prefix and
are ordered by blind tries: each suffix is compared with one leaf of its trie, and
branches off at the first character that differs, at the depth where it does.

Defined cases: a null text is empty; texts under 50 bytes lose nothing; an equal
text under a smaller doc_id removes a text of 50 bytes or more as a whole; rows
that share a doc_id are not compared with each other; a null doc_id comes after
all others. Matches never cross texts. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.repeats import Rule, remove_repeats, spread

WIDTH, GRAM = 50, 16
SHALLOW = 2  # characters of 8 bytes that multikey quicksort looks at
RULE = Rule(WIDTH, GRAM, of_words=False, within=False)
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
)


def characters(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The ``width`` bytes from each place as big-endian 8-byte characters, the last one overlapping."""
    wide = np.zeros(max(len(data) - 7, 0), np.uint64)
    for k in range(8):
        wide = (wide << np.uint64(8)) | data[k : k + len(wide)].astype(np.uint64)
    places = [*range(0, width - 8, 8), width - 8]
    return np.stack([wide[at + p] for p in places])


def _edges(*fields: np.ndarray) -> np.ndarray:
    """Where any of the fields differs from the entry before."""
    new = np.ones(len(fields[0]), bool)
    new[1:] = False
    for f in fields:
        new[1:] |= f[1:] != f[:-1]
    return new


def multikey_quicksort(chars: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, number of each tie) of suffixes inside their groups, by ``depth`` characters.

    One character at a time; only suffixes that tie so far are looked at again.
    """
    order = np.argsort(group, kind="stable")
    tie = np.cumsum(_edges(group[order])) - 1
    for d in range(depth):
        sizes = np.bincount(tie)
        open_ = np.flatnonzero(sizes[tie] > 1)
        mine = order[open_]
        sort = np.lexsort((chars[d, mine], tie[open_]))
        order[open_] = mine[sort]
        value = np.zeros(len(order), np.uint64)
        value[open_] = chars[d, order[open_]]
        tie = np.cumsum(_edges(tie, value)) - 1
    return order, tie


def blind_tries(chars: np.ndarray, order: np.ndarray, tie: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, number of each class of equal suffixes), from ties that share ``depth`` characters.

    All tries grow together. In each round the suffixes of a node are compared
    with the node's first leaf; those that differ branch off by the depth and
    character of the first difference, and each branch is a node of the next round.
    """
    order, tie = order.copy(), tie.copy()
    length = len(chars)
    sizes = np.bincount(tie)
    live = np.flatnonzero(sizes[tie] > 1)
    while len(live):
        mine, node = order[live], tie[live]
        leaf = mine[np.flatnonzero(_edges(node))][np.cumsum(_edges(node)) - 1]
        at = np.full(len(mine), length)  # of the first difference
        for d in range(length - 1, depth - 1, -1):
            at[chars[d, mine] != chars[d, leaf]] = d
        inner = np.minimum(at, length - 1)
        char, other = chars[inner, mine], chars[inner, leaf]
        same = at == length
        side = np.where(same, 0, np.where(char < other, -1, 1))
        char = np.where(same, np.uint64(0), char)
        near = np.where(side < 0, at, -at)  # smaller ones: early branches first; larger ones: last
        sort = np.lexsort((char, near, side, node))
        order[live] = mine[sort]
        new = _edges(node[sort], side[sort], near[sort], char[sort])
        rise = np.zeros(len(order), np.int64)
        rise[live[new]] = 1
        first = np.zeros(len(order), bool)
        first[live[_edges(node[sort])]] = True
        rise[first] = 0  # the node's first branch keeps its number
        tie = tie + np.cumsum(rise)
        sizes = np.bincount(tie)
        going = (side[sort] != 0) & (sizes[tie[live]] > 1)
        live = live[going]
    return order, tie


def deep_shallow(data: np.ndarray, first: np.ndarray, count: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Class of equal 50-byte suffixes, for the windows of each run, runs one after the other."""
    chars = characters(data, spread(first, count))
    order, tie = multikey_quicksort(chars, np.repeat(group, count), SHALLOW)
    order, tie = blind_tries(chars, order, tie, SHALLOW)
    out = np.empty(len(order), np.int64)
    out[order] = tie
    return out


def finish(raw: bytes, start: np.ndarray, count: np.ndarray) -> tuple:
    """Figures of a text without the bytes under its repeated windows."""
    size = len(raw)
    if not len(start):
        return size, 0, 0, hashlib.sha256(raw).hexdigest()
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, start.astype(np.int64), 1)
    np.add.at(change, start.astype(np.int64) + count + WIDTH - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1))
    return size, size - len(kept), n_spans, hashlib.sha256(kept).hexdigest()


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, RULE, deep_shallow, finish, ARROW, SCHEMA)
