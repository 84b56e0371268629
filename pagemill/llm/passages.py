"""Removal of words whose 20-word window stands earlier in the corpus, by partitioned suffix trees.

The routes of :mod:`pagemill.llm.repeats` split the suffixes into groups that fit in
memory, by a few words of each where these are rare and by all 20 words where they are
frequent. A group is a subtree: its suffixes as leaves in order, the depth at which
each branches from the one before, and the inner nodes, which are the ranges of leaves
that share a depth. An inner node of a depth of 20 words or more is a repeat; its
leaves are windows with the same words, and all but the earliest are removed.
Suffixes are ordered by ranks of their first 1, 2, 4, 8, 16 and 20 words, each made of
two shorter ranks, so words are compared and not hashes of passages.

Defined cases: a null text has no words; texts under 20 words lose nothing;
words are compared unchanged, each by a 64-bit hash of its bytes; rows that share a doc_id are not
compared with each other; a null doc_id comes after all others. Only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.repeats import Rule, remove_repeats, spread

WIDTH, GRAM = 20, 5
RULE = Rule(WIDTH, GRAM, of_words=True, within=True)
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


SPANS = (1, 2, 4, 8, 16)  # words that ranks stand for, each twice the one before


@dataclass
class Subtree:
    """Leaves (numbers of the suffixes) in order, and how many words each shares with the leaf before."""

    leaves: np.ndarray
    shared: np.ndarray

    def nodes(self, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(depth, first leaf, last leaf) of the inner nodes of a depth of ``least`` words or more, deepest first."""
        out = []
        for depth in range(WIDTH, least - 1, -1):
            if not (self.shared == depth).any():
                continue
            first = np.flatnonzero(self.shared < depth)
            last = np.append(first[1:], len(self.shared)) - 1
            here = np.maximum.reduceat(np.where(self.shared == depth, 1, 0), first) > 0  # some leaves branch at this depth
            out.append((np.full(here.sum(), depth), first[here], last[here]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*out))


def ranks(data: np.ndarray) -> dict[int, np.ndarray]:
    """For every span the place of each run of so many words in the order of all of them."""
    out = {1: np.unique(data, return_inverse=True)[1].astype(np.int64)}
    for short, span in zip(SPANS, SPANS[1:]):
        out[span] = _joined(out[short], out[short], short)
    out[WIDTH] = _joined(out[16], out[4], 16)
    return out


def _joined(left: np.ndarray, right: np.ndarray, apart: int) -> np.ndarray:
    count = max(min(len(left), len(right) - apart), 0)
    pairs = left[:count] * (int(right.max(initial=0)) + 1) + right[apart : apart + count]
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def suffix_tree(data: np.ndarray, at: np.ndarray, prefix: np.ndarray) -> Subtree:
    """The subtrees of the suffixes at ``at``, one for each prefix group, one after the other.

    Suffixes of different groups share nothing; depths are cut at WIDTH.
    """
    order = ranks(data)
    leaves = np.lexsort((order[WIDTH][at], prefix))
    place = at[leaves]
    shared = np.zeros(len(leaves), np.int64)
    alike = prefix[leaves][1:] == prefix[leaves][:-1]
    one, two = place[:-1], place[1:]
    for span in reversed(SPANS):
        fits = alike & (shared[1:] + span <= WIDTH)
        a, b = one[fits] + shared[1:][fits], two[fits] + shared[1:][fits]
        more = np.zeros(len(one), np.int64)
        more[fits] = np.where(order[span][a] == order[span][b], span, 0)
        shared[1:] += more
    return Subtree(leaves, shared)


def deep_nodes(data: np.ndarray, first: np.ndarray, count: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The inner node of depth WIDTH that each window stands under, a number of its own where there is none."""
    tree = suffix_tree(data, spread(first, count), np.repeat(group, count))
    _, low, high = tree.nodes(WIDTH)
    number = np.arange(len(tree.leaves))
    size = high - low + 1
    number[spread(low, size)] = np.repeat(low, size)
    out = np.empty(len(tree.leaves), np.int64)
    out[tree.leaves] = number
    return out


def finish(raw: bytes, start: np.ndarray, count: np.ndarray) -> tuple:
    """Figures of a text without the words under its repeated windows."""
    found = raw.split()
    kept = found
    if len(start):
        change = np.zeros(len(found) + 1, np.int32)
        np.add.at(change, start.astype(np.int64), 1)
        np.add.at(change, start.astype(np.int64) + count + WIDTH - 1, -1)
        kept = [found[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return len(found), len(found) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def remove_repeated_passages(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, RULE, deep_nodes, finish, ARROW, SCHEMA)
