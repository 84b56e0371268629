"""Which character set bytes are in, by how likely each set makes them.

Bytes that are UTF-8 are UTF-8. Others are read as characters of each set, and the set
under which they are most likely is taken. A set's model is a share for each class of its
characters (pairs of a lead and a trail byte, or single bytes), spread evenly over the
codes of the class; bytes below 128 are alike in all sets and count nothing, unless a set
reads one as the second byte of a character. In Latin-1 a letter beyond ASCII rarely
follows another, which keeps pairs apart from two such letters. Classes are looked up by
two bytes for all bytes of a block of texts at once, in Arrow tasks.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import let

# --- Fixed values: code ranges of the classes of each set, and the share of each class in running text
# (first bytes, second bytes, share); a class of single bytes has no second bytes.
SINGLE = ()
SETS: dict[str, list[tuple[tuple[tuple[int, int], ...], tuple[tuple[int, int], ...], float]]] = {
    "GBK": [
        (((0xB0, 0xD7),), ((0xA1, 0xFE),), 0.85),  # frequent ideographs
        (((0xD8, 0xF7),), ((0xA1, 0xFE),), 0.03),  # others
        (((0xA1, 0xA3),), ((0xA1, 0xFE),), 0.11),  # marks
        (((0x81, 0xFE),), ((0x40, 0x7E), (0x80, 0xFE)), 0.01),
    ],
    "Big5": [
        (((0xA4, 0xC6),), ((0x40, 0x7E), (0xA1, 0xFE)), 0.85),
        (((0xC9, 0xF9),), ((0x40, 0x7E), (0xA1, 0xFE)), 0.03),
        (((0xA1, 0xA3),), ((0x40, 0x7E), (0xA1, 0xFE)), 0.11),
    ],
    "Shift_JIS": [
        (((0x82, 0x82),), ((0x9F, 0xF1),), 0.50),  # hiragana
        (((0x83, 0x83),), ((0x40, 0x7E), (0x80, 0x96)), 0.12),  # katakana
        (((0x88, 0x97),), ((0x40, 0x7E), (0x80, 0xFC)), 0.23),  # frequent ideographs
        (((0x81, 0x81),), ((0x40, 0x7E), (0x80, 0xFC)), 0.10),  # marks
        (((0x82, 0x9F), (0xE0, 0xEA)), ((0x40, 0x7E), (0x80, 0xFC)), 0.04),
        (((0xA1, 0xDF),), SINGLE, 0.005),
    ],
    "EUC-KR": [
        (((0xB0, 0xC8),), ((0xA1, 0xFE),), 0.87),  # hangul
        (((0xA1, 0xAC),), ((0xA1, 0xFE),), 0.11),  # marks
        (((0xCA, 0xFD),), ((0xA1, 0xFE),), 0.02),  # ideographs
    ],
    "ISO-8859-1": [
        (((0xC0, 0xFF),), SINGLE, 0.97),
        (((0xA0, 0xBF),), SINGLE, 0.02),
    ],
}
FOLLOWS = 0.05  # share of Latin-1 letters beyond ASCII that follow one
NEVER = 1e-6  # share of bytes that a set has no character for
# ------------------------------------------------------------------------------
BLOCK = 1 << 16  # bytes that are looked up at once, so few that their classes stay near the processor
WIDTH = 2 + max(map(len, SETS.values()))  # classes, one of none, and bytes without a character
UTF8, LATIN1 = "UTF-8", "ISO-8859-1"


def _codes(ranges: tuple[tuple[int, int], ...]) -> int:
    return sum(b - a + 1 for a, b in ranges)


def _within(ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Of every byte, whether it is in the ranges."""
    found = np.zeros(256, bool)
    for a, b in ranges:
        found[a : b + 1] = True
    return found


@functools.cache
def _classes(name: str) -> tuple[np.ndarray, np.ndarray]:
    """The class of every two bytes (number: second byte * 256 + first) and of every single byte.

    A class is its place in the list from 1, the first that holds the bytes. Two bytes that are no character are
    0; single bytes without one come after all classes, and those below 128 are 0.
    """
    classes = SETS[name]
    pairs, singles = np.zeros((256, 256), np.uint8), np.zeros(256, np.uint8)
    singles[0x80:] = len(classes) + 1
    for k in range(len(classes), 0, -1):
        first, second, _ = classes[k - 1]
        if second:
            pairs[np.outer(_within(second), _within(first))] = k
        else:
            singles[_within(first)] = k
    return pairs.ravel(), singles


def _counts(name: str, data: np.ndarray, two: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many characters of each class, and bytes without a character, each row has; ``row`` in steps of WIDTH.

    Bytes are cut from left to right. Where two bytes make a character and the next two as well,
    each second one of such a run is the end of a character, as characters do not overlap.
    """
    pairs, singles = _classes(name)
    open_ = data >= 0x80  # bytes that count, but for those of characters of two
    at = kind = np.zeros(0, np.int64)
    if pairs.any():
        of = pairs.take(two)
        found = of != 0
        edge = found.copy()
        edge[1:] ^= found[:-1]  # each run begins at one edge and ends at the next
        edge = np.flatnonzero(edge)
        begins, ends = edge[0::2], edge[1::2]
        if len(ends) < len(begins):
            ends = np.append(ends, len(found))
        many = (ends - begins + 1) // 2
        at = np.repeat(begins - 2 * (np.cumsum(many) - many), many) + 2 * np.arange(many.sum())
        kind = of.take(at)
        open_[at] = False
        open_[at + 1] = False
    alone = np.flatnonzero(open_)
    total = np.bincount(row.take(at) + kind, minlength=rows * WIDTH) + np.bincount(row.take(alone) + singles.take(data.take(alone)), minlength=rows * WIDTH)
    return total.reshape(rows, WIDTH)[:, 1 : len(SETS[name]) + 2]


def _scores(texts: pa.Array) -> np.ndarray:
    """Log likelihood of each text under each set, a row for each text; a null text is like an empty one."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(t for t in texts.to_pylist() if t), np.uint8)
    rows = len(sizes)
    row = np.repeat(np.arange(rows, dtype=np.int64) * WIDTH, sizes)
    two = data.astype(np.int64)
    two[:-1] |= two[1:] << 8
    two &= 0xFFFF
    ends = np.cumsum(sizes)[sizes > 0] - 1
    two[ends] = data[ends]  # of the last byte no character begins that goes on in the next text
    out = np.zeros((rows, len(SETS)))
    for k, (name, classes) in enumerate(SETS.items()):
        counts = _counts(name, data, two, row, rows).astype(float)
        logs = [math.log(share / (_codes(f) * max(_codes(s), 1))) for f, s, share in classes] + [math.log(NEVER)]
        total = counts.sum(1) * logs[-1]
        for i in range(len(classes)):
            total = total + counts[:, : i + 1].sum(1) * (logs[i] - logs[i + 1])
        out[:, k] = total
    high = data >= 0x80
    begins = high.copy()
    begins[1:] &= ~high[:-1] | (row[1:] != row[:-1])
    n, runs = (np.bincount(row[x] // WIDTH, minlength=rows).astype(float) for x in (high, begins))
    latin = list(SETS).index(LATIN1)
    out[:, latin] = out[:, latin] + (n - runs) * math.log(FOLLOWS) + runs * math.log(1 - FOLLOWS)
    return out


def _likelihoods(column: pa.Array) -> pa.Array:
    """The scores of the texts of a column, in blocks of bounded size; null for null."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    found = np.concatenate([_scores(column.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])] or [np.zeros((0, len(SETS)))])
    edges = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * len(SETS), mask=np.append(column.is_null().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(edges, pa.array(found.ravel()))


def detect_charset(content: Column) -> Column:
    """``struct<charset, confidence>`` of bytes; null bytes are null.

    The confidence is the share of the best set in the likelihoods of all, for UTF-8 it is
    1. Equal likelihoods go to the set that is listed first.
    """

    def best(logs: Column) -> Column:
        scores = F.array(*(F.struct(logs[i].alias("log"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, n in enumerate(SETS)))

        def told(found: Column) -> Column:
            top = F.array_max(found)
            rest = F.aggregate(found, F.lit(0.0), lambda acc, s: acc + F.exp(F.greatest(s["log"] - top["log"], F.lit(-700.0))))
            return F.struct(top["name"].alias("charset"), (1 / rest).alias("confidence"))

        return let(scores, told)

    known = F.struct(F.lit(UTF8).alias("charset"), F.lit(1.0).alias("confidence"))
    others = F.when(~F.is_valid_utf8(content.cast("string")), content)
    logs = F.arrow_udf(_likelihoods, "array<double>")(others)
    return F.when(content.isNull(), None).when(logs.isNull(), known).otherwise(let(logs, best))
