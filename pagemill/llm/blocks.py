"""Blocks of texts inside Arrow tasks: bounded slices, words and their hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 10_000

# The word rule of all operators: runs of bytes outside \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

U = np.uint64
_TABLE = np.random.default_rng(20).integers(0, 2**63, (64, 256), dtype=np.uint64) * U(2) + U(1)


def slices(batches: Iterator[pa.RecordBatch], column: str, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of each batch whose texts sum to about ``block_bytes``; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // block_bytes + np.arange(len(sizes)) // BLOCK_ROWS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def map_blocks(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    *,
    column: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``work`` over slices of the rows, in Arrow tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in slices(batches, column, block_bytes):
            yield work(block)

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hash_runs(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each of the runs of bytes, none empty, that follow each other in ``data``."""
    place = np.arange(len(data), dtype=np.int64) - np.repeat(first, sizes)
    value = _TABLE[place & 63, data]
    if sizes.max() > 64:
        value = value * (U(2) * (place >> 6).astype(U) + U(1))
    return mix64(np.add.reduceat(value, first))


def lower_ascii(raw: bytes) -> bytes:
    return raw.lower()  # bytes.lower changes A-Z only


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Words of all texts: (hash, start, end, joined bytes, words before each text).

    ``start`` and ``end`` are places in the joined bytes; the last array has one
    entry more than there are texts.
    """
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    before = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, U), starts, ends, joined, before
    sizes = ends - starts
    value = hash_runs(data[~space], np.cumsum(sizes) - sizes, sizes)
    return value, starts, ends, joined, before


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbours; as many less as there are entries fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U)
    out = np.zeros(count, U)
    for k in range(n):
        out *= U(0x9E3779B97F4A7C15)
        out += hashes[k : k + count]
    return mix64(out)
