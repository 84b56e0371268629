"""Narrow records moved between tasks as packed arrays.

Millions of small records, such as hashes with the document they stand in, move
as one row per sending block and receiving bucket, with each field packed in a
binary column. Rows are (bucket, kind, tag, a, b, c, d, e).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FIELDS = ("a", "b", "c", "d", "e")
SCHEMA = "bucket int, kind int, tag bigint, " + ", ".join(f"{f} binary" for f in FIELDS)
_ARROW = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32()), ("tag", pa.int64()), *((f, pa.binary()) for f in FIELDS)]
)
Row = tuple


def buckets(spark: SparkSession) -> int:
    """Buckets of an exchange: four for each shuffle partition, so that hashing spreads them evenly."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def planes(values: np.ndarray) -> bytes:
    """The bytes of an array by significance: first all lowest bytes, and so on, which compresses well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def values_of(stored: bytes | None, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(stored or b"", np.uint8).reshape(size, -1).T).view(dtype).ravel()


def exchange(packed: DataFrame) -> DataFrame:
    """Rows of a bucket together, in one partition after the other."""
    partitions = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")


def batch(rows: list[Row]) -> pa.RecordBatch:
    """Rows (bucket, kind, tag, fields...) as Arrow; missing fields are null."""
    width = 3 + len(FIELDS)
    columns = list(zip(*[(*r, *[None] * (width - len(r))) for r in rows])) or [()] * width
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def cut(key: np.ndarray, fields: list[np.ndarray], kind: int, tag: int = 0) -> Iterator[Row]:
    """One row per value of ``key`` with its entries of every field."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    key = key[order]
    fields = [f[order] for f in fields]
    edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    for a, b in zip(edges, edges[1:]):
        yield (int(key[a]), kind, tag, *(planes(f[a:b]) for f in fields))


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """(bucket, rows) of a sorted partition, one bucket after the other."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and row["bucket"] != held[0]["bucket"]:
                yield held[0]["bucket"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["bucket"], held


def column(rows: list[dict], field: str, dtype: type) -> np.ndarray:
    """A field of all rows, one after the other."""
    return np.concatenate([values_of(r[field], dtype) for r in rows] or [np.zeros(0, dtype)])
