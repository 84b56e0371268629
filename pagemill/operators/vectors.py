"""Exact nearest chunks by cosine similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 2048  # queries that a task multiplies its vectors with at once
PART_ROWS = 100_000  # rows that meet a block of queries in one piece
ROW_BLOCK = 1024
DIGITS = 6  # of the similarity that is shown; ranks are by the unrounded value


def usable(vector: Column) -> Column:
    """A vector with a direction: not null, no null, NaN or infinite entry, not all zero."""
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda v: v != 0), F.lit(False))


def vector_rejects(table: DataFrame, width: int, *, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows that no search of ``width`` entries can rank, with why."""
    v = F.col(vector)
    reason = (
        F.when(v.isNull(), "no vector")
        .when(F.size(v) != width, "another width")
        .when(~usable(v), "no direction")
    )
    return table.select(id_column, reason.alias("reject_reason")).filter(F.col("reject_reason").isNotNull())


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, equal ones by id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def cosine_top_k_batch(
    table: DataFrame, queries: DataFrame, k: int, *, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` rows most like each query: query_id, id, similarity, rank.

    ``queries`` has (query_id, vector). Up to ``QUERY_BLOCK`` of them are sent to all
    tasks; more are dealt out in blocks that meet parts of the rows in tasks, in one scan
    of the rows. A task multiplies its vectors with the block and gives on its own best
    ``k`` of each query, so what leaves it does not grow with the product of rows and queries.
    Rows and queries without a direction are left out, see
    :func:`vector_rejects`; a row is compared with the queries of its width.
    """
    asked = queries.filter(usable(F.col(vector))).select("query_id", F.col(vector).alias("_query"))
    rows = table.filter(usable(F.col(vector))).select(id_column, F.transform(vector, lambda v: v.cast("double")).alias("_vector"))
    kinds = f"query_id {dict(queries.dtypes)['query_id']}, {id_column} {dict(table.dtypes)[id_column]}, similarity double"
    count = asked.count()
    if count <= QUERY_BLOCK:
        found = _best_of_few(rows, [(r["query_id"], r["_query"]) for r in asked.collect()], k, kinds)
    else:
        found = _best_of_many(rows, asked, math.ceil(count / QUERY_BLOCK), k, kinds)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col(id_column).asc())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.withColumn("similarity", F.round("similarity", DIGITS))


def _units(queries: list[tuple]) -> dict[int, tuple[list, np.ndarray]]:
    """Names and unit vectors of queries (name, vector), by width."""
    out = {}
    for width in sorted({len(v) for _, v in queries}):
        mine = [(name, v) for name, v in queries if len(v) == width]
        matrix = np.array([v for _, v in mine], np.float64)
        out[width] = [name for name, _ in mine], matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    return out


def _nearest(rows: pa.RecordBatch | pa.Table, units: dict[int, tuple[list, np.ndarray]], k: int) -> Iterator[list[pa.Array]]:
    """(query, id, similarity) of the best ``k`` of these rows (id, vector), for each query."""
    sizes = pc.list_value_length(rows.column(1)).to_numpy()
    for width, (names, unit) in units.items():
        part = rows.filter(pa.array(sizes == width))
        if not part.num_rows:
            continue
        vectors = pc.list_flatten(part.column(1)).to_numpy().reshape(-1, width)
        scores = (unit @ vectors.T) / np.linalg.norm(vectors, axis=1)
        ids = part.column(0).to_numpy()
        tops = [_best(line, ids, k) for line in scores]
        yield [
            pa.array([n for n, top in zip(names, tops) for _ in top]),
            part.column(0).take(pa.array(np.concatenate(tops))),
            pa.array(np.concatenate([line[top] for line, top in zip(scores, tops)])),
        ]


def _best_of_few(rows: DataFrame, queries: list[tuple], k: int, schema: str) -> DataFrame:
    """Each task's best ``k`` rows of a bounded number of queries."""
    shared = rows.sparkSession.sparkContext.broadcast(_units(queries))
    names = [c.split()[0] for c in schema.split(", ")]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROW_BLOCK):
                table = pa.Table.from_batches([batch.slice(first, ROW_BLOCK)]).combine_chunks()
                for columns in _nearest(table, shared.value, k):
                    yield from pa.table(columns, names=names).to_batches()

    return rows.mapInArrow(best, schema)


def _best_of_many(rows: DataFrame, asked: DataFrame, blocks: int, k: int, schema: str) -> DataFrame:
    """The best ``k`` rows of every query in each part of the rows; parts and blocks of queries meet in tasks."""
    parts = max(1, math.ceil(rows.count() / PART_ROWS))
    id_column = rows.columns[0]
    names = [c.split()[0] for c in schema.split(", ")]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = rows.select(id_column, "_vector", deal(id_column, parts).alias("_part"), every(blocks).alias("_block"))
    right = asked.select("query_id", "_query", deal("query_id", blocks).alias("_block")).select("*", every(parts).alias("_part"))

    def meet(mine: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if mine.num_rows and queries.num_rows:
            units = _units(list(zip(queries.column("query_id").to_pylist(), queries.column("_query").to_pylist())))
            for first in range(0, mine.num_rows, ROW_BLOCK):
                part = mine.slice(first, ROW_BLOCK).select([id_column, "_vector"]).combine_chunks()
                out += [pa.table(c, names=names) for c in _nearest(part, units, k)]
        if out:
            return pa.concat_tables(out)
        return pa.table([queries.column("query_id")[:0], mine.column(id_column)[:0], pa.array([], pa.float64())], names=names)

    keys = ("_part", "_block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def cosine_top_k(table: DataFrame, query: DataFrame, k: int, *, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows most like one vector, the only row of ``query``."""
    one = query.select(F.lit(0).cast("bigint").alias("query_id"), vector)
    return cosine_top_k_batch(table, one, k, id_column=id_column, vector=vector).select(id_column, "similarity")
