"""Nearest chunks by cosine similarity through an index of coarse cells.

Cells are the Voronoi cells of unit centroids that spherical k-means finds on a
bounded sample; every row is indexed, in the list of its nearest cell. A list
entry is the row's residual to the centroid in single bytes, with the length of what
rounding left, so the similarity to a unit query is known up to that length.

A search ranks cells by their centroids and looks into the nearest ones: as many as a
bounded sample of the rows needs to find ``RECALL`` of its true neighbours, which is
measured when the index is built. Entries that may be among the best by their bounds
are ranked again by their full vectors. With
``exact`` a second pass looks into all other cells that can hold a better row: no row
of a cell is nearer to the query than the angle to its centroid less the cell's widest
angle. Lists and queries meet in pieces of bounded size, however hot a cell is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.operators.vectors import DIGITS, cosine_top_k_batch, usable

CELLS, MOST_CELLS = 64, 4096  # of a small table; of any
ROWS_PER_CELL = 40  # of the sample that k-means reads
ROUNDS = 8
LIST_ROWS, LIST_QUERIES = 50_000, 2_048  # of a cell that meet in one piece
SLACK = 1e-5  # of single precision sums
RECALL, TRIED, NEIGHBOURS = 0.97, 200, 10  # rows that the number of probes is measured with, and neighbours of each
LISTS, CENTROIDS, PROBES = "lists", "centroids", "probes"


def _unit(column: pa.Array, width: int) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return (flat / np.linalg.norm(flat, axis=1, keepdims=True)).astype(np.float32)


def _sound(table: DataFrame, width: int, id_column: str, vector: str) -> DataFrame:
    good = usable(F.col(vector)) & (F.size(vector) == width)
    return table.filter(good).select(F.col(id_column).alias("id"), F.transform(vector, lambda v: v.cast("double")).alias("vector"))


def cells_for(rows: int) -> int:
    """About the root of the rows, at least CELLS for all but tiny tables."""
    return int(max(1, min(max(CELLS, rows**0.5), MOST_CELLS, rows // 4)))


def train(rows: DataFrame, width: int, cells: int) -> np.ndarray:
    """Unit centroids of ``cells`` cells, by k-means on at most ``ROWS_PER_CELL`` rows a cell.

    Tasks sum the rows of each cell; the driver holds the centroids alone.
    """
    total = rows.count()
    if not total:
        return np.zeros((0, width), np.float32)
    draw = F.xxhash64(F.col("id").cast("string"))
    share = F.pmod(draw, F.lit(1 << 30)) < F.lit(int(min(1.0, 1.2 * ROWS_PER_CELL * cells / total) * (1 << 30)) + 1)
    sample = rows.filter(share).orderBy(draw, "id").limit(ROWS_PER_CELL * cells).select("vector").cache()
    first = sample.limit(cells).collect()
    centroids = _unit(pa.array([r.vector for r in first], pa.list_(pa.float64())), width)
    for _ in range(ROUNDS):
        sums = _sums(sample, centroids, width)
        for cell, vector in sums:
            centroids[cell] = vector
    sample.unpersist()
    return centroids


def _sums(sample: DataFrame, centroids: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
    """The unit mean of the sampled rows of each cell that has some."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), width))
        for batch in batches:
            unit = _unit(batch.column(0), width)
            np.add.at(sums, (unit @ centroids.T).argmax(1), unit)
        seen = np.flatnonzero(np.abs(sums).sum(1) > 0)
        yield pa.record_batch([pa.array(seen), pa.array(list(sums[seen]), pa.list_(pa.float64()))], ["cell", "sum"])

    def whole(table: pa.Table) -> pa.Table:
        sums = np.array(table.column("sum").to_pylist()).sum(0)
        return pa.table({"cell": table.column("cell")[:1], "sum": [sums.tolist()]})

    partial = sample.mapInArrow(part, "cell bigint, sum array<double>")
    rows = partial.groupBy("cell").applyInArrow(whole, "cell bigint, sum array<double>").collect()
    sums = [(r.cell, np.array(r["sum"])) for r in rows]
    return [(c, (s / np.linalg.norm(s)).astype(np.float32)) for c, s in sums if np.linalg.norm(s) > 0]


def build(
    table: DataFrame, path: str, *, width: int | None = None, cells: int | None = None, id_column: str = "vec_id", vector: str = "embedding"
) -> None:
    """Write the index of all rows of a width, the most frequent one by default: a folder of list entries a cell, and the centroids.

    Rows without a direction are in no list, see ``vectors.vector_rejects``.
    """
    if width is None:
        sizes = table.filter(usable(F.col(vector))).groupBy(F.size(vector).alias("width")).count()
        common = sizes.orderBy(F.desc("count"), "width").first()
        width = common.width if common else 0
    rows = _sound(table, width, id_column, vector)
    centroids = train(rows, width, cells or cells_for(rows.count()))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column("vector"), width)
            near = unit @ centroids.T
            cell = near.argmax(1)
            rest = unit - centroids[cell]
            scale = np.maximum(np.abs(rest).max(1), 1e-12) / 127
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            error = np.linalg.norm(rest - code * scale[:, None], axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            columns = (cell.astype(np.int32), scale.astype(np.float64), error.astype(np.float64), angle.astype(np.float64))
            arrays = [batch.column("id"), *map(pa.array, columns), pa.array([c.tobytes() for c in code], pa.binary())]
            yield pa.record_batch(arrays, ["id", "cell", "scale", "error", "angle", "code"])

    kind = dict(rows.dtypes)["id"]
    found = rows.mapInArrow(entries, f"id {kind}, cell int, scale double, error double, angle double, code binary")
    found.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/{LISTS}")
    spark = table.sparkSession
    known = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, centroid array<float>")
    lists = _lists(spark, path, kind).groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("widest"))
    known.join(lists, "cell", "left").write.mode("overwrite").parquet(f"{path}/{CENTROIDS}")
    probes = _probes(path, rows, width)
    spark.createDataFrame([(probes,)], "probes int").write.mode("overwrite").parquet(f"{path}/{PROBES}")


def _known(spark: SparkSession, path: str) -> list:
    return spark.read.parquet(f"{path}/{CENTROIDS}").filter(F.col("rows").isNotNull()).orderBy("cell").collect()


def _probes(path: str, rows: DataFrame, width: int) -> int:
    """How many of the nearest cells hold RECALL of the true neighbours of TRIED rows."""
    known = _known(rows.sparkSession, path)
    tried = rows.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(7)), "id").limit(TRIED).select(F.col("id").alias("query_id"), "vector")
    true = cosine_top_k_batch(rows, tried, NEIGHBOURS, id_column="id", vector="vector").select("query_id", "id")
    lists = _lists(rows.sparkSession, path, dict(rows.dtypes)["id"])
    held = true.join(lists.select("id", "cell"), "id").join(tried, "query_id").select("vector", "cell").collect()
    if not held:
        return 1
    near = _unit(pa.array([r.vector for r in held], pa.list_(pa.float64())), width) @ np.array([r.centroid for r in known], np.float32).T
    place = {r.cell: k for k, r in enumerate(known)}
    own = near[np.arange(len(held)), [place[r.cell] for r in held]]
    return int(np.quantile((near >= own[:, None]).sum(1), RECALL, method="higher"))


def _lists(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"id {kind}, scale double, error double, angle double, code binary, cell int").parquet(f"{path}/{LISTS}")


def search(
    path: str, table: DataFrame, queries: DataFrame, k: int, *, probes: int | None = None, exact: bool = False, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` rows most like each query: query_id, id, similarity, rank.

    ``queries`` (query_id, vector) may be of any number. The nearest ``probes`` cells of each, by
    default the number measured for the index, are looked into, and with ``exact`` all others that its best rows so far don't rule out.
    Queries without a direction, or of another width than the index, find nothing.
    """
    spark = table.sparkSession
    known = _known(spark, path)
    width = len(known[0].centroid) if known else 0
    probes = probes or spark.read.parquet(f"{path}/{PROBES}").first().probes
    asked = _sound(queries, width, "query_id", vector).select(F.col("id").alias("query_id"), "vector")
    rows = _sound(table, width, id_column, vector)
    ranked = _rows(_first_cells(asked, known, probes, width), path, rows, asked, known, k)
    if exact and known:
        worst = ranked.groupBy("query_id").agg(F.min("similarity").alias("worst"), F.count("*").alias("n"))
        open_ = asked.join(worst, "query_id", "left")
        floor = F.when(F.coalesce("n", F.lit(0)) < k, F.lit(-2.0)).otherwise(F.col("worst"))
        more = _other_cells(open_.select("query_id", "vector", floor.alias("floor")), known, probes, width)
        ranked = _best(ranked.select("query_id", "id", "similarity").unionByName(_rows(more, path, rows, asked, known, k).select("query_id", "id", "similarity")), k)
    return ranked.select("query_id", F.col("id").alias(id_column), F.round("similarity", DIGITS).alias("similarity"), "rank")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("id").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _first_cells(asked: DataFrame, known: list, probes: int, width: int) -> DataFrame:
    """(query_id, vector, cell) of the cells whose centroids are nearest."""
    return _cells(asked, known, width, lambda near, _: np.argsort(-near, axis=1, kind="stable")[:, :probes])


def _other_cells(open_: DataFrame, known: list, probes: int, width: int) -> DataFrame:
    """(query_id, vector, cell) of the cells beyond the first that may hold a row as near as ``floor``."""
    widest = np.array([r.widest for r in known])

    def choose(near: np.ndarray, floor: np.ndarray) -> list[np.ndarray]:
        bound = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - widest - SLACK, 0))
        order = np.argsort(-near, axis=1, kind="stable")[:, probes:]
        return [cells[bound[i, cells] >= floor[i] - SLACK] for i, cells in enumerate(order)]

    return _cells(open_, known, width, choose)


def _cells(asked: DataFrame, known: list, width: int, choose) -> DataFrame:  # noqa: ANN001
    centroids = np.array([r.centroid for r in known], np.float32).reshape(-1, max(width, 1))
    number = np.array([r.cell for r in known], np.int32)
    kind = dict(asked.dtypes)["query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _unit(batch.column("vector"), width) @ centroids.T
            floor = batch.column("floor").to_numpy() if "floor" in batch.schema.names else None
            chosen = choose(near, floor)
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(c) for c in chosen]))
            cell = number[np.concatenate(list(chosen))] if batch.num_rows else number[:0]
            yield pa.record_batch([batch.column("query_id").take(at), batch.column("vector").take(at), pa.array(cell)], ["query_id", "vector", "cell"])

    return asked.mapInArrow(run, f"query_id {kind}, vector array<double>, cell int")


def _by_piece(cell: Column, pieces: dict[int, int], most: int) -> Column:
    """How many pieces of ``most`` entries the cell has."""
    counts = [-(-n // most) for _, n in sorted(pieces.items())]
    place = F.array_position(F.lit([c for c, _ in sorted(pieces.items())]), cell).cast("int")
    return F.coalesce(F.get(F.lit(counts), place - 1), F.lit(1))


def _rows(probed: DataFrame, path: str, rows: DataFrame, asked: DataFrame, known: list, k: int) -> DataFrame:
    """The best ``k`` rows of each query in its probed cells: query_id, id, similarity, rank."""
    spark = rows.sparkSession
    kinds = dict(rows.dtypes)["id"], dict(asked.dtypes)["query_id"]
    asked_of = {r.cell: r["count"] for r in probed.groupBy("cell").count().collect()}  # as many rows as cells at most
    width = len(known[0].centroid) if known else 0
    centroids = {r.cell: np.array(r.centroid, np.float32) for r in known if r.cell in asked_of}
    list_pieces = _by_piece(F.col("cell"), {r.cell: r.rows for r in known if r.cell in asked_of}, LIST_ROWS)
    query_pieces = _by_piece(F.col("cell"), asked_of, LIST_QUERIES)
    lists = _lists(spark, path, kinds[0]).filter(F.col("cell").isin(list(asked_of)))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    left = lists.select("*", own("id", list_pieces).alias("piece"), every(query_pieces).alias("asking"))
    right = probed.select("*", own("query_id", query_pieces).alias("asking")).select("*", every(list_pieces).alias("piece"))

    def meet(entries: pa.Table, asking: pa.Table) -> pa.Table:
        if not entries.num_rows or not asking.num_rows:
            return pa.table({"query_id": asking.column("query_id")[:0], "id": entries.column("id")[:0]})
        cell = entries.column("cell")[0].as_py()
        unit = _unit(asking.column("vector").combine_chunks(), width)
        code = np.frombuffer(b"".join(entries.column("code").to_pylist()), np.int8).reshape(-1, width).astype(np.float32)
        near = (unit @ code.T) * entries.column("scale").to_numpy().astype(np.float32) + (unit @ centroids[cell])[:, None]
        error = entries.column("error").to_numpy() + SLACK
        who, which = [], []
        for i, line in enumerate(near):
            low = line - error
            least = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            at = np.flatnonzero(line + error >= least)
            who.append(np.full(len(at), i))
            which.append(at)
        return pa.table({"query_id": asking.column("query_id").take(pa.array(np.concatenate(who))), "id": entries.column("id").take(pa.array(np.concatenate(which)))})

    keys = ("cell", "piece", "asking")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"query_id {kinds[1]}, id {kinds[0]}")
    both = near.join(rows, "id").join(asked.withColumnRenamed("vector", "query"), "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    cosine = dot("query", "vector") / F.sqrt(dot("query", "query")) / F.sqrt(dot("vector", "vector"))
    return _best(both.select("query_id", "id", cosine.alias("similarity")), k)
