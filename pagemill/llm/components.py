"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources.tables import stored

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is its smallest node.

    Large-star and small-star rounds: every edge is moved to the smallest neighbour
    of one of its ends until all edges of a component meet in its smallest node.
    The edges of a round are written to the shared folder, which cuts the lineage.
    """
    at = _tidy(edges)
    mark = None
    at = stored(at, "components")
    for _ in range(ROUNDS):
        at = stored(_small_star(_large_star(at)), "components")
        row = at.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark:
            break
        mark = (row.n, row.h)
    else:
        raise RuntimeError("components did not settle")
    roots = at.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()


def _tidy(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with u > v, each once."""
    return (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct()
    )


def _star(directed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v), and the least of every u and its neighbours."""
    least = directed.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
    return directed, least.select("_u", F.least("_u", "_m").alias("_m"))


def _large_star(at: DataFrame) -> DataFrame:
    """Larger neighbours of a node are joined to the node's least neighbour."""
    both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges, least = _star(both)
    joined = edges.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("_u"))
    return _tidy(joined.select(F.col("v").alias("a"), F.col("_m").alias("b")))


def _small_star(at: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are joined to the least of them."""
    edges, least = _star(at)
    joined = edges.join(least, F.col("u") == F.col("_u"))
    moved = joined.select(F.col("v").alias("a"), F.col("_m").alias("b"))
    return _tidy(moved.unionByName(least.select(F.col("_u").alias("a"), F.col("_m").alias("b"))))
