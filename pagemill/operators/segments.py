"""Ordered scans over a key that may hold a large share of the table.

A plain window sends all rows of a key to one task. Here the rows of a key are
cut into segments of their order column; a window runs inside each segment, and
one small row per segment carries the state from segment to segment. The big
table is shuffled once, by (key, segment), and the carry join reuses that.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SEGMENT, PART = "_segment", "_part"
ROWS_PER_SEGMENT = 8192


def by_position(position: str, rows: int = ROWS_PER_SEGMENT) -> Column:
    """Segments of an integer order column."""
    return F.floor(F.col(position) / rows).cast("bigint")


def by_second(ts: str) -> Column:
    """Segments of a time column, short enough for a user with very many events."""
    return F.date_trunc("second", F.col(ts))


def segmented(df: DataFrame, keys: Sequence[str], segment: Column) -> DataFrame:
    """Add the key of a row's segment, by which windows and the carry join share one shuffle.

    It is one column, never null, in which null keys are equal to each other. Rows that come
    dealt out by it already keep theirs.
    """
    return df if SEGMENT in df.columns else df.withColumn(SEGMENT, F.struct(*keys, segment.alias(PART)))


def _across(keys: Sequence[str]) -> WindowSpec:
    """The segments of a key in order."""
    return Window.partitionBy(*[f"{SEGMENT}.{key}" for key in keys]).orderBy(f"{SEGMENT}.{PART}")


def _carry(rows: DataFrame, totals: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """Join the per-segment state, scanned over the segments of a key, to the rows."""
    state = totals.select(F.col(SEGMENT).alias("_of"), *[c.alias(name) for name, c in carried.items()])
    return rows.join(state, F.col(SEGMENT) == F.col("_of"), "left").drop("_of")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    segment: Column,
    value: Column,
    out: str,
) -> DataFrame:
    """Add ``out``: sum of ``value`` from the first row of the key to this one."""
    rows = segmented(df, keys, segment).withColumn("_value", value.cast("bigint"))
    local = Window.partitionBy(SEGMENT).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    earlier = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(SEGMENT).agg(F.sum("_value").alias("_total"))
    scanned = rows.withColumn("_local", F.sum("_value").over(local))
    joined = _carry(scanned, totals, {"_before": F.sum("_total").over(earlier)})
    return joined.withColumn(
        out, F.coalesce(F.col("_before"), F.lit(0)) + F.col("_local")
    ).drop("_value", "_local", "_before", SEGMENT)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], segment: Column, out: str
) -> DataFrame:
    """Add ``out``: 1, 2, 3 ... in order within each key."""
    return running_sum(df, keys, order, segment, F.lit(1), out)


def run_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    values: Sequence[str],
    opens: Callable[[Column, Column], Column],
    out: str,
) -> DataFrame:
    """Add ``out``: the number, from 1, of the run each row of a key belongs to.

    ``opens(previous, current)`` says, from the ``values`` of two neighbours,
    whether the later one starts a new run; the first row of a key always does.
    The rows are read twice, so a costly input should be a stored table.
    """
    local = Window.partitionBy(SEGMENT).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = _across(keys)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)

    def step(previous: Column, current: Column) -> Column:
        starts = F.coalesce(opens(previous, current), F.lit(True))
        return F.when(previous.isNull() | starts, 1).otherwise(0)

    rows = (
        segmented(df, keys, segment)
        .withColumn("_this", F.struct(*values))
        .withColumn("_n", F.row_number().over(local))
        .withColumn("_prev", F.lag("_this").over(local))
        .withColumn(
            "_open", F.when(F.col("_n") > 1, step(F.col("_prev"), F.col("_this"))).otherwise(0)
        )
    )
    totals = rows.groupBy(SEGMENT).agg(
        F.sum("_open").alias("_opened"),
        F.min_by("_this", "_n").alias("_first"),
        F.max_by("_this", "_n").alias("_last"),
    )
    scanned = totals.withColumn("_head", step(F.lag("_last").over(across), F.col("_first")))
    before = F.coalesce(F.sum(F.col("_head") + F.col("_opened")).over(earlier), F.lit(0))
    joined = _carry(
        rows.withColumn("_local", F.sum("_open").over(upto)),
        scanned,
        {"_base": before + F.col("_head")},
    )
    return joined.withColumn(out, F.col("_base") + F.col("_local")).drop(
        "_this", "_n", "_prev", "_open", "_local", "_base", SEGMENT
    )
