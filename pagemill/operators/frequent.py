"""Most frequent items of any range of time, from a sketch of fixed size for each hour.

A sketch holds at most ``capacity`` items with counts, and an error: an item was
seen at least as often as its count says and at most ``error`` times more, one that is not
in the sketch at most ``error`` times. It is made by taking the count of the first item
that doesn't fit off all others, which a merge of sketches does again with their sums;
the error of a sketch is at most its total divided by the capacity. An hour's sketch is made
once; a range reads the sketches of its hours and then the log only for the few items
that the bounds leave open, so what it returns is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 1024
ITEMS = "array<struct<item:{kind},n:bigint>>"


def _reduced(counts: DataFrame, capacity: int) -> DataFrame:
    """(period, error, items) of counts (period, item, n): the largest, less the first that doesn't fit.

    A rank filter of this form is applied in every partition first.
    """
    order = Window.partitionBy("period").orderBy(F.col("n").desc(), F.col("item").asc())
    kept = counts.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= capacity + 1)
    cut = F.coalesce(F.max(F.when(F.col("_rank") == capacity + 1, F.col("n"))), F.lit(0))
    held = kept.groupBy("period").agg(cut.alias("error"), F.collect_list(F.struct("item", "n")).alias("_all"))
    less = F.transform("_all", lambda x: F.struct(x["item"].alias("item"), (x["n"] - F.col("error")).alias("n")))
    return held.select("period", "error", F.filter(less, lambda x: x["n"] > 0).alias("items"))


def sketches(log: DataFrame, item: str, ts: str = "ts", capacity: int = CAPACITY) -> DataFrame:
    """One row per hour of the log: period, total, error, items. Rows without an item or a time are passed over."""
    rows = log.filter(F.col(item).isNotNull() & F.col(ts).isNotNull())
    counts = rows.groupBy(F.date_trunc("hour", F.col(ts)).alias("period"), F.col(item).alias("item")).agg(F.count("*").alias("n"))
    totals = rows.groupBy(F.date_trunc("hour", F.col(ts)).alias("period")).agg(F.count("*").alias("total"))
    return totals.join(_reduced(counts, capacity), "period")


def merged(parts: DataFrame, capacity: int = CAPACITY, period: Column | None = None) -> DataFrame:
    """One sketch of all rows of sketches, or one for each value of ``period``: period, total, error, items."""
    period = F.lit(0) if period is None else period
    named = parts.withColumn("period", period)
    counts = named.select("period", F.inline("items")).groupBy("period", "item").agg(F.sum("n").alias("n"))
    sums = named.groupBy("period").agg(F.sum("total").alias("total"), F.sum("error").alias("_error"))
    joined = sums.join(_reduced(counts, capacity).withColumnRenamed("error", "_cut"), "period", "left")
    return joined.select(
        "period", "total", (F.col("_error") + F.coalesce("_cut", F.lit(0))).alias("error"), F.coalesce("items", F.array()).alias("items")
    )


def open_items(sketch: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """The items of a sketch that may be among the ``n`` most frequent, and whether none outside it may.

    Of the sketch, which has a bounded number of items, two numbers reach the driver.
    """
    items = sketch.select("error", F.inline("items"))
    least = items.orderBy(F.col("n").desc()).limit(n).agg(F.min("n").alias("least"), F.count("*").alias("held"), F.max("error").alias("error")).first()
    error = sketch.agg(F.max("error")).first()[0] or 0
    bound = least.least if least.held == n else 0
    whole = error == 0 or (least.held == n and bound > error)
    return items.filter(F.col("n") + error >= bound).select("item"), whole


def top_of_range(log: DataFrame, parts: DataFrame, start: Column, end: Column, n: int, item: str, ts: str = "ts", capacity: int = CAPACITY) -> DataFrame:
    """The ``n`` most frequent items of the hours from ``start`` to before ``end``: item, score; ties list the higher first.

    Exact: the open items are counted in the log. If the bounds can't rule out an item outside
    the sketch, which a larger capacity mends, all items of the range are counted.
    """
    found = merged(parts.filter((F.col("period") >= start) & (F.col("period") < end)), capacity)
    candidates, whole = open_items(found, n)
    rows = log.filter((F.col(ts) >= start) & (F.col(ts) < end) & F.col(item).isNotNull()).select(F.col(item).alias("item"))
    if whole:
        rows = rows.join(candidates, "item", "left_semi")
    return rows.groupBy("item").agg(F.count("*").alias("score")).orderBy(F.col("score").desc(), F.col("item").desc()).limit(n)
