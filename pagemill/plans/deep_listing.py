"""Pages far down a sorted listing, from a stored table of boundary rows.

A numbered page needs the rows before it counted. One pass sorts the keys of a listing by
ranges and keeps the key at every ``step``-th place; a page then starts from the last
boundary before it, so its top-n holds at most ``step`` rows and a page, however deep it lies.
The boundaries are those of the catalog they were made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.constants import DEFAULT_PAGE_SIZE
from pagemill.operators.catalog import catalog_search, check_paging, check_sort
from pagemill.sources.tables import stored

STEP = 10_000
LOCAL = (1 << 33) - 1  # the bits of a generated id that number the rows of a partition


def _directed(sort_by: str, sort_order: str) -> list[Column]:
    return [F.col(c).asc() if sort_order == "asc" else F.col(c).desc() for c in (sort_by, "id")]


def boundaries(catalog: DataFrame, *, sort_by: str = "created_at", sort_order: str = "desc", step: int = STEP, **filters: object) -> DataFrame:
    """(place, key, id): the sort key and id at every ``step``-th place, from 0, of the listing with these filters."""
    check_sort(sort_by, sort_order)
    spark = catalog.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _directed(sort_by, sort_order)
    keys = catalog_search(catalog, **filters).select(sort_by, "id")
    ranged = keys.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    numbered = ranged.select(F.col(sort_by).alias("key"), "id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL)).alias("at"))
    held = stored(numbered, "listing")
    sizes = {r.part: r["count"] for r in held.groupBy("part").count().collect()}  # one of each partition
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    place = F.get(F.lit(before or [0]).cast("array<bigint>"), F.col("part")) + F.col("at")
    return held.select(place.alias("place"), "key", "id").filter(F.col("place") % step == 0)


def _from(key: object, last: object, sort_by: str, up: bool) -> Column:
    """Rows at or after a boundary; null keys come first going up, and last going down. The bound reaches the scan."""
    value = F.col(sort_by)
    tie = F.col("id") >= F.lit(last) if up else F.col("id") <= F.lit(last)
    if key is None:
        return value.isNotNull() | tie if up else value.isNull() & tie
    bound = value >= F.lit(key) if up else value <= F.lit(key)
    return bound & ((value != F.lit(key)) | tie) if up else value.isNull() | (bound & ((value != F.lit(key)) | tie))


def deep_page(
    catalog: DataFrame, bounds: DataFrame, *, sort_by: str = "created_at", sort_order: str = "desc", page: int, page_size: int = DEFAULT_PAGE_SIZE, **filters: object
) -> DataFrame:
    """The numbered page of a sorted listing, as ``sorted_listing`` gives it, by its ``boundaries``."""
    check_paging(page, page_size)
    check_sort(sort_by, sort_order)
    wanted = (page - 1) * page_size
    start = bounds.filter(F.col("place") <= wanted).orderBy(F.col("place").desc()).limit(1).collect()
    rows = catalog_search(catalog, **filters)
    skipped = wanted
    if start:
        skipped = wanted - start[0].place
        rows = rows.filter(_from(start[0].key, start[0]["id"], sort_by, sort_order == "asc"))
    return rows.orderBy(*_directed(sort_by, sort_order)).offset(skipped).limit(page_size)
