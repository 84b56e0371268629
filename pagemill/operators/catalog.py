"""Queries over the document catalog."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from pagemill.constants import (
    DEFAULT_PAGE_SIZE,
    MAX_PAGE_SIZE,
    SORTABLE_COLUMNS,
    STATUSES,
)
from pagemill.functions.encoding import decode_cursor, encode_cursor
from pagemill.functions.text import iso_micros


def check_paging(page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> None:
    if page < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be between 1 and {MAX_PAGE_SIZE}")


def check_sort(sort_by: str, sort_order: str) -> None:
    if sort_by not in SORTABLE_COLUMNS:
        raise ValueError(f"sort_by must be one of {', '.join(SORTABLE_COLUMNS)}")
    if sort_order not in ("asc", "desc"):
        raise ValueError("sort_order must be asc or desc")


def check_status(status: str) -> None:
    if status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")


def get_by_id(table: DataFrame, row_id: object, *, id_column: str = "id") -> DataFrame:
    return table.filter(F.col(id_column) == F.lit(row_id))


def get_by_ids(
    table: DataFrame, ids: Sequence[object] | DataFrame, *, id_column: str = "id"
) -> DataFrame:
    """Rows of the given ids: a pushed-down list, or a semi join with a table of ids."""
    if isinstance(ids, DataFrame):
        return table.join(ids.select(id_column), id_column, "left_semi")
    return table.filter(F.col(id_column).isin(*ids))


def catalog_filter(
    *,
    user_id: object | None = None,
    keyword: str | None = None,
    status: str | None = None,
    file_type: str | None = None,
) -> Column:
    """The conjunction of the filters that are given.

    ``%`` and ``_`` in a keyword stay wildcards.
    """
    terms: list[Column] = []
    if user_id is not None:
        terms.append(F.col("user_id") == F.lit(user_id))
    if keyword:
        terms.append(F.col("filename").ilike(f"%{keyword}%"))
    if status:
        check_status(status)
        terms.append(F.col("status") == status)
    if file_type:
        terms.append(F.col("file_type") == file_type)
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def catalog_search(catalog: DataFrame, **filters: object) -> DataFrame:
    return catalog.filter(catalog_filter(**filters))


def keyset_after(catalog: DataFrame, created_at: Column, row_id: Column) -> DataFrame:
    """Rows after a sort key in newest-first order.

    The bound on ``created_at`` alone adds nothing to the result; it is there
    because it can be pushed to the scan, which a comparison of structs cannot.
    """
    here = F.struct(F.col("created_at").alias("a"), F.col("id").alias("b"))
    key = F.struct(created_at.alias("a"), row_id.alias("b"))
    return catalog.filter((F.col("created_at") <= created_at) & (here < key))


def _after_cursor(catalog: DataFrame, cursor: str) -> DataFrame:
    key = decode_cursor(F.lit(cursor))
    kinds = dict(catalog.dtypes)
    return keyset_after(
        catalog, key["created_at"].cast(kinds["created_at"]), key["id"].cast(kinds["id"])
    )


def _first_rows(
    catalog: DataFrame, cursor: str | None, page_size: int, filters: dict[str, object]
) -> DataFrame:
    """The page and one row more, ranked."""
    check_paging(page_size=page_size)
    rows = catalog_search(catalog, **filters)
    if cursor:
        rows = _after_cursor(rows, cursor)
    order = [F.col("created_at").desc(), F.col("id").desc()]
    top = rows.orderBy(*order).limit(page_size + 1)
    return top.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))


def keyset_page(
    catalog: DataFrame,
    *,
    cursor: str | None = None,
    page_size: int = DEFAULT_PAGE_SIZE,
    **filters: object,
) -> DataFrame:
    """One newest-first page after ``cursor``."""
    rows = _first_rows(catalog, cursor, page_size, filters)
    return rows.filter(F.col("_rank") <= page_size).drop("_rank")


def keyset_page_info(
    catalog: DataFrame,
    *,
    cursor: str | None = None,
    page_size: int = DEFAULT_PAGE_SIZE,
    **filters: object,
) -> DataFrame:
    """One row: ``item_count``, ``has_more`` and the ``next_cursor`` (null at the end)."""
    rows = _first_rows(catalog, cursor, page_size, filters)
    has_more = F.count("*") > page_size
    last = F.max(
        F.when(
            F.col("_rank") == page_size,
            F.struct("created_at", "id"),
        )
    )
    return rows.agg(
        F.least(F.count("*"), F.lit(page_size)).cast("int").alias("item_count"),
        has_more.alias("has_more"),
        F.when(has_more, encode_cursor(last["created_at"], last["id"])).alias("next_cursor"),
    )


def sorted_listing(
    catalog: DataFrame,
    *,
    sort_by: str = "created_at",
    sort_order: str = "desc",
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    **filters: object,
) -> DataFrame:
    """A numbered page in any of the sortable columns; ties go by id the same way."""
    check_paging(page, page_size)
    check_sort(sort_by, sort_order)
    rows = catalog_search(catalog, **filters)
    directed = [F.col(c).asc() if sort_order == "asc" else F.col(c).desc() for c in (sort_by, "id")]
    return rows.orderBy(*directed).offset((page - 1) * page_size).limit(page_size)


def offset_page(
    catalog: DataFrame,
    *,
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    **filters: object,
) -> DataFrame:
    return sorted_listing(catalog, page=page, page_size=page_size, **filters)


def document_info(catalog: DataFrame) -> DataFrame:
    """The light shape: no storage path, no owner."""
    return catalog.select(
        "id",
        "filename",
        "file_type",
        "file_size",
        "status",
        iso_micros(F.col("created_at")).alias("created_at"),
        iso_micros(F.col("updated_at")).alias("updated_at"),
    )


def document_response(catalog: DataFrame) -> DataFrame:
    """The public shape: ids as text, no owner."""
    return catalog.select(
        F.col("id").cast("string").alias("id"),
        "filename",
        "file_type",
        "file_size",
        "status",
        "storage_path",
        iso_micros(F.col("created_at")).alias("created_at"),
        iso_micros(F.col("updated_at")).alias("updated_at"),
    )


def to_strings(rows: DataFrame, *, key: str = "id", value: str = "fields") -> DataFrame:
    """Each row as one map of text, as a key-value store holds it."""
    pairs: list[Column] = []
    for name, kind in rows.dtypes:
        text = iso_micros(F.col(name)) if kind.startswith("timestamp") else F.col(name).cast("string")
        pairs += [F.lit(name), F.coalesce(text, F.lit(""))]
    return rows.select(F.col(key).cast("string").alias(key), F.create_map(*pairs).alias(value))


def typed_from_strings(rows: DataFrame, *, value: str = "fields") -> DataFrame:
    """Maps of text back to typed rows; ``reject_reason`` says what would not convert."""
    m = F.col(value)
    typed = rows.select(
        m["id"].alias("id"),
        m["filename"].alias("filename"),
        m["file_type"].alias("file_type"),
        m["file_size"].try_cast("bigint").alias("file_size"),
        m["status"].alias("status"),
        m["storage_path"].alias("storage_path"),
        m["created_at"].try_cast("timestamp_ntz").alias("created_at"),
        m["updated_at"].try_cast("timestamp_ntz").alias("updated_at"),
    )
    reason = (
        F.when(F.col("file_size").isNull() | (F.col("file_size") < 0), "file_size")
        .when(F.col("status").isNull() | ~F.col("status").isin(*STATUSES), "status")
        .when(F.col("created_at").isNull(), "created_at")
        .when(F.col("updated_at").isNull(), "updated_at")
    )
    return typed.withColumn("reject_reason", reason)


def count_where(table: DataFrame, predicate: Column | None = None) -> DataFrame:
    rows = table if predicate is None else table.filter(predicate)
    return rows.agg(F.count("*").alias("n"))


def count_by_status(catalog: DataFrame, user_id: object | None = None) -> DataFrame:
    """Documents per status of one user, or of every user."""
    if user_id is not None:
        return (
            catalog.filter(F.col("user_id") == F.lit(user_id))
            .groupBy("status")
            .agg(F.count("*").alias("cnt"))
        )
    return catalog.groupBy("user_id", "status").agg(F.count("*").alias("cnt"))


def catalog_totals(
    catalog: DataFrame, *, page_size: int = DEFAULT_PAGE_SIZE, matching: Column | None = None
) -> DataFrame:
    """Per user: all documents, those that match the filters, and pages of the former."""
    return _totals(catalog.groupBy("user_id"), page_size, matching)


def owner_totals(
    catalog: DataFrame, user_id: object, *, page_size: int = DEFAULT_PAGE_SIZE, matching: Column | None = None
) -> DataFrame:
    """The totals of one user: one row, also of a user without documents."""
    mine = catalog.filter(F.col("user_id") == F.lit(user_id))
    return _totals(mine.groupBy(), page_size, matching)


def _totals(groups: GroupedData, page_size: int, matching: Column | None) -> DataFrame:
    check_paging(page_size=page_size)
    total = F.count("*")
    matched = total if matching is None else F.count_if(matching)
    return groups.agg(
        total.alias("total"),
        matched.alias("filtered_total"),
        F.greatest(F.lit(1), F.ceil(total / page_size)).cast("bigint").alias("total_pages"),
    )
