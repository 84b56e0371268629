"""Listing and deleting documents of one owner."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.constants import DEFAULT_PAGE_SIZE
from pagemill.operators import catalog as ct
from pagemill.operators import mutations as mu
from pagemill.operators import ranking as rk


@dataclass(frozen=True)
class Listing:
    """A page, what follows it, and how much there is in all."""

    items: DataFrame
    info: DataFrame
    totals: DataFrame


def list_documents(
    catalog: DataFrame,
    user_id: object,
    *,
    cursor: str | None = None,
    page_size: int = DEFAULT_PAGE_SIZE,
    **filters: object,
) -> Listing:
    """One page of an owner's documents, newest first, with the owner's totals."""
    mine = catalog.filter(F.col("user_id") == F.lit(user_id))
    page = {"cursor": cursor, "page_size": page_size, **filters}
    return Listing(
        ct.document_response(ct.keyset_page(mine, **page)),
        ct.keyset_page_info(mine, **page),
        ct.owner_totals(catalog, user_id, page_size=page_size, matching=ct.catalog_filter(**filters)),
    )


@dataclass(frozen=True)
class Deletion:
    """The tables without the deleted documents, and which requests found one."""

    catalog: DataFrame
    chunks: DataFrame
    scores: DataFrame
    outcome: DataFrame


def delete_documents(
    catalog: DataFrame, chunks: DataFrame, scores: DataFrame, requested: DataFrame
) -> Deletion:
    """Delete documents by id: their rows, their chunks, and their place in the ranking."""
    kept_chunks, _ = mu.cascade_delete(chunks, requested, child="document_id")
    return Deletion(
        mu.delete_rows(catalog, requested),
        kept_chunks,
        rk.hot_remove(scores, requested.select(F.col("id").alias("doc_id"))),
        mu.deleted_flags(catalog, requested),
    )
