"""Inserts, updates and deletes as new snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_if_absent(
    existing: DataFrame, incoming: DataFrame, *, keys: Sequence[str], first_by: str
) -> DataFrame:
    """Existing rows and those incoming ones whose key is not there yet.

    Of incoming rows with one key the first by ``first_by`` is kept.
    """
    others = [c for c in incoming.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in others])
    firsts = incoming.groupBy(*keys).agg(F.min_by(row, first_by).alias("_row"))
    new = firsts.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    return existing.unionByName(new.select(*keys, "_row.*"))


def update_rows(
    table: DataFrame, changes: DataFrame, *, key: str = "id", columns: Sequence[str], latest: str | None = None
) -> DataFrame:
    """The table with ``columns`` set from the change row of the same key, null included.

    Of several changes to a key the one that is last by ``latest`` counts; without
    such a column, the largest by its values.
    """
    change = F.struct(*[F.col(c) for c in columns])
    order = F.struct(F.col(latest), change) if latest else change
    renamed = changes.groupBy(key).agg(F.max_by(change, order).alias("_change"))
    joined = table.join(renamed, key, "left")
    changed = F.col("_change").isNotNull()
    return joined.select(
        *[
            F.when(changed, F.col("_change")[c]).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in table.columns
        ]
    )


def delete_rows(table: DataFrame, deleted: DataFrame, *, key: str = "id") -> DataFrame:
    return table.join(deleted.select(key), key, "left_anti")


def deleted_flags(table: DataFrame, requested: DataFrame, *, key: str = "id") -> DataFrame:
    """Per requested id, whether there was a row to delete."""
    present = table.select(F.col(key), F.lit(True).alias("_there"))
    return requested.select(key).join(present, key, "left").select(
        key, F.coalesce("_there", F.lit(False)).alias("deleted")
    )


def cascade_delete(
    children: DataFrame, deleted_parents: DataFrame, *, child: str, parent: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """Children that stay, and those that go with their parent.

    The second feeds the next level down the chain.
    """
    ids = deleted_parents.select(F.col(parent).alias("_parent"))
    match = children[child] == F.col("_parent")
    return children.join(ids, match, "left_anti"), children.join(ids, match, "left_semi")


def replace_document_chunks(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks after some documents were parsed again: theirs are exchanged."""
    redone = fresh.select("document_id").distinct()
    kept = existing.join(redone, "document_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
