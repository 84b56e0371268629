"""Table rules as queries that list what breaks them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.constants import STATUSES


def check_unique(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def check_fk(children: DataFrame, parents: DataFrame, *, child: str, parent: str) -> DataFrame:
    """Children whose parent is missing; a null reference is allowed."""
    ids = parents.select(F.col(parent).alias("_parent"))
    linked = children.filter(F.col(child).isNotNull())
    return linked.join(ids, linked[child] == F.col("_parent"), "left_anti")


def check_rules(table: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Per rule, how many rows break it; all rules in one pass over the table."""
    broken = table.agg(
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]
    )
    return broken.unpivot([], list(rules), "rule", "violations")


def catalog_rules() -> dict[str, Column]:
    """The rules of the catalog: domains, bounds, required columns, lengths."""
    rules = {
        "status_domain": F.col("status").isin(*STATUSES),
        "file_size_not_negative": F.col("file_size") >= 0,
        "filename_length": F.length("filename") <= 512,
        "file_type_length": F.length("file_type") <= 16,
        "storage_path_length": F.length("storage_path") <= 1024,
    }
    for name in ("id", "user_id", "filename", "file_type", "file_size", "storage_path", "status"):
        rules[f"{name}_required"] = F.col(name).isNotNull()
    return rules
