"""Bounded samples of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(divisor: int) -> Column:
    """crc32 of the document id as text, modulo ``divisor``; a null id counts as empty."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` documents of each class 0 and 1, one of each id.

    The documents are those with the smallest hash of their id among the rows
    that ``keep`` allows, so a rerun takes the same. Rows without a text, an id
    or a class are passed over; of the texts of one id the one with the least hash is
    taken. Only the chosen ids, whose number is bounded, are broadcast to the texts.
    """
    narrow = (
        labels.where(keep & F.col("doc_id").isNotNull())
        .select("doc_id", F.col(label).cast("int").alias("label"))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .withColumn("_draw", F.md5(F.col("doc_id").cast("string").cast("binary")))
    )
    chosen = None
    for value in (0, 1):
        part = narrow.where(F.col("label") == value).orderBy("_draw").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.select(F.col("doc_id").alias("_id"), "label")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    one = F.min(F.struct(F.xxhash64("text"), "text")).alias("_one")
    return found.groupBy("doc_id", "label").agg(one).select("doc_id", "_one.text", "label")


def class_share(labels: DataFrame, label: str, keep: Column) -> float | None:
    """Share of class 1 among all labelled rows that ``keep`` allows; None without any."""
    row = labels.where(keep & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).agg(F.avg(label)).first()
    return None if row is None or row[0] is None else float(row[0])
