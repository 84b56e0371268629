"""Rows of any table known by a hash of their id and text, and what is left of the table without some.

A table's columns travel as one struct, so none clashes with a column of a join; columns
of any type pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.jaccard import similar_rows, text_key
from pagemill.sources.tables import stored


def key_of(doc_id: Column, hashed_text: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("-")), hashed_text)


def packed(docs: DataFrame) -> DataFrame:
    """(key, row): the row as a struct of all its columns."""
    key = key_of(docs["doc_id"], text_key(docs["text"]))
    return docs.select(key.alias("key"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the key of the row in the place of the id."""
    return docs.select(key_of(docs["doc_id"], text_key(docs["text"])).alias("doc_id"), "text")


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is not in the only column of ``keys``."""
    gone = keys.toDF("key").distinct()
    return packed(docs).join(gone, "key", "left_anti").select("row.*")


def one_of_each(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of each of these keys: the one with the least hash of its columns, but for maps."""
    whole = packed(docs).join(keys.toDF("key"), "key", "left_semi")
    plain = [F.col("row")[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return whole.groupBy("key").agg(F.min_by("row", F.xxhash64(*plain)).alias("row")).select("row.*")


def first_of_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id and key of its text.

    Rows without a word are copies of none. Rows of the same id and text, null ids too,
    are reduced to one without gathering them in a task.
    """
    found = similar_rows(docs).where(F.col("n_shingles") > 0)
    found = stored(found.select(key_of(F.col("doc_id"), F.col("text_key")).alias("key"), "is_first"), "copies")
    copies = found.where(~F.col("is_first")).select("key")
    same = found.where("is_first").groupBy("key").count().where(F.col("count") > 1).select("key")
    if same.isEmpty():
        return without(docs, copies)
    return without(docs, copies.unionByName(same)).unionByName(one_of_each(docs, same))
