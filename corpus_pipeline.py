"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the
last return the columns of docs, with the rows or texts that they decide on:

1. language: documents whose language can't be told are removed;
2. near copies: of each group of texts linked by word shingles, the document with
   the smallest id and text hash stays; texts without a word are no copies of each other;
3. decontamination: documents that hold a test item are removed;
4. personal data: every span found is replaced by its kind in angle brackets;
5. mixing: every document with the number of copies that the mix takes of it.

A row is known by its id and a hash of its text, so texts that share an id, or have
none, are judged apart. Of rows with the same id and text one stays in stage 2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, language, mixing, private_data, rows
from pagemill.llm.labelled import fold
from pagemill.sources.tables import read_table, stored

LEAST_SCORE = 0.3  # of the predicted language


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents with a language; learned from those that are not held out."""
    found = language.predict(rows.keyed(docs), language.train(docs, fold(4) != 2))
    lost = found.where((F.col("lang_pred") == language.UNKNOWN) | (F.col("score") < LEAST_SCORE))
    return rows.without(docs, lost.select("doc_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return rows.first_of_copies(docs)


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that hold no test item."""
    return rows.without(docs, decontaminate.leaks(rows.keyed(docs), read_table(spark, sf_dir, "benchmark")).select("doc_id"))


def redact_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced; n_chars follows the text where there is such a column."""
    found = private_data.find(docs).where(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"))
    key = private_data.key_of(docs["doc_id"], docs["text"])
    whole = docs.select(key.alias("key"), F.struct(*(docs[c] for c in docs.columns)).alias("row")).join(found, "key", "left")
    hit, text = F.col("spans").isNotNull(), F.col("row.text")
    text = F.when(hit, private_data.redact(text, F.col("spans"))).otherwise(text)

    def value(name: str) -> Column:
        if name == "text":
            return text.alias("text")
        if name == "n_chars":
            kept = F.when(hit, F.length(text).cast("bigint")).otherwise(F.col("row.n_chars"))
            return kept.cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col("row")[name].alias(name)

    return whole.select(*(value(name) for name in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken words of every document."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate_texts),
    ("private_data", redact_private_data),
    ("mixing", mix_sources),
]

# A learned stage can't be told in SQL; tests compare the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
