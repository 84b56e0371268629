"""Documents to block rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import containers
from pagemill.functions.markdown import inline_text, joined_text, markdown_blocks, table_block, table_text
from pagemill.functions.text import text_paragraphs


def paragraph_struct(text: Column) -> Column:
    """A bare paragraph block, in the shape the chunking step reads."""
    return F.struct(
        F.lit("paragraph").alias("block_type"),
        text.alias("text"),
        F.lit(None).cast("int").alias("page_number"),
        F.lit(None).cast("boolean").alias("cross_page_boundary"),
    )


def text_block_array(text: Column) -> Column:
    return F.transform(text_paragraphs(text), paragraph_struct)


def markdown_block_array(text: Column) -> Column:
    return F.transform(
        markdown_blocks(text),
        lambda b: F.struct(
            b["block_type"].alias("block_type"),
            b["text"].alias("text"),
            b["page_number"].alias("page_number"),
            F.lit(None).cast("boolean").alias("cross_page_boundary"),
        ),
    )


def split_paragraphs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph of a text file, numbered from 0."""
    return docs.select(
        F.col(doc_id), F.posexplode(text_paragraphs(F.col(text))).alias("position", "text")
    )


def md_blocks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per Markdown block, in document order."""
    exploded = docs.select(
        F.col(doc_id), F.posexplode(markdown_blocks(F.col(text))).alias("position", "b")
    )
    b = F.col("b")
    return exploded.select(
        doc_id,
        "position",
        b["block_type"].alias("block_type"),
        b["text"].alias("text"),
        b["level"].alias("level"),
        b["language"].alias("language"),
        b["ordered"].alias("ordered"),
        b["is_quote"].alias("is_quote"),
        b["headers"].alias("headers"),
        b["table_rows"].alias("table_rows"),
        F.when(b["headers"].isNotNull(), F.size(b["table_rows"])).alias("rows"),
        F.when(b["headers"].isNotNull(), F.size(b["headers"])).alias("cols"),
    )


NESTED = "position int, block_type string, raw string, level int, language string, ordered boolean, quotes int, path string"


def md_nested_blocks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per Markdown block, in and outside of containers, in document order.

    ``path`` has a character for each container around a block (q quote, u and o items),
    ``is_quote`` says whether one is a quote. An item's first paragraph is its text.
    A null text has no blocks.
    """
    kind = dict(docs.dtypes)[doc_id]
    names = ("block_type", "text", "level", "language", "ordered", "quotes", "path")
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, value in enumerate(batch.column(1)):
                blocks = containers.parse(value.as_py() or "")
                columns = [pa.array([getattr(b, n) for b in blocks], t) for n, t in zip(names, types)]
                owner = batch.column(0).take(pa.array([at] * len(blocks), pa.int32()))
                position = pa.array(range(len(blocks)), pa.int32())
                yield pa.record_batch([owner, position, *columns], [doc_id, *(f.split()[0] for f in NESTED.split(", "))])

    found = docs.select(doc_id, text).mapInArrow(run, f"{doc_id} {kind}, {NESTED}")
    raw, is_table = F.col("raw"), F.col("block_type") == "table"
    table = table_block(raw)
    read = F.when(F.col("block_type") == "code", raw).when(is_table, table["text"]).otherwise(inline_text(joined_text(raw)))
    rows = F.when(is_table, table["table_rows"])
    return found.select(
        doc_id, "position", "block_type", read.alias("text"), "level", "language", "ordered",
        (F.col("quotes") > 0).alias("is_quote"), "path", F.when(is_table, table["headers"]).alias("headers"), rows.alias("table_rows"),
    )


def md_tables(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per Markdown table: headers and rows as arrays."""
    blocks = md_blocks(docs, doc_id=doc_id, text=text)
    return blocks.filter(F.col("block_type") == "table").select(
        doc_id, "position", "headers", F.col("table_rows").alias("rows")
    )


def table_to_text(tables: DataFrame, out: str = "text") -> DataFrame:
    return tables.withColumn(out, table_text(F.col("headers"), F.col("rows")))


def parse_stats(blocks: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """Per document: how many blocks of which kind."""
    is_type = lambda t: F.col("block_type") == t
    return blocks.groupBy(doc_id).agg(
        F.count("*").alias("total_blocks"),
        F.count_if(is_type("heading")).alias("heading_count"),
        F.count_if(is_type("code")).alias("code_block_count"),
        F.count_if(is_type("table")).alias("table_count"),
        (F.count_if(is_type("table")) > 0).alias("has_tables"),
    )
