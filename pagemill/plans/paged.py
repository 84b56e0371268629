"""Paged documents to chunk rows with page numbers, and one parsed record each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.constants import ChunkingConfig
from pagemill.operators import chunking as ch
from pagemill.operators import pages as pg
from pagemill.sources.tables import stored


def paged_blocks(pages: DataFrame, raw_tables: DataFrame) -> DataFrame:
    """Numbered blocks of classified pages with their text, as a stored table."""
    blocks = pg.page_blocks(pages, pages, raw_tables)
    return stored(pg.number_blocks(blocks), "numbered-blocks", "zstd")


def page_chunk_rows(blocks: DataFrame, *, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """Rows of the chunk table; a chunk has the page of its first block."""
    rows = blocks.withColumn("page_number", F.col("page_number").cast("int"))
    merged = ch.merge_short(ch.split_long(rows, config=config), config=config)
    return ch.to_chunk_table(
        merged.select(
            F.col("doc_id").alias("document_id"), F.col("position").alias("chunk_index"), "text", "page_number"
        )
    )


def parsed_documents(pages: DataFrame, blocks: DataFrame, raw_tables: DataFrame, *guards: DataFrame) -> DataFrame:
    """One record per document: pages of each class, blocks, warnings in page order, status.

    ``guards`` are further warnings (doc_id, page_number, warning), such as those
    of repeated regions; a warning of the whole document has no page and comes first.
    """
    warnings = pg.page_warnings(pages).unionByName(pg.table_warnings(pg.page_tables(raw_tables)))
    for more in guards:
        warnings = warnings.unionByName(more)
    listed = warnings.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page_number", "warning"))).getField("warning").alias("warnings")
    )
    counted = blocks.groupBy("doc_id").agg(F.count("*").alias("total_blocks"))
    record = pg.page_summary(pages).join(counted, "doc_id", "left").join(listed, "doc_id", "left")
    return record.withColumns(
        {
            "total_blocks": F.coalesce("total_blocks", F.lit(0)),
            "warnings": F.coalesce("warnings", F.array().cast("array<string>")),
            "status": F.when(F.col("total_blocks").isNull(), "failed").otherwise("ready"),
        }
    )
