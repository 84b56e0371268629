"""Blocks to chunk rows.

Two forms of the same rules. The array form takes a document's blocks as one
array and shuffles nothing. The row form takes blocks as rows, for tables where
a document may hold any share of them; its scans run over segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.constants import ChunkingConfig
from pagemill.functions.chunking import chunk_blocks, is_splittable, split_block
from pagemill.functions.text import sanitize, text_hash, token_estimate
from pagemill.operators.segments import (
    by_position,
    row_numbers,
    run_numbers,
)

DEFAULT = ChunkingConfig()


def chunk_arrays(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    blocks: str = "blocks",
    config: ChunkingConfig = DEFAULT,
) -> DataFrame:
    """One row per chunk with its split and merge marks (array form)."""
    chunks = chunk_blocks(F.col(blocks), config)
    c = F.col("c")
    h = c["head"]
    return docs.select(F.col(doc_id), F.posexplode(chunks).alias("position", "c")).select(
        doc_id,
        "position",
        h["block_type"].alias("block_type"),
        c["text"].alias("text"),
        h["page_number"].alias("page_number"),
        h["split_part"].alias("split_part"),
        h["split_total"].alias("split_total"),
        h["page_number_certain"].alias("page_number_certain"),
        h["char_offset_start"].alias("char_offset_start"),
        h["char_offset_end"].alias("char_offset_end"),
        c["merged_from"].alias("merged_from"),
        c["merged_to"].alias("merged_to"),
    )


def chunk_rows(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    blocks: str = "blocks",
    config: ChunkingConfig = DEFAULT,
) -> DataFrame:
    """The rows of the chunk table: sanitized text, its hash and its token estimate."""
    chunks = chunk_blocks(F.col(blocks), config, offsets=False)
    exploded = docs.select(F.col(doc_id), F.posexplode(chunks).alias("chunk_index", "c"))
    return to_chunk_table(
        exploded.select(
            F.col(doc_id).alias("document_id"),
            "chunk_index",
            F.col("c.text").alias("text"),
            F.col("c.head.page_number").alias("page_number"),
        )
    )


def to_chunk_table(chunks: DataFrame) -> DataFrame:
    clean = chunks.withColumn("chunk_text", sanitize(F.col("text")))
    return clean.select(
        "document_id",
        "chunk_index",
        "chunk_text",
        text_hash(F.col("chunk_text")).alias("chunk_hash"),
        token_estimate(F.col("chunk_text")).alias("token_count"),
        "page_number",
    )


def split_long(
    blocks: DataFrame, *, doc_id: str = "doc_id", config: ChunkingConfig = DEFAULT
) -> DataFrame:
    """Block rows to part rows; a block that is not cut is one part with null marks."""
    rows = blocks
    if "cross_page_boundary" not in rows.columns:
        rows = rows.withColumn("cross_page_boundary", F.lit(False))
    block = F.struct("block_type", "text", "page_number", "cross_page_boundary")
    parts = rows.select(
        doc_id,
        F.col("position").alias("source_position"),
        F.posexplode(split_block(block, config)).alias("part", "p"),
    )
    return parts.select(doc_id, "source_position", "part", "p.*")


def merge_short(
    parts: DataFrame, *, doc_id: str = "doc_id", config: ChunkingConfig = DEFAULT
) -> DataFrame:
    """Part rows to merged rows, numbered from 0 (row form)."""
    order = ["source_position", "part"]

    def opens(previous: Column, current: Column) -> Column:
        joins = (
            is_splittable(current["block_type"])
            & (current["chars"] < config.merge_short_threshold)
            & is_splittable(previous["block_type"])
        )
        return ~joins

    grouped = run_numbers(
        parts.withColumn("chars", F.length("text")),
        [doc_id],
        order,
        by_position("source_position"),
        ["block_type", "chars"],
        opens,
        "_run",
    )
    key = F.struct(*order)
    first = F.min_by(
        F.struct(
            "block_type",
            "page_number",
            "split_part",
            "split_total",
            "page_number_certain",
            "char_offset_start",
            "char_offset_end",
        ),
        key,
    )
    merged = grouped.groupBy(doc_id, "_run").agg(
        first.alias("head"),
        F.max_by(F.struct("split_part"), key).alias("last"),
        F.count("*").alias("n"),
        F.expr(
            "listagg(text, '\\n') WITHIN GROUP (ORDER BY source_position, part)"
        ).alias("text"),
    )
    several = F.col("n") > 1
    # Every run has a number of its own and the first is 1, so it is the position.
    return merged.select(
        doc_id,
        (F.col("_run") - 1).cast("int").alias("position"),
        "head.block_type",
        "text",
        "head.page_number",
        "head.split_part",
        "head.split_total",
        "head.page_number_certain",
        "head.char_offset_start",
        "head.char_offset_end",
        F.when(several, F.coalesce("head.split_part", F.lit(0))).alias("merged_from"),
        F.when(several, F.coalesce("last.split_part", F.lit(0))).alias("merged_to"),
    )


def renumber(
    rows: DataFrame, *, doc_id: str = "doc_id", position: str = "position"
) -> DataFrame:
    """Make ``position`` dense from 0, keeping the order."""
    numbered = row_numbers(rows, [doc_id], [F.col(position)], by_position(position), "_n")
    return numbered.withColumn(position, (F.col("_n") - 1).cast("int")).drop("_n")


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """Keep, of chunks with equal hash, the one of the lowest document and index.

    The keepers are found on the narrow key columns with partial aggregation, so
    a text copied into a third of the table is reduced before any shuffle; the
    texts then move once, spread by their unique key.
    """
    keepers = (
        chunks.groupBy("chunk_hash")
        .agg(F.min(F.struct("document_id", "chunk_index")).alias("k"))
        .select("k.document_id", "k.chunk_index")
    )
    return chunks.join(keepers, ["document_id", "chunk_index"], "left_semi")


def chunk_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(
        F.count("*").alias("chunks"),
        F.sum("token_count").cast("bigint").alias("tokens"),
        F.sum(F.length("chunk_text")).cast("bigint").alias("chars"),
        F.round(F.avg(F.length("chunk_text")), 4).alias("avg_chars"),
    )
