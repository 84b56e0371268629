"""Files to chunks: admit, decode, parse, chunk, set status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.constants import PARSEABLE_EXTENSIONS, ChunkingConfig
from pagemill.functions.encoding import decode_text
from pagemill.functions.text import garbled_warning, is_blank_text, replacement_count
from pagemill.operators.blocks import markdown_block_array, text_block_array
from pagemill.operators.chunking import chunk_rows
from pagemill.sources.files import admit_files, file_id, parse_status, storage_columns

EMPTY_BLOCKS = (
    "cast(array() as array<struct<block_type:string,text:string,"
    "page_number:int,cross_page_boundary:boolean>>)"
)


def blocks_by_type(file_type: Column, text: Column) -> Column:
    """The block array of a decoded file; types that hold no plain text give none."""
    return (
        F.when(file_type == ".md", markdown_block_array(text))
        .when(file_type == ".txt", text_block_array(text))
        .otherwise(F.expr(EMPTY_BLOCKS))
    )


def parse_files(files: DataFrame) -> DataFrame:
    """Every file with text, blocks, warnings and status, one row each.

    Nothing here raises on a bad file: undecodable bytes become replacement
    characters, what cannot be parsed is marked failed, and what may not enter is
    marked rejected with its ``reject_reason``; see :func:`rejected_files`.
    """
    admitted = admit_files(files)
    entered = F.col("reject_reason").isNull()
    plain = entered & F.col("file_type").isin(".txt", ".md")
    decoded = decode_text(admitted.withColumn("_bytes", F.when(plain, F.col("content"))), "_bytes")
    parsed = decoded.drop("_bytes").withColumn("blocks", blocks_by_type(F.col("file_type"), F.col("text")))
    # A paged file arrives as its pages (see operators.pages); its bytes alone
    # cannot be read here.
    error = F.when(
        F.col("file_type").isin(*PARSEABLE_EXTENSIONS) & F.col("text").isNull(), F.lit("no text")
    ).when(plain & (F.size("blocks") == 0) & ~is_blank_text(F.col("text")), F.lit("no blocks"))
    return (
        parsed.withColumn("error", F.when(entered, error))
        .withColumn("status", F.when(entered, parse_status(F.col("file_type"), F.col("error"))).otherwise("rejected"))
        .withColumn("warnings", F.array_compact(F.array(garbled_warning(F.col("text")))))
        .withColumn("replacement_chars", replacement_count(F.col("text")))
    )


def rejected_files(files: DataFrame) -> DataFrame:
    """The files that may not enter, with why."""
    return admit_files(files).filter(F.col("reject_reason").isNotNull()).select("filename", "length", "reject_reason")


def catalog_rows(
    files: DataFrame, *, key: Column, user_id: Column, stored_at: Column
) -> DataFrame:
    """Catalog rows of the admitted files, with the status their parsing gave them."""
    entered = parse_files(files).filter(F.col("reject_reason").isNull())
    named = storage_columns(entered, key=key, stored_at=stored_at)
    return named.select(
        file_id(key).alias("id"),
        user_id.alias("user_id"),
        "filename",
        "file_type",
        F.col("length").alias("file_size"),
        "storage_path",
        "status",
        stored_at.alias("created_at"),
        stored_at.alias("updated_at"),
    )


def ingest(
    files: DataFrame, *, doc_id: str = "path", config: ChunkingConfig = ChunkingConfig()
) -> DataFrame:
    """Files to rows of the chunk table: a narrow job from scan to write."""
    return chunk_rows(parse_files(files), doc_id=doc_id, config=config)
