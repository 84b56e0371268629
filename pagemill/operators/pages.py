"""Pages and their tables to blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.markdown import table_text
from pagemill.functions.pages import image_ratio, page_type
from pagemill.functions.text import page_paragraphs
from pagemill.operators.segments import SEGMENT, by_position, row_numbers, segmented

PAGE = ["doc_id", "page_number"]


def classify_pages(page_stats: DataFrame) -> DataFrame:
    """Add ``image_count``, ``image_ratio`` and ``page_type`` to page measures."""
    images = F.coalesce("images", F.expr("cast(array() as array<struct<x0:double,y0:double,x1:double,y1:double>>)"))
    return (
        page_stats.withColumn("image_count", F.size(images))
        .withColumn("image_ratio", image_ratio(images, F.col("width"), F.col("height")))
        .withColumn(
            "page_type",
            page_type(
                F.coalesce("text_len", F.lit(0)), F.col("image_count"), F.col("image_ratio")
            ),
        )
    )


def page_summary(pages: DataFrame) -> DataFrame:
    """Pages of each class per document."""
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"),
        *[
            F.count_if(F.col("page_type") == kind).alias(f"{kind}_pages")
            for kind in ("text", "scanned", "hybrid", "blank")
        ],
    )


def ocr_placeholders(pages: DataFrame) -> DataFrame:
    """An empty block for each scanned page, so that it is not lost silently."""
    return pages.filter(F.col("page_type") == "scanned").select(
        *PAGE,
        F.lit("paragraph").alias("block_type"),
        F.lit("").alias("text"),
        "page_type",
        F.lit(True).alias("needs_ocr"),
        "image_count",
    )


def page_warnings(pages: DataFrame) -> DataFrame:
    """What was left out: pages that need OCR, and images of mixed pages."""
    page = F.concat(F.lit("page "), F.col("page_number").cast("string"))
    message = F.when(
        F.col("page_type") == "scanned",
        F.concat(page, F.lit(" scanned: no text, needs OCR, images="), F.col("image_count").cast("string")),
    ).when(F.col("page_type") == "hybrid", F.concat(page, F.lit(" hybrid: text kept, images skipped")))
    return pages.select(*PAGE, message.alias("warning")).filter(F.col("warning").isNotNull())


def split_paragraphs_page(page_text: DataFrame) -> DataFrame:
    """One row per paragraph of a page, blank ones dropped, numbered within the page."""
    return page_text.select(
        *PAGE, F.posexplode(page_paragraphs(F.col("text"))).alias("seq", "text")
    )


def page_tables(raw_tables: DataFrame) -> DataFrame:
    """First row to headers, the rest to rows, null cells to ''; drops empty tables."""
    filled = F.transform(
        "cells", lambda row: F.transform(row, lambda cell: F.coalesce(cell, F.lit("")))
    )
    named = raw_tables.filter(F.size("cells") > 0).withColumn("_cells", filled)
    return named.select(
        *[c for c in raw_tables.columns if c != "cells"],
        F.get("_cells", F.lit(0)).alias("headers"),
        F.slice("_cells", F.lit(2), F.size("_cells")).alias("rows"),
    )


def tables_with_rows(tables: DataFrame) -> DataFrame:
    return tables.filter(F.size("rows") > 0).withColumn(
        "text", table_text(F.col("headers"), F.col("rows"))
    )


def table_warnings(tables: DataFrame) -> DataFrame:
    """Tables skipped because they have headers and nothing else."""
    page = F.col("page_number").cast("string")
    return tables.filter(F.size("rows") == 0).select(
        *PAGE,
        F.concat(F.lit("page "), page, F.lit(" table: headers only, skipped")).alias("warning"),
    )


def page_blocks(pages: DataFrame, page_text: DataFrame, raw_tables: DataFrame) -> DataFrame:
    """Blocks of paged documents, not yet numbered.

    Blank pages give nothing and scanned pages give a placeholder. The rows lie by the
    segments of :func:`number_blocks`.
    """
    readable = pages.filter(F.col("page_type").isin("text", "hybrid")).select(*PAGE, F.lit(1).alias("_classes"))
    paragraphs = split_paragraphs_page(page_text).select(
        *PAGE, F.lit(1).alias("_kind"), "seq", F.lit("paragraph").alias("block_type"), "text"
    )
    tables = tables_with_rows(page_tables(raw_tables)).select(
        *PAGE,
        F.lit(2).alias("_kind"),
        F.col("table_no").cast("int").alias("seq"),
        F.lit("table").alias("block_type"),
        "text",
        F.size("rows").alias("rows"),
        F.size("headers").alias("cols"),
    )
    scanned = ocr_placeholders(pages).select(
        *PAGE, F.lit(0).alias("_kind"), F.lit(0).alias("seq"), "block_type", "text", "needs_ocr", "image_count"
    )
    # Blocks meet the readable classes of their page in a window, so that texts are dealt out
    # once, by the segment that numbering needs. As in a join, a null key meets none.
    rows = None
    for part in (paragraphs, tables, scanned, readable):
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    dealt = segmented(rows, ["doc_id"], by_position("page_number")).repartition(SEGMENT)
    met = F.sum("_classes").over(Window.partitionBy(SEGMENT, "page_number"))
    known = F.col("doc_id").isNotNull() & F.col("page_number").isNotNull()
    times = F.when(F.col("_kind") == 0, 1).when(known, F.coalesce(met, F.lit(0)).cast("int")).otherwise(0)
    found = dealt.withColumn("_times", times).filter(F.col("_kind").isNotNull() & (F.col("_times") > 0))
    return found.withColumn("_time", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("_classes", "_times", "_time")


def number_blocks(blocks: DataFrame) -> DataFrame:
    """Add ``position``: reading order within the document, per page text before tables.

    The blocks are read twice, once without their texts.
    """
    order = [F.col("page_number"), F.col("_kind"), F.col("seq")]
    numbered = row_numbers(blocks, ["doc_id"], order, by_position("page_number"), "_n")
    return numbered.withColumn("position", (F.col("_n") - 1).cast("int")).drop("_n", "_kind", "seq")
