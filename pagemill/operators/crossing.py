"""Paragraphs that go on over the end of a page are one block.

The last block of a page goes on in the first block of the next page that has any if both
are paragraphs, it ends without the end of a sentence, and the next one begins with a
small letter or one of a script without case. A word cut by a hyphen is put together; between
other words comes a blank, and nothing before a script without case. Only neighbours are
looked at, so a paragraph may run over any number of pages; pages are scanned in segments,
and what is gathered is a paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.segments import by_position, run_numbers

# --- Fixed values: what ends a sentence, and what may close after it ----------
SENTENCE_END = "[.!?:;。！？：；…][\"'”’)\\]}»]*$"
GOES_ON = r"^[\p{Ll}\p{Lo}]"
# ------------------------------------------------------------------------------
SEAM, SEAM_OF_TEXT = "﷐", "�"  # where pieces meet; what a text's own seams become


def goes_on(before: Column, after: Column) -> Column:
    """Whether a block (page_number, block_type, text) goes on in the one after it."""
    paragraphs = (before["block_type"] == "paragraph") & (after["block_type"] == "paragraph")
    return paragraphs & (before["page_number"] != after["page_number"]) & ~before["text"].rlike(SENTENCE_END) & after["text"].rlike(GOES_ON)


def mended(text: Column) -> Column:
    """Pieces with seams between them as running text."""
    whole = F.regexp_replace(text, rf"(\p{{L}})-{SEAM}", "$1")
    return F.replace(F.regexp_replace(whole, rf"{SEAM}(\p{{Lo}})", "$1"), F.lit(SEAM), F.lit(" "))


def join_across_pages(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page_number, position, block_type, text), those that go on put together.

    ``page_number`` and ``last_page`` are the first and last page of a block; ``cross_page_boundary``
    says that they differ, and then ``page_number_certain`` is false. Positions are numbered
    anew. The blocks are read twice, so pass a stored table.
    """
    rows = blocks.select("doc_id", "page_number", "position", "block_type", F.coalesce("text", F.lit("")).alias("text"))
    runs = run_numbers(
        rows, ["doc_id"], ["page_number", "position"], by_position("page_number"), ["page_number", "block_type", "text"],
        lambda before, after: ~goes_on(before, after), "_run",
    )
    pieces = runs.withColumn("text", F.translate("text", SEAM, SEAM_OF_TEXT))
    joined = pieces.groupBy("doc_id", "_run").agg(
        F.expr(f"listagg(text, '{SEAM}') WITHIN GROUP (ORDER BY page_number, position)").alias("_text"),
        F.min("page_number").alias("page_number"),
        F.max("page_number").alias("last_page"),
        F.min("block_type").alias("block_type"),
        F.count("*").alias("pieces"),
    )
    crosses = F.col("pieces") > 1
    return joined.select(
        "doc_id", (F.col("_run") - 1).cast("int").alias("position"), "block_type", mended(F.col("_text")).alias("text"), "page_number", "last_page",
        "pieces", crosses.alias("cross_page_boundary"), (~crosses).alias("page_number_certain"),
    )
