"""Repeated page headers and footers.

Input: ``pages(doc_id, page_number)`` with every page of a document, and
``spans(doc_id, page_number, seq, text, y0)`` with the placed pieces of text.
Everything is grouped by page or by (document, text, page); no step gathers the
pages of a document, which may be most of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.constants import (
    FOOTER_SHARE,
    HEADER_SHARE,
    REGION_LABEL_CHARS,
    REGION_MAX_CHARS,
    REGION_MIN_PAGES,
    REPEAT_SHARE,
    WS,
    WS_CHARS,
)
from pagemill.functions.text import collapse_spaces, strip
from pagemill.operators.segments import by_position, row_numbers

PAGE = ["doc_id", "page_number"]


def normalize_region(text: Column) -> Column:
    """Numbers to '#', white space folded, so that page numbers do not matter."""
    return collapse_spaces(F.regexp_replace(text, F.lit(r"(?U)\b\d+\b"), F.lit("#")))


def hf_guards(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Per document: page counts, and whether detection runs, is limited or is skipped."""
    filled = spans.select(*PAGE).distinct().withColumn("_has", F.lit(1))
    counts = (
        pages.join(filled, PAGE, "left")
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("total_pages"),
            F.count_if(F.col("_has").isNull()).alias("empty_pages"),
        )
        .withColumn("valid_pages", F.col("total_pages") - F.col("empty_pages"))
    )
    outcome = (
        F.when(F.col("valid_pages") == 0, "skipped_no_text")
        .when(F.col("valid_pages") < REGION_MIN_PAGES, "skipped_few_pages")
        .when(F.col("empty_pages") > 0, "limited")
        .otherwise("full")
    )
    return counts.withColumn("detection", outcome)


def hf_guard_warnings(guards: DataFrame) -> DataFrame:
    """What the guards of detection have to say: why it was skipped, or limited."""
    n = lambda c: F.col(c).cast("string")
    text = (
        F.when(F.col("detection") == "skipped_no_text", "repeated regions not looked for: no page has text")
        .when(
            F.col("detection") == "skipped_few_pages",
            F.concat(F.lit("repeated regions not looked for: pages with text: "), n("valid_pages"), F.lit(f", needed: {REGION_MIN_PAGES}")),
        )
        .when(
            F.col("detection") == "limited",
            F.concat(F.lit("repeated regions looked for on part of the pages: "), n("empty_pages"), F.lit(" of "), n("total_pages"), F.lit(" have no text")),
        )
    )
    return guards.select("doc_id", text.alias("warning")).filter(F.col("warning").isNotNull())


def hf_regions(spans: DataFrame) -> DataFrame:
    """Text of the top and of the bottom of each page, if short enough to be a header.

    A page's lowest span gives its height. Spans are joined to the page heights
    and filtered to the margins; regions that must be too long are dropped by a
    partial sum before any text is put together, so what is gathered per page is
    bounded by the length limit.
    """
    placed = spans.filter(F.col("y0").isNotNull())
    heights = placed.groupBy(*PAGE).agg(F.max("y0").alias("_max"))
    heights = heights.withColumn("_height", F.coalesce(F.nullif("_max", F.lit(0.0)), F.lit(1.0)))
    margin = placed.join(heights.select(*PAGE, "_height"), PAGE)
    sides = F.array_compact(
        F.array(
            F.when(F.col("y0") <= F.col("_height") * HEADER_SHARE, F.lit("header")),
            F.when(F.col("y0") >= F.col("_height") * FOOTER_SHARE, F.lit("footer")),
        )
    )
    cut = margin.select(*PAGE, "seq", "text", F.explode(sides).alias("region"))
    inked = F.length(F.regexp_replace("text", F.lit(f"{WS}+"), F.lit("")))
    key = [*PAGE, "region"]
    extents = (
        cut.withColumn("_inked", inked)
        .groupBy(*key)
        .agg(
            F.sum("_inked").alias("_inked_total"),
            F.min(F.when(F.col("_inked") > 0, F.col("seq"))).alias("_first"),
            F.max(F.when(F.col("_inked") > 0, F.col("seq"))).alias("_last"),
        )
        .filter((F.col("_inked_total") > 0) & (F.col("_inked_total") <= REGION_MAX_CHARS))
    )
    kept = cut.join(extents, key).filter(
        F.col("seq").between(F.col("_first"), F.col("_last")) & (F.col("text") != "")
    )
    # The first and the last kept span hold ink, so stripping the region removes
    # their outer white space and nothing else: its length is known beforehand.
    outer = F.lit(WS_CHARS)
    lead = F.length("text") - F.length(F.ltrim("text", outer))
    trail = F.length("text") - F.length(F.rtrim("text", outer))
    sized = kept.groupBy(*key).agg(
        F.sum(
            F.length("text")
            - F.when(F.col("seq") == F.col("_first"), lead).otherwise(0)
            - F.when(F.col("seq") == F.col("_last"), trail).otherwise(0)
        ).alias("_chars")
    )
    short = sized.filter(F.col("_chars") <= REGION_MAX_CHARS)
    text = F.expr("listagg(text, '') WITHIN GROUP (ORDER BY seq)")
    regions = kept.join(short.select(*key), key, "left_semi").groupBy(*key).agg(text.alias("_text"))
    return (
        regions.withColumn("text", strip(F.col("_text")))
        .drop("_text")
        .withColumn("norm", normalize_region(F.col("text")))
    )


def hf_groups(regions: DataFrame) -> DataFrame:
    """Per document, side and normalized text: a sample and the number of pages."""
    return regions.groupBy("doc_id", "region", "norm").agg(
        F.min_by("text", "page_number").alias("text"),
        F.min("page_number").alias("first_page"),
        F.count("*").alias("page_count"),
    )


def hf_confirm(groups: DataFrame, guards: DataFrame) -> DataFrame:
    """Groups on at least half of all pages of a document whose detection ran."""
    ran = guards.filter(F.col("detection").isin("limited", "full"))
    return (
        groups.join(ran.select("doc_id", "total_pages"), "doc_id")
        .filter(F.col("page_count") / F.col("total_pages") >= REPEAT_SHARE)
    )


def hf_order(confirmed: DataFrame) -> DataFrame:
    """Shortest text first within a document, then the earliest seen."""
    return confirmed.orderBy("doc_id", "region", F.length("text"), "first_page", "norm")


def hf_page_ranges(regions: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Runs of consecutive pages of each confirmed group, one row per run."""
    key = ["doc_id", "region", "norm"]
    pages = regions.join(confirmed.select(*key), key, "left_semi").select(*key, "page_number")
    ranked = row_numbers(pages, key, [F.col("page_number")], by_position("page_number"), "_n")
    runs = (
        ranked.withColumn("_island", F.col("page_number") - F.col("_n"))
        .groupBy(*key, "_island")
        .agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"))
    )
    single = F.col("first_page") == F.col("last_page")
    first, last = F.col("first_page").cast("string"), F.col("last_page").cast("string")
    label = F.when(single, first).otherwise(F.concat_ws("-", first, last))
    return runs.select(*key, "first_page", "last_page", label.alias("pages"))


def hf_warnings(confirmed: DataFrame, ranges: DataFrame) -> DataFrame:
    """One line per confirmed group, with its page ranges."""
    key = ["doc_id", "region", "norm"]
    listed = ranges.groupBy(*key).agg(
        F.expr("listagg(pages, ', ') WITHIN GROUP (ORDER BY first_page)").alias("pages")
    )
    line = F.concat(
        F.col("region"),
        F.lit("_detected: '"),
        F.substring("text", 1, REGION_LABEL_CHARS),
        F.lit("' on "),
        F.col("page_count").cast("string"),
        F.lit("/"),
        F.col("total_pages").cast("string"),
        F.lit(" pages ("),
        F.col("pages"),
        F.lit(")"),
    )
    return confirmed.join(listed, key).select("doc_id", "region", "norm", line.alias("warning"))
