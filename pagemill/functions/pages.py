"""Measures of one page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.constants import BLANK_PAGE_CHARS, SCANNED_IMAGE_SHARE, SCANNED_PAGE_CHARS


def image_ratio(images: Column, width: Column, height: Column) -> Column:
    """Share of the page under images; 0 without images or without a page size."""
    area = F.nullif(width * height, F.lit(0.0))
    covered = F.aggregate(
        images,
        F.lit(0.0),
        lambda total, im: total
        + F.abs(
            (F.coalesce(im["x1"], F.lit(0.0)) - F.coalesce(im["x0"], F.lit(0.0)))
            * (F.coalesce(im["y1"], F.lit(0.0)) - F.coalesce(im["y0"], F.lit(0.0)))
        ),
    )
    return F.coalesce(covered / area, F.lit(0.0))


def page_type(text_len: Column, image_count: Column, ratio: Column) -> Column:
    return (
        F.when((text_len <= BLANK_PAGE_CHARS) & (image_count == 0), "blank")
        .when(
            (text_len <= SCANNED_PAGE_CHARS) & (image_count > 0) & (ratio > SCANNED_IMAGE_SHARE),
            "scanned",
        )
        .when((text_len > BLANK_PAGE_CHARS) & (image_count > 0), "hybrid")
        .otherwise("text")
    )
