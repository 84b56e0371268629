"""Repeated headers and footers, from spans to warnings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from pagemill.operators import repeated as rp
from pagemill.sources.tables import stored


@dataclass(frozen=True)
class Repeated:
    guards: DataFrame
    regions: DataFrame
    confirmed: DataFrame
    ranges: DataFrame
    warnings: DataFrame


# From spans to regions (doc_id, page_number, region, text, norm), at most a few short ones per page.
Detector = Callable[[DataFrame], DataFrame]


def detect(pages: DataFrame, spans: DataFrame, *, detector: Detector = rp.hf_regions) -> Repeated:
    """All results of detection; ``detector`` finds the regions that may repeat.

    The regions (at most two short texts per page) and the confirmed groups are
    stored: everything later reads these small tables and not the spans again.
    """
    guards = rp.hf_guards(pages, spans)
    regions = stored(detector(spans), "regions")
    confirmed = stored(rp.hf_confirm(rp.hf_groups(regions), guards), "confirmed")
    ranges = rp.hf_page_ranges(regions, confirmed)
    return Repeated(guards, regions, confirmed, ranges, rp.hf_warnings(confirmed, ranges))
