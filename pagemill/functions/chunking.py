"""Splitting long blocks and merging short ones inside one row.

A document's blocks are an array, so the whole step is a narrow map: it needs no
shuffle, serves batch and stream alike, and a document never meets another one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.constants import CUT_WINDOW_CHARS, UNSPLITTABLE_TYPES, ChunkingConfig
from pagemill.functions.text import let


def is_splittable(block_type: Column) -> Column:
    return ~block_type.isin(*UNSPLITTABLE_TYPES)


def cut_pattern(config: ChunkingConfig) -> str:
    """A pattern whose successive matches are the pieces between cuts.

    The first piece reaches ``max_chars``; each later one advances by
    ``max_chars - overlap`` since a part starts ``overlap`` before the last cut.
    A piece then runs on to the end of the best delimiter that lies wholly in
    the search window and is not the last character of the text; alternatives
    are in order of priority, and lazy counts take the nearest of a kind.
    """
    stops = "|".join(
        rf".{{0,{CUT_WINDOW_CHARS - len(d)}}}?\Q{d}\E(?=.)"
        for d in config.split_on
        if len(d) <= CUT_WINDOW_CHARS
    )

    def piece(size: int) -> str:
        return rf"(?:.{{1,{size}}}\z|.{{{size}}}(?:{stops + '|' if stops else ''}))"

    step = config.max_chars - config.overlap_chars
    return rf"(?s)\A{piece(config.max_chars)}|{piece(step)}"


def prefix_sums(values: Column) -> Column:
    """Running totals of an integer array, by doubling steps (k log k, not k squared)."""
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int")

    def add_shifted(totals: Column, r: Column) -> Column:
        gap = F.pow(F.lit(2), r).cast("int")
        return F.transform(
            totals,
            lambda v, i: v + F.when(i >= gap, F.get(totals, i - gap)).otherwise(F.lit(0)),
        )

    return F.aggregate(
        F.sequence(F.lit(0), rounds - 1), values, lambda totals, r: add_shifted(totals, r)
    )


def split_parts(text: Column, config: ChunkingConfig, *, offsets: bool = True) -> Column:
    """``array<struct<text, part, total[, start, end]>>`` of one long text."""
    overlap = config.overlap_chars
    step = config.max_chars - overlap
    reach = max(1, math.ceil(overlap / step))

    def tail(pieces: Column, i: Column) -> Column:
        if overlap == 0:
            return F.lit("")
        if reach == 1:
            before = F.get(pieces, i - 1)
        else:
            first = F.greatest(i - reach, F.lit(0))
            before = F.array_join(F.slice(pieces, first + 1, i - first), "")
        return F.when(i > 0, F.right(before, F.lit(overlap))).otherwise(F.lit(""))

    def parts(pieces: Column) -> Column:
        def build(piece: Column, i: Column, ends: Column | None) -> Column:
            fields = [
                F.concat(tail(pieces, i), piece).alias("text"),
                (i + 1).alias("part"),
                F.size(pieces).alias("total"),
            ]
            if ends is not None:
                start = F.when(i > 0, F.get(ends, i - 1) - overlap).otherwise(F.lit(0))
                fields += [start.alias("start"), F.get(ends, i).alias("end")]
            return F.struct(*fields)

        if not offsets:
            return F.transform(pieces, lambda p, i: build(p, i, None))
        lengths = F.transform(pieces, lambda p: F.length(p))
        return let(
            prefix_sums(lengths),
            lambda ends: F.transform(pieces, lambda p, i: build(p, i, ends)),
        )

    return let(F.regexp_extract_all(text, F.lit(cut_pattern(config)), F.lit(0)), parts)


def split_block(block: Column, config: ChunkingConfig, *, offsets: bool = True) -> Column:
    """The parts of one block; a heading, code or short block is its own only part."""
    def part_row(p: Column | None) -> Column:
        none = F.lit(None)
        fields = [
            block["block_type"].alias("block_type"),
            (block["text"] if p is None else p["text"]).alias("text"),
            block["page_number"].alias("page_number"),
            (none.cast("int") if p is None else p["part"]).alias("split_part"),
            (none.cast("int") if p is None else p["total"]).alias("split_total"),
        ]
        if offsets:
            crosses = F.coalesce(block["cross_page_boundary"], F.lit(False))
            fields += [
                (none.cast("boolean") if p is None else ~crosses).alias("page_number_certain"),
                (none.cast("int") if p is None else p["start"]).alias("char_offset_start"),
                (none.cast("int") if p is None else p["end"]).alias("char_offset_end"),
            ]
        return F.struct(*fields)

    long = is_splittable(block["block_type"]) & (F.length(block["text"]) > config.max_chars)
    return F.when(
        long,
        F.transform(split_parts(block["text"], config, offsets=offsets), part_row),
    ).otherwise(F.array(part_row(None)))


def merge_short_parts(parts: Column, config: ChunkingConfig) -> Column:
    """Join each short part to the one before it, keeping headings and code apart.

    A part opens a new output block unless it and its predecessor may both be
    merged and it is short; each run from one opening to the next is one block.
    """
    threshold = config.merge_short_threshold

    def opens(ps: Column, i: Column) -> Column:
        here, before = F.get(ps, i), F.get(ps, i - 1)
        joins = (
            (i > 0)
            & is_splittable(here["block_type"])
            & (F.length(here["text"]) < threshold)
            & is_splittable(before["block_type"])
        )
        return ~F.coalesce(joins, F.lit(False))

    def merge(ps: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ps) - 1), lambda i: opens(ps, i)
        )

        def run(ss: Column, start: Column, j: Column) -> Column:
            stop = F.coalesce(F.get(ss, j + 1), F.size(ps))
            size = stop - start
            head = F.get(ps, start)
            last = F.get(ps, stop - 1)
            texts = F.transform(F.slice(ps, start + 1, size), lambda p: p["text"])
            single = size == 1
            return F.struct(
                head.alias("head"),
                F.when(single, head["text"]).otherwise(F.array_join(texts, "\n")).alias("text"),
                F.when(~single, F.coalesce(head["split_part"], F.lit(0))).alias("merged_from"),
                F.when(~single, F.coalesce(last["split_part"], F.lit(0))).alias("merged_to"),
            )

        runs = let(starts, lambda ss: F.transform(ss, lambda s, j: run(ss, s, j)))
        return F.when(F.size(ps) > 0, runs)

    return let(parts, merge)


def chunk_blocks(blocks: Column, config: ChunkingConfig, *, offsets: bool = True) -> Column:
    """Split, then merge; the place in the returned array is the new position."""
    parts = F.flatten(
        F.transform(blocks, lambda b: split_block(b, config, offsets=offsets))
    )
    return merge_short_parts(parts, config)
