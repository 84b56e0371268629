import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from pagemill.operators import pages as pg
from pagemill.operators import repeated as rp
from pagemill.plans.detect import detect

IMAGES = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def stats(spark, rows):
    return spark.createDataFrame(
        rows, f"doc_id long, page_number int, text_len int, width double, height double, images {IMAGES}"
    )


def test_page_classes_at_their_bounds(spark):
    big, small = (0.0, 0.0, 60.0, 60.0), (0.0, 0.0, 10.0, 10.0)
    edge = (0.0, 0.0, 100.0, 30.0)
    cases = [
        (10, [], "blank"), (11, [], "text"), (50, [big], "scanned"), (51, [big], "hybrid"),
        (50, [small], "hybrid"), (10, [small], "text"), (5, [edge], "text"), (5, [edge, small], "scanned"),
        (5, [(60.0, 60.0, 0.0, 0.0)], "scanned"), (None, None, "blank"),
    ]
    df = stats(spark, [(1, i, n, 100.0, 100.0, im) for i, (n, im, _) in enumerate(cases)])
    rows = pg.classify_pages(df).orderBy("page_number").collect()
    assert [r.page_type for r in rows] == [c for _, _, c in cases]


def test_ratio_without_a_page_size_is_zero(spark):
    df = stats(spark, [(1, 1, 5, 0.0, 100.0, [(0.0, 0.0, 9.0, 9.0)]), (1, 2, 5, None, None, [(0.0, 0.0, 9.0, 9.0)])])
    assert {r.image_ratio for r in pg.classify_pages(df).collect()} == {0.0}


def test_blocks_in_reading_order(spark):
    page = (100.0, 100.0)
    big = [(0.0, 0.0, 90.0, 90.0)]
    pages = pg.classify_pages(stats(spark, [(1, 1, 80, *page, []), (1, 2, 3, *page, big), (1, 3, 0, *page, []), (1, 4, 90, *page, big)]))
    text = spark.createDataFrame(
        [(1, 1, "first paragraph here\n\ntiny\n\nsecond paragraph here"), (1, 2, "abc"), (1, 3, ""), (1, 4, "hybrid page text")],
        "doc_id long, page_number int, text string",
    )
    tables = spark.createDataFrame(
        [(1, 1, 1, [["h", None], ["1", None]]), (1, 4, 1, [["only"]]), (1, 4, 2, [])],
        "doc_id long, page_number int, table_no int, cells array<array<string>>",
    )
    rows = pg.number_blocks(pg.page_blocks(pages, text, tables)).orderBy("position").collect()
    assert [(r.position, r.page_number, r.block_type, r.text) for r in rows] == [
        (0, 1, "paragraph", "first paragraph here"),
        (1, 1, "paragraph", "second paragraph here"),
        (2, 1, "table", "h | \n--- | ---\n1 | "),
        (3, 2, "paragraph", ""),
        (4, 4, "paragraph", "hybrid page text"),
    ]
    assert rows[3].needs_ocr and rows[3].image_count == 1
    assert {r.warning for r in pg.page_warnings(pages).collect()} == {
        "page 2 scanned: no text, needs OCR, images=1", "page 4 hybrid: text kept, images skipped",
    }
    assert [r.warning for r in pg.table_warnings(pg.page_tables(tables)).collect()] == ["page 4 table: headers only, skipped"]
    [summary] = pg.page_summary(pages).collect()
    assert (summary.total_pages, summary.text_pages, summary.scanned_pages, summary.hybrid_pages, summary.blank_pages) == (4, 1, 1, 1, 1)


def expected_regions(spans):
    pages = defaultdict(list)
    for doc, page, seq, text, y0 in spans:
        pages[doc, page].append((seq, text, y0))
    out = set()
    for (doc, page), items in pages.items():
        items.sort()
        height = max(y for _, _, y in items) or 1
        for side, inside in (("header", lambda y: y <= 0.15 * height), ("footer", lambda y: y >= 0.85 * height)):
            text = "".join(t for _, t, y in items if inside(y)).strip()
            if text and len(text) <= 200:
                norm = re.sub(r"\s+", " ", re.sub(r"\b\d+\b", "#", text)).strip()
                out.add((doc, page, side, text, norm))
    return out


def random_spans(seed):
    rng = random.Random(seed)
    spans = []
    for doc in range(4):
        for page in range(1, 30):
            if rng.random() < 0.1:
                continue
            seq = 0
            for y in sorted(rng.choice([0, 0, 5, 10, 14.9, 15, 50, 84, 85, 90, 100]) * 1.0 for _ in range(rng.randint(1, 8))):
                text = rng.choice(["Title", f"page {page}", " ", "", "\n", "x" * 120, "正文", "　"])
                spans.append((doc, page, seq, text, y))
                seq += 1
    return spans


SPAN = "doc_id long, page_number long, seq long, text string, y0 double"


def test_regions_match_a_page_by_page_reading(spark):
    spans = random_spans(4)
    got = rp.hf_regions(spark.createDataFrame(spans, SPAN)).collect()
    assert {(r.doc_id, r.page_number, r.region, r.text, r.norm) for r in got} == expected_regions(spans)


def test_region_of_two_hundred_characters_stays(spark):
    spans = [(1, p, 0, "a" * n, 0.0) for p, n in ((1, 200), (2, 201))] + [(1, p, 1, "end", 100.0) for p in (1, 2)]
    spans += [(1, 3, 0, " " * 300 + "a", 0.0), (1, 3, 1, " " * 300, 1.0), (1, 3, 2, "b" + " " * 300, 2.0), (1, 3, 3, "end", 100.0)]
    got = rp.hf_regions(spark.createDataFrame(spans, SPAN)).filter("region = 'header'").collect()
    assert {r.page_number for r in got} == {1}
    spans[-2] = (1, 3, 2, " " * 300, 2.0)
    got = rp.hf_regions(spark.createDataFrame(spans, SPAN)).filter("region = 'header' AND page_number = 3").collect()
    assert [r.text for r in got] == ["a"]


def document(doc, pages, header, empty=()):
    rows = [(doc, p) for p in pages]
    spans = []
    for p in pages:
        if p in empty:
            continue
        spans += [(doc, p, 0, header(p), 0.0), (doc, p, 1, f"body {p * 7919}", 50.0), (doc, p, 2, f"foot{'x' * p}", 100.0)]
    return rows, spans


def test_detection_guards_halves_and_ranges(spark):
    parts = [
        document(1, range(1, 11), lambda p: f"Report {p}"),                              # all pages
        document(2, range(1, 11), lambda p: "Odd" if p % 2 else "z" * p),                # exactly half
        document(3, range(1, 12), lambda p: "Odd" if p % 2 == 0 else "z" * p),           # just under half
        document(4, range(1, 4), lambda p: "T", empty=(2,)),                             # two valid pages
        document(5, range(1, 4), lambda p: "T"),                                         # three valid pages
        document(6, range(1, 4), lambda p: "T", empty=(1, 2, 3)),                        # none
        document(7, range(1, 9), lambda p: "T", empty=(3, 4, 5, 6)),                     # half of all, limited
    ]
    pages = spark.createDataFrame([r for rows, _ in parts for r in rows], "doc_id long, page_number long")
    spans = spark.createDataFrame([s for _, rows in parts for s in rows], SPAN)
    found = detect(pages, spans)
    assert {r.doc_id: r.detection for r in found.guards.collect()} == {
        1: "full", 2: "full", 3: "full", 4: "skipped_few_pages", 5: "full", 6: "skipped_no_text", 7: "limited",
    }
    assert {(r.doc_id, r.norm, r.page_count) for r in found.confirmed.collect()} == {
        (1, "Report #", 10), (2, "Odd", 5), (5, "T", 3), (7, "T", 4),
    }
    lines = {r.doc_id: r.warning for r in found.warnings.collect()}
    assert lines[1] == "header_detected: 'Report 1' on 10/10 pages (1-10)"
    assert lines[2].endswith("(1, 3, 5, 7, 9)") and lines[7].endswith("4/8 pages (1-2, 7-8)")


def test_numbers_in_words_stay(values):
    assert values(rp.normalize_region, ["a1 12 v2.0", "page\t 3 ", "第3页 4"]) == ["a1 # v2.#", "page #", "第3页 #"]


def test_one_source_may_hold_most_pages(spark):
    pages = spark.range(20000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("page_number"))
    spans = pages.select(
        "doc_id", "page_number", F.lit(0).cast("long").alias("seq"),
        F.when(F.col("page_number") % 3 == 2, "other").otherwise("same").alias("text"), F.lit(0.0).alias("y0"),
    ).unionByName(pages.select("doc_id", "page_number", F.lit(1).cast("long").alias("seq"), F.lit("end").alias("text"), F.lit(9.0).alias("y0")))
    found = detect(pages, spans)
    runs = found.ranges.filter("region = 'header'").agg(F.count("*").alias("n"), F.min(F.col("last_page") - F.col("first_page")).alias("d")).first()
    assert (runs.n, runs.d) == (6667, 1)


def test_guard_warnings(spark):
    guards = spark.createDataFrame(
        [("a", 4, 4, 0, "skipped_no_text"), ("b", 4, 2, 2, "skipped_few_pages"), ("c", 9, 1, 8, "limited"), ("d", 9, 0, 9, "full")],
        "doc_id string, total_pages int, empty_pages int, valid_pages int, detection string")
    got = {r.doc_id: r.warning for r in rp.hf_guard_warnings(guards).collect()}
    assert set(got) == {"a", "b", "c"} and "2, needed: 3" in got["b"] and "1 of 9" in got["c"]


def test_any_detector(spark):
    from pyspark.sql import functions as F

    from pagemill.plans.detect import detect

    pages = spark.createDataFrame([(1, p) for p in range(1, 5)], "doc_id long, page_number long")
    spans = spark.createDataFrame([(1, p, 0, f"t{p}", 1.0) for p in range(1, 5)], "doc_id long, page_number long, seq long, text string, y0 double")

    def titles(rows):
        return rows.select("doc_id", "page_number", F.lit("title").alias("region"), "text", F.lit("t").alias("norm"))

    found = detect(pages, spans, detector=titles)
    assert [(r.region, r.page_count) for r in found.confirmed.collect()] == [("title", 4)]
    assert [r.pages for r in found.ranges.collect()] == ["1-4"]


def test_paged_documents(spark):
    from pagemill.constants import ChunkingConfig
    from pagemill.plans import paged

    image = [(0.0, 0.0, 90.0, 90.0)]
    rows = [(1, 1, "a paragraph of the first page", 29, 100.0, 100.0, []), (1, 2, "", 0, 100.0, 100.0, image), (1, 3, "x" * 150, 150, 100.0, 100.0, [])]
    frame = spark.createDataFrame(rows, "doc_id long, page_number int, text string, text_len int, width double, height double, images array<struct<x0 double, y0 double, x1 double, y1 double>>")
    tables = spark.createDataFrame([(1, 3, 1, [["h", "k"], ["1", None]]), (1, 1, 1, [["only"]])], "doc_id long, page_number int, table_no int, cells array<array<string>>")
    pages = pg.classify_pages(frame)
    blocks = paged.paged_blocks(pages, tables)
    chunks = paged.page_chunk_rows(blocks, config=ChunkingConfig(100, 10, 0)).orderBy("chunk_index").collect()
    assert [r.page_number for r in chunks] == sorted(r.page_number for r in chunks) and {1, 3} <= {r.page_number for r in chunks}
    [record] = paged.parsed_documents(pages, blocks, tables).collect()
    assert (record.total_pages, record.scanned_pages, record.status) == (3, 1, "ready") and record.total_blocks == blocks.count()
    assert record.warnings == ["page 1 table: headers only, skipped", "page 2 scanned: no text, needs OCR, images=1"]


def test_texts_of_blocks_are_dealt_out_once(spark):
    image = [(0.0, 0.0, 90.0, 90.0)]
    rows = [(1, 1, "a paragraph of the first page", 29, 100.0, 100.0, []), (1, 1, "a paragraph of the first page", 29, 100.0, 100.0, []),
            (None, 1, "a paragraph of no document", 29, 100.0, 100.0, []), (None, 2, "", 0, 100.0, 100.0, image)]
    frame = spark.createDataFrame(rows, "doc_id long, page_number int, text string, text_len int, width double, height double, images array<struct<x0 double, y0 double, x1 double, y1 double>>")
    tables = spark.createDataFrame([(1, 1, 1, [["h"], ["1"]]), (None, 1, 1, [["h"], ["1"]]), (2, 1, 1, [["h"], ["1"]])], "doc_id long, page_number int, table_no int, cells array<array<string>>")
    blocks = pg.number_blocks(pg.page_blocks(pg.classify_pages(frame), frame, tables))
    got = sorted((r.doc_id or 0, r.position, r.block_type, r.rows) for r in blocks.collect())
    assert got == [(0, 0, "paragraph", None), *((1, k, "paragraph", None) for k in range(4)), (1, 4, "table", 1), (1, 5, "table", 1)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pg.number_blocks(pg.page_blocks(pg.classify_pages(frame), frame, tables))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 4  # blocks with texts; without, for the sums; sums by document and back
