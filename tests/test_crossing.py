"""Paragraphs over page ends."""

import random
import re

from pagemill.operators import crossing as cr

KIND = "doc_id string, page_number int, position int, block_type string, text string"


def joined(spark, rows):
    found = cr.join_across_pages(spark.createDataFrame(rows, KIND).repartition(3))
    return sorted(tuple(r) for r in found.select("doc_id", "position", "text", "page_number", "last_page", "page_number_certain").collect())


def test_examples(spark):
    rows = [
        ("a", 1, 0, "paragraph", "A title"), ("a", 1, 1, "paragraph", "It goes on and"), ("a", 2, 0, "paragraph", "on, over a hyphen-"),
        ("a", 5, 0, "paragraph", "ated page and"), ("a", 6, 0, "paragraph", "ends."), ("a", 6, 1, "paragraph", "not joined on a page"),
        ("a", 7, 0, "table", "a | b"), ("a", 8, 0, "paragraph", "small after a table"), ("a", 9, 0, "paragraph", "Large letter"),
        ("a", 10, 0, "heading", "heads never go on"), ("b", 1, 0, "paragraph", "other document without an end"),
        ("c", 1, 0, "paragraph", "他说"), ("c", 2, 0, "paragraph", "好的。"), ("c", 3, 0, "paragraph", "x"), ("c", 4, 0, "paragraph", "“quoted.”"),
        ("c", 5, 0, "paragraph", "y"), ("c", 6, 0, "paragraph", "\ufdd0"), ("c", 7, 0, "paragraph", None),
    ]
    assert joined(spark, rows) == [
        ("a", 0, "A title", 1, 1, True), ("a", 1, "It goes on and on, over a hyphenated page and ends.", 1, 6, False), ("a", 2, "not joined on a page", 6, 6, True),
        ("a", 3, "a | b", 7, 7, True), ("a", 4, "small after a table", 8, 8, True), ("a", 5, "Large letter", 9, 9, True), ("a", 6, "heads never go on", 10, 10, True),
        ("b", 0, "other document without an end", 1, 1, True), ("c", 0, "他说好的。", 1, 2, False), ("c", 1, "x", 3, 3, True),
        ("c", 2, "“quoted.”", 4, 4, True), ("c", 3, "y", 5, 5, True), ("c", 4, "\ufffd", 6, 6, True), ("c", 5, "", 7, 7, True),
    ]


def test_many_pages_in_segments(spark):
    rng = random.Random(2)
    rows = [("a", p, k, "paragraph", rng.choice(["goes on", "ends.", "Begins", "cut-"])) for p in range(0, 60_000, 7) for k in range(rng.choice([1, 1, 2]))]
    wanted, last = [], None
    for _, page, _, _, text in rows:
        if last and last[1] != page and not last[2].endswith(".") and text[0].islower():
            wanted[-1] = (re.sub("-$", "", wanted[-1][0]) + ("" if wanted[-1][0].endswith("-") else " ") + text, wanted[-1][1], page)
        else:
            wanted.append((text, page, page))
        last = (None, page, text)
    assert [(t, a, b) for _, _, t, a, b, _ in joined(spark, rows)] == wanted


def test_nothing(spark):
    assert joined(spark, []) == []
