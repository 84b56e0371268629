"""Markdown with containers, by examples."""

import time

import pytest

from pagemill.functions.containers import parse
from pagemill.operators.blocks import md_nested_blocks

CASES = {
    "> quoted\nlazy\n\nnot": [("paragraph", "quoted\nlazy", "q"), ("paragraph", "not", "")],
    "> a\n- b": [("paragraph", "a", "q"), ("list_item", "b", "u")],
    "> - one\n>   - two\n> - three": [("list_item", "one", "qu"), ("list_item", "two", "quu"), ("list_item", "three", "qu")],
    "- a\n\n  b\n\n      code\n\nc": [("list_item", "a", "u"), ("paragraph", "b", "u"), ("code", "code", "u"), ("paragraph", "c", "")],
    "1. a\n   > b\n   > c\n2. d": [("list_item", "a", "o"), ("paragraph", "b\nc", "oq"), ("list_item", "d", "o")],
    "> ```py\n> x = 1\n>\n>   y\n> ```\n> after": [("code", "x = 1\n\n  y", "q"), ("paragraph", "after", "q")],
    "> ```\n> open\nout": [("code", "open", "q"), ("paragraph", "out", "")],
    "- ```\n  a\n  ```\n- b": [("code", "a", "u"), ("list_item", "b", "u")],
    "text\n2. not a list": [("paragraph", "text\n2. not a list", "")],
    "text\n1. a list": [("paragraph", "text", ""), ("list_item", "a list", "o")],
    "> # h\n> Title\n> ===\nnext": [("heading", "h", "q"), ("heading", "Title", "q"), ("paragraph", "next", "")],
    "> | a | b |\n> |---|---|\n> | 1 | 2 |\nend": [("table", "| a | b |\n|---|---|\n| 1 | 2 |", "q"), ("paragraph", "end", "")],
    "- - a\n  - b": [("list_item", "a", "uu"), ("list_item", "b", "uu")],
    "* * *\n- - -\nx": [("paragraph", "x", "")],
    "-\n  a\n\n-\n\n  b": [("list_item", "a", "u"), ("list_item", "b", "u")],
    "\tcode\n\n\tmore\n\ntext": [("code", "code\n\nmore", ""), ("paragraph", "text", "")],
    ">>> deep\n> lazy": [("paragraph", "deep\nlazy", "qqq")],
    "[a]: /x \"t\"\n[b]: <y>\n[A] [t][b] [c]": [("paragraph", "[A](#) [t](#) [c]", "")],
    "> [q]: /x\n\nsee [q]": [("paragraph", "see [q](#)", "")],
    "": [],
    "> \n>\n- ": [],
    "# \n#\n####### no": [("heading", "", ""), ("heading", "", ""), ("paragraph", "####### no", "")],
}


@pytest.mark.parametrize("text", CASES)
def test_blocks(text):
    got = [(b.block_type, b.text, b.path) for b in parse(text)]
    assert got == CASES[text]
    assert [(b.block_type, b.text, b.path) for b in parse(text.replace("\n", "\r\n"))] == CASES[text]


def test_levels_and_languages():
    blocks = parse("1. a\n   - b\n     ~~~ c++ \n     x\n     ~~~\n")
    assert [(b.level, b.ordered, b.language) for b in blocks] == [(1, True, None), (2, False, None), (None, None, "c++")]


@pytest.mark.parametrize("text", [">" * 200_000, "> " * 3_000 + "\n" + "> " * 3_000, "- " * 50_000 + "\n\n" * 2_000, "> a\nb\n" * 50_000, "[" * 200_000, "#" * 200_000, "- a\n" * 60_000, "1. " * 30_000 + " " * 100_000])
def test_time_is_linear(text):
    start = time.perf_counter()
    parse(text)
    assert time.perf_counter() - start < 5


def test_rows(spark):
    docs = spark.createDataFrame([(1, "> *a*\n> **b `x*y`**\n\n| h |\n|---|\n| *c* |"), (2, None), (None, "- [t][r]\n\n[r]: u")], "doc_id long, text string")
    rows = sorted(md_nested_blocks(docs).collect(), key=lambda r: (r.doc_id or 0, r.position))
    assert [(r.doc_id, r.block_type, r.text, r.is_quote, r.path) for r in rows] == [
        (None, "list_item", "t", False, "u"),
        (1, "paragraph", "a b x*y", True, "q"),
        (1, "table", "h\n---\nc", False, ""),
    ]
    assert rows[2].headers == ["h"] and rows[2].table_rows == [["c"]]


def test_emphasis_of_any_depth(values):
    from pagemill.functions.markdown import inline_text

    deep = "word"
    for k in range(9):
        deep = f"*a{k} {deep} b{k}*" if k % 2 else f"**c{k} {deep} d{k}**"
    assert "*" not in values(inline_text, [deep])[0]
    marks = "*" * 5000 + " x " + "*" * 5000
    start = time.perf_counter()
    values(inline_text, [marks, "*a " * 3000])
    assert time.perf_counter() - start < 30
