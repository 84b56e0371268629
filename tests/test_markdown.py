import pytest

from pagemill.operators import blocks as bl


@pytest.fixture
def parse(spark):
    def run(text):
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        return sorted(bl.md_blocks(df).collect(), key=lambda r: r.position)

    return run


def shape(rows):
    return [(r.block_type, r.text) for r in rows]


def test_headings_and_paragraphs(parse):
    rows = parse("# One\n\n## Two ##\ntext of two\nstill\n### Three\n\nlast\n####### seven\n#no")
    assert [(r.text, r.level) for r in rows if r.block_type == "heading"] == [("One", 1), ("Two", 2), ("Three", 3)]
    assert [r.text for r in rows if r.block_type == "paragraph"] == ["text of two still", "last ####### seven #no"]


def test_underlined_headings(parse):
    rows = parse("Top\n===\n\nSub\ntitle\n---\nbody\n\n---\n\nend")
    assert [(r.text, r.level) for r in rows if r.level] == [("Top", 1), ("Sub title", 2)]
    assert [r.text for r in rows if r.block_type == "paragraph"] == ["body", "end"]


def test_fences(parse):
    rows = parse("```py title\n# not a heading\n\n- nor a list\n```\nafter\n~~~\n```\n~~~\n````\n```\n````\n```\n```\n```\nopen")
    assert [(r.block_type, r.text, r.language) for r in rows] == [
        ("code", "# not a heading\n\n- nor a list", "py title"),
        ("paragraph", "after", None),
        ("code", "```", "unknown"),
        ("code", "```", "unknown"),
        ("code", "", "unknown"),
        ("code", "open", "unknown"),
    ]


def test_indented_code(parse):
    rows = parse("para\n    goes on\n\n    code\n\n      more\n\nend")
    assert shape(rows) == [("paragraph", "para goes on"), ("code", "code\n\n  more"), ("paragraph", "end")]


def test_lists(parse):
    rows = parse("# L\n\n- item 1\n- item 2\n  more\n  - nested\n3. third\n4) fourth\n- [ ] task\n* star\n+ plus")
    items = [r for r in rows if r.block_type == "list_item"]
    assert [(r.text, r.ordered, r.level) for r in items] == [
        ("item 1", False, 1), ("item 2 more", False, 1), ("nested", False, 2), ("third", True, 1),
        ("fourth", True, 1), ("[ ] task", False, 1), ("star", False, 1), ("plus", False, 1),
    ]


def test_tables(parse):
    rows = parse("intro\n\n| A | B |\n|---|:-:|\n| a1 | **b1** |\n| a\\|2 |\n\nx | y\n- | -\n1 | 2 | 3\n\nend | not table")
    first, second = [r for r in rows if r.block_type == "table"]
    assert (first.headers, first.table_rows) == (["A", "B"], [["a1", "b1"], ["a|2", ""]])
    assert first.text == "A | B\n--- | ---\na1 | b1\na|2 | " and (first.rows, first.cols) == (2, 2)
    assert (second.headers, second.table_rows) == (["x", "y"], [["1", "2"]])
    assert rows[-1].block_type == "paragraph"


def test_quotes_rules_and_inline(parse):
    rows = parse("> a *b*\n>\n> c\n\n***\n\n- - -\n_under_ snake_case __strong__ ![](i.png) ![alt](i.png) [l](u) <b>x</b> `c*d` `` x`y `` \\* <http://a.b>")
    assert (rows[0].text, rows[0].is_quote) == ("a b c", True)
    assert shape(rows[1:]) == [("paragraph", "under snake_case strong [image] alt l x c*d x`y * http://a.b")]


def test_breaks_inside_a_paragraph(parse):
    assert shape(parse("one\ntwo  \nthree\\\nfour")) == [("paragraph", "one two\nthree\nfour")]


@pytest.mark.parametrize("text", ["", "\n\n \n", "***", None])
def test_nothing_to_parse(parse, text):
    assert parse(text) == []


def test_chinese(parse):
    rows = parse("# 中文标题\n\n这是一段内容。\n\n## 第二节\n\n更多内容。")
    assert shape(rows) == [("heading", "中文标题"), ("paragraph", "这是一段内容。"), ("heading", "第二节"), ("paragraph", "更多内容。")]


def test_long_blocks_do_not_exhaust_the_stack(parse):
    line = "word " * 10
    rows = parse("\n".join([line] * 20000) + "\n\n```\n" + "\n".join(["x"] * 50000) + "\n```\n" + "-" * 30000 + "\n\n" + "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 5000)
    assert [r.block_type for r in rows] == ["paragraph", "code", "table"]
    assert len(rows[1].text) == 99999 and rows[2].rows == 5000


def test_stats(spark):
    df = spark.createDataFrame([(1, "# a\n\nb\n\n```py\nc\n```\n\n| x | y |\n|---|---|\n| 1 | 2 |")], "doc_id long, text string")
    [row] = bl.parse_stats(bl.md_blocks(df)).collect()
    assert (row.total_blocks, row.heading_count, row.code_block_count, row.table_count, row.has_tables) == (4, 1, 1, 1, True)


@pytest.mark.parametrize("mark", ["a|", "[", "![", "[a](", "<a", "<http://a", "<!--", "<!-- -", "*", "**a ", "_a", "`", "`` ` ", "\\\\", "| - ", "- ", "> "])
def test_a_long_line_of_marks_takes_linear_time(parse, mark):
    import time

    start = time.perf_counter()
    parse(mark * (1_000_000 // len(mark)))
    assert time.perf_counter() - start < 20


def test_marks_inside_marks(parse):
    text = "**bold *it* more** and *it **bold** more*\n\n[a [b] c](u(v)) x\n\n<!-- a-b > c --><!-- d <e> -->end\n\n*a ﷐ b* `!`"
    assert [r.text for r in parse(text)] == ["bold it more and it bold more", "a [b] c x", "end", "a ﷐ b !"]
