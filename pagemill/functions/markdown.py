"""Markdown to typed blocks, one pass per document, inside the row.

A pattern whose alternatives are the block kinds cuts the text into raw blocks
in document order; each raw block is then labelled by its first lines. Repeats
are over single characters only, so long blocks cost no stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import let, strip

# --- Fixed values: line shapes of the Markdown block kinds --------------------
HEADING = r" {0,3}#{1,6}(?:[ \t][^\n]*)?$"
BACKTICK_FENCE = r" {0,3}(`{3,})[^`\n]*$"
TILDE_FENCE = r" {0,3}(~{3,})[^\n]*$"
ANY_FENCE = r" {0,3}(?:`{3,}[^`\n]*|~{3,}[^\n]*)$"
RULE = r" {0,3}(?:\*[ \t]*\*[ \t]*\*[* \t]*|-[ \t]*-[ \t]*-[- \t]*|_[ \t]*_[ \t]*_[_ \t]*)$"
ITEM = r"[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+\S"
QUOTE = r" {0,3}>"
TABLE_DELIMITER = r"[ \t]*(?:\|[ \t]*:?-|:?-[^\n|]*\|)[-:| \t]*$"
TABLE_START = rf"[^\n|]*+\|[^\n]*+\n{TABLE_DELIMITER}"
UNDERLINE = r" {0,3}(?:=+|-+)[ \t]*$"
INDENTED = r"(?: {4}| {0,3}\t)[ \t]*\S"
BLANK = r"[ \t]*$"
# ------------------------------------------------------------------------------

# Code spans, escaped characters, and the text between them.
INLINE_LITERALS = (
    r"(?s)(?<!`)(`+)(?!`).+?(?<!`)\1(?!`)|\\[!-/:-@\[-`{-~]|[^`\\]+|[`\\]"
)
MARKS = "!()*<>[\\]_`"
HELD = "".join(chr(0xFDD0 + i) for i in range(len(MARKS)))
ASIDE = "".join(chr(0xFDE0 + i) for i in range(len(MARKS)))  # where a text's own HELD characters wait
NESTING = 3  # emphasis inside emphasis that every text with marks is looked through for
STRONG, EMPHASIS = r"\*\*([^*\n]+)\*\*", r"\*([^*\s\n]|[^*\s\n][^*\n]*[^*\s\n])\*"

FLAGS = "(?dms)"
INTERRUPT = "|".join([BLANK, HEADING, ANY_FENCE, RULE, ITEM, QUOTE, TABLE_START])
BLOCKS = FLAGS + "|".join(
    [
        rf"^{BACKTICK_FENCE}.*?(?:^ {{0,3}}\1`*[ \t]*$|\z)",
        rf"^{TILDE_FENCE}.*?(?:^ {{0,3}}\2~*[ \t]*$|\z)",
        rf"^{HEADING}",
        rf"^{RULE}",
        rf"^{TABLE_START}.*?(?=\n[^\n|]*$|\z)",
        rf"^{ITEM}.*?(?=\n(?:{INTERRUPT})|\z)",
        rf"^{QUOTE}.*?(?=\n(?!{QUOTE})|\z)",
        rf"^{INDENTED}.*?(?=\n(?!{INDENTED}|{BLANK})|\z)",
        rf"^[ \t]*\S.*?(?:\n{UNDERLINE}|(?=\n(?:{INTERRUPT}))|\z)",
    ]
)


def _starts(raw: Column, pattern: str) -> Column:
    return raw.rlike(rf"{FLAGS}\A(?:{pattern})")


def _sub(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def inline_text(text: Column) -> Column:
    """Text as read: marks, link targets and inline HTML removed.

    Characters in code spans and after a backslash are not marks. They are held
    as noncharacters while the marks are taken out; those that a text has itself
    are put aside meanwhile.
    """
    def plain(t: Column) -> Column:
        own = F.translate(t, HELD, ASIDE)
        held = F.when(t.rlike(r"[`\\]"), _hold_literals(own)).otherwise(own)
        return F.translate(_without_marks(held), HELD + ASIDE, MARKS + HELD)

    return let(text, lambda t: F.when(t.rlike(r"[`\\\[<*_]"), plain(t)).otherwise(t))


def _hold_literals(text: Column) -> Column:
    def hold(token: Column) -> Column:
        code = _sub(_sub(token, r"\A`+|`+\z", ""), r"(?s)\A (.*\S.*) \z", "$1")
        return (
            F.when(F.length(token) < 2, token)
            .when(F.startswith(token, F.lit("`")), F.translate(code, MARKS, HELD))
            .when(F.startswith(token, F.lit("\\")), F.translate(F.substring(token, 2, 1), MARKS, HELD))
            .otherwise(token)
        )

    tokens = F.regexp_extract_all(text, F.lit(INLINE_LITERALS), F.lit(0))
    return F.array_join(F.transform(tokens, hold), "")


def _without_marks(text: Column) -> Column:
    """Each pattern stops at the next mark of its kind, so a line of marks costs no more than one of words."""
    target = r"\((?:[^()]|\([^()]*+\))*+\)"
    text = _sub(text, rf"!\[\]{target}", "[image]")
    text = _sub(text, rf"!?\[((?:[^\[\]]|\[[^\[\]]*+\])*+)\]{target}", "$1")
    text = _sub(text, r"<((?:https?://|mailto:)[^<>\s]++)>", "$1")
    text = _sub(text, r"</?[A-Za-z][^<>]*+>|<!--(?:[^<-]|<(?!!--)|-(?!->))*+-->", "")
    for _ in range(NESTING):
        text = _without_stars(text)
    text = let(text, lambda t: F.when(t.rlike(f"{STRONG}|{EMPHASIS}"), _without_all_stars(t)).otherwise(t))
    text = _sub(text, r"(^|[^\w])__([^_\n]+)__($|[^\w])", "$1$2$3")
    return _sub(text, r"(^|[^\w])_([^_\n]+)_($|[^\w])", "$1$2$3")


def _without_stars(text: Column) -> Column:
    return _sub(_sub(text, STRONG, "$1"), EMPHASIS, "$1")


def _without_all_stars(text: Column) -> Column:
    """As long as marks go; each round takes a pair at least, and rounds after the last change cost nothing."""
    rounds = F.sequence(F.lit(0), F.size(F.split(text, r"\*")))
    begin = F.struct(text.alias("text"), F.lit(True).alias("open"))
    step = lambda old: let(_without_stars(old), lambda new: F.struct(new.alias("text"), (new != old).alias("open")))
    return F.aggregate(rounds, begin, lambda acc, _: F.when(acc["open"], step(acc["text"])).otherwise(acc))["text"]


def join_lines(lines: Column) -> Column:
    """Lines of one paragraph: a soft break is a space, a hard break a new line."""
    return let(lines, _join)


def joined_text(raw: Column) -> Column:
    one_line = F.btrim(raw, F.lit(" \t"))
    return F.when(~F.contains(raw, F.lit("\n")), one_line).otherwise(join_lines(F.split(raw, "\n")))


def _join(lines: Column) -> Column:
    last = F.size(lines) - 1

    def piece(line: Column, i: Column) -> Column:
        slash = F.endswith(line, F.lit("\\"))
        hard = slash | F.endswith(line, F.lit("  "))
        bare = F.btrim(line, F.lit(" \t"))
        bare = F.when(slash & (i < last), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)
        joint = F.when(i == last, F.lit("")).when(hard, F.lit("\n")).otherwise(F.lit(" "))
        return F.concat(bare, joint)

    return F.array_join(F.transform(lines, piece), "")


def table_cells(line: Column) -> Column:
    """Cells of one table line, outer bars and escapes removed."""
    bare = _sub(strip(line), r"\A\||(?<!\\)\|\z", "")
    return F.transform(
        F.split(bare, r"(?<!\\)\|"), lambda c: inline_text(strip(_sub(c, r"\\\|", "|")))
    )


def table_text(headers: Column, rows: Column) -> Column:
    """A table as searchable text: headers, a dashed line, rows."""
    dashes = F.array_join(F.transform(headers, lambda h: F.lit("---")), " | ")
    return F.array_join(
        F.concat(
            F.array(F.array_join(headers, " | "), dashes),
            F.transform(rows, lambda r: F.array_join(r, " | ")),
        ),
        "\n",
    )


def _fit(cells: Column, width: Column) -> Column:
    """As many cells as the header has: extra ones cut, missing ones ''."""
    missing = F.greatest(width - F.size(cells), F.lit(0))
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), missing)), F.lit(1), width)


def _block(
    block_type: str,
    text: Column,
    *,
    level: Column | None = None,
    language: Column | None = None,
    ordered: Column | None = None,
    is_quote: bool = False,
    headers: Column | None = None,
    rows: Column | None = None,
) -> Column:
    no_row = F.lit(None).cast("array<string>")
    return F.struct(
        F.lit(block_type).alias("block_type"),
        text.alias("text"),
        F.lit(None).cast("int").alias("page_number"),
        (F.lit(None) if level is None else level).cast("int").alias("level"),
        (F.lit(None) if language is None else language).cast("string").alias("language"),
        (F.lit(None) if ordered is None else ordered).cast("boolean").alias("ordered"),
        (F.lit(True) if is_quote else F.lit(None).cast("boolean")).alias("is_quote"),
        (no_row if headers is None else headers).alias("headers"),
        (F.lit(None).cast("array<array<string>>") if rows is None else rows).alias("table_rows"),
    )


def _heading(raw: Column) -> Column:
    body = F.regexp_extract(raw, r"^ {0,3}#{1,6}(?:[ \t]+(.*))?$", 1)
    body = _sub(body, r"(?:\A|[ \t]+)#+[ \t]*\z", "")
    level = F.length(F.regexp_extract(raw, r"^ {0,3}(#{1,6})", 1))
    return _block("heading", strip(body), level=level)


def _setext(raw: Column) -> Column:
    lines = F.split(raw, "\n")
    mark = strip(F.get(lines, F.size(lines) - 1))
    text = join_lines(F.slice(lines, 1, F.size(lines) - 1))
    return _block("heading", text, level=F.when(mark.startswith("="), 1).otherwise(2))


def _fenced(raw: Column) -> Column:
    opening = F.substring_index(raw, "\n", 1)
    closing = F.substring_index(raw, "\n", -1)
    info = strip(F.regexp_extract(opening, r"\A {0,3}(?:`{3,}|~{3,})(.*)", 1))
    start = F.length(opening) + 1
    closed = F.contains(raw, F.lit("\n")) & closing.rlike(r"\A {0,3}(?:`{3,}|~{3,})[ \t]*\z")
    inner = F.length(raw) - start - F.length(closing) - 1
    body = F.when(
        closed, F.substring(raw, start + 1, F.greatest(inner, F.lit(0)))
    ).otherwise(_sub(F.substring(raw, start + 1, F.length(raw)), r"\n\z", ""))
    return _block("code", body, language=F.coalesce(F.nullif(info, F.lit("")), F.lit("unknown")))


def _indented(raw: Column) -> Column:
    body = F.rtrim(_sub(raw, r"(?dm)^(?: {4}| {0,3}\t)", ""), F.lit(" \t\n"))
    return _block("code", body, language=F.lit("unknown"))


def _item(raw: Column) -> Column:
    indent = F.length(F.replace(F.regexp_extract(raw, r"\A([ \t]*)", 1), F.lit("\t"), F.lit("    ")))
    body = _sub(raw, r"\A[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+", "")
    return _block(
        "list_item",
        joined_text(body),
        level=F.floor(indent / 2) + 1,
        ordered=raw.rlike(r"\A[ \t]*\d"),
    )


def _quote(raw: Column) -> Column:
    lines = F.split(_sub(raw, r"(?dm)^ {0,3}> ?", ""), "\n")
    filled = F.filter(lines, lambda x: strip(x) != "")
    return _block("paragraph", join_lines(filled), is_quote=True)


def table_block(raw: Column) -> Column:
    def build(lines: Column) -> Column:
        headers = table_cells(F.get(lines, F.lit(0)))
        body = F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0)))

        def filled(head: Column) -> Column:
            rows = F.transform(body, lambda x: _fit(table_cells(x), F.size(head)))
            return let(
                rows,
                lambda rs: _block("table", table_text(head, rs), headers=head, rows=rs),
            )

        return let(headers, filled)

    return let(F.split(raw, "\n"), build)


def _paragraph(raw: Column) -> Column:
    return _block("paragraph", joined_text(raw))


def markdown_blocks(text: Column) -> Column:
    """``array<struct<block_type, text, ..., headers, table_rows>>`` in document order."""
    unix = F.when(
        F.contains(text, F.lit("\r")), F.regexp_replace(text, F.lit(r"\r\n?"), F.lit("\n"))
    ).otherwise(text)
    raws = F.regexp_extract_all(unix, F.lit(BLOCKS), F.lit(0))

    def label(raw: Column) -> Column:
        return (
            F.when(_starts(raw, ANY_FENCE), _fenced(raw))
            .when(_starts(raw, HEADING), _heading(raw))
            .when(_starts(raw, RULE), F.lit(None))
            .when(_starts(raw, TABLE_START), table_block(raw))
            .when(_starts(raw, ITEM), _item(raw))
            .when(_starts(raw, QUOTE), _quote(raw))
            .when(_starts(raw, INDENTED), _indented(raw))
            .when(raw.rlike(rf"(?dm)\n{UNDERLINE}\z"), _setext(raw))
            .otherwise(_paragraph(raw))
        )

    def read(block: Column) -> Column:
        verbatim = block["block_type"].isin("code", "table")
        text = F.when(verbatim, block["text"]).otherwise(inline_text(block["text"]))
        return block.withField("text", text)

    blocks = F.transform(F.filter(F.transform(raws, label), lambda b: b.isNotNull()), read)
    return F.filter(
        blocks, lambda b: (b["block_type"] != "paragraph") | (strip(b["text"]) != "")
    )
