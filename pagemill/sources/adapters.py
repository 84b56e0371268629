"""The given tables in the shapes the operators read.

Each adapter is a projection, or an aggregation where rows must be numbered; it
keeps every row of its table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.encoding import any_charset
from pagemill.functions.encoding import any_charset
from pagemill.functions.text import let, strip
from pagemill.operators.prompts import PRESETS
from pagemill.sources.tables import read_table, shared_folder, spread, write_files

NEW_LINE = "\n"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))


def lines(docs: DataFrame) -> DataFrame:
    """Lines of each document, numbered from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", NEW_LINE)).alias("line_no", "line"))


def markdown_text() -> Column:
    """A document as Markdown: its lines as paragraphs, then one block of each kind."""
    first = F.get(F.split("text", NEW_LINE), F.lit(0))
    doc_id = F.col("doc_id").cast("string")
    return F.concat(
        F.lit("# Source **"), F.col("source"), F.lit("**\n\n"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")),
        F.lit("\n\n## Extract `"), F.col("lang"), F.lit("`\n\n```"), F.col("lang"), F.lit("\n"),
        F.col("text"), F.lit("\n```\n\n- doc "), doc_id, F.lit("\n- *lang* "), F.col("lang"),
        F.lit("\n  1. nested [link](http://example.com/"), doc_id, F.lit(")\n\n> "), first,
        F.lit("\n> quoted\n\n***\n\n| key | value |\n|-----|:-----:|\n| doc | "), doc_id,
        F.lit(" |\n| lang | "), F.col("lang"), F.lit(" |\n"),
    )


def misread_spans(spans: DataFrame) -> DataFrame:
    """Titles of which two pages in three have a letter more or less."""
    page = F.col("page_number") % 3
    title = F.when(page == 1, F.replace("text", F.lit("Report "), F.lit("Reports "))).when(page == 2, F.replace("text", F.lit("Report "), F.lit("Rport ")))
    return spans.withColumn("text", F.when(F.col("seq") == 0, F.coalesce(title, "text")).otherwise(F.col("text")))


# Letters that stand for a to z in files of each character set: frequent ones of its language.
ALPHABETS = {
    "GBK": "的一是不了人我在有他这中大来上个国到说们为子和你地出",
    "Big5": "的一是不了人我在有他這中大來上個國到說們為子和你地出",
    "Shift_JIS": "のにはをたがでてとしれさいるなあもっかけことまりすき",
    "EUC-KR": "이다는을에의가고하지한로기사도어리은아나인그자시대서",
}
LATIN1 = "ISO-8859-1"


def recoded_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a file of every set: (doc_id, charset, written, content).

    Its letters become letters of the set; what the set lacks is left out. In Latin-1 it is
    itself, and only there if it has a letter beyond ASCII and none beyond the set.
    """
    docs = documents(spark, folder).select("doc_id", "text")
    out = None
    with any_charset(spark):
        for charset, letters in ALPHABETS.items():
            # What the set lacks goes first, so that bytes below 128 are passed over without a look at the letters.
            kept = F.regexp_replace(F.lower("text"), f"[^\\x00-\\x7f](?<![{letters}])", "")
            text = F.translate(kept, "abcdefghijklmnopqrstuvwxyz", letters)
            lettered = docs.filter(F.lower("text").rlike(f"[a-z{letters}]"))  # those that keep a letter, told before it is replaced
            part = lettered.select("doc_id", F.lit(charset).alias("charset"), text.alias("written")).withColumn("content", F.encode("written", charset))
            out = part if out is None else out.unionByName(part)
        plain = docs.filter(F.col("text").rlike(r"[\xa0-\xff]") & ~F.col("text").rlike(r"[^\x00-\xff]"))
        latin = plain.select("doc_id", F.lit(LATIN1).alias("charset"), F.col("text").alias("written"), F.encode("text", LATIN1).alias("content"))
        return out.unionByName(latin)


def broken_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each source's pages as blocks; every second page stops inside a sentence, every third begins in one."""
    page, text = F.col("page_number"), F.col("text")
    end = F.when(page % 2 == 0, F.regexp_replace(text, "[^\\p{L}]+$", "")).otherwise(text)
    end = F.when(page % 4 == 0, F.concat(end, F.lit("-"))).otherwise(end)
    begin = F.when(page % 3 == 0, F.concat(F.lower(F.substring("text", 1, 1)), F.substring("text", 2, 2**30))).otherwise(F.col("text"))
    pages = source_pages(spark, folder).filter(page >= 0).withColumn("text", end).withColumn("text", begin)
    lines = F.filter(F.transform(F.split("text", NEW_LINE), strip), lambda x: x != "")
    return pages.select("doc_id", "page_number", F.posexplode(lines).alias("position", "text")).withColumn("block_type", F.lit("paragraph"))


def nested_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of every document, as letters and blanks, inside nested containers: six shapes in turn."""
    line = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L} ]", ""), " +", " "))
    lines = F.filter(F.transform(F.split("text", "\n"), line), lambda x: x != "")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    def unit(t: Column, i: Column) -> Column:
        label = F.concat(F.lit("r"), i.cast("string"))
        return (
            F.when(i % 6 == 0, t)
            .when(i % 6 == 1, say("> ", t, "\nand on"))
            .when(i % 6 == 2, say("> - ", t, "\n>   - deeper ", t, "\n>\n>   then ", t))
            .when(i % 6 == 3, say("1. ", t, "\n\n   ~~~sql\n   ", t, "\n\n     more\n   ~~~\n   > said ", t))
            .when(i % 6 == 4, say("[", label, "]: http://x.y/", label, "\n\n[", t, "][", label, "] and [", label, "]"))
            .otherwise(say("> > ", t, "\n> # ", t))
        )

    text = F.array_join(F.transform(lines, unit), "\n\n")
    return documents(spark, folder).select("doc_id", text.alias("text"))


def markdown_documents(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", markdown_text().alias("text"))


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: the language decides the type, odd ids hold a stray byte."""
    suffix = (
        F.when(F.col("lang") == "en", ".txt")
        .when(F.col("lang") == "fr", ".md")
        .when(F.col("lang") == "de", ".TXT")
        .otherwise(".csv")
    )
    stray = F.when(F.col("doc_id") % 2 == 1, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(F.col("text").cast("binary"), stray)
    return documents(spark, folder).select(
        "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), suffix).alias("filename"),
        content.alias("content"),
        F.octet_length(content).cast("bigint").alias("length"),
    )


def encoded_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as bytes: plain, with a mark, in GBK with two characters before it, or in UTF-16."""
    docs = documents(spark, folder)
    text, turn = F.col("text"), F.col("doc_id") % 4
    narrow = F.length("text") == F.octet_length("text")
    with any_charset(spark):
        content = (
            F.when(turn == 0, F.concat(F.unhex(F.lit("EFBBBF")), text.cast("binary")))
            .when(turn == 2, text.cast("binary"))
            .when(narrow, F.encode(F.concat(F.lit("编码"), text), "GBK"))
            .otherwise(F.encode(text, "UTF-16"))
        )
        return docs.select("doc_id", content.alias("content"))


def document_files(spark: SparkSession, folder: str) -> str:
    """A folder with one text file per document, under a folder named by its id."""
    path = shared_folder(spark, "files")
    write_files(read_table(spark, folder, "documents").select("doc_id", "text"), path)
    return path


BROKEN = "cut off"  # what the one broken file of pages begins with


def page_files(spark: SparkSession, folder: str) -> str:
    """A folder with one file per web page, under a folder named by its id; the page of the largest id is broken."""
    path = shared_folder(spark, "pages")
    pages = read_table(spark, folder, "pages").select("page_id", "html")
    last = pages.agg(F.max("page_id").alias("_last"))  # one row, so that no task gets all pages
    html = F.when(F.col("page_id") == F.col("_last"), F.concat(F.lit(BROKEN), "html")).otherwise(F.col("html"))
    write_files(pages.crossJoin(F.broadcast(last)).select("page_id", html.alias("html")), path)
    return path


def html_paragraphs(name: str, content: bytes) -> list[tuple[str, str, None]]:
    """A parser of the paragraphs of a web page, without marks inside them."""
    text = content.decode()
    if text.startswith(BROKEN):
        raise ValueError("not a page")
    return [("paragraph", re.sub("<[^>]*>", "", p), None) for p in re.findall(r"(?s)<p>(.*?)</p>", text)]


def web_files(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as files named by their address, without the query part."""
    return spread(read_table(spark, folder, "pages").select(
        "page_id",
        F.regexp_replace("url", F.lit(r"[?#].*$"), F.lit("")).alias("filename"),
        F.octet_length("html").cast("bigint").alias("length"),
    ))


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as catalog rows."""
    p = F.col("o_orderpriority")
    suffix = (
        F.when(p == "1-URGENT", ".pdf")
        .when(p == "2-HIGH", ".md")
        .when(p == "3-MEDIUM", ".txt")
        .when(p == "4-NOT SPECIFIED", ".csv")
        .otherwise(".json")
    )
    s = F.col("o_orderstatus")
    status = F.when(s == "O", "uploaded").when(s == "P", "parsing").otherwise("ready")
    key = F.col("o_orderkey").cast("string")
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lower(p), F.lit("_"), key, suffix).alias("filename"),
        suffix.alias("file_type"),
        F.round(F.col("o_totalprice") * 100, 0).cast("bigint").alias("file_size"),
        F.concat(F.date_format("o_orderdate", "'uploads/'yyyy/MM'/doc-'"), key, suffix).alias("storage_path"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.col("c_mktsegment").alias("segment"),
    )


def catalog_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as chunks of the catalog's documents."""
    return read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_linenumber").alias("chunk_index"),
        F.col("l_quantity").cast("int").alias("token_count"),
    )


def access_log_of(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("doc_id"),
        "user_id",
        "event_type",
        "ts",
    )


def access_log(spark: SparkSession, folder: str) -> DataFrame:
    return access_log_of(read_table(spark, folder, "events"))


def source_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each source as one paged document; its documents are the pages, by their id.

    Every seventh has an empty page of its own as well, as scanned ones are.
    """
    docs = documents(spark, folder)
    empty = docs.filter(F.col("doc_id") % 7 == 0).withColumns({"doc_id": -F.col("doc_id") - 1, "text": F.lit("")})
    return docs.unionByName(empty).select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), "text", "lang"
    )


def page_spans(pages: DataFrame) -> DataFrame:
    """Placed lines: a title at the top, the text between, a footer at the bottom.

    Pages without text have no spans.
    """
    page = F.col("page_number").cast("string")
    def span(seq: Column, text: Column, y0: Column) -> Column:
        return F.struct(
            seq.cast("bigint").alias("seq"), text.alias("text"), y0.cast("double").alias("y0")
        )

    title = F.concat(F.lit("Report "), F.col("doc_id"), F.lit("  page "), page)
    footer = F.concat(F.lit(" "), F.col("lang"), F.lit(" edition - "), page, F.lit(" "))

    def place(body: Column) -> Column:
        count = F.size(body)
        return F.concat(
            F.array(span(F.lit(0), title, F.lit(0.0))),
            F.transform(body, lambda x, i: span(i + 1, x, i * 600.0 / count + 200)),
            F.array(span(count + 1, footer, F.lit(1000.0))),
        )

    placed = let(F.split("text", NEW_LINE), place)
    return (
        pages.filter(strip(F.col("text")) != "")
        .select("doc_id", "page_number", F.explode(placed).alias("s"))
        .select("doc_id", "page_number", "s.*")
    )


def line_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each line as a page: its text, a page size, and none to two images."""
    page = F.col("page_number")
    w = F.pmod(F.col("doc_id") * 7 + page * 13, F.lit(600)).cast("double")
    h = F.pmod(F.col("doc_id") * 11 + page * 5, F.lit(800)).cast("double")
    image = F.struct(
        F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), w.alias("x1"), h.alias("y1")
    )
    count = F.pmod(F.col("doc_id") + page, F.lit(3)).cast("int")
    split = lines(documents(spark, folder)).select(
        "doc_id", (F.col("line_no") + 1).alias("page_number"), F.col("line").alias("text")
    )
    return split.withColumns(
        {
            "text_len": F.length(F.btrim("text")),
            "width": F.lit(600.0),
            "height": F.lit(800.0),
            "images": F.array_repeat(image, count),
        }
    )


def raw_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A table per document on its first page: the words of each line."""
    return documents(spark, folder).select(
        "doc_id",
        F.lit(1).alias("page_number"),
        F.lit(1).alias("table_no"),
        F.transform(F.split("text", NEW_LINE), lambda x: F.split(x, " ")).alias("cells"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    thought = F.when(
        F.col("role") == "assistant", F.concat(F.lit("weighed turn "), F.col("turn").cast("string"))
    )
    return read_table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content"), thought.alias("reasoning_content")
    )


def chat_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Each message as a session whose lines are its messages."""
    listed = F.transform(
        F.split("text", NEW_LINE),
        lambda x, i: F.struct(
            F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"),
            x.alias("content"),
            F.concat(F.lit("2026-01-01T00:00:"), F.lpad(F.pmod(i, F.lit(60)).cast("string"), 2, "0"), F.lit("Z")).alias("timestamp"),
        ),
    )
    return read_table(spark, folder, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.to_json(listed).alias("messages"),
    )


def stored_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns as stored completions, of the turn before, with the templates in turn.

    Some leave out the finish reason, the model or the reasoning.
    """
    turn, size = F.col("turn"), F.length("text")
    names = F.array(*[F.lit(t.name) for t in PRESETS])
    choice = F.struct(
        F.struct(
            F.col("text").alias("content"),
            F.when(turn % 3 == 0, F.lit("thought")).alias("reasoning_content"),
        ).alias("message"),
        F.when(turn % 4 == 1, F.lit("length")).alias("finish_reason"),
    )
    raw = F.to_json(
        F.struct(
            F.when(F.col("conv_id") % 2 == 0, F.lit("model-a")).alias("model"),
            F.array(choice).alias("choices"),
            F.struct(
                size.alias("prompt_tokens"),
                F.when(turn % 5 != 3, size * 2).alias("completion_tokens"),
                (size * 3).alias("total_tokens"),
            ).alias("usage"),
        )
    )
    return read_table(spark, folder, "conversations").filter(F.col("role") == "assistant").select(
        _input_id(F.col("conv_id"), turn - 1).alias("input_id"),
        F.get(names, F.pmod(F.col("conv_id") + F.floor(turn / 2), F.lit(len(PRESETS))).cast("int")).alias("prompt_name"),
        turn.alias("run_no"),
        raw.alias("raw"),
        (size * 1.23456).alias("latency_ms"),
    )


def damaged_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Stored responses of which some are cut short, missing or without an answer."""
    n = F.col("run_no")
    raw = (
        F.when(n % 4 == 1, F.substring("raw", 1, 10))
        .when(n % 8 == 3, F.lit(None))
        .when(n % 8 == 7, F.lit('{"choices": []}'))
        .otherwise(F.col("raw"))
    )
    return stored_responses(spark, folder).withColumn("raw", raw)


def _input_id(conversation: Column, turn: Column) -> Column:
    return F.concat_ws("-", conversation.cast("string"), turn.cast("string"))


def experiment_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Every user message as an input, named by its conversation and turn."""
    asked = read_table(spark, folder, "conversations").filter(F.col("role") == "user")
    return asked.select(_input_id(F.col("conv_id"), F.col("turn")).alias("input_id"), "text")
