"""One query per operator over the given tables.

Every query reads whole tables. ``QUERIES`` maps a name to a function of the
session and the folder of the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.constants import HOT_TOP_N, ChunkingConfig
from pagemill.functions import text as tx
from pagemill.functions.encoding import decode_cursor, decode_detected, decode_text, encode_cursor
from pagemill.functions.pages import image_ratio
from pagemill.operators import blocks as bl
from pagemill.operators import catalog as ct
from pagemill.operators import cells as cl
from pagemill.operators import chunking as ch
from pagemill.operators import conversations as cv
from pagemill.operators import crossing as cr
from pagemill.operators import frequent as fr
from pagemill.operators import mutations as mu
from pagemill.operators import pages as pg
from pagemill.operators import prompts as pr
from pagemill.operators import quality as ql
from pagemill.operators import ranking as rk
from pagemill.operators import repeated as rp
from pagemill.operators import totals as to
from pagemill.operators import variants as va
from pagemill.operators import vectors as vc
from pagemill.plans import deep_listing as dl
from pagemill.plans import detect as dp
from pagemill.plans import experiment as ex
from pagemill.plans import ingest as ig
from pagemill.plans import listing as ls
from pagemill.plans import paged as pd
from pagemill.sources import adapters as ad
from pagemill.sources import files as fs
from pagemill.sources import keyed as ky
from pagemill.sources import parsed as pf
from pagemill.sources import tables as tb
from pagemill.streaming import jobs as sj
from pagemill.streaming import versions as vs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

USER = 7  # the owner whose catalog the single-user queries list
SKETCH_ITEMS = 64
HOT_RANGES = {
    "all": ("2024-01-01 00:00:00", "2024-02-01 00:00:00"),
    "week": ("2024-01-08 00:00:00", "2024-01-15 00:00:00"),
    "morning": ("2024-01-20 06:00:00", "2024-01-20 12:00:00"),
}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _chunkable(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their paragraphs as blocks."""
    docs = ad.documents(spark, folder)
    return docs.select("doc_id", bl.text_block_array(F.col("text")).alias("blocks"))


def _paragraphs_of_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with every line as a paragraph, so that short ones occur."""
    docs = ad.documents(spark, folder)
    spaced = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return docs.select("doc_id", bl.text_block_array(spaced).alias("blocks"))


# --- files ------------------------------------------------------------------


def _document_of(path: Column) -> Column:
    return F.regexp_extract(path, "doc_id=([0-9]+)", 1).cast("bigint").alias("doc_id")


@query
def scan_files(spark, folder):
    """One file per document, scanned; those over the upload limit come without their bytes."""
    files = fs.scan_files(spark, ad.document_files(spark, folder))
    admitted = fs.admit_files(files)
    return admitted.select(
        _document_of(F.col("path")), "file_type", "length", F.sha2("content", 256).alias("content_hash"), "reject_reason"
    )


@query
def file_type(spark, folder):
    files = ad.web_files(spark, folder)
    return files.select("page_id", tx.file_type(F.col("filename")).alias("file_type"))


@query
def admit_files(spark, folder):
    return fs.admit_files(ad.text_files(spark, folder)).select("doc_id", "file_type", "reject_reason")


@query
def admit_web_files(spark, folder):
    return fs.admit_files(ad.web_files(spark, folder)).select("page_id", "file_type", "reject_reason")


@query
def storage_paths(spark, folder):
    cat = ad.catalog(spark, folder).drop("file_type", "storage_path")
    key = F.concat_ws("|", F.col("user_id").cast("string"), F.col("filename"))
    return fs.storage_columns(cat, key=key, stored_at=F.col("created_at")).select("id", "file_type", "storage_path")


@query
def save_partitioned(spark, folder):
    path = tb.shared_folder(spark, "catalog")
    tb.write_by_month(ad.catalog(spark, folder), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))


@query
def save_files(spark, folder):
    path = tb.shared_folder(spark, "files")
    files = ad.text_files(spark, folder).drop("length")
    fs.save_files(files, path, key=F.col("filename"), stored_at=F.lit("2026-08-03").cast("timestamp_ntz"))
    labelled = tb.read_table(spark, folder, "labels").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename")
    )
    wanted = fs.storage_columns(labelled, key=F.col("filename"), stored_at=F.lit("2026-08-03").cast("timestamp_ntz"))
    return fs.read_saved(spark, path, wanted).select(
        "doc_id", "storage_path", "file_size", F.sha2("content", 256).alias("content_hash"), "year", "month"
    )


@query
def catalog_rows(spark, folder):
    at = F.lit("2026-08-03").cast("timestamp_ntz")
    rows = ig.catalog_rows(ad.text_files(spark, folder), key=F.col("filename"), user_id=F.col("doc_id") % 10, stored_at=at)
    return rows.drop("created_at", "updated_at")


@query
def write_documents(spark, folder):
    path = tb.shared_folder(spark, "documents")
    catalog = ad.catalog(spark, folder).withColumn("status", F.nullif("status", F.lit("uploaded")))
    tb.write_documents(catalog.filter(F.col("id") % 2 == 0).withColumn("status", F.lit("parsing")), path)
    tb.write_documents(catalog, path)  # puts the first rows right
    return spark.read.parquet(path).select("id", "filename", "status", tx.iso_micros(F.col("created_at")).alias("created_at"))


@query
def write_chunks(spark, folder):
    path = tb.shared_folder(spark, "chunks")
    chunks = ch.chunk_rows(_chunkable(spark, folder))
    for _ in range(2):  # ingesting again changes nothing
        tb.write_chunks(chunks, path)
    return spark.read.parquet(path).select("document_id", "chunk_index", "chunk_hash", "token_count")


@query
def upsert_documents(spark, folder):
    """All rows, then new states of some and the removal of others, then the rows left, read after a compaction."""
    table = ky.KeyedTable(spark, tb.shared_folder(spark, "documents"), "id")
    catalog = ad.catalog(spark, folder)
    table.write(catalog.withColumn("status", F.lit("parsing")))
    table.write(catalog.filter(F.col("id") % 7 != 0))
    table.compact()
    failed = catalog.filter(F.col("id") % 7 == 0).withColumn("status", F.lit("failed"))
    for _ in range(2):  # a retried batch changes nothing
        table.write(failed, gone=catalog.filter(F.col("id") % 11 == 0).select("id"), name="batch-1")
    table.write(catalog.limit(0), gone=failed.filter(F.col("id") % 3 == 0).select("id"))
    return table.read().select("id", "filename", "status", tx.iso_micros(F.col("created_at")).alias("created_at"))


@query
def upsert_chunks(spark, folder):
    """Chunks of documents, some of which are parsed again to fewer chunks and some to none."""
    table = ky.KeyedTable(spark, tb.shared_folder(spark, "chunks"), "document_id")
    chunks = ch.chunk_rows(_chunkable(spark, folder))
    table.write(chunks)
    again = F.col("document_id") % 3 == 0
    first = chunks.filter(again & (F.col("document_id") % 2 == 0) & (F.col("chunk_index") == 0))
    table.write(first, gone=chunks.filter(again).select("document_id"))
    return table.read().select("document_id", "chunk_index", "chunk_hash", "token_count")


@query
def write_report(spark, folder):
    path = tb.shared_folder(spark, "report")
    results = ex.run_experiment(ad.experiment_inputs(spark, folder), ad.stored_responses(spark, folder))
    tb.write_report(results, path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query
def stream_files(spark, folder):
    path, checkpoint = tb.shared_folder(spark, "names"), tb.shared_folder(spark, "checkpoint")
    files = fs.stream_files(spark, ad.document_files(spark, folder)).select(
        _document_of(F.col("path")), "length", tx.file_type(F.col("filename")).alias("file_type"),
        F.sha2("content", 256).alias("content_hash"),
    )
    sj.append_to(files, path, checkpoint).awaitTermination()
    return spark.read.parquet(path)


@query
def route_by_type(spark, folder):
    files = fs.admit_files(ad.text_files(spark, folder))

    def text_parser(part: DataFrame) -> DataFrame:
        return bl.split_paragraphs(decode_text(part))

    def md_parser(part: DataFrame) -> DataFrame:
        return bl.md_blocks(decode_text(part)).select("doc_id", "position", "text")

    blocks, unsupported = fs.route_by_type(files, {".txt": text_parser, ".md": md_parser})
    counted = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    rejected = unsupported.select("doc_id", F.lit(0).cast("bigint").alias("blocks"), "error")
    return counted.unionByName(rejected, allowMissingColumns=True)


@query
def parsed_files(spark, folder):
    """The paragraphs of files of web pages, through a parser plug-in; one file is broken."""
    pf.register_parsers(spark, {".txt": ad.html_paragraphs})
    blocks = spark.read.format(pf.NAME).option("packedBytes", 100_000).load(ad.page_files(spark, folder))
    page = F.regexp_extract("path", r"page_id=(\d+)/", 1).cast("bigint")
    return blocks.filter(F.col("file_type") == ".txt").select(page.alias("page_id"), "position", "block_type", "text", "error")


@query
def isolate_failures(spark, folder):
    parsed = ig.parse_files(ad.text_files(spark, folder))
    return parsed.select("doc_id", "file_type", "encoding", "status", "replacement_chars", F.size("blocks").alias("blocks"))


# --- catalog ----------------------------------------------------------------


def _public(rows: DataFrame) -> DataFrame:
    return rows.select("id", "user_id", "filename", "status", tx.iso_micros(F.col("created_at")).alias("created_at"))


@query
def get_by_id(spark, folder):
    return _public(ct.get_by_id(ad.catalog(spark, folder), 42))


@query
def get_by_ids(spark, folder):
    labelled = tb.read_table(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    return _public(ct.get_by_ids(ad.catalog(spark, folder), labelled))


@query
def get_by_id_list(spark, folder):
    return _public(ct.get_by_ids(ad.catalog(spark, folder), [3, 5, 8, 13, 21, 34]))


@query
def filter_keyword(spark, folder):
    return _public(ct.catalog_search(ad.catalog(spark, folder), keyword="URG_NT%7"))


@query
def filter_status(spark, folder):
    return _public(ct.catalog_search(ad.catalog(spark, folder), status="parsing"))


@query
def filter_file_type(spark, folder):
    return _public(ct.catalog_search(ad.catalog(spark, folder), file_type=".md"))


@query
def catalog_search(spark, folder):
    return _public(
        ct.catalog_search(
            ad.catalog(spark, folder), keyword="high_1", status="ready", file_type=".md"
        )
    )


@query
def keyset_after(spark, folder):
    at = F.lit("1998-01-01").cast("timestamp_ntz")
    return _public(ct.keyset_after(ad.catalog(spark, folder), at, F.lit(5000).cast("bigint")))


@query
def keyset_page(spark, folder):
    return _public(ct.keyset_page(ad.catalog(spark, folder), status="ready", page_size=50))


@query
def keyset_page_info(spark, folder):
    return ct.keyset_page_info(ad.catalog(spark, folder), status="ready", page_size=50)


@query
def keyset_second_page(spark, folder):
    cat = ad.catalog(spark, folder)
    cursor = ct.keyset_page_info(cat, status="ready", page_size=50).first()["next_cursor"]
    return _public(ct.keyset_page(cat, cursor=cursor, status="ready", page_size=50))


@query
def encode_cursor_round_trip(spark, folder):
    events = tb.read_table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    packed = events.withColumn("cursor", encode_cursor(F.col("created_at"), F.col("id")))
    back = packed.withColumn("key", decode_cursor(F.col("cursor")))
    return back.select(
        "id", "cursor", F.col("key.created_at").alias("created_at"), F.col("key.id").cast("bigint").alias("decoded_id")
    )


@query
def list_documents(spark, folder):
    listing = ls.list_documents(ad.catalog(spark, folder), USER, page_size=5, status="ready")
    return listing.items.drop("updated_at", "storage_path").select(
        "*",
        listing.totals.select("total").scalar().alias("total"),
        listing.totals.select("filtered_total").scalar().alias("filtered_total"),
        listing.totals.select("total_pages").scalar().alias("total_pages"),
        listing.info.select("has_more").scalar().alias("has_more"),
        listing.info.select("next_cursor").scalar().alias("next_cursor"),
    )


@query
def sorted_listing(spark, folder):
    return _public(
        ct.sorted_listing(ad.catalog(spark, folder), sort_by="file_size", sort_order="asc", page=2, page_size=100)
    )


@query
def offset_page(spark, folder):
    return _public(ct.offset_page(ad.catalog(spark, folder), page=3, page_size=20, file_type=".pdf"))


@query
def deep_page(spark, folder):
    """A page far down the listing of files by size, from boundary rows a thousand places apart."""
    catalog = ad.catalog(spark, folder)
    bounds = tb.stored(dl.boundaries(catalog, sort_by="file_size", sort_order="desc", step=1000), "boundaries")
    return _public(dl.deep_page(catalog, bounds, sort_by="file_size", sort_order="desc", page=14, page_size=100))


@query
def document_info(spark, folder):
    return ct.document_info(ad.catalog(spark, folder))


@query
def document_response(spark, folder):
    return ct.document_response(ad.catalog(spark, folder))


@query
def typed_from_strings(spark, folder):
    packed = ct.to_strings(ad.catalog(spark, folder))
    broken = F.when(
        F.col("fields")["file_type"] == ".json",
        F.map_concat(F.map_filter("fields", lambda k, v: k != "file_size"), F.create_map(F.lit("file_size"), F.lit("n/a"))),
    ).otherwise(F.col("fields"))
    typed = ct.typed_from_strings(packed.withColumn("fields", broken))
    return typed.select(
        "id", "file_size", "status", tx.iso_micros(F.col("created_at")).alias("created_at"), "reject_reason"
    )


@query
def count_where(spark, folder):
    return ct.count_where(ad.catalog(spark, folder), F.col("file_size") > 20_000_000)


@query
def count_by_status(spark, folder):
    return ct.count_by_status(ad.catalog(spark, folder))


@query
def count_by_status_user(spark, folder):
    return ct.count_by_status(ad.catalog(spark, folder), USER)


@query
def catalog_totals(spark, folder):
    return ct.catalog_totals(ad.catalog(spark, folder), matching=ct.catalog_filter(status="ready"))


@query
def maintained_totals(spark, folder):
    """Totals per owner and status after inserts, updates and deletes, none of which read the whole catalog."""
    table = ky.KeyedTable(spark, tb.shared_folder(spark, "documents"), "id")
    totals = to.Totals(table, tb.shared_folder(spark, "totals"), ["user_id", "status"], {"bytes": F.col("file_size")})
    catalog = ad.catalog(spark, folder).select("id", "user_id", "status", "file_size")
    totals.write(catalog.filter(F.col("id") % 5 != 0), name="first")
    totals.write(catalog.filter(F.col("id") % 5 == 0).withColumn("status", F.lit("uploaded")), name="second")
    table.compact()
    failed = catalog.filter(F.col("id") % 7 == 0).withColumn("status", F.lit("failed"))
    for _ in range(2):  # a retried batch changes nothing
        totals.write(failed, gone=catalog.filter(F.col("id") % 11 == 0).select("id"), name="third")
    totals.fold("fold-1")
    totals.write(catalog.limit(0), gone=failed.filter(F.col("id") % 3 == 0).select("id"), name="fourth")
    return totals.read()


@query
def owner_lookup(spark, folder):
    owners = ad.users(spark, folder).select(F.col("id").alias("user_id"), "username")
    return ad.catalog(spark, folder).join(owners, "user_id").select("id", "username", "filename")


# --- text -------------------------------------------------------------------


@query
def is_blank_text(spark, folder):
    rows = ad.lines(ad.documents(spark, folder))
    return rows.select("doc_id", "line_no", tx.is_blank_text(F.col("line")).alias("is_blank"))


@query
def is_noise(spark, folder):
    rows = ad.lines(ad.documents(spark, folder))
    damaged = F.translate("line", "etaoins", "\x01" * 7)
    return rows.select("doc_id", "line_no", tx.is_noise(damaged).alias("is_noise"))


@query
def decode_text_files(spark, folder):
    decoded = decode_text(ad.encoded_files(spark, folder))
    return decoded.select("doc_id", "encoding", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_hash"))


@query
def garbled_warning(spark, folder):
    damaged = F.translate("text", "h", "�")
    return ad.documents(spark, folder).select("doc_id", tx.garbled_warning(damaged).alias("warning"))


@query
def charset_of_files(spark, folder):
    """Documents written in five character sets, read without being told which."""
    read = decode_detected(ad.recoded_files(spark, folder))
    return read.select("doc_id", "charset", "encoding", (F.col("text") == F.col("written")).alias("same_text"))


@query
def text_stats(spark, folder):
    text = F.translate("text", "h", "�")
    return ad.documents(spark, folder).select(
        "doc_id",
        F.octet_length(text).alias("byte_size"),
        F.length(text).alias("char_count"),
        tx.replacement_count(text).alias("replacement_chars"),
    )


@query
def sanitize_text(spark, folder):
    dirty = F.translate("text", "wly", "\x07\x7f\x85")
    clean = tx.sanitize(dirty)
    return ad.documents(spark, folder).select("doc_id", F.length(clean).alias("chars"), F.sha2(clean, 256).alias("text_hash"))


@query
def split_paragraphs(spark, folder):
    docs = ad.documents(spark, folder).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n \n")))
    return bl.split_paragraphs(docs)


@query
def md_blocks(spark, folder):
    blocks = bl.md_blocks(ad.markdown_documents(spark, folder))
    return blocks.drop("headers", "table_rows")


@query
def md_nested_blocks(spark, folder):
    blocks = bl.md_nested_blocks(ad.nested_documents(spark, folder))
    return blocks.drop("headers", "table_rows")


@query
def md_tables(spark, folder):
    tables = bl.table_to_text(bl.md_tables(ad.markdown_documents(spark, folder)))
    return tables.select("doc_id", F.size("headers").alias("cols"), F.size("rows").alias("rows"), "text")


def _md_kind(spark: SparkSession, folder: str, kind: str, *columns: str) -> DataFrame:
    blocks = bl.md_blocks(ad.markdown_documents(spark, folder))
    return blocks.filter(F.col("block_type") == kind).select("doc_id", "position", "text", *columns)


@query
def md_heading(spark, folder):
    return _md_kind(spark, folder, "heading", "level")


@query
def md_code(spark, folder):
    return _md_kind(spark, folder, "code", "language")


@query
def md_list_item(spark, folder):
    return _md_kind(spark, folder, "list_item", "ordered", "level")


@query
def md_quote(spark, folder):
    return _md_kind(spark, folder, "paragraph", "is_quote").filter("is_quote").drop("is_quote")


@query
def parse_stats(spark, folder):
    return bl.parse_stats(bl.md_blocks(ad.markdown_documents(spark, folder)))


@query
def parse_warnings(spark, folder):
    parsed = ig.parse_files(
        ad.text_files(spark, folder).withColumn(
            "content", F.translate(F.col("content").cast("string"), "h", "�").cast("binary")
        )
    )
    return parsed.select("doc_id", F.explode("warnings").alias("warning"))


# --- pages ------------------------------------------------------------------


@query
def classify_pages(spark, folder):
    pages = pg.classify_pages(ad.line_pages(spark, folder))
    return pages.select("doc_id", "page_number", "image_count", "page_type")


@query
def image_ratio_of_pages(spark, folder):
    pages = ad.line_pages(spark, folder)
    ratio = image_ratio(F.col("images"), F.col("width"), F.col("height"))
    return pages.select("doc_id", "page_number", F.round(ratio, 10).alias("image_ratio"))


@query
def page_summary(spark, folder):
    return pg.page_summary(pg.classify_pages(ad.line_pages(spark, folder)))


@query
def ocr_placeholder(spark, folder):
    return pg.ocr_placeholders(pg.classify_pages(ad.line_pages(spark, folder)))


@query
def page_warnings(spark, folder):
    return pg.page_warnings(pg.classify_pages(ad.line_pages(spark, folder)))


@query
def split_paragraphs_page(spark, folder):
    return pg.split_paragraphs_page(ad.line_pages(spark, folder))


@query
def page_tables(spark, folder):
    return pg.tables_with_rows(pg.page_tables(ad.raw_tables(spark, folder))).select(
        "doc_id", "page_number", F.size("rows").alias("rows"), F.size("headers").alias("cols"), "text"
    )


@query
def table_warnings(spark, folder):
    return pg.table_warnings(pg.page_tables(ad.raw_tables(spark, folder)))


@query
def page_blocks(spark, folder):
    pages = pg.classify_pages(ad.line_pages(spark, folder))
    blocks = pg.page_blocks(pages, ad.line_pages(spark, folder), ad.raw_tables(spark, folder))
    return pg.number_blocks(blocks)


@query
def join_across_pages(spark, folder):
    return cr.join_across_pages(tb.stored(ad.broken_pages(spark, folder), "blocks"))


@query
def page_chunk_rows(spark, folder):
    pages = pg.classify_pages(ad.line_pages(spark, folder))
    rows = pd.page_chunk_rows(pd.paged_blocks(pages, ad.raw_tables(spark, folder)))
    return rows.select("document_id", "chunk_index", "chunk_hash", "token_count", "page_number")


@query
def parsed_documents(spark, folder):
    pages, tables = pg.classify_pages(ad.line_pages(spark, folder)), ad.raw_tables(spark, folder)
    record = pd.parsed_documents(pages, pd.paged_blocks(pages, tables), tables)
    return record.withColumns(
        {"n_warnings": F.size("warnings"), "warnings": F.sha2(F.array_join("warnings", "\n"), 256)}
    )


def _repeated(spark: SparkSession, folder: str) -> dp.Repeated:
    pages = ad.source_pages(spark, folder)
    return dp.detect(pages.select("doc_id", "page_number"), ad.page_spans(pages))


@query
def hf_guards(spark, folder):
    pages = ad.source_pages(spark, folder)
    return rp.hf_guards(pages.select("doc_id", "page_number"), ad.page_spans(pages))


@query
def hf_guard_warnings(spark, folder):
    pages = ad.source_pages(spark, folder)
    return rp.hf_guard_warnings(rp.hf_guards(pages.select("doc_id", "page_number"), ad.page_spans(pages)))


@query
def hf_regions(spark, folder):
    return rp.hf_regions(ad.page_spans(ad.source_pages(spark, folder)))


@query
def hf_normalize(spark, folder):
    rows = ad.lines(ad.documents(spark, folder))
    return rows.select("doc_id", "line_no", rp.normalize_region(F.col("line")).alias("norm"))


@query
def hf_groups(spark, folder):
    return rp.hf_groups(rp.hf_regions(ad.page_spans(ad.source_pages(spark, folder))))


def _misread_groups(spark: SparkSession, folder: str) -> DataFrame:
    return rp.hf_groups(rp.hf_regions(ad.misread_spans(ad.page_spans(ad.source_pages(spark, folder)))))


@query
def hf_variants(spark, folder):
    return va.hf_variants(_misread_groups(spark, folder)).drop("text", "first_page")


@query
def hf_similar_groups(spark, folder):
    return va.hf_similar_groups(va.hf_variants(_misread_groups(spark, folder)))


@query
def hf_similar_confirm(spark, folder):
    """Merged groups on at least half of the pages, where none of their variants may be."""
    pages = ad.source_pages(spark, folder)
    guards = rp.hf_guards(pages.select("doc_id", "page_number"), ad.page_spans(pages))
    return rp.hf_confirm(va.hf_similar_groups(va.hf_variants(_misread_groups(spark, folder))), guards)


@query
def hf_confirm(spark, folder):
    return rp.hf_order(_repeated(spark, folder).confirmed)


@query
def hf_page_ranges(spark, folder):
    return _repeated(spark, folder).ranges


@query
def hf_warnings(spark, folder):
    return _repeated(spark, folder).warnings


# --- chunks -----------------------------------------------------------------


@query
def split_long(spark, folder):
    docs = ad.documents(spark, folder).select(
        "doc_id",
        F.lit(0).alias("position"),
        F.lit("paragraph").alias("block_type"),
        "text",
        F.lit(None).cast("int").alias("page_number"),
        (F.col("lang") == "fr").alias("cross_page_boundary"),
    )
    parts = ch.split_long(docs)
    return parts.select(
        "doc_id", "part", "page_number_certain", "split_part", "split_total", "char_offset_start", "char_offset_end",
        F.sha2("text", 256).alias("text_hash"),
    )


@query
def merge_short(spark, folder):
    blocks = bl.md_blocks(ad.markdown_documents(spark, folder))
    parts = ch.split_long(blocks.withColumn("page_number", F.lit(None).cast("int")))
    merged = ch.merge_short(tb.stored(parts, "parts"))
    return merged.select(
        "doc_id", "position", "block_type", "merged_from", "merged_to", F.sha2("text", 256).alias("text_hash")
    )


@query
def chunk_blocks(spark, folder):
    docs = ad.markdown_documents(spark, folder)
    arrays = docs.select("doc_id", bl.markdown_block_array(F.col("text")).alias("blocks"))
    return ch.chunk_arrays(arrays).select(
        "doc_id", "position", "block_type", "split_part", "split_total", "char_offset_start",
        "char_offset_end", "merged_from", "merged_to", F.sha2("text", 256).alias("text_hash"),
    )


@query
def chunk_rows(spark, folder):
    return ch.chunk_rows(_chunkable(spark, folder)).drop("page_number")


@query
def chunk_rows_small(spark, folder):
    config = ChunkingConfig(max_chars=100, overlap_chars=20, merge_short_threshold=30)
    rows = ch.chunk_rows(_paragraphs_of_lines(spark, folder), config=config)
    return rows.select("document_id", "chunk_index", "chunk_hash", "token_count")


@query
def ingest_files(spark, folder):
    rows = ig.ingest(ad.text_files(spark, folder), doc_id="doc_id")
    return rows.groupBy("document_id").agg(
        F.count("*").alias("chunks"), F.sum("token_count").cast("bigint").alias("tokens")
    )


@query
def renumber(spark, folder):
    rows = bl.md_blocks(ad.markdown_documents(spark, folder)).filter(F.col("block_type") != "code")
    return ch.renumber(tb.stored(rows.select("doc_id", "position", "block_type"), "blocks"))


@query
def dedup_chunks(spark, folder):
    chunks = tb.stored(ch.chunk_rows(_paragraphs_of_lines(spark, folder)), "chunks")
    kept = ch.dedup_chunks(chunks)
    return kept.select("document_id", "chunk_index", "chunk_hash")


@query
def chunk_summary(spark, folder):
    return ch.chunk_summary(ch.chunk_rows(_paragraphs_of_lines(spark, folder)))


@query
def chunk_hash(spark, folder):
    rows = ad.lines(ad.documents(spark, folder))
    return rows.select("doc_id", "line_no", tx.text_hash(F.col("line")).alias("chunk_hash"))


@query
def status_flow(spark, folder):
    files = fs.admit_files(ad.text_files(spark, folder))
    uploaded = files.select(
        F.col("doc_id").cast("string").alias("id"), "filename", F.lit("uploaded").alias("status")
    )
    parsed = ig.parse_files(ad.text_files(spark, folder)).filter(
        (F.size("blocks") > 0) | (F.col("file_type") == ".csv") | (F.col("status") == "failed")
    )
    outcome = parsed.select(F.col("doc_id").cast("string").alias("id"), "status")
    return mu.update_rows(uploaded, outcome, columns=["status"])


@query
def token_estimate(spark, folder):
    rows = ad.lines(ad.documents(spark, folder))
    return rows.select("doc_id", "line_no", tx.token_estimate(F.col("line")).alias("token_count"))


# --- ranking and sessions ---------------------------------------------------


@query
def hot_counts(spark, folder):
    return rk.hot_counts(ad.access_log(spark, folder))


@query
def hot_top_n(spark, folder):
    return rk.hot_top_n(rk.hot_counts(ad.access_log(spark, folder)))


@query
def hot_remove(spark, folder):
    bad = tb.read_table(spark, folder, "labels").filter(F.col("toxic") == 1)
    return rk.hot_top_n(rk.hot_remove(rk.hot_counts(ad.access_log(spark, folder)), bad))


def _range(first: str, last: str) -> tuple[Column, Column]:
    return F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")


@query
def hot_sketches(spark, folder):
    """Hourly sketches that hold every document of an hour, as the counts in them."""
    parts = fr.sketches(ad.access_log(spark, folder), "doc_id")
    return parts.select(F.date_format("period", "yyyy-MM-dd HH").alias("period"), "total", "error", F.inline("items"))


@query
def hot_of_ranges(spark, folder):
    """The top documents of three ranges of hours, from one table of sketches of a few items each."""
    log = ad.access_log(spark, folder)
    parts = tb.stored(fr.sketches(log, "doc_id", capacity=SKETCH_ITEMS), "sketches")
    out = None
    for name, (start, end) in HOT_RANGES.items():
        top = fr.top_of_range(log, parts, *_range(start, end), HOT_TOP_N, "doc_id", capacity=SKETCH_ITEMS)
        part = top.select(F.lit(name).alias("range"), F.col("item").alias("doc_id"), "score")
        out = part if out is None else out.unionByName(part)
    return out


@query
def recent_access(spark, folder):
    recent = rk.recent_access(ad.access_log(spark, folder))
    return recent.select("user_id", "rank", "doc_id", tx.iso_micros(F.col("last_ts")).alias("last_ts"))


@query
def session_timeout(spark, folder):
    found = rk.sessions(ad.access_log(spark, folder))
    return found.select(
        "user_id", "session_no", tx.iso_micros(F.col("session_start")).alias("session_start"),
        tx.iso_micros(F.col("last_access")).alias("last_access"), "accesses",
    )


# --- tables -----------------------------------------------------------------


@query
def insert_if_absent(spark, folder):
    cat = ad.catalog(spark, folder).select("user_id", "file_type", "id", "filename")
    status = ad.catalog(spark, folder).select("user_id", "file_type", "id", "filename", "status")
    existing = status.filter(F.col("status") == "ready").drop("status")
    return mu.insert_if_absent(existing, cat, keys=["user_id", "file_type"], first_by="id")


@query
def update_rows(spark, folder):
    changes = tb.read_table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.lit("ready")).alias("status")
    )
    updated = mu.update_rows(ad.catalog(spark, folder), changes, columns=["status"])
    return updated.select("id", "status", "filename")


@query
def delete_rows(spark, folder):
    deleted = tb.read_table(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    return _public(mu.delete_rows(ad.catalog(spark, folder), deleted))


@query
def deleted_flags(spark, folder):
    asked = tb.read_table(spark, folder, "events").select(F.col("event_id").alias("id"))
    return mu.deleted_flags(ad.catalog(spark, folder).filter(F.col("status") == "ready"), asked)


@query
def cascade_delete(spark, folder):
    gone = ad.users(spark, folder).filter(F.col("segment") == "BUILDING")
    docs_left, docs_gone = mu.cascade_delete(ad.catalog(spark, folder), gone, child="user_id")
    chunks_left, _ = mu.cascade_delete(ad.catalog_chunks(spark, folder), docs_gone, child="document_id")
    per_doc = chunks_left.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunks"))
    return docs_left.select("id", "user_id").join(per_doc, "id", "left").withColumn(
        "chunks", F.coalesce("chunks", F.lit(0))
    )


@query
def delete_documents(spark, folder):
    scores = rk.hot_counts(ad.access_log(spark, folder))
    asked = tb.read_table(spark, folder, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    left = ls.delete_documents(ad.catalog(spark, folder), ad.catalog_chunks(spark, folder), scores, asked)
    sizes = [
        (left.catalog, "catalog"), (left.chunks, "chunks"), (left.scores, "scores"), (left.outcome.filter("deleted"), "deleted"),
    ]
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for rows, name in sizes]
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3])


@query
def replace_document_chunks(spark, folder):
    kept = ad.catalog_chunks(spark, folder)
    fresh = ad.catalog(spark, folder).filter(F.col("status") == "parsing").select(
        F.col("id").alias("document_id"), F.lit(0).alias("chunk_index"), F.length("filename").alias("token_count")
    )
    return mu.replace_document_chunks(kept, fresh).groupBy("document_id").agg(
        F.count("*").alias("chunks"), F.sum("token_count").cast("bigint").alias("tokens")
    )


@query
def check_unique(spark, folder):
    return ql.check_unique(ad.catalog_chunks(spark, folder), ["document_id", "chunk_index"])


@query
def check_fk(spark, folder):
    docs = ad.documents(spark, folder)
    children = ad.catalog_chunks(spark, folder)
    return ql.check_fk(children, docs, child="document_id", parent="doc_id")


@query
def check_domain(spark, folder):
    return ql.check_rules(ad.catalog(spark, folder), ql.catalog_rules())


# --- conversations and prompts ----------------------------------------------


@query
def build_conversation(spark, folder):
    return cv.build_conversation(ad.messages(spark, folder)).select("conv_id", "position", "role", "content")


@query
def message_json(spark, folder):
    return cv.message_json(ad.messages(spark, folder)).select("conv_id", "turn", "message")


@query
def assemble_request(spark, folder):
    messages = ad.messages(spark, folder)
    newest = messages.filter(F.col("role") == "user").groupBy("conv_id").agg(
        F.max("turn").alias("asked"), F.max_by("content", "turn").alias("user_message")
    )
    before = messages.join(newest.select("conv_id", "asked"), "conv_id").filter(F.col("turn") < F.col("asked"))
    history = cv.build_conversation(before.drop("asked"))
    ask = newest.select("conv_id", F.lit("Be brief.").alias("system"), "user_message")
    return cv.assemble_request(history, ask).select("conv_id", "section", "position", "role", "content")


@query
def request_params(spark, folder):
    asked = tb.read_table(spark, folder, "events").select(
        "event_id",
        F.pmod("user_id", F.lit(5)).cast("int").alias("max_tokens"),
        F.when(F.col("event_type") == "click", "").when(F.col("event_type") == "view", "low").alias("reasoning_effort"),
        F.when(F.col("event_type") == "error", F.lit(False)).alias("thinking_enabled"),
    )
    return cv.request_params(asked)


@query
def parse_response(spark, folder):
    return cv.parse_response(ad.stored_responses(spark, folder), default_model="model-z")


@query
def explode_messages(spark, folder):
    return cv.explode_messages(ad.chat_sessions(spark, folder))


@query
def prompt_registry(spark, folder):
    """The registry, and how many stored responses each template has."""
    asked = ad.stored_responses(spark, folder).groupBy("prompt_name").agg(F.count("*").alias("responses"))
    registry = pr.prompt_registry(spark).withColumnRenamed("name", "prompt_name")
    return registry.join(asked, "prompt_name", "left").select(
        "prompt_name", "ord", F.length("user_template").alias("template_chars"), F.coalesce("responses", F.lit(0)).alias("responses")
    )


@query
def unreadable_responses(spark, folder):
    return ex.unreadable_responses(ad.damaged_responses(spark, folder))


@query
def render_prompts(spark, folder):
    asked = ad.documents(spark, folder).select(
        "doc_id", "lang", "source",
        F.when(F.col("lang") == "es", "{lang}: {other}").otherwise("In {lang}, {{from}} {source}?").alias("user_template"),
    )
    return pr.render_prompts(asked, {"lang": "lang", "source": "source"}).select("doc_id", "user_message", "reject_reason")


@query
def render_grid(spark, folder):
    inputs = ad.experiment_inputs(spark, folder)
    return pr.render_grid(inputs, names=["csv_facts", "nobody", "plain", "two_sides"]).select(
        "input_id", "prompt_name", "ord", "user_message"
    )


@query
def unknown_names(spark, folder):
    asked = tb.read_table(spark, folder, "events").select(
        F.when(F.col("event_type") == "view", "plain").otherwise(F.col("event_type")).alias("prompt_name")
    )
    return pr.unknown_names(asked)


@query
def has_json(spark, folder):
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.col("props"))
        .when(kind == "click", F.concat("props", F.lit(" x")))
        .when(kind == "error", F.concat(F.lit('"'), kind, F.lit('"')))
        .when(kind == "purchase", F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(", null]")))
        .otherwise(kind)
    )
    return tb.read_table(spark, folder, "events").select("event_id", tx.has_json(text).alias("has_json"))


@query
def output_metrics(spark, folder):
    marked = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit(" see [1]")).otherwise(F.lit("")))
    outputs = ad.documents(spark, folder).select("doc_id", marked.alias("text"))
    return pr.output_metrics(outputs).drop("text")


@query
def prompt_metrics_summary(spark, folder):
    results = ex.experiment_results(ad.experiment_inputs(spark, folder), ad.stored_responses(spark, folder))
    return pr.prompt_metrics_summary(results)


@query
def run_experiment(spark, folder):
    return ex.run_experiment(ad.experiment_inputs(spark, folder), ad.stored_responses(spark, folder))


# --- vectors ----------------------------------------------------------------


@query
def cosine_top_k(spark, folder):
    table = spread_vectors(spark, folder)
    return vc.cosine_top_k(table, table.filter(F.col("vec_id") == 0), 10)


def spread_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return tb.spread(tb.read_table(spark, folder, "embeddings"))


@query
def cosine_top_k_batch(spark, folder):
    table = spread_vectors(spark, folder)
    asked = table.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return vc.cosine_top_k_batch(table, asked, 5)


@query
def cosine_index_top_k(spark, folder):
    table = spread_vectors(spark, folder)
    asked = table.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    path = tb.shared_folder(spark, "cells")
    cl.build(table, path)
    return cl.search(path, table, asked, 10, exact=True)


# --- streams ----------------------------------------------------------------


@query
def ingest_stream(spark, folder):
    path, checkpoint = tb.shared_folder(spark, "chunks"), tb.shared_folder(spark, "checkpoint")
    docs = tb.stream_table(spark, folder, "documents")
    files = docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("doc_id").alias("path"),
        F.col("text").cast("binary").alias("content"),
        F.octet_length("text").cast("bigint").alias("length"),
    )
    sj.append_to(sj.ingest_stream(files), path, checkpoint).awaitTermination()
    return spark.read.parquet(path).select("document_id", "chunk_index", "chunk_hash", "token_count")


@query
def version_stream(spark, folder):
    """Documents, then a second version of some after a restart: half the text of even ones, nothing of every fifth."""
    inbox, checkpoint = tb.shared_folder(spark, "versions"), tb.shared_folder(spark, "checkpoint")
    table = vs.chunk_table(spark, tb.shared_folder(spark, "chunks"))
    docs, at = tb.read_table(spark, folder, "documents"), F.lit("2026-08-03").cast("timestamp")
    first = docs.select(F.col("doc_id").alias("document_id"), F.lit(1).cast("bigint").alias("version"), at.alias("at"), "text")
    half = F.substring("text", F.floor(F.length("text") / 2).cast("int") + 1, F.length("text"))
    text = F.when(F.col("document_id") % 5 == 0, "").when(F.col("document_id") % 2 == 0, half).otherwise(F.col("text"))
    second = first.filter((F.col("document_id") % 5 == 0) | (F.col("document_id") % 2 == 0))
    second = second.select("document_id", F.lit(2).cast("bigint").alias("version"), "at", text.alias("text"))
    for versions in (first, second.unionByName(first.filter(F.col("document_id") % 3 == 0))):  # some come again as they were
        tb.spread(versions).write.mode("append").parquet(inbox, compression="zstd")
        stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1000).parquet(inbox)
        vs.into_table(vs.changes(vs.versions_with_chunks(stream)), table, checkpoint).awaitTermination()
    return table.read().select("document_id", "chunk_index", "chunk_hash", "token_count")


@query
def hot_stream_ranges(spark, folder):
    """Sketches of a stream, folded to one an hour, and the top documents of a week from them."""
    checkpoint, table = tb.shared_folder(spark, "checkpoint"), ky.KeyedTable(spark, tb.shared_folder(spark, "sketches"), "id")
    log = ad.access_log_of(tb.stream_table(spark, folder, "events"))
    sj.sketches_into(log, "doc_id", table, checkpoint, SKETCH_ITEMS).awaitTermination()
    sj.fold_sketches(table, SKETCH_ITEMS)
    top = fr.top_of_range(ad.access_log(spark, folder), table.read(), *_range(*HOT_RANGES["week"]), HOT_TOP_N, "doc_id", capacity=SKETCH_ITEMS)
    return top.select(F.col("item").alias("doc_id"), "score")


@query
def hot_stream(spark, folder):
    table, checkpoint = sj.counts_table(spark, tb.shared_folder(spark, "hot")), tb.shared_folder(spark, "checkpoint")
    log = ad.access_log_of(tb.stream_table(spark, folder, "events"))
    sj.counts_into(sj.running_counts(log, ["doc_id"], "score"), ["doc_id"], table, checkpoint).awaitTermination()
    return rk.hot_top_n(table.read().select("doc_id", "score"), HOT_TOP_N)


@query
def count_stream(spark, folder):
    table, checkpoint = sj.counts_table(spark, tb.shared_folder(spark, "counts")), tb.shared_folder(spark, "checkpoint")
    orders = tb.stream_table(spark, folder, "orders").select(F.col("o_orderstatus").alias("status"))
    sj.counts_into(sj.running_counts(orders, ["status"], "cnt"), ["status"], table, checkpoint).awaitTermination()
    return table.read().select("status", "cnt")


@query
def session_stream(spark, folder):
    path, checkpoint = tb.shared_folder(spark, "sessions"), tb.shared_folder(spark, "checkpoint")
    events = tb.stream_table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    sj.append_to(sj.closed_sessions(events), path, checkpoint).awaitTermination()
    return spark.read.parquet(path).select(
        "user_id", tx.iso_micros(F.col("session_start")).alias("session_start"),
        tx.iso_micros(F.col("session_end")).alias("session_end"), "accesses",
    )
