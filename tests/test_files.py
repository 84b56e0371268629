from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pagemill.functions.encoding import decode_text
from pagemill.operators import blocks as bl
from pagemill.operators.chunking import chunk_rows
from pagemill.plans.ingest import catalog_rows, ingest, parse_files
from pagemill.sources import files as fs
from pagemill.sources import tables as tb
from pagemill.streaming import jobs as sj

MB = 1024 * 1024


def test_admission(spark):
    rows = [("a.PDF", 50 * MB), ("b.txt", 50 * MB + 1), ("c.exe", 1), ("", 1), (None, 1), ("noext", 1), ("d.json", 0), ("x.png", 9)]
    df = spark.createDataFrame(rows, "filename string, length long")
    got = {r.filename: r.reject_reason for r in fs.admit_files(df).collect()}
    assert got == {"a.PDF": None, "b.txt": "too_large", "c.exe": "extension_not_allowed", "": "empty_name", None: "empty_name",
                   "noext": "extension_not_allowed", "d.json": None, "x.png": "extension_not_allowed"}


def test_decoding(spark):
    chinese = "这是一份中文文档，用于测试编码。"
    cases = [
        ("utf8", chinese.encode(), chinese, "utf-8"),
        ("gbk", chinese.encode("gbk"), chinese, "gbk"),
        ("stray", b"abc\xffdef", "abc�def", "utf-8"),
        ("empty", b"", "", "utf-8"),
        ("null", None, None, None),
        ("bom", "﻿x".encode(), "x", "utf-8"),
    ]
    df = spark.createDataFrame([(n, b) for n, b, _, _ in cases], "n string, content binary")
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    got = {r.n: (r.text, r.encoding) for r in decode_text(df).collect()}
    assert got == {n: (t, e) for n, _, t, e in cases}
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(("first paragraph\n\n" + "x" * 2500 + "\n\nlast").encode())
    (tmp_path / "in" / "sub" / "b.md").write_bytes("# 标题\n\ntext\n\n```py\ncode\n```".encode())
    (tmp_path / "in" / "c.TXT").write_bytes("中文内容在这里，用国标编码。".encode("gbk"))
    (tmp_path / "in" / "d.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "in" / "e.csv").write_bytes(b"a,b")
    (tmp_path / "in" / "f.exe").write_bytes(b"MZ")
    (tmp_path / "in" / "g.txt").write_bytes(b"")
    return tmp_path


def test_one_bad_file_stops_nothing(spark, folder):
    parsed = parse_files(fs.scan_files(spark, str(folder / "in")))
    got = {r.filename: (r.status, r.n, r.encoding) for r in parsed.withColumn("n", F.size("blocks")).collect()}
    assert got == {"a.txt": ("ready", 3, "utf-8"), "b.md": ("ready", 3, "utf-8"), "c.TXT": ("ready", 1, "gbk"),
                   "d.pdf": ("failed", 0, None), "e.csv": ("ready", 0, None), "f.exe": ("rejected", 0, None)}


def test_ingest_is_a_narrow_job(spark, folder):
    rows = ingest(fs.scan_files(spark, str(folder / "in")))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    texts = {r.document_id.rsplit("/", 1)[1]: [] for r in rows.collect()}
    for r in rows.orderBy("document_id", "chunk_index").collect():
        texts[r.document_id.rsplit("/", 1)[1]].append(r.chunk_text)
    # "last" is short and joins the part before it.
    assert [len(t) for t in texts["a.txt"]] == [15, 1000, 1000, 905]
    assert texts["b.md"] == ["标题", "text", "code"] and texts["c.TXT"] == ["中文内容在这里，用国标编码。"]


def test_content_is_not_read_for_listing(spark, folder):
    listed = fs.list_files(spark, str(folder / "in")).select("filename", "length")
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    assert listed.count() == 6  # the file source passes over empty files
    small = fs.scan_files(spark, str(folder / "in"), max_bytes=5)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,5)" in small
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        fs.scan_files(spark, str(folder / "nowhere")).collect()


def test_routing_and_user_parsers(spark, folder):
    def pages(name, content):
        if b"broken" in content:
            raise ValueError(f"cannot read {name}")
        yield ("paragraph", content.decode(), 1)

    files = fs.admit_files(fs.scan_files(spark, str(folder / "in"))).withColumn("doc_id", F.col("filename"))
    text = lambda part: bl.split_paragraphs(decode_text(part))
    python = fs.python_parser(pages)
    blocks, rest = fs.route_by_type(files, {".TXT": text, ".pdf": python, ".csv": python})
    rows = blocks.collect()
    assert {r.doc_id for r in rows if r.error is None} == {"a.txt", "c.TXT", "e.csv"}
    assert [r.error for r in rows if r.doc_id == "d.pdf"] == ["cannot read d.pdf"]
    assert {(r.filename, r.error) for r in rest.collect()} == {
        ("b.md", "no parser for '.md'; have .csv, .pdf, .txt"), ("f.exe", "no parser for '.exe'; have .csv, .pdf, .txt")}


def test_stored_names_are_stable(spark):
    df = spark.createDataFrame([("Plan.PDF",)], "filename string")
    path = fs.storage_columns(df, key=F.lit("k"), stored_at=F.lit("2026-08-03").cast("timestamp"))
    [row] = path.collect()
    assert row.storage_path == path.first().storage_path
    assert row.storage_path.startswith("uploads/2026/08/doc-") and row.storage_path.endswith(".pdf") and len(row.storage_path) == 36


def test_saved_files_are_found_by_their_path(spark, folder, tmp_path):
    files = fs.admit_files(fs.scan_files(spark, str(folder / "in"))).filter("reject_reason IS NULL").drop("file_type")
    at = F.lit("2026-08-03").cast("timestamp")
    out = str(tmp_path / "saved")
    fs.save_files(files, out, key=F.col("filename"), stored_at=at)
    catalog = catalog_rows(files, key=F.col("filename"), user_id=F.lit("u"), stored_at=at)
    wanted = catalog.filter("filename = 'c.TXT'")
    [row] = fs.read_saved(spark, out, wanted).collect()
    assert row.content.decode("gbk") == "中文内容在这里，用国标编码。" and row.file_size == 28 and row.file_type == ".txt"
    assert fs.read_saved(spark, out).count() == 5
    assert {(r.filename, r.status) for r in catalog.collect()} == {
        ("a.txt", "ready"), ("b.md", "ready"), ("c.TXT", "ready"), ("d.pdf", "failed"), ("e.csv", "ready")}


def test_month_folders_and_document_defaults(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2026-08-03"), (2, "2026-09-01"), (3, "2026-08-09")], "id int, d string").select("id", F.to_timestamp("d").alias("created_at"))
    tb.write_by_month(rows, str(tmp_path / "m"))
    assert (tmp_path / "m" / "year=2026" / "month=8").is_dir()
    assert spark.read.parquet(str(tmp_path / "m")).filter("month = 8").count() == 2
    tb.write_documents(spark.createDataFrame([(1,)], "id int"), str(tmp_path / "d"))
    row = spark.read.parquet(str(tmp_path / "d")).first()
    assert row.status == "uploaded" and row.created_at == row.updated_at


def test_files_that_arrive_are_chunked_once(spark, folder):
    source, out, checkpoint = (str(folder / d) for d in ("in", "out", "cp"))
    def run():
        sj.append_to(sj.ingest_stream(fs.stream_files(spark, source)), out, checkpoint).awaitTermination()
        return sorted((r.document_id, r.chunk_index, r.chunk_hash) for r in spark.read.parquet(out).collect())
    first = run()
    assert run() == first  # nothing new, nothing twice
    (folder / "in" / "late.txt").write_text("a late file")
    batch = ingest(fs.scan_files(spark, source)).collect()
    assert run() == sorted((r.document_id, r.chunk_index, r.chunk_hash) for r in batch)


def test_counts_over_several_batches(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "cp"))
    for n in (3, 5):
        spark.range(n * 10).select((F.col("id") % n).alias("doc_id")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long").parquet(source)
        sj.changes_to(sj.running_counts(stream, ["doc_id"], "score"), out, checkpoint).awaitTermination()
    got = {r.doc_id: r.score for r in sj.latest_counts(spark, out, ["doc_id"], "score").collect()}
    assert got == {0: 20, 1: 20, 2: 20, 3: 10, 4: 10}
    assert {r.batch_id: r["count"] for r in spark.read.option("basePath", out).parquet(f"{out}/batch_id=*").groupBy("batch_id").count().collect()} == {0: 3, 1: 5}


def test_shared_folder_comes_from_the_session(spark):
    def session(folder, master):
        conf = SimpleNamespace(get=lambda key, default: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-1"))

    assert tb.shared_folder(session("/shared/place/", "yarn"), "x").startswith("/shared/place/app-1/x-")
    with pytest.raises(ValueError):
        tb.shared_folder(session(None, "yarn"), "x")
    assert tb.shared_folder(spark, "x") != tb.shared_folder(spark, "x")


def test_chunk_rows_of_stored_blocks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one\n\ntwo")], "doc_id long, text string")
    blocks = tb.stored(docs.select("doc_id", bl.text_block_array(F.col("text")).alias("blocks")), "blocks")
    assert [r.chunk_text for r in chunk_rows(blocks).collect()] == ["one\ntwo"]


def test_marks_and_wide_encodings(spark):
    files = [("bom.md", b"\xef\xbb\xbf# Title"), ("le.txt", "one\n\ntwo é".encode("utf-16")), ("be.txt", b"\xfe\xff" + "drei ß".encode("utf-16-be")),
             ("gbk.txt", "中文内容".encode("gbk")), ("only.txt", b"\xef\xbb\xbf"), ("blank.txt", b" \n"), ("x.exe", b"MZ")]
    rows = [(n, len(c), c) for n, c in files]
    parsed = parse_files(spark.createDataFrame(rows, "filename string, length long, content binary"))
    got = {r.filename: r for r in parsed.withColumn("texts", F.col("blocks.text")).collect()}
    assert got["bom.md"].texts == ["Title"] and got["bom.md"].blocks[0].block_type == "heading" and got["bom.md"].encoding == "utf-8"
    assert got["le.txt"].texts == ["one", "two é"] and got["le.txt"].encoding == "utf-16"
    assert got["be.txt"].texts == ["drei ß"] and got["gbk.txt"].texts == ["中文内容"] and got["gbk.txt"].encoding == "gbk"
    assert got["only.txt"].texts == [] and got["blank.txt"].texts == [] and got["blank.txt"].status == "ready"
    assert (got["x.exe"].status, got["x.exe"].reject_reason) == ("rejected", "extension_not_allowed")


def test_large_files_are_rejected_not_lost(spark, tmp_path):
    from pagemill.plans.ingest import rejected_files

    (tmp_path / "small.txt").write_text("a few words")
    with open(tmp_path / "large.txt", "wb") as f:
        f.truncate(51 * 1024 * 1024)
    files = fs.scan_files(spark, str(tmp_path))
    assert sorted((r.filename, r.content is None) for r in files.select("filename", "content").collect()) == [("large.txt", True), ("small.txt", False)]
    assert [(r.filename, r.reject_reason) for r in rejected_files(files).collect()] == [("large.txt", "too_large")]
    assert {r.document_id.rsplit("/", 1)[1] for r in ingest(files).collect()} == {"small.txt"}
    assert {r.filename: r.status for r in parse_files(files).collect()} == {"small.txt": "ready", "large.txt": "rejected"}


def test_writing_again_replaces(spark, tmp_path):
    path = str(tmp_path / "chunks")
    def rows(*values):
        return spark.createDataFrame(list(values), "document_id string, chunk_index int, chunk_text string")
    tb.write_chunks(rows(("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")), path)
    tb.write_chunks(rows(("a", 0, "new"), ("c", 0, "w")), path)
    tb.write_chunks(rows(("a", 0, "new"), ("c", 0, "w")), path)
    got = sorted((r.document_id, r.chunk_index, r.chunk_text) for r in spark.read.parquet(path).collect())
    assert got == [("a", 0, "new"), ("b", 0, "z"), ("c", 0, "w")]


def test_files_without_bytes_are_rejected_by_the_same_limit(spark, folder):
    files = fs.admit_files(fs.scan_files(spark, str(folder / "in"), max_bytes=5), max_bytes=5).collect()
    large = [r for r in files if r.content is None]
    assert large and all(r.length > 5 and r.reject_reason in ("too_large", "extension_not_allowed") for r in large)
    assert any(r.reject_reason == "too_large" for r in large) and all(r.reject_reason != "too_large" for r in files if r.length <= 5)


def test_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from pagemill.sources.tables import write_files

    monkeypatch.setattr(DataFrameWriter, "text", lambda *a: pytest.fail("Spark moves every folder from the driver"))
    write_files(spark.createDataFrame([(1, "é\nb"), (2, None), (3, "x"), (3, "y"), (None, "z")], "k long, t string"), f"file://{tmp_path}/out")
    found = {p.parent.name: p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found.pop("k=3") in ("x\ny\n", "y\nx\n")
    assert found == {"k=1": "é\nb\n", "k=2": "\n", "k=__HIVE_DEFAULT_PARTITION__": "z\n"}
    write_files(spark.createDataFrame([], "k long, t string"), f"file://{tmp_path}/none")
    assert fs.list_files(spark, f"file://{tmp_path}/none").count() == 0


def test_listing_takes_few_tasks(spark, tmp_path):
    for k in range(100):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "a.txt").write_text("a")
    tracker, group = spark.sparkContext.statusTracker(), "listing"
    spark.sparkContext.setJobGroup(group, group)
    try:
        files = fs.scan_files(spark, f"file://{tmp_path}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism
    assert files.count() == 100


def test_pages_are_not_all_in_one_task(spark, tmp_path, monkeypatch):
    from pagemill.sources import adapters

    spark.createDataFrame([(1, "<p>a</p>"), (7, "<p>b</p>"), (7, "<p>c</p>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    seen = []
    monkeypatch.setattr(adapters, "write_files", lambda rows, path: seen.append(rows))
    adapters.page_files(spark, str(tmp_path))
    assert sorted(r.html for r in seen[0].collect()) == ["<p>a</p>", "cut off<p>b</p>", "cut off<p>c</p>"]
    assert "Window" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_folders_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameReader

    root = tmp_path / "in put%20é"
    names = ["a.txt", "k=1/part.txt", "k=2/b/c.txt", "_k=3/d.txt", "_hidden/e.txt", ".f.txt", "_g.txt", "h.txt._COPYING_", "_metadata", "_metadata_of/i.txt", "empty.txt", "ü ~+&.txt", "no/o"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if name == "empty.txt" else name.encode() * 1000)
    (root / "none").mkdir()
    (root / "link.txt").symlink_to(root / "a.txt")
    (root / "packed.gz").write_bytes(b"\x1f\x8bnot unpacked")
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root))
    expected = sorted((r.path, r.modificationTime, r.length, bytes(r.content)) for r in plain.collect())
    assert len(expected) == 9
    monkeypatch.setattr(DataFrameReader, "format", lambda *a: pytest.fail("the driver lists every file"))
    for path in (str(root), f"file://{root}/"):
        found = fs.list_files(spark, path) if path[0] == "/" else fs.list_files(spark, f"{tmp_path}/./{root.name}/")
        assert sorted((r.path, r.modificationTime, r.length, bytes(r.content)) for r in found.collect()) == expected
    assert {f.name: f.dataType for f in fs.list_files(spark, str(root)).schema if f.name != "filename"} == {f.name: f.dataType for f in plain.schema}


def test_patterns_and_single_files_are_listed(spark, folder):
    assert {r.filename for r in fs.list_files(spark, f"{folder}/in/*.txt").select("filename").collect()} == {"a.txt"}
    [row] = fs.list_files(spark, f"{folder}/in/sub/b.md").collect()
    assert row.filename == "b.md" and row.content.startswith(b"# ")
