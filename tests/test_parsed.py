"""Files read by parser plug-ins as a data source."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagemill.sources import parsed

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests


def lines_parser(name, content):
    if b"broken" in content:
        raise ValueError("broken file")
    return [("paragraph", line, 1) for line in content.decode().splitlines()]


def title_parser(name, content):
    return [("heading", name, None)]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "sub" / "b.TXT").write_text("three")
    (tmp_path / "sub" / "broken.txt").write_text("broken")
    (tmp_path / "c.md").write_text("x")
    (tmp_path / "d.pdf").write_text("y")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "large.txt").write_text("z" * 5000)
    (tmp_path / "_hidden.txt").write_text("no")
    (tmp_path / ".also.txt").write_text("no")
    return f"file://{tmp_path}"


@pytest.fixture(autouse=True)
def registered(spark):
    parsed.register_parsers(spark, {".txt": lines_parser, ".md": title_parser})


def name(column="path"):
    return F.substring_index(column, "/", -1).alias("name")


def test_blocks_and_rejects(spark, folder):
    rows = spark.read.format(parsed.NAME).option("maxBytes", 1000).load(folder).select(name(), "position", "block_type", "text", "page_number", "error").collect()
    assert sorted(tuple(r)[:5] for r in rows if r.error is None) == [
        ("a.txt", 0, "paragraph", "one", 1), ("a.txt", 1, "paragraph", "two", 1), ("b.TXT", 0, "paragraph", "three", 1), ("c.md", 0, "heading", "c.md", None)
    ]
    assert {r.name: r.error for r in rows if r.error} == {"broken.txt": "broken file", "d.pdf": "no parser for '.pdf'", "large.txt": "too_large"}


def test_filters_and_columns_spare_reading(spark, folder):
    def never(name, content):
        raise AssertionError("read")

    parsed.register_parsers(spark, {".txt": never, ".md": title_parser})
    files = spark.read.format(parsed.NAME).load(folder)
    assert [r.text for r in files.filter(F.col("file_type") == ".md").collect()] == ["c.md"]
    assert files.filter(F.col("file_type").isin(".md", ".pdf") & F.col("error").isNull()).count() == 1
    listed = spark.read.format(parsed.NAME).schema(parsed.FILE_COLUMNS).load(folder).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in listed) == [
        ("a.txt", 7), ("b.TXT", 5), ("broken.txt", 6), ("c.md", 1), ("d.pdf", 1), ("empty.txt", 0), ("large.txt", 5000)]


def test_packs_by_bytes(spark, folder, monkeypatch):
    monkeypatch.setattr(parsed, "FILE_COST", 10)
    sizes = [900, 5, 5, 400, 300, 90, 20, 2000]
    packs = parsed.packed([(str(k), ".txt", n) for k, n in enumerate(sizes)], 1000)
    assert sorted(f[2] for p in packs for f in p) == sorted(sizes)
    assert all(len(p) == 1 or sum(f[2] + 10 for f in p) <= 1000 for p in packs) and len(packs) < len(sizes)
    files = spark.read.format(parsed.NAME).option("packedBytes", 1).load(folder)
    assert files.rdd.getNumPartitions() == 7


def test_no_files(spark, tmp_path):
    assert spark.read.format(parsed.NAME).load(f"file://{tmp_path}").collect() == []


def test_very_many_files_are_few_partitions():
    files = [(f"{k}", ".txt", 4000) for k in range(20_000)]
    packs = parsed.packed(files, 100_000)
    assert len(packs) < 1.2 * parsed.PACKS and sorted(f for p in packs for f in p) == sorted(files)
