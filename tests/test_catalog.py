import base64
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions.encoding import decode_cursor, encode_cursor
from pagemill.operators import catalog as ct
from pagemill.operators import mutations as mu
from pagemill.operators import quality as ql
from pagemill.operators import ranking as rk
from pagemill.plans.listing import delete_documents, list_documents
from pagemill.schemas import DOCUMENTS

START = dt.datetime(2026, 8, 1, 10, 0, 0)


@pytest.fixture(scope="module")
def catalog(spark):
    rng = random.Random(11)
    rows = []
    for i in range(230):
        created = START + dt.timedelta(microseconds=rng.randint(0, 60) * 1001)
        kind = rng.choice([".pdf", ".md", ".txt"])
        rows.append(
            (f"{i:04x}", rng.choice(["u1", "u1", "u2"]), f"Report_{i}%{kind}", kind, rng.randint(0, 99), f"uploads/{i}",
             rng.choice(["ready", "failed", "uploaded"]), created, created)
        )
    return spark.createDataFrame(rows, DOCUMENTS).cache()


def keys(df):
    return [(r.created_at, r.id) for r in df.collect()]


@pytest.mark.parametrize("size", [1, 7, 100])
def test_walking_the_cursor_lists_everything_once(catalog, size):
    mine = [(r.created_at, r.id) for r in catalog.filter("user_id = 'u1'").collect()]
    expected = sorted(mine, reverse=True)
    if size == 1:
        expected = expected[:4]
    seen, cursor = [], None
    while True:
        seen += sorted(keys(ct.keyset_page(catalog, user_id="u1", cursor=cursor, page_size=size)), reverse=True)
        info = ct.keyset_page_info(catalog, user_id="u1", cursor=cursor, page_size=size).first()
        cursor = info.next_cursor
        assert info.has_more == (cursor is not None)
        if cursor is None or (size == 1 and len(seen) == 4):
            break
    assert seen == expected


def test_last_page_exactly_full_has_no_more(catalog):
    few = catalog.orderBy("id").limit(20).cache()
    info = ct.keyset_page_info(few, page_size=20).first()
    assert (info.item_count, info.has_more, info.next_cursor) == (20, False, None)
    empty = ct.keyset_page_info(few.filter("false"), page_size=20).first()
    assert (empty.item_count, empty.has_more, empty.next_cursor) == (0, False, None)


def test_cursor_is_url_safe_json_with_microseconds(spark):
    at = dt.datetime(2026, 1, 2, 3, 4, 5, 678901)
    df = spark.createDataFrame([(at, "ÿ>?~" * 30)], "a timestamp, i string").withColumn("c", encode_cursor(F.col("a"), F.col("i")))
    row = df.select("c", decode_cursor(F.col("c")).alias("k")).first()
    assert json.loads(base64.urlsafe_b64decode(row.c)) == {"created_at": "2026-01-02T03:04:05.678901", "id": "ÿ>?~" * 30}
    assert row.k.id == "ÿ>?~" * 30 and not set(row.c) & set("+/\r\n")


def test_filters(catalog):
    everything = catalog.collect()
    def ids(**f):
        return {r.id for r in ct.catalog_search(catalog, **f).collect()}
    assert ids() == {r.id for r in everything}
    assert ids(keyword="REPORT_1_%") == {r.id for r in everything if r.filename.startswith("Report_1")}
    assert ids(user_id="u2", status="ready", file_type=".md") == {
        r.id for r in everything if (r.user_id, r.status, r.file_type) == ("u2", "ready", ".md")
    }
    assert ids(file_type=".MD") == set()
    with pytest.raises(ValueError):
        ids(status="done")


def test_numbered_pages_and_sorting(catalog):
    rows = catalog.collect()
    by_size = sorted((r.file_size, r.id) for r in rows)
    got = [(r.file_size, r.id) for r in ct.sorted_listing(catalog, sort_by="file_size", sort_order="asc", page=2, page_size=30).collect()]
    assert got == by_size[30:60]
    newest = sorted(((r.created_at, r.id) for r in rows), reverse=True)
    assert keys(ct.offset_page(catalog, page=3, page_size=20)) == newest[40:60]
    assert keys(ct.offset_page(catalog, page=99, page_size=20)) == []


@pytest.mark.parametrize("bad", [{"page": 0}, {"page_size": 0}, {"page_size": 101}, {"sort_by": "status"}, {"sort_order": "up"}])
def test_bounds_are_checked(catalog, bad):
    with pytest.raises(ValueError):
        ct.sorted_listing(catalog, **bad)


def test_keyset_bound_reaches_the_scan(spark, catalog, tmp_path):
    path = str(tmp_path / "c")
    catalog.write.parquet(path)
    page = ct.keyset_after(spark.read.parquet(path), F.lit(START).cast("timestamp"), F.lit("00ff"))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(created_at" in plan
    listing = ct.keyset_page(spark.read.parquet(path), user_id="u1")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in listing and "EqualTo(user_id,u1)" in listing


def test_lookup_by_id_lists_and_tables(spark, catalog):
    assert [r.id for r in ct.get_by_id(catalog, "0003").collect()] == ["0003"]
    assert ct.get_by_id(catalog, "zzzz").collect() == []
    wanted = spark.createDataFrame([("0001",), ("0002",), ("nope",)], "id string")
    for ids in (["0001", "0002", "nope"], wanted):
        assert {r.id for r in ct.get_by_ids(catalog, ids).collect()} == {"0001", "0002"}


def test_counts_and_totals(catalog):
    rows = catalog.collect()
    assert ct.count_where(catalog).first().n == 230
    by = {r.status: r.cnt for r in ct.count_by_status(catalog, "u1").collect()}
    assert by == {s: sum(r.user_id == "u1" and r.status == s for r in rows) for s in by}
    totals = {r.user_id: r for r in ct.catalog_totals(catalog, page_size=50, matching=ct.catalog_filter(status="ready")).collect()}
    n = sum(r.user_id == "u1" for r in rows)
    assert (totals["u1"].total, totals["u1"].total_pages) == (n, -(-n // 50))
    assert totals["u1"].filtered_total == by["ready"]


def test_string_round_trip_and_rejects(catalog):
    packed = ct.to_strings(catalog)
    back = ct.typed_from_strings(packed).orderBy("id").collect()
    rows = catalog.orderBy("id").collect()
    assert [(r.id, r.file_size, r.created_at) for r in back] == [(r.id, r.file_size, r.created_at) for r in rows]
    assert {r.reject_reason for r in back} == {None}
    def swap(k, v):
        return F.map_concat(F.map_filter("fields", lambda a, b: a != k), F.create_map(F.lit(k), F.lit(v)))
    for k, v in (("file_size", "x"), ("file_size", "-1"), ("status", "gone"), ("created_at", "?")):
        assert {r.reject_reason for r in ct.typed_from_strings(packed.withColumn("fields", swap(k, v))).collect()} == {k}


def test_shapes(catalog):
    assert ct.document_info(catalog).columns == ["id", "filename", "file_type", "file_size", "status", "created_at", "updated_at"]
    assert "user_id" not in ct.document_response(catalog).columns


def test_insert_if_absent(spark):
    old = spark.createDataFrame([("a", 1)], "name string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "name string, v int")
    for _ in range(2):  # running it again changes nothing
        old = mu.insert_if_absent(old, new, keys=["name"], first_by="v")
    assert {tuple(r) for r in old.collect()} == {("a", 1), ("b", 2)}


def test_update_can_set_null(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, v int, w string")
    change = spark.createDataFrame([("b", None, "q"), ("c", 5, "z")], "id string, v int, w string")
    got = {tuple(r) for r in mu.update_rows(table, change, columns=["v"]).collect()}
    assert got == {("a", 1, "x"), ("b", None, "y")}


def test_deletes_cascade(spark):
    users = spark.createDataFrame([("u1",), ("u2",)], "id string")
    docs = spark.createDataFrame([("d1", "u1"), ("d2", "u2"), ("d3", "u1")], "id string, user_id string")
    chunks = spark.createDataFrame([("c1", "d1"), ("c2", "d2"), ("c3", "d3"), ("c4", "d3")], "id string, document_id string")
    gone = users.filter("id = 'u1'")
    left, lost = mu.cascade_delete(docs, gone, child="user_id")
    assert {r.id for r in left.collect()} == {"d2"}
    assert {r.id for r in mu.cascade_delete(chunks, lost, child="document_id")[0].collect()} == {"c2"}
    flags = mu.deleted_flags(docs, spark.createDataFrame([("d1",), ("d9",)], "id string"))
    assert {tuple(r) for r in flags.collect()} == {("d1", True), ("d9", False)}
    again = mu.replace_document_chunks(chunks, spark.createDataFrame([("n", "d3")], "id string, document_id string"))
    assert {r.id for r in again.collect()} == {"c1", "c2", "n"}


def test_listing_brings_page_and_totals(catalog):
    rows = [r for r in catalog.collect() if r.user_id == "u1"]
    ready = sorted(((r.created_at, r.id) for r in rows if r.status == "ready"), reverse=True)
    listing = list_documents(catalog, "u1", status="ready", page_size=10)
    assert [r.id for r in listing.items.orderBy(F.desc("created_at"), F.desc("id")).collect()] == [i for _, i in ready[:10]]
    assert listing.info.first().has_more is (len(ready) > 10)
    totals = listing.totals.first()
    assert (totals.total, totals.filtered_total, totals.total_pages) == (len(rows), len(ready), -(-len(rows) // 10))


def test_deleting_documents_reaches_chunks_and_ranking(spark, catalog):
    chunks = spark.createDataFrame([("0001", 0), ("0001", 1), ("0002", 0)], "document_id string, chunk_index int")
    scores = spark.createDataFrame([("0001", 9), ("0002", 5)], "doc_id string, score long")
    left = delete_documents(catalog, chunks, scores, spark.createDataFrame([("0001",), ("none",)], "id string"))
    assert left.catalog.count() == 229 and left.chunks.count() == 1
    assert [r.doc_id for r in left.scores.collect()] == ["0002"]
    assert {tuple(r) for r in left.outcome.collect()} == {("0001", True), ("none", False)}


def test_rules(spark, catalog):
    assert {r.violations for r in ql.check_rules(catalog, ql.catalog_rules()).collect()} == {0}
    bad = catalog.withColumn("status", F.lit("odd")).withColumn("file_size", F.lit(-1)).withColumn("filename", F.lit(None).cast("string"))
    broken = {r.rule for r in ql.check_rules(bad, ql.catalog_rules()).collect() if r.violations == 230}
    assert broken == {"status_domain", "file_size_not_negative", "filename_length", "filename_required"}
    twice = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "a int, b int")
    assert [tuple(r) for r in ql.check_unique(twice, ["a", "b"]).collect()] == [(1, 1, 2)]
    children = spark.createDataFrame([(1,), (2,), (None,)], "p int")
    assert [r.p for r in ql.check_fk(children, spark.createDataFrame([(1,)], "id int"), child="p", parent="id").collect()] == [2]


@pytest.fixture
def log(spark):
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        user = 1 if rng.random() < 0.5 else rng.randint(2, 9)
        rows.append((i, rng.randint(1, 60), user, START + dt.timedelta(seconds=rng.randint(0, 86400 * 5))))
    return spark.createDataFrame(rows, "event_id long, doc_id long, user_id long, ts timestamp")


def test_hot_ranking_and_recent(spark, log):
    rows = log.collect()
    score = {}
    for r in rows:
        score[r.doc_id] = score.get(r.doc_id, 0) + 1
    ranked = sorted(((s, d) for d, s in score.items()), reverse=True)
    assert [(r.score, r.doc_id) for r in rk.hot_top_n(rk.hot_counts(log)).collect()] == ranked[:20]
    gone = spark.createDataFrame([(ranked[0][1],)], "doc_id long")
    assert [(r.score, r.doc_id) for r in rk.hot_top_n(rk.hot_remove(rk.hot_counts(log), gone), 3).collect()] == ranked[1:4]
    last = {}
    for r in rows:
        last[r.user_id, r.doc_id] = max(last.get((r.user_id, r.doc_id), r.ts), r.ts)
    expected = {(u, n, d) for u in range(1, 10) for n, (_, d) in
                enumerate(sorted(((t, d) for (w, d), t in last.items() if w == u), reverse=True)[:20], 1)}
    assert {(r.user_id, r.rank, r.doc_id) for r in rk.recent_access(log).collect()} == expected


def test_sessions_end_after_half_an_hour(log):
    expected, previous = [], {}
    for r in sorted(log.collect(), key=lambda r: (r.ts, r.event_id)):
        if r.user_id not in previous or r.ts - previous[r.user_id] >= dt.timedelta(minutes=30):
            expected.append([r.user_id, r.ts, r.ts, 0])
        current = [s for s in expected if s[0] == r.user_id][-1]
        current[2], current[3] = r.ts, current[3] + 1
        previous[r.user_id] = r.ts
    got = {(r.user_id, r.session_start, r.last_access, r.accesses) for r in rk.sessions(log).collect()}
    assert got == {tuple(s) for s in expected}


def test_an_owner_without_documents_has_totals(spark):
    from pagemill.plans.listing import list_documents

    catalog = spark.createDataFrame([], DOCUMENTS)
    listing = list_documents(catalog, "nobody")
    assert [tuple(r) for r in listing.totals.select("total", "filtered_total", "total_pages").collect()] == [(0, 0, 1)]
    assert listing.items.collect() == []


def test_repeated_changes_do_not_multiply_rows(spark):
    from pagemill.operators import mutations as mu

    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, status string")
    changes = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (3, "z", 1)], "id long, status string, at int")
    got = mu.update_rows(table, changes, columns=["status"], latest="at").orderBy("id").collect()
    assert [(r.id, r.status) for r in got] == [(1, "x"), (2, "b")]
    got = mu.update_rows(table, changes, columns=["status"]).orderBy("id").collect()
    assert [(r.id, r.status) for r in got] == [(1, "y"), (2, "b")]
