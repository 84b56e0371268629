import os

import pytest

import corpus_pipeline
from pagemill.llm import mixing
from test_jaccard import by_hand

FOLDER = "/root/testdata/sf0.001"


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontamination", "private_data", "mixing"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame(
        [(90001, None, "en", "src1", 0), (90002, "", None, None, None), (90003, "1234 !!", "en", "src2", 7)], docs.schema
    )
    docs = docs.unionByName(extra).unionByName(docs.limit(3))
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language"](spark, docs, FOLDER)
    assert one.columns == docs.columns
    rows = one.collect()
    kept = {r.doc_id for r in rows}
    assert not kept & {90001, 90002, 90003} and len(rows) >= 0.98 * (docs.count() - 3)

    two = stages["near_copies"](spark, one, FOLDER)
    wanted = sorted(i for i, n, c in by_hand(list({(r.doc_id, r.text) for r in rows})) if i == c or n == 0)
    assert sorted({r.doc_id for r in two.collect()}) == wanted and two.columns == docs.columns

    three = stages["decontamination"](spark, two, FOLDER)
    bench = [r.text.lower() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in two.collect() if any(b in r.text.lower() for b in bench)}
    assert {r.doc_id for r in three.collect()} == set(wanted) - leaked

    four = stages["private_data"](spark, three, FOLDER)
    assert four.columns == docs.columns and four.schema == three.schema
    before, after = {r.doc_id: r for r in three.collect()}, {r.doc_id: r for r in four.collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        if "@" not in before[i].text and not any(c.isdigit() for c in before[i].text):
            assert r == before[i]
        assert ".example.com" not in r.text and r.n_chars == len(r.text)

    five = stages["mixing"](spark, four, FOLDER).collect()
    again = mixing.mix(four).collect()
    assert sorted((r.doc_id, r.taken, r.target) for r in five) == sorted((r.doc_id, r.taken, r.target) for r in again)
    assert all(r.taken == r.copies * r.size for r in five)


def test_null_ids_and_empty_tables(spark, documents, prose):
    docs = documents([(None, prose(1, 40)), (None, prose(1, 40)), (2, prose(2, 40))])
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 2
    none = documents([])
    assert corpus_pipeline.drop_near_copies(spark, none, "").columns == none.columns
    assert corpus_pipeline.redact_private_data(spark, none, "").collect() == []
    assert corpus_pipeline.mix_sources(spark, none, "").collect() == []


def test_rows_of_one_id_are_judged_apart(spark, documents, prose, tmp_path):
    item = prose(900, 30) + ". " + prose(901, 8) + "."
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leaked = prose(1, 90) + " " + item
    docs = documents([(None, leaked), (None, prose(2, 90)), (7, leaked), (7, prose(3, 90))], clash=False)
    got = corpus_pipeline.decontaminate_texts(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, prose(2, 90)), (7, prose(3, 90))]

    rows = [(None, prose(4, 40), "aa"), (None, "", None), (5, prose(5, 40), "aa"), (5, "12 !?", None)]
    rows += [(100 + k, prose(100 + k, 40), "aa") for k in range(20)]
    got = corpus_pipeline.identify_language(spark, documents(rows), "").where("coalesce(doc_id, 0) < 100").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, prose(4, 40)), (5, prose(5, 40))]

    near = prose(6, 80) + " more"
    rows = [(None, prose(6, 80)), (None, prose(7, 80)), (3, near), (4, near), (4, prose(8, 80)), (9, prose(9, 80))]
    rows += [(9, prose(9, 80)), (9, prose(9, 80) + " more"), (2, ""), (2, "")]
    got = corpus_pipeline.drop_near_copies(spark, documents(rows), "").collect()
    kept = sorted((r.doc_id or 0, r.text) for r in got)
    nines = [x for x in kept if x[0] == 9]
    assert len(nines) == 1 and kept[:5] == sorted([(0, prose(7, 80)), (2, ""), (2, ""), (3, near), (4, prose(8, 80))]) and len(kept) == 6


def test_columns_with_names_of_the_pipeline(spark, prose, tmp_path):
    names = "_gone _key _row _same _spans key row spans count is_first text_key node draw source_size _one".split()
    spark.createDataFrame([(1, prose(900, 30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(
        [(k, prose(k % 9, 40), "aa", "s", 1) for k in range(30)] + [(None, prose(1, 40), "aa", "s", 1)] * 2,
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    ).selectExpr("*", *(f"'x' as `{n}`" for n in names), "map('a', 1) as `_map`")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    kept = at.collect()
    assert len(kept) == 9 and all(r._gone == "x" and r._map == {"a": 1} for r in kept)
    assert corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count() == 9
