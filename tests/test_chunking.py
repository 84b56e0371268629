import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from pagemill import ChunkingConfig
from pagemill.functions.chunking import prefix_sums, split_parts
from pagemill.operators import chunking as ch

BLOCKS = (
    "array<struct<block_type:string,text:string,page_number:int,cross_page_boundary:boolean>>"
)
SMALL = ChunkingConfig(max_chars=100, overlap_chars=20, merge_short_threshold=30)
KEPT_APART = {"heading", "code"}


def expected_cuts(text, config):
    """(start, end) of each part, by trying every delimiter in order of priority."""
    cuts, begin = [], 0
    while True:
        goal = begin + config.max_chars
        if goal >= len(text):
            return cuts + [(begin, len(text))]
        # The last character of the text is never searched.
        window = text[goal : min(goal + 200, len(text) - 1)]
        hits = (window.find(d) + len(d) for d in config.split_on if d in window)
        finish = goal + next(hits, 0)
        cuts.append((begin, finish))
        begin = finish - config.overlap_chars


def expected_chunks(blocks, config):
    parts = []
    for kind, text in blocks:
        if kind in KEPT_APART or len(text) <= config.max_chars:
            parts.append((kind, text, None))
        else:
            cuts = expected_cuts(text, config)
            parts += [(kind, text[a:b], i) for i, (a, b) in enumerate(cuts, 1)]
    short = [k not in KEPT_APART and len(t) < config.merge_short_threshold for k, t, _ in parts]
    loose = [k not in KEPT_APART for k, _, _ in parts]
    opens = [i == 0 or not (short[i] and loose[i - 1]) for i in range(len(parts))]
    runs = itertools.groupby(zip(itertools.accumulate(opens), parts), key=lambda p: p[0])
    out = []
    for _, members in runs:
        run = [p for _, p in members]
        marks = (run[0][2] or 0, run[-1][2] or 0) if len(run) > 1 else (None, None)
        out.append((run[0][0], "\n".join(t for _, t, _ in run), *marks))
    return out


def random_text(rng, size):
    alphabet = "abc de fg\n。；，é😀"
    weights = [10] * 9 + [rng.choice([0, 1, 4])] + [rng.choice([0, 1])] * 3 + [1, 1]
    text = "".join(rng.choices(alphabet, weights, k=size))
    return text.replace("\n", "\n\n") if rng.random() < 0.3 else text


def frame(spark, documents):
    rows = [
        (i, [(k, t, None, None) for k, t in blocks]) for i, blocks in enumerate(documents)
    ]
    return spark.createDataFrame(rows, f"doc_id long, blocks {BLOCKS}")


def chunks_of(rows):
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.position)):
        by_doc.setdefault(r.doc_id, []).append(
            (r.block_type, r.text, r.merged_from, r.merged_to)
        )
    return by_doc


@pytest.mark.parametrize(
    "config",
    [SMALL, ChunkingConfig(), ChunkingConfig(100, 0, 0), ChunkingConfig(50, 40, 10), ChunkingConfig(7, 6, 3),
     ChunkingConfig(100, 20, 30, split_on=("ab", "."))],
)
def test_parts_match_the_rule(spark, config):
    rng = random.Random(config.max_chars)
    texts = [random_text(rng, rng.choice([1, 6, 99, 100, 101, 299, 300, 301, 700, 2500])) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", split_parts(F.col("t"), config).alias("p")).collect()
    for r in rows:
        text = texts[r.i]
        cuts = expected_cuts(text, config)
        assert [(p.start, p.end) for p in r.p] == cuts
        assert [p.text for p in r.p] == [text[a:b] for a, b in cuts]
        assert [(p.part, p.total) for p in r.p] == [(n + 1, len(cuts)) for n in range(len(cuts))]


def test_window_ends_before_the_last_character(spark):
    config = ChunkingConfig(10, 0, 0)
    texts = ["a" * 10 + "\n", "a" * 10 + "\nb", "a" * 10 + "\n\n", "a" * 12 + "，b\n\nc", "a" * 10 + "b" * 199 + "\n" + "c" * 30,
             "a" * 10 + "b" * 200 + "\n" + "c" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", split_parts(F.col("t"), config).alias("p")).collect():
        assert [(p.start, p.end) for p in r.p] == expected_cuts(texts[r.i], config)


def test_long_text_is_covered_with_fixed_overlap(spark):
    text = random_text(random.Random(1), 400_000)
    [row] = spark.createDataFrame([(text,)], "t string").select(split_parts(F.col("t"), ChunkingConfig()).alias("p")).collect()
    ends = [p.end for p in row.p]
    assert [p.start for p in row.p] == [0] + [e - 200 for e in ends[:-1]]
    assert ends[-1] == len(text) and all(len(p.text) <= 1200 for p in row.p)
    assert all(p.text == text[p.start : p.end] for p in row.p)


def random_documents(seed, count=120):
    rng = random.Random(seed)
    kinds = ["paragraph", "paragraph", "heading", "code", "list_item", "table"]
    return [
        [(rng.choice(kinds), random_text(rng, rng.choice([0, 5, 29, 30, 60, 150, 400])))
         for _ in range(rng.randint(1, 12))]
        for _ in range(count)
    ]


def test_array_form_matches_the_rules(spark):
    documents = random_documents(5)
    got = chunks_of(ch.chunk_arrays(frame(spark, documents), config=SMALL).collect())
    assert got == {i: expected_chunks(d, SMALL) for i, d in enumerate(documents)}


def test_row_form_equals_array_form_across_segments(spark, monkeypatch):
    from pagemill.operators import segments

    documents = random_documents(6, 40)
    documents.append([("paragraph", "s" * (i % 40)) for i in range(3000)])  # one hot document
    df = frame(spark, documents)
    blocks = df.select("doc_id", F.posexplode("blocks").alias("position", "b")).select("doc_id", "position", "b.*")
    monkeypatch.setattr(ch, "by_position", lambda c: segments.by_position(c, 3))
    rows = ch.merge_short(ch.split_long(blocks, config=SMALL), config=SMALL)
    arrays = ch.chunk_arrays(df, config=SMALL)
    columns = sorted(arrays.columns)
    assert sorted(map(repr, rows.select(columns).collect())) == sorted(map(repr, arrays.select(columns).collect()))


def test_headings_and_code_are_never_cut_and_short_blocks_join(spark):
    documents = [
        [("heading", "h" * 300), ("code", "c" * 300)],
        [("paragraph", "short"), ("paragraph", "also short")],
        [("heading", "H"), ("paragraph", "p"), ("code", "x"), ("paragraph", "q"), ("list_item", "r")],
        [],
    ]
    got = chunks_of(ch.chunk_arrays(frame(spark, documents), config=SMALL).collect())
    assert [t for _, t, _, _ in got[0]] == ["h" * 300, "c" * 300]
    assert got[1] == [("paragraph", "short\nalso short", 0, 0)]
    assert [t for _, t, _, _ in got[2]] == ["H", "p", "x", "q\nr"]
    assert 3 not in got


def test_cross_page_blocks_are_uncertain(spark):
    rows = [(1, [("paragraph", "a" * 250, 4, True), ("paragraph", "b" * 250, 5, None)])]
    df = spark.createDataFrame(rows, f"doc_id long, blocks {BLOCKS}")
    got = ch.chunk_arrays(df, config=SMALL).orderBy("position").collect()
    assert {(r.page_number, r.page_number_certain) for r in got} == {(4, False), (5, True)}


def test_chunk_rows_are_clean_and_hashed(spark):
    df = frame(spark, [[("paragraph", "a\x00b\x07c\td")]])
    [row] = ch.chunk_rows(df).collect()
    assert row.chunk_text == "abc\td"
    assert row.chunk_hash == hashlib.sha256(b"abc\td").hexdigest()
    assert (row.chunk_index, row.token_count, row.page_number) == (0, 2, None)


def test_dedup_keeps_the_first_copy(spark):
    copies = [(d, i, f"text {i % 3}" if d % 2 else "hot") for d in range(30) for i in range(3)]
    df = spark.createDataFrame(copies, "document_id long, chunk_index int, chunk_text string").withColumn(
        "chunk_hash", F.sha2("chunk_text", 256)
    )
    got = {(r.document_id, r.chunk_index, r.chunk_text) for r in ch.dedup_chunks(df).collect()}
    assert got == {(0, 0, "hot"), (1, 0, "text 0"), (1, 1, "text 1"), (1, 2, "text 2")}


def test_renumber_is_dense(spark):
    df = spark.createDataFrame([(1, 10), (1, 3), (1, 20000), (2, 7)], "doc_id long, position int")
    got = {(r.doc_id, r.position) for r in ch.renumber(df).collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (2, 0)}


def test_prefix_sums(values):
    rng = random.Random(2)
    lists = [[rng.randint(0, 9) for _ in range(n)] for n in (1, 2, 3, 4, 5, 17, 64, 65)]
    assert values(prefix_sums, lists, "array<int>") == [list(itertools.accumulate(x)) for x in lists]


@pytest.mark.parametrize("bad", [{"overlap_chars": 1000}, {"overlap_chars": -1}, {"max_chars": 0}, {"split_on": ("",)}, {"merge_short_threshold": -1}])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        ChunkingConfig(**bad)
