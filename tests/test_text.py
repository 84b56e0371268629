import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.constants import WS_CHARS
from pagemill.functions import text as tx


def test_strip_is_python_strip(values):
    samples = ["", "  ", "a", "\x1c a b\x85", "　中 文 ", "\xa0x\t\n"]
    assert values(tx.strip, samples) == [s.strip() for s in samples]


def test_white_space_characters_are_those_of_python():
    assert sorted(WS_CHARS) == [chr(c) for c in range(0x110000) if chr(c).isspace()]


def test_paragraphs_follow_blank_lines(values):
    samples = ["a\n\nb", "a\n \t\nb\n\n\n\nc\n", "one\ntwo", "", " \n\n ", "\n\na", "x\n\x0b\n\ny"]
    expected = [[p.strip() for p in re.split(r"\n\s*\n", s) if p.strip()] for s in samples]
    assert values(tx.paragraphs, samples) == expected


def test_noise_counts_what_can_be_seen(values):
    samples = ["\x01" * 4 + "abcdef", "\x01" * 5 + "abcde", "", "​​ab", "中文字", "\x02\n\n\n"]
    def share(s):
        return sum(c.isprintable() or c in "\n\r\t" for c in s) / len(s)
    assert values(tx.is_noise, samples) == [not s or share(s) < 0.6 for s in samples]


def test_text_paragraphs_drop_noise(values):
    assert values(tx.text_paragraphs, ["good text\n\n\x01\x02\x03\x04a\n\nmore"]) == [["good text", "more"]]


def test_blank_needs_ten_characters(values):
    assert values(tx.is_blank_text, ["a b c d e f g h i", "abcdefghij", "   \n", ""]) == [True, False, True, True]


def test_sanitize_keeps_tab_and_line_ends(values):
    dirty = "".join(chr(c) for c in range(0x00, 0xA1)) + "é😀"
    kept = "".join(c for c in dirty if c in "\t\n\r" or not (ord(c) < 32 or 127 <= ord(c) <= 159))
    assert values(tx.sanitize, [dirty]) == [kept]


def test_lengths_and_tokens_count_code_points(values):
    assert values(tx.token_estimate, ["", "a", "abc", "😀" * 5]) == [1, 1, 1, 2]


@pytest.mark.parametrize(
    "name, kind",
    [(".hidden", ""), ("x.", ""), ("a.tar.gz", ".gz"), ("A.PDF", ".pdf"), ("dir.d/file", ""),
     ("p/q.Md", ".md"), ("", ""), ("a..b", ".b"), ("no", "")],
)
def test_file_type(values, name, kind):
    assert values(tx.file_type, [name]) == [kind]


def test_garbled_warning_above_five_percent(values):
    under, over = "�" * 5 + "a" * 95, "�" * 6 + "a" * 94
    assert values(tx.garbled_warning, [under, over, "fine", ""]) == [
        None, "encoding_quality_poor: 6 characters lost (6.0%)", None, None,
    ]


def test_percent_rounds_as_python(values):
    shares = [0.1125, 0.5, 1 / 3, 0.06349, 0.05005]
    assert values(tx.percent, shares, "double") == [f"{s:.1%}" for s in shares]


def test_json_and_citation(values):
    samples = ['{"a": 1}', '{"a": 1} x', "[1, 2]", "3", '"s"', "", "  ", "{", "null",
               '{"a":1},"b":{}', "1,2", "1],[2", '1},{"x":2', " [1] "]
    assert values(tx.has_json, samples) == [
        True, False, True, True, True, False, False, False, True, False, False, False, False, True,
    ]
    marked = ["see [1]", "见来源", "a Reference", "none [3]", "参见"]
    assert values(tx.has_citation, marked) == [True, True, True, False, True]


def test_words_and_excerpt(values):
    assert values(tx.word_count, ["", " a  b\nc ", "中文 字"]) == [0, 3, 2]
    cut = values(tx.excerpt, ["a" * 500, "a" * 501])
    assert cut[0] == "a" * 500 and cut[1] == "a" * 500 + "\n...(truncated)"


def test_let_evaluates_arrays_once(values):
    assert values(lambda x: tx.let(F.split(x, ","), lambda a: F.size(a) + F.size(a)), ["a,b"]) == [4]


def test_random_paragraphs(values):
    rng = random.Random(3)
    samples = ["".join(rng.choice("ab \n\n\t\x0c") for _ in range(60)) for _ in range(50)]
    expected = [[p.strip() for p in re.split(r"\n\s*\n", s) if p.strip()] for s in samples]
    assert values(tx.paragraphs, samples) == expected


def test_a_text_is_decoded_once_a_row(spark):
    from pagemill.functions.encoding import decode_text

    made = F.translate(F.col("content").cast("string"), "h", "�").cast("binary")
    files = spark.createDataFrame([(1, bytearray(b"h\xc3\xa9h")), (2, None), (3, bytearray(b"\xff\xfea\0")), (4, bytearray("编".encode("gbk")))], "id int, content binary")
    read = decode_text(files.withColumn("content", F.when(F.col("id") == 1, made).otherwise(F.col("content"))))
    assert [(r.text, r.encoding) for r in read.orderBy("id").collect()] == [("�é�", "utf-8"), (None, None), ("a", "utf-16"), ("编", "gbk")]
    plan = read.select(F.length("text"), F.sha2("text", 256), "encoding")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
