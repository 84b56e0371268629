"""Character sets told by likelihood."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions.charsets import detect_charset
from pagemill.functions.encoding import decode_detected

TEXTS = {
    "GBK": "今天天气很好，我们一起去公园玩。他说这个问题很重要，需要认真研究。",
    "Big5": "今天天氣很好，我們一起去公園玩。他說這個問題很重要，需要認真研究。",
    "Shift_JIS": "今日はとても天気がいいので、公園へ散歩に行きました。コンピュータの問題を研究する。",
    "EUC-KR": "오늘은 날씨가 아주 좋아서 공원에 산책하러 갔습니다. 이 문제는 매우 중요하다.",
    "ISO-8859-1": "Él dijo que «mañana» será otro día; où êtes-vous, Fräulein Müßig?",
    "UTF-8": "naïve 日本 한국",
}


@pytest.mark.parametrize("around", ["{}", "plain words before {} and after", "{}\n" * 300])
def test_sentences_of_each_set(spark, around):
    rows = [(name, around.replace("{}", text), bytearray(around.replace("{}", text).encode(name))) for name, text in TEXTS.items()]
    frame = spark.createDataFrame(rows, "name string, written string, content binary")
    for r in decode_detected(frame).collect():
        assert (r.encoding, r.text) == (r.name.lower(), r.written) and r.confidence > 0.99


def test_other_bytes(values):
    junk = [None, bytearray(b""), bytearray(b"ascii only"), bytearray(bytes(range(256)) * 20), bytearray(b"\xff" * 100_000), bytearray(b"\x80a" * 100_000)]
    got = values(detect_charset, junk, "binary")
    assert got[0] is None and [g.charset for g in got[1:3]] == ["UTF-8"] * 2
    assert all(0 < g.confidence <= 1 for g in got[3:])


def test_extra_columns_stay(spark):
    frame = spark.createDataFrame([(1, bytearray(b"x"), "kept")], "charset int, content binary, _found string")
    row = decode_detected(frame).select(F.struct("*").alias("r")).first().r
    assert (row.charset, row._found, row.text, row.encoding) == (1, "kept", "x", "utf-8")


def test_bytes_are_looked_up_not_matched(spark):
    import math
    import random

    from pagemill.functions import charsets as cs

    def plainly(name, raw):
        inside = lambda ranges, b: any(x <= b <= y for x, y in ranges)
        pair = lambda two: next((k for k, (f, s, _) in enumerate(cs.SETS[name]) if s and inside(f, two[0]) and inside(s, two[1])), None)
        logs = [math.log(p / (cs._codes(f) * max(cs._codes(s), 1))) for f, s, p in cs.SETS[name]] + [math.log(cs.NEVER)]
        at, total = 0, 0.0
        while at < len(raw):
            k = pair(raw[at : at + 2]) if at + 1 < len(raw) else None
            if k is not None:
                at, total = at + 2, total + logs[k]
                continue
            if raw[at] >= 0x80:
                total += logs[next((k for k, (f, s, _) in enumerate(cs.SETS[name]) if not s and inside(f, raw[at])), -1)]
            at += 1
        if name == cs.LATIN1:
            follows = [x >= 0x80 for x in raw[:-1]]
            total += sum(math.log(cs.FOLLOWS if k and follows[k - 1] else 1 - cs.FOLLOWS) for k, b in enumerate(raw) if b >= 0x80)
        return total

    rng = random.Random(5)
    raws = [bytes(rng.choices([*range(0x3F, 0x100), 0x0A], k=rng.randint(1, 60))) for _ in range(200)] + [b"\xb0", b"\xa1\xa1" * 50_000, b"\xa1", b"", b"plain"]
    rows = [(k, bytearray(r)) for k, r in enumerate(raws)] + [(len(raws), None)]
    found = spark.createDataFrame(rows, "k int, content binary").repartition(2).select("k", detect_charset(F.col("content")).alias("c"))
    assert "regexp" not in found._jdf.queryExecution().executedPlan().toString().lower()
    for k, c in found.collect():
        raw = raws[k] if k < len(raws) else None
        if raw is None:
            assert c is None
        elif b"" == raw or raw == b"plain":
            assert (c.charset, c.confidence) == ("UTF-8", 1.0)
        else:
            scores = {name: plainly(name, raw) for name in cs.SETS}
            best = max(scores.values())
            try:
                raw.decode()
                assert c.charset == "UTF-8"
            except UnicodeDecodeError:
                assert scores[c.charset] > best - 1e-6
                assert abs(1 / c.confidence - sum(math.exp(max(s - best, -700)) for s in scores.values())) < 1e-6
