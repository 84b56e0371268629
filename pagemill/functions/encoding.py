"""Bytes to text, and opaque page cursors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.charsets import SETS, UTF8, detect_charset
from pagemill.functions.text import let, replacement_count

_LENIENT = {
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
}


@contextmanager
def any_charset(spark: SparkSession) -> Iterator[None]:
    """Let ``encode`` and ``decode`` accept GBK and replace bad bytes.

    The two settings are read when the expression is analysed, so they hold for
    the plan built inside the block and leave the session as it was.
    """
    before = {key: spark.conf.get(key, None) for key in _LENIENT}
    for key, value in _LENIENT.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def decode_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``text`` and ``encoding`` to a table of file bytes.

    A byte-order mark decides: that of UTF-8 is dropped, those of UTF-16 are
    followed. Other bytes that are valid UTF-8 are taken as they are; the rest is
    read as GBK and as UTF-8 with replacement characters, and the reading that
    loses fewer characters is kept.
    """
    marks = [F.unhex(F.lit(mark)) for mark in ("FFFE", "FEFF")]

    # Each step is evaluated once a row, and what reads the text later reads a column.
    def read(raw: Column) -> Column:
        marked = F.substring(raw, 1, 3) == F.unhex(F.lit("EFBBBF"))
        body = F.when(marked, F.substring(raw, F.lit(4), F.octet_length(raw))).otherwise(raw)
        wide = F.struct(F.decode(raw, "UTF-16").alias("text"), F.lit("utf-16").alias("encoding"))
        return F.when(F.substring(raw, 1, 2).isin(*marks), wide).otherwise(let(body.cast("string"), narrow(raw)))

    def narrow(raw: Column) -> Callable[[Column], Column]:
        def told(text: Column) -> Column:
            plain = F.struct(text.alias("text"), F.lit("utf-8").alias("encoding"))
            both = F.struct(F.make_valid_utf8(text).alias("utf8"), F.decode(raw, "GBK").alias("gbk"))
            return F.when(F.is_valid_utf8(text), plain).otherwise(let(both, better))

        return told

    def better(both: Column) -> Column:
        use_gbk = F.coalesce(replacement_count(both["gbk"]) < replacement_count(both["utf8"]), F.lit(False))
        gbk = F.struct(both["gbk"].alias("text"), F.lit("gbk").alias("encoding"))
        return F.when(use_gbk, gbk).otherwise(F.struct(both["utf8"].alias("text"), F.lit("utf-8").alias("encoding")))

    with any_charset(files.sparkSession):
        whole = files.select("*", F.inline(F.array(let(F.col(content), read))))
    return whole.withColumn("encoding", F.when(F.col("text").isNotNull(), F.col("encoding")))


def decode_detected(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``text``, ``encoding`` and ``confidence``: bytes read in the set that makes them most likely.

    Bytes that the set has no character for are replacement characters.
    """
    raw = F.col(content)

    def read(found: Column) -> Column:
        text = F.when(found["charset"] == UTF8, raw.cast("string"))
        for charset in SETS:
            text = text.when(found["charset"] == charset, F.decode(raw, charset))
        return F.struct(text.alias("text"), F.lower(found["charset"]).alias("encoding"), found["confidence"].alias("confidence"))

    with any_charset(files.sparkSession):
        whole = files.select("*", F.inline(F.array(let(detect_charset(raw), read))))
    return whole


def encode_cursor(created_at: Column, row_id: Column) -> Column:
    """The sort key of a row as URL-safe base64 of a JSON object."""
    payload = F.to_json(
        F.struct(
            F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
            row_id.cast("string").alias("id"),
        )
    )
    packed = F.regexp_replace(F.base64(payload.cast("binary")), F.lit(r"[\r\n]"), F.lit(""))
    return F.translate(packed, "+/", "-_")


def decode_cursor(cursor: Column) -> Column:
    """``struct(created_at string, id string)`` of a cursor, null if it is not one."""
    raw = F.unbase64(F.translate(cursor, "-_", "+/")).cast("string")
    return F.from_json(raw, "created_at string, id string")
