"""Text measures and clean-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.constants import (
    BLANK_TEXT_CHARS,
    CITATION_MARKERS,
    CONTROL_CHARS,
    EXCERPT_CHARS,
    GARBLED_SHARE,
    NOISE_PRINTABLE_SHARE,
    REPLACEMENT_CHAR,
    WS,
    WS_CHARS,
)

NON_PRINTABLE = r"[\p{C}\p{Z}&&[^ \n\r\t]]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, F.lit(f"{WS}+"), F.lit(" ")))


def word_count(text: Column) -> Column:
    words = F.split(text, f"{WS}+")
    return F.size(F.filter(words, lambda w: w != ""))


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def is_blank_text(text: Column, threshold: int = BLANK_TEXT_CHARS) -> Column:
    return F.length(F.regexp_replace(text, F.lit(f"{WS}+"), F.lit(""))) < threshold


def printable_share(text: Column) -> Column:
    visible = F.length(F.regexp_replace(text, F.lit(NON_PRINTABLE), F.lit("")))
    return visible / F.nullif(F.length(text), F.lit(0))


def is_noise(text: Column, threshold: float = NOISE_PRINTABLE_SHARE) -> Column:
    """Empty, or too few characters a reader could see."""
    return F.coalesce(printable_share(text) < threshold, F.lit(True))


def replacement_count(text: Column) -> Column:
    return count_char(text, REPLACEMENT_CHAR)


def replacement_share(text: Column) -> Column:
    return replacement_count(text) / F.greatest(F.length(text), F.lit(1))


def percent(share: Column) -> Column:
    return F.concat(F.format_number(share * 100, 1), F.lit("%"))


def garbled_warning(text: Column, threshold: float = GARBLED_SHARE) -> Column:
    """A warning when the text lost too much in decoding, else null."""
    return F.when(
        replacement_share(text) > threshold,
        F.concat(
            F.lit("encoding_quality_poor: "),
            replacement_count(text).cast("string"),
            F.lit(" characters lost ("),
            percent(replacement_share(text)),
            F.lit(")"),
        ),
    )


def sanitize(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL_CHARS), F.lit(""))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def token_estimate(text: Column) -> Column:
    """Half a token per character, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) * F.lit(0.5)).cast("int"))


def file_type(name: Column) -> Column:
    """Last extension with its dot, lower-cased; '' for none and for dot files."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)\z", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def has_citation(text: Column) -> Column:
    found = F.lit(False)
    for marker in CITATION_MARKERS:
        found = found | F.contains(text, F.lit(marker))
    return found


def has_json(text: Column) -> Column:
    """The whole text is one JSON value.

    The parser stops at the end of the first value. What may follow a value in
    an object and what may follow one in an array exclude each other, so only a
    text that is one value passes both.
    """
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return in_object.isNotNull() & in_array.isNotNull() & (strip(text) != "")


def excerpt(text: Column, chars: int = EXCERPT_CHARS) -> Column:
    cut = F.substring(text, 1, chars)
    return F.when(F.length(text) > chars, F.concat(cut, F.lit("\n...(truncated)"))).otherwise(cut)


def iso_micros(ts: Column) -> Column:
    """A fixed-width ISO stamp that sorts like the time it shows."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def paragraphs(text: Column) -> Column:
    """Stripped pieces between blank lines, in order; '' pieces are dropped."""
    pieces = F.transform(F.split(text, rf"\n{WS}*\n"), strip)
    return F.filter(pieces, lambda p: p != "")


def text_paragraphs(text: Column) -> Column:
    """Paragraphs of a text file: those a reader could not see are dropped too."""
    return F.filter(paragraphs(text), lambda p: ~is_noise(p))


def page_paragraphs(text: Column) -> Column:
    """Paragraphs of a page: those with hardly any character are dropped too."""
    return F.filter(paragraphs(text), lambda p: ~is_blank_text(p))
