"""Spelling variants of a corpus's words: near pairs by pivotal grams, and the form each word goes back to.

Words that differ by one edit share a gram of two letters that the edit leaves
alone. Each word's bigrams are ordered from rare to frequent; its prefix is the
three first ones (with equal ones of the last), and its pivots are two disjoint
grams of the prefix whose lists are shortest, chosen by dynamic programming. One edit
spoils one pivot at most, so of two near words a pivot of one lies in the prefix
of the other. A common gram that the edit left alone has all code points on one side
of it equal, and its place moves by the difference in length only; so pivots and
prefixes meet under keys made of the gram's side and place, not under the gram alone. Where
much lies on the other side, halves of it go into the key as well (an edit leaves one
half alone), until ``REST`` code points at most are open, so no frequent gram gathers a
group. The Levenshtein distance of the whole words decides on every candidate.

The text's words are runs of letters in lower case of A-Z, some of them with a code point
dropped by their checksum with the document's id. Texts that are null or empty have none; a
null id is an empty one in the checksum; documents with the same id and text count
as often as they stand there. Of near words with the same count the smallest is the form.
An empty table gives no words. Other columns than doc_id and text are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.blocks import U, mix64, slices
from pagemill.sources.tables import stored

# Fixed values of the contract.
DAMAGE, LEAST_LENGTH, LEAST_COUNT, OUTWEIGHS = 97, 5, 3, 2
RUN = re.compile("[a-zÀ-ÿ]+").findall
OUTSIDE = re.compile("[^a-zÀ-ÿ]").search

LETTERS = 26 + 64  # code points of the runs, so LETTERS ** 2 grams at most
EDITS = 1
PREFIX = 2 * EDITS + 1  # grams of two: an edit spoils two of them
REST = 3  # code points that candidates may differ in; an eighth of words over 31
PIECE = 1 << 20  # characters of a text that are cut into words at once
HELD = 200_000  # different words that a task counts before it passes them on
WORDS = 50_000  # words that are indexed at once
# Spark sizes these tables by the stored words, in compressed bytes and without the keys that are made of
# them, and would send some hundred times its limit for broadcasts through the driver.
MERGE = "merge"


def document_words(doc_id: object, text: str) -> Iterator[tuple[str, int]]:
    """The words of a text with their counts, damaged where the checksum says so; short ones are left out."""
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    runs: Counter[str] = Counter()
    at = 0
    while at < len(lowered):
        end = OUTSIDE(lowered, at + PIECE) if len(lowered) - at > PIECE else None
        until = end.start() if end else len(lowered)
        runs.update(RUN(lowered[at:until]))
        at = until
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, count in runs.items():
        if len(run) < LEAST_LENGTH:
            continue
        check = zlib.crc32(run.encode(), seed)
        if check % DAMAGE == 0:
            drop = check % len(run)
            run = run[:drop] + run[drop + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, count


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of the texts that stand there often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, int] = defaultdict(int)

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for block in slices(batches, "text", 2 << 20):
            for doc_id, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist()):
                for word, count in document_words(doc_id, text or ""):
                    held[word] += count
            if len(held) > HELD:
                yield told()
                held.clear()
        yield told()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def codes(words: list[str]) -> np.ndarray:
    """Numbers below LETTERS of the code points of words of the same length, a row for each word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.int64)
    return np.where(points < 0xC0, points - ord("a"), points - 0xC0 + 26)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, codes) of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for k in range(0, len(at), max(1, 4_000_000 // int(n))):
            part = at[k : k + max(1, 4_000_000 // int(n))]
            yield part, codes([words[i] for i in part])


def grams_of(code: np.ndarray) -> np.ndarray:
    return code[:, :-1] * LETTERS + code[:, 1:]


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often each of the LETTERS ** 2 grams stands in the words; so many rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**2, np.int64)
        for batch in batches:
            for _, code in _by_length(batch.column(0).to_pylist()):
                total += np.bincount(grams_of(code).ravel(), minlength=LETTERS**2)
        yield pa.record_batch([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["gram", "n"])

    found = words.select("word").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(LETTERS**2, np.int64)
    for row in found.collect():
        counts[row.gram] = row.n
    return counts


def prefix_and_pivots(code: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every gram of the words, whether it is in the prefix; places of the two pivots."""
    grams = grams_of(code)
    order = np.empty(len(counts), np.int64)
    order[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    rank = order[grams]
    last = np.partition(rank, PREFIX - 1, axis=1)[:, PREFIX - 1]
    prefix = rank <= last[:, None]
    never = np.iinfo(np.int64).max // 4
    cost = np.where(prefix, counts[grams], never)
    rows = np.arange(len(code))
    one = np.full(len(code), never)  # least cost of a gram that ends before the next pivot, and its place
    one_at = np.zeros(len(code), np.int64)
    two = np.full(len(code), 2 * never)
    pivots = np.zeros((len(code), 2), np.int64)
    for p in range(2, grams.shape[1]):
        better = cost[:, p - 2] < one
        one = np.where(better, cost[:, p - 2], one)
        one_at = np.where(better, p - 2, one_at)
        better = one + cost[:, p] < two
        two = np.where(better, one + cost[:, p], two)
        pivots[better] = np.stack([one_at[better], np.full(better.sum(), p)], 1)
    assert prefix[rows, pivots[:, 0]].all() and prefix[rows, pivots[:, 1]].all()
    return prefix, pivots


def _hashes(code: np.ndarray) -> np.ndarray:
    """Hash of the first 0, 1, 2 ... code points of every word."""
    out = np.zeros((len(code), code.shape[1] + 1), U)
    for k in range(code.shape[1]):
        out[:, k + 1] = mix64(out[:, k] * U(0x9E3779B97F4A7C15) + code[:, k].astype(U) + U(1))
    return out


def keys(code: np.ndarray, word: np.ndarray, place: np.ndarray, is_pivot: bool) -> tuple[np.ndarray, np.ndarray]:
    """(word, key) under which the grams at ``place`` of the words meet those of other words.

    Three kinds of pairs meet apart: equal lengths, the pivot's word shorter, or longer
    by one. ``left`` and ``right`` code points at the ends are equal; of the shorter word
    ``open_`` lie between them.
    """
    n = code.shape[1]
    parts = []
    for kind in (0, 1, 2):
        longer = kind == (2 if is_pivot else 1)
        for left, right in ((place + 2, np.zeros_like(place)), (np.zeros_like(place), n - place)):
            parts.append((word, left, right, n - left - right - longer, np.full(len(word), kind)))
    word, left, right, open_, kind = (np.concatenate([p[k] for p in parts]) for k in range(5))
    fits = open_ >= (kind == 0)
    state = [x[fits] for x in (word, left, right, open_, kind)]
    rest = np.where(state[4] == (2 if is_pivot else 1), n - 1, n) // 8  # of the shorter word, so both of a pair stop alike
    done = []
    while len(state[0]):
        word, left, right, open_, kind = state
        small = open_ <= np.maximum(REST, rest)
        done.append([x[small] for x in state])
        word, left, right, open_, kind, rest = (x[~small] for x in (*state, rest))
        half = open_ // 2
        state = [np.concatenate(x) for x in ((word, word), (left + half, left), (right, right + open_ - half), (open_ - half, half), (kind, kind))]
        rest = np.concatenate([rest, rest])
    word, left, right, open_, kind = (np.concatenate([d[k] for d in done]) for k in range(5))
    ends = mix64(_hashes(code)[word, left] * U(0xD6E8FEB86659FD93) + _hashes(code[:, ::-1])[word, right])
    shape = (left.astype(U) * U(0x9E3779B97F4A7C15) + right.astype(U)) * U(0xBF58476D1CE4E5B9) + open_.astype(U) * U(4) + kind.astype(U)
    return word, mix64(ends + mix64(shape))


def index(words: DataFrame, counts: np.ndarray, pivots: bool) -> DataFrame:
    """(key, word) of the pivots, or of the prefixes, of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for at, code in _by_length(column.to_pylist()):
                prefix, pair = prefix_and_pivots(code, counts)
                word, place = (np.repeat(np.arange(len(code)), 2), pair.ravel()) if pivots else np.nonzero(prefix)
                for k in range(0, len(word), WORDS):
                    owner, key = keys(code, word[k : k + WORDS], place[k : k + WORDS], pivots)
                    yield pa.record_batch([pa.array(key.view(np.int64)), column.take(pa.array(at[owner]))], ["key", "word"])

    return words.select("word").mapInArrow(run, "key bigint, word string")


def near_pairs(words: DataFrame, counts: np.ndarray | None = None) -> DataFrame:
    """(a, b) with a < b of all words that differ by one inserted, deleted or replaced code point."""
    counts = gram_counts(words) if counts is None else counts
    pivot, prefix = index(words, counts, True).alias("l"), index(words, counts, False).alias("r")
    found = pivot.join(prefix.hint(MERGE), (F.col("l.key") == F.col("r.key")) & (F.levenshtein(F.col("l.word"), F.col("r.word"), 1) == 1))
    return found.select(F.least("l.word", "r.word").alias("a"), F.greatest("l.word", "r.word").alias("b")).distinct()


def forms(words: DataFrame) -> DataFrame:
    """word, n, n_near, form and form_n of the words (word, n)."""
    pairs = stored(near_pairs(words), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("word").alias("b"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "b")).alias("best")
    near = both.join(other.hint(MERGE), "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best)
    joined = words.join(near.hint(MERGE), "word", "left")
    has = -F.col("best.less") >= OUTWEIGHS * F.col("n")
    return joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(has, F.col("best.b")).alias("form"),
        F.when(has, -F.col("best.less")).alias("form_n"),
    )


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the end of their forms, by doubling steps.

    Counts double from word to form, so there are at most as many steps as a count has bits.
    """
    at = stored(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = at.join(ahead.hint(MERGE), F.col("root") == F.col("_word"), "left")
        moved = joined.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved"))
        moved = stored(moved, "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of the texts."""
    found = stored(forms(stored(vocabulary(docs), "spelling-words")), "spelling-forms")
    joined = found.join(roots(found).hint(MERGE), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
