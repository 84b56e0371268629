"""Test items inside training texts, by BM25 search with block-max WAND.

The test items, cut into parts of at most ``PART`` words, are the documents of an
inverted index. Every training passage is a query: passages are two neighbouring
blocks of ``PART`` words, so every part-long stretch of a text lies whole in one of
them, and together they cover all of the text. A posting's impact is its BM25
weight as a share of what the part would score against itself; all parts at which
a passage reaches ``THRESHOLD`` are retrieved. Retrieved items are then verified:
word trigrams of the item's question (all sentences but the last) and of its
answer (the last sentence) are looked up around the passage.

Items are searched in shards of about ``SHARD`` items; ``AT_ONCE`` indexes of shards are
sent to all tasks and searched in one scan of the corpus, so a larger benchmark means more
scans, not a larger broadcast. Document
frequencies, the number of parts and their mean length are those of all items.

Defined cases: a null text or one without words has no passages; an item without
words is never found; repeated items are found each, repeated rows give equal
results, and a null doc_id or item_id stays null. Only doc_id and text, item_id
and text are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.blocks import BLOCK_BYTES, U, grams, lower_ascii, slices, text_bytes, words
from pagemill.sources.tables import stored

PART = 64  # words
THRESHOLD = 0.6  # of a part's own score
K1, B = 1.2, 0.75
POSTINGS = 32  # of a block of a posting list
RANGES = 128  # of part numbers, whose largest impacts bound a passage before it is searched
SHARD, AT_ONCE = 4_000, 8  # items of an index; indexes that one scan of the corpus searches
TRIGRAM = 3
QUESTION, ANSWER, WHOLE = 0.6, 0.5, 0.7  # least overlaps
SCHEMA = "doc_id bigint, item_id bigint, score double, start_word bigint, question_overlap double, answer_overlap double"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64())]
    + [("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]
)


@dataclass
class Item:
    item_id: int | None
    length: int
    question: np.ndarray  # trigrams
    answer: np.ndarray


def _pieces(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the trigrams, or of all words if there are fewer than three."""
    return np.unique(grams(hashes, min(TRIGRAM, len(hashes)))) if len(hashes) else np.zeros(0, U)


def parse_item(item_id: int | None, raw: bytes) -> tuple[Item, np.ndarray]:
    """An item's question and answer, and its words."""
    hashes, starts, _, joined, _ = words([lower_ascii(raw)])
    ends = [m.end() for m in re.finditer(rb"[.?!](?=[\x20\x09-\x0D])|\n", joined.rstrip())]
    cut = int(np.searchsorted(starts, ends[-1])) if ends else 0
    if not 0 < cut < len(hashes):
        cut = len(hashes) - len(hashes) // 4
    return Item(item_id, len(hashes), _pieces(hashes[: cut + 2 if cut < len(hashes) else cut]), _pieces(hashes[cut:])), hashes


@dataclass
class Posting:
    parts: list[int]
    impacts: list[float]
    top: float
    block_tops: list[float]


@dataclass
class Statistics:
    """Of all parts of a benchmark; words, in order, and the parts that hold each are those that a shard needs."""

    n_parts: int
    mean: float  # words of a part
    words: np.ndarray
    df: np.ndarray


class Index:
    """BM25 impacts of item parts by word, with the largest impact of every list and block."""

    def __init__(self, items: list[tuple[int | None, bytes]], known: Statistics | None = None) -> None:
        """``known``: statistics of all items, if these are not all."""
        parsed = [parse_item(*x) for x in items]
        self.items = [item for item, _ in parsed]
        cut = [(i, h[a : a + PART]) for i, (_, h) in enumerate(parsed) for a in range(0, len(h), PART)]
        self.owner = [i for i, _ in cut]
        counts = [np.unique(h, return_counts=True) for _, h in cut]
        self.words, df = np.unique(np.concatenate([w for w, _ in counts] or [np.zeros(0, U)]), return_counts=True)
        n_parts, mean = len(cut), sum(len(h) for _, h in cut) / max(len(cut), 1)
        if known is not None:
            n_parts, mean = known.n_parts, known.mean
            df = known.df[np.searchsorted(known.words, self.words)]
        idf = np.log(1 + (n_parts - df + 0.5) / (df + 0.5))
        lists: list[tuple[list[int], list[float]]] = [([], []) for _ in self.words]
        for part, (word, n) in enumerate(counts):
            at = np.searchsorted(self.words, word)
            size = float(n.sum())
            weight = idf[at] * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean))
            for k, impact in zip(at.tolist(), (weight / weight.sum()).tolist()):
                lists[k][0].append(part)
                lists[k][1].append(impact)
        self.lists = [
            Posting(p, w, max(w), [max(w[a : a + POSTINGS]) for a in range(0, len(w), POSTINGS)]) for p, w in lists
        ]
        self.range_tops = np.zeros((len(self.lists), RANGES), np.float32)
        width = -(-max(len(cut), 1) // RANGES)
        for k, x in enumerate(self.lists):
            np.maximum.at(self.range_tops[k], np.array(x.parts) // width, x.impacts)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the index, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """(part, score) of all parts that reach the threshold, by block-max WAND."""
        cursor = [[self.lists[t].parts[0], 0, self.lists[t]] for t in terms]
        found = []
        while cursor:
            cursor.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursor):
                total += c[2].top
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            part = cursor[pivot][0]
            while pivot + 1 < len(cursor) and cursor[pivot + 1][0] == part:
                pivot += 1
            bound, skip = 0.0, math.inf
            for c in cursor[: pivot + 1]:
                at = _seek(c, part) // POSTINGS
                if at < len(c[2].block_tops):
                    bound += c[2].block_tops[at]
                    skip = min(skip, c[2].parts[min((at + 1) * POSTINGS, len(c[2].parts)) - 1] + 1)
            if bound < threshold:
                follow = cursor[pivot + 1][0] if pivot + 1 < len(cursor) else math.inf
                target = max(min(skip, follow), part + 1)
            else:
                score = sum(c[2].impacts[at] for c in cursor[: pivot + 1] if (at := _at(c, part)) >= 0)
                if score >= threshold:
                    found.append((part, score))
                target = part + 1
            for c in cursor[: pivot + 1]:
                c[1] = _seek(c, target)
                c[0] = c[2].parts[c[1]] if c[1] < len(c[2].parts) else math.inf
            cursor = [c for c in cursor if c[0] != math.inf]
        return found


def _seek(cursor: list, part: float) -> int:
    """Place of the first posting of ``part`` or later, from the cursor on."""
    parts = cursor[2].parts
    low, high = cursor[1], len(parts)
    while low < high:
        mid = (low + high) // 2
        if parts[mid] < part:
            low = mid + 1
        else:
            high = mid
    return low


def _at(cursor: list, part: int) -> int:
    at = _seek(cursor, part)
    return at if at < len(cursor[2].parts) and cursor[2].parts[at] == part else -1


def share(wanted: np.ndarray, there: np.ndarray) -> float:
    return float(np.isin(wanted, there).mean()) if len(wanted) else 0.0


def overlaps(item: Item, around: np.ndarray) -> tuple[float, float, bool]:
    """Shares of the question and of the answer found among these words, and whether that is a leak."""
    there = np.concatenate([grams(around, n) for n in range(1, TRIGRAM + 1)])
    question, answer = share(item.question, there), share(item.answer, there)
    whole = share(np.concatenate([item.question, item.answer]), there)
    return question, answer, (question >= QUESTION and answer >= ANSWER) or whole >= WHOLE


def leaks_of(index: Index, texts: list[bytes]) -> list[tuple]:
    """(text, item_id, score, start word, overlaps) of all verified items of the texts."""
    hashes, _, _, _, before = words([lower_ascii(t) for t in texts])
    sizes = np.diff(before)
    number = index.numbers(hashes)
    blocks = np.maximum(-(-sizes // PART), 1)
    base = np.cumsum(blocks) - blocks
    text = np.repeat(np.arange(len(texts)), sizes)
    block = base[text] + (np.arange(len(hashes)) - before[text]) // PART
    known = number >= 0
    pairs = np.unique(block[known] * (len(index.words) + 1) + number[known])
    block, term = pairs // (len(index.words) + 1), pairs % (len(index.words) + 1)
    edges = np.searchsorted(block, np.arange(int(blocks.sum()) + 1))
    filled = np.flatnonzero(np.diff(edges))
    bound = np.zeros((int(blocks.sum()), RANGES), np.float32)
    if len(filled):
        bound[filled] = np.add.reduceat(index.range_tops[term], edges[filled], axis=0)
    owner = np.repeat(np.arange(len(texts)), blocks)
    follows = np.append(owner[1:] == owner[:-1], False)
    alone = ~follows & np.insert(owner[1:] != owner[:-1], 0, True)
    bound[:-1][follows[:-1]] += bound[1:][follows[:-1]]  # a passage is two blocks
    likely = bound.max(1) >= THRESHOLD - 1e-4
    out = []
    for b in np.flatnonzero(likely & (follows | alone)):
        last = b + 2 if follows[b] else b + 1
        terms = np.unique(term[edges[b] : edges[last]])
        i = int(owner[b])
        start = int(b - base[i]) * PART
        for part, score in index.search(terms.tolist()):
            item = index.items[index.owner[part]]
            low = int(before[i]) + max(start - item.length, 0)
            high = min(int(before[i]) + start + 2 * PART + item.length, int(before[i + 1]))
            question, answer, leak = overlaps(item, hashes[low:high])
            if leak:
                out.append((i, item.item_id, score, start, question, answer))
    return out


def part_words(items: DataFrame) -> DataFrame:
    """(word, size, shard): a row for each distinct word of every part of these items, and one without a word per part."""

    def run(batches):  # noqa: ANN001, ANN202
        for block in slices(batches, "text", BLOCK_BYTES // 8):
            word, size, shard = [], [], []
            for raw, k in zip(text_bytes(block.column("text")), block.column("shard").to_pylist()):
                hashes = parse_item(None, raw)[1]
                for a in range(0, len(hashes), PART):
                    mine = hashes[a : a + PART]
                    own = np.unique(mine).view(np.int64).tolist()
                    word += [None, *own]
                    size += [len(mine)] * (len(own) + 1)
                    shard += [k] * (len(own) + 1)
            columns = [pa.array(word, pa.int64()), pa.array(size, pa.int64()), pa.array(shard, pa.int64())]
            yield pa.record_batch(columns, ["word", "size", "shard"])

    return items.mapInArrow(run, "word bigint, size bigint, shard bigint")


def search_shards(docs: DataFrame, indexes: list[Index]) -> DataFrame:
    """Verified leaks of the items of these indexes in all passages of all texts, in one scan."""
    shared = docs.sparkSession.sparkContext.broadcast(indexes)

    def run(batches):  # noqa: ANN001, ANN202
        for block in slices(batches, "text", BLOCK_BYTES // 2):
            ids, texts = block.column("doc_id").to_pylist(), text_bytes(block.column("text"))
            rows = [(ids[i], *rest) for index in shared.value for i, *rest in leaks_of(index, texts)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 6, ARROW)], schema=ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item that leaked into it, with its best passage."""
    usable = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    shards = max(1, math.ceil(usable.count() / SHARD))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    found, indexes = None, []
    if shards > 1:
        counted = stored(part_words(usable.select("text", shard.cast("bigint").alias("shard"))).groupBy("word", "shard").agg(
            F.count("*").alias("n"), F.sum("size").alias("size")
        ), "benchmark-words")
        whole = counted.where(F.col("word").isNull()).agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
        frequency = counted.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("df"))
    for k in range(shards):
        known = None
        if shards > 1:
            own = counted.where((F.col("shard") == k) & F.col("word").isNotNull()).select("word")
            rows = np.array([(r.word, r.df) for r in frequency.join(own, "word", "left_semi").collect()], np.int64).reshape(-1, 2)
            word, df = np.ascontiguousarray(rows[:, 0]).view(U), rows[:, 1]
            order = np.argsort(word)
            known = Statistics(whole.n or 0, (whole.size or 0) / max(whole.n or 0, 1), word[order], df[order])
        items = sorted(((r.item_id, r.text.encode()) for r in usable.where(shard == k).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        indexes.append(Index(items, known))
        if len(indexes) == AT_ONCE or k == shards - 1:
            part = search_shards(docs, indexes)
            found, indexes = part if found is None else found.unionByName(part), []
    best = F.max_by(F.struct("score", "start_word", "question_overlap", "answer_overlap"), F.struct("score", -F.col("start_word")))
    grouped = found.groupBy("doc_id", "item_id").agg(best.alias("_best"), F.count("*").alias("n_passages"))
    return grouped.select("doc_id", "item_id", "_best.*", "n_passages")
