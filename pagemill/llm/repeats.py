"""Windows of a text that stand earlier in the corpus, found exactly and without all-pairs work.

A window is ``width`` neighbouring units (bytes or words) of one text. Equal
windows have equal *anchors*: the smallest hash of a gram of ``gram`` units inside
them. Neighbouring windows mostly share their anchor, so a text has far fewer
anchors than windows.

1. Anchors of all texts are grouped by hash; an anchor of one text only cannot
   belong to a window that stands in two texts. Texts get back the anchors that
   do repeat.
2. Runs of windows with a repeated anchor, with the units under them, are grouped
   by anchor, and an operator's own sort decides which windows of a group are
   equal. Of equal windows all but those of the smallest document are repeats.
3. Each text gets back the spans of its repeated windows.

Groups fit in memory: anchors that stand in very many texts are found in a sample
beforehand, and their windows are grouped by all their units instead; of such
windows, equal ones are reduced to their first document before they are moved.
The sample decides on the route only, never on the result.

A row is known by its doc_id and 16 bytes of the SHA-256 of its text. Rows that
share both are equal and get equal results; rows that share the id alone are compared
with smaller ids, and each with itself. A null id counts as the largest one. Between
tasks a text is a number in the block of texts that it was read with; a block's tag
hashes its rows in order, its partition and its number there, and the rows of a
partition come in the order of their keys, so a task that is run again makes the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm import packs
from pagemill.llm.blocks import BLOCK_BYTES, grams, mix64, slices, words

U = np.uint64
LAST = np.iinfo(np.int64).max
FLUSH_BYTES = 32 << 20  # of text whose anchors are packed together
SAMPLED = 16  # one text in so many is looked at for frequent anchors
FREQUENT = 2048  # texts that hold an anchor, by the sample
COMPARED = 300_000  # windows that are compared at once, but for larger groups
HELD = 4_000_000  # results of a task that are packed together
LIST = 20_000  # frequent anchors, at most: no other one has more than its share of 1 / LIST
KEY = np.dtype("V16")
TEXT_SCHEMA = "doc_id bigint, _order bigint, _key binary, _packed binary"

ANCHORS, NAMES, MARKS, RUNS, FOUND = range(5)


@dataclass(frozen=True)
class Rule:
    width: int
    gram: int
    of_words: bool  # units are words, not bytes
    within: bool  # an earlier place in the same text counts too

    @property
    def dtype(self) -> type:
        return np.uint64 if self.of_words else np.uint8


# Which windows are equal: (units, first unit and number of windows of each run,
# anchor group of each run) to a class number for each window, runs one after the other.
Classes = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def units(rule: Rule, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Units of all texts and where each text's begin; one entry more at the end."""
    if rule.of_words:
        hashes, _, _, _, before = words(texts)
        return hashes, before
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def gram_hashes(rule: Rule, data: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` neighbouring units."""
    if rule.of_words:
        return grams(data, n)
    if len(data) < n:
        return np.zeros(0, U)
    power, done, out = data.astype(U) + U(1), 0, None  # power: hashes of 1, 2, 4 ... bytes
    size = 1
    while True:
        if n & size:
            if out is None:
                out = power
            else:
                m = len(power) - done
                out = out[:m] * U(0x9E3779B97F4A7C15) + power[done:]
            done += size
        size *= 2
        if size > n:
            return mix64(out)
        half = size // 2
        power = power[:-half] * U(0xD6E8FEB86659FD93) + power[half:]
        power ^= power >> U(29)
        power *= U(0x94D049BB133111EB)


def smallest(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` neighbours."""
    if len(values) < span:
        return np.zeros(0, values.dtype)
    size = 1
    while size * 2 <= span:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = span - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


@dataclass
class Runs:
    """Windows with the same anchor that follow each other: text, first window (in all units), number, anchor."""

    text: np.ndarray
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray

    def take(self, mine: np.ndarray) -> Runs:
        return Runs(self.text[mine], self.first[mine], self.count[mine], self.anchor[mine])


def runs_of(rule: Rule, data: np.ndarray, bounds: np.ndarray, skip: np.ndarray | None = None) -> Runs:
    """Runs of all texts, without the windows marked in ``skip``."""
    least = smallest(gram_hashes(rule, data, rule.gram), rule.width - rule.gram + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    usable = text[: len(least)] == text[len(text) - len(least) :] if len(least) else np.zeros(0, bool)
    if skip is not None:
        usable &= ~skip
    at = np.flatnonzero(usable)
    if not len(at):
        return Runs(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U)))
    value, owner = least[at], text[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    start = np.flatnonzero(new)
    return Runs(owner[start], at[start], np.diff(np.append(start, len(at))), value[start])


def repeated_inside(rule: Rule, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of every window, whether its own text has it at an earlier place."""
    value = gram_hashes(rule, data, rule.width)
    out = np.zeros(len(value), bool)
    if not len(value):
        return out
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(text[: len(value)] == text[len(text) - len(value) :])
    key = mix64(value[at] ^ (text[at].astype(U) * U(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    here, before = at[order[1:][same]], at[order[:-1][same]]
    out[here] = _equal(data, here, before, rule.width) & (text[here] == text[before])
    return out


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, runs one after the other."""
    total = int(count.sum())
    offset = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(count) else np.zeros(0, np.int64)
    return offset + np.arange(total)


def row_key(raw: bytes) -> bytes:
    """What tells the texts of one id apart."""
    return hashlib.sha256(raw).digest()[: KEY.itemsize]


def block_tag(number: int, order: np.ndarray, key: list[bytes]) -> int:
    """The tag of a task's block of texts."""
    said = hashlib.sha256(np.array([TaskContext.get().partitionId(), number], np.int64).tobytes() + order.tobytes() + b"".join(key))
    return int.from_bytes(said.digest()[:8], "little") >> 1


def name_row(n: int, tag: int, order: np.ndarray, key: list[bytes], needed: np.ndarray) -> packs.Row:
    """The row that says which texts the numbers of a block are."""
    keys = np.frombuffer(b"".join(key), KEY)
    return (tag % n, NAMES, tag, packs.planes(order), packs.planes(keys), packs.planes(needed.astype(np.uint32)))


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, order, key, compressed text) of every row, as texts are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for block in slices(batches, "text", BLOCK_BYTES):
            raw = [x or b"" for x in block.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch(
                [
                    block.column("doc_id"), block.column("_order"), pa.array(list(map(row_key, raw)), pa.binary()),
                    pa.array(list(map(squeeze.compress, raw)), pa.binary()),
                ],
                ["doc_id", "_order", "_key", "_packed"],
            )

    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("_order")
    return docs.select(F.col("doc_id").cast("bigint"), order, "text").mapInArrow(run, TEXT_SCHEMA)


def raw_texts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("_order"), "text")


Extract = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray | None]]


def anchor_extract(rule: Rule) -> Extract:
    """(text, anchor) of all runs, and no need of more than one repeated anchor."""

    def extract(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, None]:
        runs = runs_of(rule, *units(rule, raw))
        sort = np.lexsort((runs.anchor, runs.text))
        text, value = runs.text[sort], runs.anchor[sort]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
        return text[new], value[new], None

    return extract


def _raw(block: pa.RecordBatch) -> list[bytes]:
    if "_packed" in block.schema.names:
        return _unpacked(block)
    return [x or b"" for x in block.column("text").cast(pa.binary()).to_pylist()]


def frequent_values(sampled: DataFrame, extract: Extract, column: str = "text") -> np.ndarray:
    """Values that many texts hold, by a fixed sample of the texts; a sorted list of bounded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in slices(batches, column, BLOCK_BYTES // 2):
            value, count = np.unique(extract(_raw(block))[1], return_counts=True)
            yield pa.record_batch([pa.array(value.view(np.int64)), pa.array(count)], ["anchor", "n"])

    sampled = sampled.where(F.pmod(F.xxhash64("_order"), F.lit(SAMPLED)) == 0)
    counted = sampled.mapInArrow(run, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= FREQUENT // SAMPLED).orderBy(F.desc("n"), "anchor").limit(LIST).collect()
    return np.sort(np.array([r.anchor for r in found], np.int64).view(U))


def sent_values(
    texts: DataFrame, extract: Extract, frequent: np.ndarray, n: int, column: str = "text", back: bool = False
) -> DataFrame:
    """Packed (hash, text) of all values, and the names of the texts of a block.

    Frequent values are known to repeat; they are left out, or go straight ``back`` to their texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        order: list[np.ndarray] = []
        needed: list[np.ndarray] = []
        key: list[bytes] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(order)
            tag = block_tag(number, ids, key)
            every, text = np.concatenate(value), np.concatenate(owner)
            often = np.isin(every, frequent) if len(frequent) else np.zeros(len(every), bool)
            rows = list(packs.cut((every[~often] >> U(32)) % U(n), [every[~often].astype(np.uint32), text[~often]], ANCHORS, tag))
            rows.append(name_row(n, tag, ids, key, np.concatenate(needed)))
            if back and often.any():
                rows.append((tag % n, MARKS, tag, packs.planes(every[often].astype(np.uint32)), packs.planes(text[often])))
            return packs.batch(rows)

        for block in slices(batches, column, BLOCK_BYTES // 2):
            raw = _raw(block)
            text, found, need = extract(raw)
            value.append(found)
            owner.append((text + len(key)).astype(np.uint16))
            order.append(block.column("_order").to_numpy())
            needed.append(np.ones(len(raw), np.uint32) if need is None else need)
            key.extend(map(row_key, raw))
            size += sum(map(len, raw))
            if size >= FLUSH_BYTES or len(key) > 50_000:
                yield flush()
                value, owner, order, needed, key, size = [], [], [], [], [], 0
                number += 1
        if key:
            yield flush()

    return texts.mapInArrow(run, packs.SCHEMA)


def marks(packed: DataFrame, n: int) -> DataFrame:
    """(order, key, repeated values) of every text that has as many as it needs."""

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in packs.groups(batches):
            out = [(r["bucket"], r["kind"], r["tag"], r["a"], r["b"], r["c"]) for r in rows if r["kind"] != ANCHORS]
            rows = [r for r in rows if r["kind"] == ANCHORS]
            if rows:
                value, text = packs.column(rows, "a", np.uint32), packs.column(rows, "b", np.uint16)
                tags = np.repeat(np.array([r["tag"] for r in rows], np.int64), [len(r["b"]) // 2 for r in rows])
                sort = np.argsort(value, kind="stable")
                same = value[sort][1:] == value[sort][:-1]
                mine = sort[np.append(same, False) | np.append(False, same)]
                if len(mine):
                    by = mine[np.argsort(tags[mine], kind="stable")]
                    edges = [0, *(np.flatnonzero(np.diff(tags[by])) + 1).tolist(), len(by)]
                    for a, b in zip(edges, edges[1:]):
                        tag = int(tags[by[a]])
                        out.append((tag % n, MARKS, tag, packs.planes(value[by[a:b]]), packs.planes(text[by[a:b]])))
            yield packs.batch(out)

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in packs.groups(batches):
            for tag in sorted({r["tag"] for r in rows}):
                mine = [r for r in rows if r["tag"] == tag]
                names = next(r for r in mine if r["kind"] == NAMES)
                order, key = packs.values_of(names["a"], np.int64), packs.values_of(names["b"], KEY)
                mine = [r for r in mine if r["kind"] == MARKS]
                value, text = packs.column(mine, "a", np.uint32), packs.column(mine, "b", np.uint16)
                sort = np.lexsort((value, text))
                value, text = value[sort], text[sort]
                edges = np.searchsorted(text, np.arange(len(order) + 1))
                has = np.flatnonzero(np.diff(edges) >= packs.values_of(names["c"], np.uint32))
                yield pa.record_batch(
                    [
                        pa.array(order[has]), pa.array([key[i].tobytes() for i in has], pa.binary()),
                        pa.array([value[edges[i] : edges[i + 1]].tobytes() for i in has], pa.binary()),
                    ],
                    ["_order", "_key", "_marks"],
                )

    back = packs.exchange(packs.exchange(packed).mapInArrow(repeated, packs.SCHEMA))
    found = back.mapInArrow(by_text, "_order bigint, _key binary, _marks binary")
    return found.groupBy("_order", "_key").agg(F.first("_marks").alias("_marks"))


def _unpacked(block: pa.RecordBatch) -> list[bytes]:
    loose = zstandard.ZstdDecompressor()
    return [loose.decompress(x) for x in block.column("_packed").to_pylist()]


def marked_runs(texts: DataFrame, rule: Rule, frequent: np.ndarray, n: int) -> DataFrame:
    """Packed runs of windows with a repeated anchor, what the texts themselves already show, and the names of the texts."""

    def rows_of(tag: int, order: np.ndarray, data: np.ndarray, bounds: np.ndarray, runs: Runs, key: np.ndarray) -> list:
        if not len(runs.text):
            return []
        sort = np.argsort((key >> U(32)) % U(n), kind="stable")
        runs, key = runs.take(sort), key[sort]
        bucket = ((key >> U(32)) % U(n)).astype(np.int64)
        size = runs.count + rule.width - 1
        content = data[spread(runs.first, size)]
        cuts = np.concatenate([[0], np.cumsum(size)])
        start = (runs.first - bounds[runs.text]).astype(np.uint32)
        names = np.empty(len(sort), [("order", np.int64), ("text", np.uint16), ("start", np.uint32), ("count", np.uint32)])
        names["order"], names["text"], names["start"], names["count"] = order[runs.text], runs.text, start, runs.count
        low = key.astype(np.uint32)
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        return [
            (
                int(bucket[a]), RUNS, tag, low[a:b].tobytes(), *(packs.planes(names[f][a:b]) for f in ("order", "text", "start")),
                packs.planes(names["count"][a:b]) + content[cuts[a] : cuts[b]].tobytes(),
            )
            for a, b in zip(edges, edges[1:])
        ]

    def found_rows(tag: int, text: np.ndarray, start: np.ndarray) -> list:
        return list(_found(np.full(len(text), tag), text, start, np.ones(len(start), np.uint32), n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in enumerate(slices(batches, "_packed", BLOCK_BYTES // 4)):
            raw = _unpacked(block)
            order, key = block.column("_order").to_numpy(), block.column("_key").to_pylist()
            tag = block_tag(number, order, key)
            data, bounds = units(rule, raw)
            out = [name_row(n, tag, order, key, np.zeros(len(raw)))]
            inside = None
            if rule.within:
                inside = repeated_inside(rule, data, bounds)
                at = np.flatnonzero(inside)
                text = np.searchsorted(bounds, at, "right") - 1
                out += found_rows(tag, text, at - bounds[text])
            runs = runs_of(rule, data, bounds, inside)
            marked = [np.frombuffer(x or b"", np.uint32) for x in block.column("_marks").to_pylist()]
            known = np.concatenate([m.astype(U) | U(i << 32) for i, m in enumerate(marked)])
            asked = runs.anchor & U(0xFFFFFFFF) | runs.text.astype(U) << U(32)
            mine = runs.take(np.isin(asked, known) & ~np.isin(runs.anchor, frequent))
            out += rows_of(tag, order, data, bounds, mine, mine.anchor)
            if len(frequent):
                often = runs.take(np.isin(runs.anchor, frequent))
                at = spread(often.first, often.count)
                text = np.repeat(often.text, often.count)
                window = gram_hashes(rule, data, rule.width)[at]
                sort = np.lexsort((order[text], window))
                window, at, text = window[sort], at[sort], text[sort]
                new = np.ones(len(window), bool)
                new[1:] = window[1:] != window[:-1]
                head = np.flatnonzero(new)[np.cumsum(new) - 1]  # the first of those with the same hash
                later = order[text] > order[text[head]]
                later[later] = _equal(data, at[later], at[head[later]], rule.width)
                out += found_rows(tag, text[later], at[later] - bounds[text[later]])
                one = Runs(text[~later], at[~later], np.ones((~later).sum(), np.int64), window[~later])
                out += rows_of(tag, order, data, bounds, one, one.anchor)
            yield packs.batch(out)

    return texts.mapInArrow(run, packs.SCHEMA)


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` units from each place in ``a`` are those from the place in ``b``."""
    out = np.ones(len(a), bool)
    for k in range(width):
        out &= data[a + k] == data[b + k]
    return out


def _found(tag: np.ndarray, text: np.ndarray, start: np.ndarray, count: np.ndarray, n: int) -> Iterator[packs.Row]:
    fields = [tag.astype(np.int64), text.astype(np.uint16), start.astype(np.uint32), count.astype(np.uint32)]
    return packs.cut(tag % n, fields, FOUND)


def content_classes(data: np.ndarray, cuts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Number of each run's content among the contents of all groups: equal runs, equal numbers."""
    raw = data.tobytes()
    at = (cuts * data.itemsize).tolist()
    number: dict[tuple[int, bytes], int] = {}
    return np.array([number.setdefault((g, raw[a:b]), len(number)) for g, a, b in zip(group.tolist(), at, at[1:])], np.int64)


def decide(rule: Rule, rows: list[dict], classes: Classes) -> Iterator[tuple[np.ndarray, ...]]:
    """(tag, text, start, count) of windows that stand in a smaller document too."""
    group = np.frombuffer(b"".join(r["a"] for r in rows), np.uint32)
    tag = np.repeat(np.array([r["tag"] for r in rows], np.int64), [len(r["a"]) // 4 for r in rows])
    order, text = packs.column(rows, "b", np.int64), packs.column(rows, "c", np.uint16)
    start = packs.column(rows, "d", np.uint32)
    counts, parts = [], []
    for r in rows:
        k = len(r["a"])  # as many bytes of counts as of anchors
        counts.append(packs.values_of(r["e"][:k], np.uint32))
        parts.append(np.frombuffer(r["e"], rule.dtype, offset=k))
    count, data = np.concatenate(counts).astype(np.int64), np.concatenate(parts)
    cuts = np.concatenate([[0], np.cumsum(count + rule.width - 1)])
    content = content_classes(data, cuts, group)
    # Equal runs: all but those of the smallest document are repeats as a whole.
    least = np.full(int(content.max()) + 1, LAST)
    np.minimum.at(least, content, order)
    later = order > least[content]
    yield tag[later], text[later], start[later], count[later]
    first = np.flatnonzero(~later)
    one = first[np.unique(content[first], return_index=True)[1]]  # a run of each content
    # Where an anchor has runs of several contents, their windows are compared.
    _, of, sizes = np.unique(group[one], return_inverse=True, return_counts=True)
    several = one[sizes[of] > 1]
    if not len(several):
        return
    several = several[np.argsort(group[several], kind="stable")]
    total = np.cumsum(count[several])
    last = np.append(group[several][1:] != group[several][:-1], True)
    ends = np.flatnonzero(last) + 1  # of the groups, which are worked on a bounded number of windows at a time
    ends = ends[np.append(np.diff(total[ends - 1] // COMPARED) > 0, True)]
    alike = first[np.argsort(content[first], kind="stable")]
    for a, b in zip([0, *ends.tolist()], ends.tolist()):
        yield from _compare(several[a:b], alike, content, order, tag, text, start, count, classes, data, cuts, group)


def _compare(
    mine: np.ndarray, alike: np.ndarray, content: np.ndarray, order: np.ndarray, tag: np.ndarray, text: np.ndarray,
    start: np.ndarray, count: np.ndarray, classes: Classes, data: np.ndarray, cuts: np.ndarray, group: np.ndarray,
) -> Iterator[tuple[np.ndarray, ...]]:
    """What ``decide`` finds among runs of different contents; ``alike`` has the runs of a content together."""
    size = count[mine] + np.diff(cuts)[mine[0]] - count[mine[0]]
    local = np.concatenate([[0], np.cumsum(size)])
    number = classes(data[spread(cuts[mine], size)], local[:-1], count[mine], group[mine])
    owner = np.repeat(order[mine], count[mine])
    least = np.full(int(number.max()) + 1, LAST)
    np.minimum.at(least, number, owner)
    repeated = owner > least[number]
    if not repeated.any():
        return
    # The verdict on a run holds for all runs of its content in the same document.
    low = np.searchsorted(content[alike], content[mine])
    high = np.searchsorted(content[alike], content[mine], "right")
    source = np.repeat(np.arange(len(mine)), high - low)
    runs = alike[spread(low, high - low)]
    begin = np.cumsum(count[mine]) - count[mine]
    flags = repeated[spread(begin[source], count[mine][source])]
    at = spread(start[runs].astype(np.int64), count[runs])[flags]
    who = np.repeat(runs, count[runs])[flags]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (who[1:] != who[:-1])
    edge = np.flatnonzero(new)
    yield tag[who[edge]], text[who[edge]], at[edge].astype(np.uint32), np.diff(np.append(edge, len(at)))


def spans(packed: DataFrame, rule: Rule, classes: Classes, n: int) -> DataFrame:
    """(order, key, first windows and numbers) of the repeated windows of every text that has some."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for _, rows in packs.groups(batches):
            yield packs.batch([(r["bucket"], r["kind"], r["tag"], r["a"], r["b"], r["c"], r["d"]) for r in rows if r["kind"] != RUNS])
            rows = [r for r in rows if r["kind"] == RUNS]
            held += decide(rule, rows, classes) if rows else []
            if sum(len(h[0]) for h in held) > HELD:
                yield packs.batch(list(_found(*map(np.concatenate, zip(*held)), n)))
                held = []
        if held:
            yield packs.batch(list(_found(*map(np.concatenate, zip(*held)), n)))

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in packs.groups(batches):
            names = {r["tag"]: r for r in rows if r["kind"] == NAMES}
            rows = [r for r in rows if r["kind"] == FOUND]
            tag, text = packs.column(rows, "a", np.int64), packs.column(rows, "b", np.uint16)
            start, count = packs.column(rows, "c", np.uint32), packs.column(rows, "d", np.uint32)
            sort = np.lexsort((start, text, tag))
            tag, text, start, count = tag[sort], text[sort], start[sort], count[sort]
            new = np.ones(len(tag), bool)
            new[1:] = (tag[1:] != tag[:-1]) | (text[1:] != text[:-1])
            edges = np.append(np.flatnonzero(new), len(tag))
            order, key = [], []
            for t in np.unique(tag).tolist():
                mine = text[edges[:-1]][tag[edges[:-1]] == t]
                order += packs.values_of(names[t]["a"], np.int64)[mine].tolist()
                key += [k.tobytes() for k in packs.values_of(names[t]["b"], KEY)[mine]]
            yield pa.record_batch(
                [
                    pa.array(order, pa.int64()), pa.array(key, pa.binary()),
                    pa.array([start[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                    pa.array([count[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                ],
                ["_order", "_key", "_start", "_count"],
            )

    compared = packs.exchange(packed).mapInArrow(compare, packs.SCHEMA)
    found = packs.exchange(compared).mapInArrow(by_text, "_order bigint, _key binary, _start binary, _count binary")
    one = found.groupBy("_order", "_key").agg(F.first(F.struct("_start", "_count")).alias("_one"))  # equal rows have equal spans
    return one.select("_order", "_key", "_one._start", "_one._count")


Finish = Callable[[bytes, np.ndarray, np.ndarray], tuple]


def remove_repeats(docs: DataFrame, rule: Rule, classes: Classes, finish: Finish, arrow: pa.Schema, schema: str) -> DataFrame:
    """``finish(text, first windows, numbers)`` of every row, as (doc_id, columns of ``schema``)."""
    n = packs.buckets(docs.sparkSession)
    extract = anchor_extract(rule)
    frequent = frequent_values(raw_texts(docs), extract)
    texts = packed_texts(docs)
    sent = sent_values(raw_texts(docs), extract, frequent, n)
    marked = texts.join(marks(sent, n), ["_order", "_key"], "left").sortWithinPartitions("_order", "_key")
    found = spans(marked_runs(marked, rule, frequent, n), rule, classes, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in slices(batches, "_packed", BLOCK_BYTES // 2):
            rows = zip(_unpacked(block), block.column("_start").to_pylist(), block.column("_count").to_pylist())
            done = [finish(raw, np.frombuffer(a or b"", np.uint32), np.frombuffer(b or b"", np.uint32)) for raw, a, b in rows]
            yield pa.record_batch([block.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*done), list(arrow)[1:]))], schema=arrow)

    return texts.join(found, ["_order", "_key"], "left").select("doc_id", "_packed", "_start", "_count").mapInArrow(run, schema)
