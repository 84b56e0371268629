"""Groups of texts whose 5-word shingles overlap, by a join on count-vector R-trees.

Two texts link when 100 * intersection >= 75 * union of their sets of distinct
shingles. The join is exact; no link between different sets is lost.

1. Equal sets are one node, represented by its first text.
2. In the order of the shingles' hashes, two linked sets share the first of their
   common shingles within a prefix of each that is a little over a quarter long,
   and several within half of each. Half of every set is looked up; texts that do
   not share enough of it with others drop out.
3. The other sets are routed by a few shared shingles of their prefix. Where sets
   meet, shingles are hashed into ``GROUPS`` groups, the counts per group are
   points of an R-tree, and the sum of the smaller coordinates of a point and a
   box bounds the overlap with all points in the box. What survives is verified.
   Sets that are linked already, directly or through others, are not compared.
4. Components so far are contracted. Every shared shingle of every prefix at
   which two components still meet is joined in the same way, between
   components, which leaves no pair out.

A shingle at which very many sets meet is split: into parts in step 3, where later
steps make up for what the parts cannot see, and into all pairs of parts in step 4.

Defined cases: words are compared with A-Z lower-cased; a text with fewer than
five words has its whole sequence as one shingle; a null text and a text without
words has an empty set and is linked with nothing; a null doc_id counts as the
largest id, and stays null; rows that repeat get equal results, and texts under one
id are told apart by 16 bytes of their SHA-256. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm import packs
from pagemill.llm.blocks import BLOCK_BYTES, grams, lower_ascii, mix64, slices, words
from pagemill.llm.components import components
from pagemill.llm.repeats import U, _unpacked, frequent_values, marks, packed_texts, raw_texts, row_key, sent_values
from pagemill.sources.tables import stored

SHINGLE = 5
ROUTES = 3  # shared shingles by which a set is routed at first
GROUPS = 256  # of shingle hashes: coordinates of a point
FULL = 255  # counts are moved as single bytes
FANOUT = 16  # children of a box
MEETING, MEETING_BYTES = 512, 64 << 20  # sets at a shingle, and their bytes, that are joined in one piece
POINTED = 2048  # points at a shingle that are joined in one piece


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of all texts, by text and hash."""
    hashes, _, _, _, before = words([lower_ascii(t) for t in texts])
    sizes = np.diff(before)
    owner = np.repeat(np.arange(len(texts)), sizes)
    if len(hashes) >= SHINGLE:
        value = grams(hashes, SHINGLE)
        same = owner[: len(value)] == owner[SHINGLE - 1 :]
        text, value = owner[: len(value)][same], value[same]
    else:
        text, value = owner[:0], hashes[:0]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(sizes == n)
        if len(short):
            at = before[short]
            whole = np.full(len(short), n, U)
            for k in range(n):
                whole = mix64(whole * U(0x9E3779B97F4A7C15) + hashes[at + k])
            text, value = np.concatenate([text, short]), np.concatenate([value, whole])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def enough(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of ``n`` with any set that it links with."""
    return -(-3 * n // 4)


def required(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of linked sets of these sizes."""
    return -(-3 * (a + b) // 7)


def looked_up(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the first half of each set, and how many of them another set must hold."""
    text, value = shingle_sets(texts)
    n = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n) - n
    length = n - enough(n) - (-n // 4)
    mine = np.arange(len(text)) - first[text] < length[text]
    return text[mine], value[mine], np.maximum(-(-enough(n) // 4), 1)


def set_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, order, key, n_shingles, node) of every row; the node stands for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in slices(batches, "text", BLOCK_BYTES // 2):
            raw = [x or b"" for x in block.column("text").cast(pa.binary()).to_pylist()]
            text, value = shingle_sets(raw)
            n = np.bincount(text, minlength=len(raw))
            node = np.zeros(len(raw), U)
            np.add.at(node, text, mix64(value ^ U(0x5851F42D4C957F2D)))
            node = mix64(node + n.astype(U))
            yield pa.record_batch(
                [block.column("doc_id"), block.column("_order"), pa.array(list(map(row_key, raw)), pa.binary()), pa.array(n), pa.array(node.view(np.int64))],
                ["doc_id", "_order", "_key", "n_shingles", "node"],
            )

    keyed = raw_texts(docs, F.col("doc_id").cast("bigint"))
    return keyed.mapInArrow(run, "doc_id bigint, _order bigint, _key binary, n_shingles bigint, node bigint")


def text_key(text: Column) -> Column:
    """What tells the texts of one id apart, as in the rows of :func:`similar_rows`."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def shared_sets(texts: DataFrame, heads: DataFrame, n: int, frequent: np.ndarray) -> DataFrame:
    """(node, n, shingles, routes) of the sets that may have links; routes: shared shingles of the prefix."""
    keys = ["_order", "_key"]
    nodes = texts.join(heads, keys).sortWithinPartitions(*keys)
    found = marks(sent_values(nodes.select(*keys, "_packed"), looked_up, frequent, n, "_packed", back=True), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in slices(batches, "_packed", BLOCK_BYTES // 4):
            raw = _unpacked(block)
            text, value = shingle_sets(raw)
            cuts = np.searchsorted(text, np.arange(len(raw) + 1))
            sets = [value[a:b] for a, b in zip(cuts, cuts[1:])]
            known = [np.frombuffer(m, np.uint32) for m in block.column("_marks").to_pylist()]
            routes = []
            for s, m in zip(sets, known):
                prefix = s[: len(s) - int(enough(len(s))) + 1]
                routes.append(prefix[np.isin(prefix.astype(np.uint32), m)].view(np.int64).tolist())
            yield pa.record_batch(
                [
                    block.column("node"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(routes, pa.list_(pa.int64())),
                ],
                ["node", "n", "shingles", "routes"],
            )

    return nodes.join(found, keys).mapInArrow(run, "node bigint, n bigint, shingles binary, routes array<bigint>")


def points(sets: list[np.ndarray]) -> np.ndarray:
    """Count vectors: how many shingles of each set fall into each group."""
    out = np.zeros((len(sets), GROUPS), np.int32)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s >> U(8)) % U(GROUPS), minlength=GROUPS)
    return out


class Tree:
    """An R-tree over count vectors, packed by size and then by the first coordinates.

    A box keeps the largest count of each group and the range of set sizes below it.
    """

    def __init__(self, vectors: np.ndarray, n: np.ndarray) -> None:
        self.order = np.lexsort((vectors[:, 1], vectors[:, 0], n))
        self.levels = [(vectors[self.order], n[self.order], n[self.order])]
        while len(self.levels[-1][0]) > FANOUT:
            top, low, high = self.levels[-1]
            cut = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def near(self, vector: np.ndarray, n: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, bounds) of the points whose overlap with this one may suffice, best first.

        ``live`` marks the entries that are of interest.
        """
        at = np.arange(len(self.levels[-1][0]))
        bound = at
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            least = required(n, np.maximum(low[at], enough(n)))
            bound = np.minimum(top[at], vector).sum(1)
            fits = (bound >= least) & (4 * low[at] <= n * 16 // 3 + 4) & (high[at] >= enough(n))
            at, bound = at[fits], bound[fits]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        entry = self.order[at]
        mine = live[entry]
        entry, bound = entry[mine], bound[mine]
        best = np.argsort(-bound, kind="stable")
        return entry[best], bound[best]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    return overlap(a, b) >= int(required(len(a), len(b)))


def spanning_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all sets which are connected by links among these."""
    n = np.array([len(s) for s in sets])
    vectors = points(sets)
    tree = Tree(vectors, n)
    part = np.arange(len(sets))
    seen = np.zeros(len(sets), bool)
    out = []
    for i in range(len(sets)):
        entry = tree.near(vectors[i], int(n[i]), seen)[0]
        while len(entry):
            j = int(entry[0])
            entry = entry[1:]
            if linked(sets[i], sets[j]):
                out.append((i, j))
                part[part == part[i]] = part[j]
            entry = entry[part[entry] != part[i]] if len(out) and out[-1] == (i, j) else entry
        seen[i] = True
    return out


def meet(sets: DataFrame) -> DataFrame:
    """Verified links (a, b) between sets that meet at one of their first shared shingles."""
    routed = sets.select("node", "shingles", F.explode(F.slice("routes", 1, ROUTES)).alias("route"))
    parts = F.greatest(F.ceil(F.count("*") / MEETING), F.ceil(F.sum(F.octet_length("shingles")) / MEETING_BYTES))
    busy = routed.groupBy(F.col("route").alias("_route")).agg(parts.alias("_parts")).where(F.col("_parts") > 1)
    busy = stored(busy, "jaccard-busy")  # a table of its own, so that Spark can split a hot shingle's rows in the join
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("node", "route"), F.col("_parts"))).otherwise(F.lit(0))
    keyed = routed.join(busy, F.col("route") == F.col("_route"), "left").select(
        "node", "shingles", "route", part.cast("bigint").alias("part")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        key = None
        a: list[int] = []
        b: list[int] = []

        def join() -> None:
            if len(held) > 1:
                for i, j in spanning_links([s for _, s in held]):
                    a.append(held[i][0])
                    b.append(held[j][0])

        for batch in batches:
            for node, route, part, raw in zip(*(batch.column(c).to_pylist() for c in ("node", "route", "part", "shingles"))):
                if (route, part) != key:
                    join()
                    held, key = [], (route, part)
                held.append((node, np.frombuffer(raw, U)))
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        join()
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    together = keyed.repartition("route", "part").sortWithinPartitions("route", "part", "node")
    return together.mapInArrow(run, "a bigint, b bigint").distinct()


def candidates(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that meet at a shared shingle and may link by their points."""
    placed = sets.join(parts.select(F.col("node").alias("_node"), "component"), F.col("node") == F.col("_node"), "left")
    placed = placed.select("node", "n", "shingles", "routes", F.coalesce("component", "node").alias("component"))
    routed = placed.select("node", "component", F.explode("routes").alias("route"))
    mixed = (
        routed.groupBy("route")
        .agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_n"))
        .where(F.col("_low") != F.col("_high"))
        .select(F.col("route").alias("_route"), F.ceil(F.col("_n") / POINTED).cast("int").alias("_parts"))
    )
    mixed = stored(mixed, "jaccard-mixed")
    met = routed.join(mixed, F.col("route") == F.col("_route"))
    own = F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), F.col("_parts") - 1),
        lambda other: F.struct(F.least(F.col("_own"), other).alias("x"), F.greatest(F.col("_own"), other).alias("y")),
    )
    met = met.withColumn("_own", own).select("node", "component", "route", "_own", F.explode(pair).alias("_pair"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in slices(batches, "shingles", BLOCK_BYTES):
            sets_ = [np.frombuffer(x, U) for x in block.column("shingles").to_pylist()]
            rows = [v.astype(np.uint8).tobytes() for v in np.minimum(points(sets_), FULL)]
            yield pa.record_batch([block.column("node"), block.column("n"), pa.array(rows, pa.binary())], ["_at", "n", "point"])

    pointed = placed.select("node", "n", "shingles").mapInArrow(vectors, "_at bigint, n bigint, point binary")
    met = met.join(pointed, F.col("node") == F.col("_at")).select(
        "node", "component", "route", F.col("_pair.x").alias("x"), F.col("_pair.y").alias("y"), F.col("_own").alias("own"), "n", "point"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("route", "x", "y", "own", "node", "component", "n", "point")
        held: list[tuple] = []
        a: list[int] = []
        b: list[int] = []

        def join() -> None:
            if len(held) < 2:
                return
            _, x, y, own, node, component, n, point = (np.array(c) if k < 7 else c for k, c in enumerate(zip(*held)))
            found = np.frombuffer(b"".join(point), np.uint8).reshape(-1, GROUPS).astype(np.int32)
            found[found == FULL] = np.iinfo(np.int32).max // GROUPS  # a count of FULL or more bounds nothing
            tree = Tree(found, n)
            for i in range(len(held)):
                if x[i] != y[i] and own[i] != x[i]:
                    continue  # between two parts, only one of them asks
                live = (component != component[i]) & ((own == y[i]) if x[i] != y[i] else (node > node[i]))
                for j in tree.near(found[i], int(n[i]), live)[0]:
                    a.append(int(min(node[i], node[j])))
                    b.append(int(max(node[i], node[j])))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if held and row[:3] != held[0][:3]:
                    join()
                    held = []
                held.append(row)
                if len(a) > 100_000:
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                    a, b = [], []
        join()
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    together = met.repartition("route", "x", "y").sortWithinPartitions("route", "x", "y", "node")
    return together.mapInArrow(run, "a bigint, b bigint").distinct()


def fine_point(shingles: np.ndarray) -> np.ndarray:
    """A point with one coordinate for each 16 bits of a hash, as the sorted list of the counted values."""
    return np.sort((shingles >> U(24)).astype(np.uint16))


def fine_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Sum of the smaller coordinates of two fine points."""
    (x, m), (y, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(m[i], n[j]).sum())


def _kept(pairs: DataFrame, sides: DataFrame, dtype: type, test: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """The pairs (a, b) whose two sides (node, side) pass a test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in slices(batches, "_one", BLOCK_BYTES):
            both = zip(block.column("_one").to_pylist(), block.column("_two").to_pylist())
            keep = pa.array([test(np.frombuffer(x, dtype), np.frombuffer(y, dtype)) for x, y in both], pa.bool_())
            yield block.select(["a", "b"]).filter(keep)

    one = sides.select(F.col("node").alias("a"), F.col("side").alias("_one"))
    two = sides.select(F.col("node").alias("b"), F.col("side").alias("_two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "_one", "_two").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are linked: first by fine points, which are a quarter as long, then by the sets."""

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in slices(batches, "shingles", BLOCK_BYTES):
            rows = [fine_point(np.frombuffer(x, U)).tobytes() for x in block.column("shingles").to_pylist()]
            yield pa.record_batch([block.column("node"), pa.array(rows, pa.binary())], ["node", "side"])

    points_ = sets.select("node", "shingles").mapInArrow(fine, "node bigint, side binary")
    likely = _kept(pairs, points_, np.uint16, lambda x, y: fine_bound(x, y) >= int(required(len(x), len(y))))
    return _kept(likely, sets.select("node", F.col("shingles").alias("side")), U, linked)


def similar_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, of every row."""
    return similar_rows(docs).select("doc_id", "n_shingles", "component_id")


def similar_rows(docs: DataFrame) -> DataFrame:
    """As similar_texts, with the text's key and whether the row is the first of its group by id and text key."""
    n = packs.buckets(docs.sparkSession)
    keys = stored(set_keys(docs), "jaccard-keys")
    heads = (
        keys.where(F.col("n_shingles") > 0)
        .groupBy("node")
        .agg(F.min(F.struct("_order", "_key")).alias("_head"))
        .select("_head._order", "_head._key", "node")
    )
    frequent = frequent_values(raw_texts(docs), looked_up)
    sets = stored(shared_sets(packed_texts(docs), heads, n, frequent), "jaccard-sets")
    first = stored(meet(sets), "jaccard-links")
    parts = components(first)
    links = stored(verified(candidates(sets, parts), sets), "jaccard-more")
    parts = components(first.unionByName(links))
    joined = keys.where(F.col("n_shingles") > 0).groupBy("node").agg(F.min(F.struct("_order", "_key", "doc_id")).alias("_first"))
    named = joined.join(parts, "node", "left").withColumn("_part", F.coalesce("component", "node"))
    lowest = named.groupBy("_part").agg(F.min("_first").alias("_lowest"))
    named = named.join(lowest, "_part").select(F.col("node").alias("_node"), "_lowest")
    result = keys.join(named, (F.col("node") == F.col("_node")) & (F.col("n_shingles") > 0), "left")
    return result.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("_lowest").isNotNull(), F.col("_lowest.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.col("_key").alias("text_key"),
        F.coalesce((F.col("_order") == F.col("_lowest._order")) & (F.col("_key") == F.col("_lowest._key")), F.lit(True)).alias("is_first"),
    )
