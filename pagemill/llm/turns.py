"""Repair of conversations by the lightest derivation of a legal order of turns.

A repaired conversation has role initials ``(s?(ua)+)?``. Its rows, in order, are
given edits: Keep (0), Rerole to user or assistant (1), Delete (2; blank rows and
rows whose role and text came before must go), Insert a row without text (5); a
truncated row that stays costs 5 more. Among the cheapest the edits whose initials
sort first are taken. Items are (rows read, state); a deduction takes an item and an
edit to another, with cost and audit string added, and :func:`lightest` pops items in
order of (cost, audit) until the goals are final (Knuth's generalisation of
Dijkstra's algorithm). Adding an edit makes neither smaller, and of two audits of
the same rows and cost neither begins the other, so the order is monotone.

Rows are dealt out by ranges of (conversation, turn, role, text), so a conversation
of any size is many segments of at most ``segment_rows`` rows. Conversations that end
within one segment are derived there. A segment of others is derived from every
state that it may begin in, and :func:`chain` deduces over segments, one narrow row
each. Exact repeats are counted before any shuffle of rows in order.

Rows of a turn are ordered by role and text, exact repeats side by side. A null turn
comes first; a null role or text is one blank, so such a text is blank. A role other
than system, user and assistant goes by its first character; one without any is kept
nowhere. Conversations without an id are one conversation; without rows, none.
Other columns are not looked at. Differences of turns beyond a long stay at its end.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagemill.sources.tables import stored

SEGMENT_ROWS, SEGMENT_CHARS, BATCH_CHARS = 256, 1 << 21, 1 << 22
RANGE_CHARS = 64  # of a text in the keys of ranges; rows equal so far stay together

# Fixed values of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = r"\x20\x09-\x0D"
LAST = re.compile(rf"([^{SPACE}])[{SPACE}]*\Z").search
LEGAL = {"su", "ua", "au"}

# States are the role last written: none (N), system, user or assistant.
STATES = "Nsua"
START, GOALS = "N", "Na"
NEXT = {("N", "s"): "s", ("N", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
TURN = {"N": "u", "s": "u", "a": "u", "u": "a"}  # what Rerole and Insert write
ROLE = {"u": "user", "a": "assistant"}

Weight = tuple[int, str]


def lightest(axioms: dict, deductions: Callable[[object], Iterable[tuple[object, int, str]]]) -> dict:
    """The lightest (cost, audit) of every item that can be derived.

    ``axioms`` are items with their weights; ``deductions`` gives the conclusions
    of an item, each with the cost and the letters that the step adds.
    """
    agenda = [(*weight, item) for item, weight in axioms.items()]
    heapq.heapify(agenda)
    final: dict = {}
    while agenda:
        cost, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit)
        for head, more, letters in deductions(item):
            if head not in final:
                heapq.heappush(agenda, (cost + more, audit + letters, head))
    return final


def derive(rows: list[tuple[str, str]], state: str) -> dict[str, Weight]:
    """Lightest edits of rows (initial, fault) from a state to every state they can end in."""

    def deductions(item: tuple[int, str]) -> Iterator[tuple[tuple[int, str], int, str]]:
        k, q = item
        yield (k, TURN[q]), INSERT, "I"
        if k == len(rows):
            return
        initial, fault = rows[k]
        yield (k + 1, q), DELETE, "D"
        if fault in ("blank", "duplicate"):
            return
        extra = TRUNCATED if fault == "truncated" else 0
        if (q, initial) in NEXT:
            yield (k + 1, NEXT[q, initial]), extra, "K"
        yield (k + 1, TURN[q]), REROLE + extra, "R"

    found = lightest({(0, state): (0, "")}, deductions)
    return {q: found[len(rows), q] for q in STATES if (len(rows), q) in found}


def apply(lines: list[tuple[str, str]], audit: str, state: str) -> list[tuple[str, str]]:
    """(role, text) of the rows after the edits of an audit that begins in ``state``."""
    out, rest = [], iter(lines)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rest)
        if letter == "D":
            continue
        state = NEXT[state, role[:1]] if letter == "K" else TURN[state]
        out.append((role if letter == "K" else ROLE[state], text))
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of rows damaged by the checksum of their conversation and turn."""
    place = F.concat(*(F.coalesce(c, F.lit(" ")) for c in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))))
    kind = F.crc32(place.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    hit = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = conversations.where(kind != 0)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), hit.alias("text"), copies.alias("_copy")).drop("_copy")


def _same(*keys: str) -> Column:
    at = F.lit(True)
    for key in keys:
        at = at & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    return at


def counted(rows: DataFrame) -> DataFrame:
    """Each different row once, with how often it stands there and whether the first is new in its conversation."""
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times"))
    said = F.sha2(F.concat_ws("\0", F.length("role"), "role", "text"), 256)
    once = once.withColumn("said", F.unhex(said))
    first = once.groupBy("conv_id", "said").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("null_turn"))
    joined = once.alias("l").join(first.alias("r"), _same("conv_id", "said"))
    new = F.when(F.col("r.null_turn"), F.col("l.turn").isNull()).otherwise(F.col("l.turn") == F.col("r.least"))
    return joined.select("l.conv_id", "l.turn", "l.role", "l.text", "l.times", new.alias("new"))


def fault_of(text: str, new: bool) -> str:
    last = LAST(text)
    return "blank" if last is None else "duplicate" if not new else "" if last[1] in ".!?" else "truncated"


class Segment:
    """Rows of a conversation that follow each other."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.rows, self.lines, self.turns, self.chars = conv_id, [], [], [], 0

    def add(self, turn: int | None, role: str, text: str, new: bool) -> None:
        self.rows.append((role[:1], fault_of(text, new)))
        self.lines.append((role, text))
        self.chars += len(text) + len(role)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def full(self, rows: int) -> bool:
        return len(self.rows) >= rows or self.chars >= SEGMENT_CHARS

    def row(self, part: int, number: int, whole: bool) -> dict:
        """The segment as a row; of a whole conversation only its lightest derivation."""
        paths = []
        for state in START if whole else STATES:
            ends = derive(self.rows, state)
            if whole:
                goal = min((ends[q], q) for q in GOALS if q in ends)[1]
                ends = {goal: ends[goal]}
            paths += [{"came": state, "goes": q, "cost": c, "audit": a} for q, (c, a) in ends.items()]
        faults = [f for _, f in self.rows]
        initials = [i for i, _ in self.rows]
        return {
            "conv_id": self.conv_id,
            "part": part,
            "segment": number,
            "whole": whole,
            "blank": faults.count("blank"),
            "duplicate": faults.count("duplicate"),
            "truncated": faults.count("truncated"),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "head": initials[0],
            "tail": initials[-1],
            "low": self.turns[0] if self.turns else None,
            "high": self.turns[-1] if self.turns else None,
            "turns": len(self.turns),
            "paths": paths,
            "lines": [{"role": r, "text": t} for r, t in self.lines],
        }


MEASURES = (
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, low bigint, high bigint, turns bigint"
)
PLACE = "part int, segment bigint"
PATHS = "paths array<struct<came:string,goes:string,cost:bigint,audit:string>>"
LINES = "lines array<struct<role:string,text:string>>"


def _mapped(frame: DataFrame, make: Callable[[Iterator[dict]], Iterator[tuple[dict, int]]], columns: str) -> DataFrame:
    """conv_id and ``columns`` of the rows that ``make`` gives, each with its size, for the rows of a task in order."""
    ddl = f"conv_id {frame.schema['conv_id'].dataType.simpleString()}, {columns}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for row, size in make(row for batch in batches for row in batch.to_pylist()):
            held.append(row)
            chars += size + 500
            if chars >= BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, chars = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return frame.mapInArrow(run, ddl)


def segments(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Segments of the conversations of ``counted`` rows, with the lightest edits between states."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(partitions, "conv_id", "turn", "role", F.substring("text", 1, RANGE_CHARS))

    def made(ordered: Iterator[dict]) -> Iterator[tuple[dict, int]]:
        part, number = TaskContext.get().partitionId(), 0
        held: Segment | None = None
        begun = False  # the conversation is known to begin with this segment
        for row in ordered:
            for copy in range(row["times"]):
                other = held is None or held.conv_id != row["conv_id"]
                if other or held.full(segment_rows):
                    if held is not None:
                        yield held.row(part, number, other and begun), held.chars
                        number += 1
                    begun = other and held is not None
                    held = Segment(row["conv_id"])
                held.add(row["turn"], row["role"], row["text"], row["new"] and copy == 0)
        if held is not None:
            yield held.row(part, number, False), held.chars

    return _mapped(
        ranged.sortWithinPartitions("conv_id", "turn", "role", "text"), made, f"{PLACE}, whole boolean, {MEASURES}, {PATHS}, {LINES}"
    )


class Link:
    """A derivation of the segments so far: its last step and the ones before."""

    __slots__ = ("before", "cost", "came", "audit")

    def __init__(self, before: Link | None, cost: int, came: str, audit: str) -> None:
        self.before, self.cost, self.came, self.audit = before, cost, came, audit

    def __lt__(self, other: Link) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b, mine, theirs = self, other, [], []
        while a is not b:  # as many steps in both; what they share needs no look
            mine.append(a.audit)
            theirs.append(b.audit)
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(theirs))


def follow(at: dict[str, Link], paths: list[dict]) -> dict[str, Link]:
    """The lightest derivations to every state after one more segment."""
    agenda = [(Link(at[p["came"]], at[p["came"]].cost + p["cost"], p["came"], p["audit"]), p["goes"]) for p in paths if p["came"] in at]
    heapq.heapify(agenda)
    final: dict[str, Link] = {}
    while agenda:
        link, state = heapq.heappop(agenda)
        final.setdefault(state, link)
    return final


def _by_conversation(frame: DataFrame) -> DataFrame:
    """The segments of a conversation after each other in one task."""
    partitions = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "part", "segment")


def chain(opened: DataFrame) -> DataFrame:
    """(conv_id, part, segment, came, cost, audit): where each segment begins, and its edits."""

    def made(ordered: Iterator[dict]) -> Iterator[tuple[dict, int]]:
        for conv_id, rows in itertools.groupby(ordered, lambda r: r["conv_id"]):
            at = {START: Link(None, 0, START, "")}
            places = []
            for row in rows:
                at = follow(at, row["paths"])
                places.append((row["part"], row["segment"]))
            link = min(at[q] for q in GOALS if q in at)
            links = []
            while link.before is not None:
                links.append(link)
                link = link.before
            for (part, segment), link in zip(places, reversed(links)):
                cost = link.cost - link.before.cost
                step = {"conv_id": conv_id, "part": part, "segment": segment, "came": link.came, "cost": cost, "audit": link.audit}
                yield step, len(link.audit)

    narrow = opened.select("conv_id", "part", "segment", "paths")
    return _mapped(_by_conversation(narrow), made, f"{PLACE}, came string, cost bigint, audit string")


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Segments of the repaired conversations of rows (conv_id, turn, role, text).

    Columns: conv_id, part, segment (their order), whole (the only one of its
    conversation), measures of the rows before repair, came (the state it begins
    in), cost, audit, lines (rows before repair). ``lines`` of :func:`repaired` are those after.
    """
    found = stored(segments(stored(counted(rows), "turns-rows"), segment_rows), "turns-segments")
    one = F.col("paths")[0]
    closed = found.where("whole").select("*", one.came.alias("came"), one.cost.alias("cost"), one.audit.alias("audit")).drop("paths")
    opened = found.where(~F.col("whole"))
    steps = chain(opened)
    taken = opened.drop("paths").alias("l").join(steps.alias("r"), _same("conv_id", "part", "segment"))
    return closed.unionByName(taken.select("l.*", "r.came", "r.cost", "r.audit"))


def _kept(row: dict) -> list[tuple[str, str]]:
    return apply([(x["role"], x["text"]) for x in row["lines"]], row["audit"], row["came"])


def repaired(found: DataFrame) -> DataFrame:
    """(conv_id, part, segment, place, role, text) of the rows after repair; the first four give their order."""

    def made(ordered: Iterator[dict]) -> Iterator[tuple[dict, int]]:
        for row in ordered:
            for place, (role, text) in enumerate(_kept(row)):
                yield {**{k: row[k] for k in ("conv_id", "part", "segment")}, "place": place, "role": role, "text": text}, len(text)

    narrow = found.select("conv_id", "part", "segment", "came", "audit", "lines")
    return _mapped(narrow, made, f"{PLACE}, place int, role string, text string")


RESULT = (
    *((n, "bigint") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
    ("audit", "string"),
    ("repaired_sha256", "string"),
)


class Digest:
    """Measures of a conversation, segment by segment."""

    def __init__(self, conv_id: object) -> None:
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0)
        self.conv_id, self.low, self.high, self.tail, self.audit = conv_id, None, None, None, []
        self.sha, self.lines = hashlib.sha256(), 0

    def add(self, row: dict) -> None:
        for name in self.sums:
            self.sums[name] += row[name]
        if self.tail is not None and self.tail + row["head"] not in LEGAL:
            self.sums["illegal"] += 1
        if row["low"] is not None:
            self.sums["turns"] -= row["low"] == self.high
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        self.tail = row["tail"]
        self.audit.append(row["audit"])
        for role, text in _kept(row):
            self.sha.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode())
            self.lines += 1

    def row(self) -> dict:
        turns = self.sums.pop("turns")
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - turns, 2**63 - 1)
        return {"conv_id": self.conv_id, "gaps": gaps, **self.sums, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def _folded(segments_in_order: DataFrame) -> DataFrame:
    """One row per conversation from its segments, which follow each other."""

    def made(ordered: Iterator[dict]) -> Iterator[tuple[dict, int]]:
        for conv_id, rows in itertools.groupby(ordered, lambda r: r["conv_id"]):
            held = Digest(conv_id)
            for row in rows:
                held.add(row)
            done = held.row()
            yield done, len(done["audit"])

    return _mapped(segments_in_order, made, ", ".join(f"{n} {k}" for n, k in RESULT))


def digest(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """The measures, edits and hash of every conversation; zeros for those without rows in ``found``."""
    told = _folded(found.where("whole")).unionByName(_folded(_by_conversation(found.where(~F.col("whole")))))
    every = conversations.groupBy("conv_id").agg(F.lit(1).alias("_one")).select("conv_id")
    joined = every.alias("l").join(told.alias("r"), _same("conv_id"), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return joined.select("l.conv_id", *(F.coalesce(F.col(f"r.{n}"), F.lit(empty.get(n, 0)).cast(k)).alias(n) for n, k in RESULT))
