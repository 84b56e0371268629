"""Repair of conversations against all edit sequences, tried out."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from pagemill.llm import turns

LEGAL = re.compile(r"(s?(ua)+)?")


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def _faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _states(lines):
    """Role initials written so far, as far as they matter; None if they can't become legal."""
    initials = "".join(r[:1] or "-" for r, _ in lines)
    if not re.fullmatch(r"s?(ua)*u?", initials):
        return None
    return "" if not initials else initials[-1]


def _cheapest(rows):
    """All (cost, audit, lines) by breadth, keeping of each state the least at every step; inserts tried up to twice in a row."""
    faults = _faults(rows)
    at = {"": (0, "", [])}

    def offer(into, cost, audit, lines):
        state = _states(lines)
        if state is not None and (state not in into or (cost, audit) < into[state][:2]):
            into[state] = (cost, audit, lines)
            return True
        return False

    def insert(into):
        for _ in range(3):
            for cost, audit, lines in list(into.values()):
                for role in ("user", "assistant"):
                    offer(into, cost + 5, audit + "I", [*lines, (role, "")])

    for (_, _, role, text), fault in zip(rows, faults):
        insert(at)
        fresh = {}
        for cost, audit, lines in at.values():
            offer(fresh, cost + 2, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                offer(fresh, cost + extra, audit + "K", [*lines, (role, text)])
                for other in ("user", "assistant"):
                    offer(fresh, cost + extra + 1, audit + "R", [*lines, (other, text)])
        at = fresh
    insert(at)
    return min(v for v in at.values() if LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in v[2])))


def _everything(rows):
    """The cheapest edits among all sequences with at most one insert in a gap."""
    faults, best = _faults(rows), None
    choices = [("D",) if f in ("blank", "duplicate") else ("D", "K", "Ru", "Ra") for f in faults]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(("", "u", "a"), repeat=len(rows) + 1):
            cost, audit, initials = 0, "", ""
            for k in range(len(rows) + 1):
                if gaps[k]:
                    cost, audit, initials = cost + 5, audit + "I", initials + gaps[k]
                if k < len(rows):
                    e = edits[k]
                    audit += e[0]
                    cost += {"D": 2, "K": 0, "R": 1}[e[0]] + (5 if faults[k] == "truncated" and e != "D" else 0)
                    initials += "" if e == "D" else (rows[k][2][:1] or "-") if e == "K" else e[1]
            if LEGAL.fullmatch(initials) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def _expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = _damaged([r for r in rows if r[0] == conv])
        faults, initials = _faults(mine), [r[2][:1] for r in mine]
        known = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = _cheapest(mine)
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        )
    return out


def _frame(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for name in ("times", "new", "part", "segment", "whole", "said", "audit", "lines", "cost", "l", "r"):
        frame = frame.selectExpr("*", f"'x' as `{name}`")
    return frame


def _found(spark, rows, size=256):
    frame = _frame(spark, rows)
    found = turns.digest(frame, turns.repair(turns.damage(frame), size))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r)[1:] for r in found.collect()}


def _made(rng, conv, n):
    texts = ["One. ", "Two!", "three", "", " \t", "four?", None, "five", "Six.", "Seven é!", "eight"]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", ""]
    return [(conv, rng.choice([None, rng.randrange(n + 2), k, k]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {k}.") for k in range(n)]


def test_edits_against_all_sequences():
    rng = random.Random(4)
    for _ in range(150):
        rows = _damaged(_made(rng, rng.randrange(1000), rng.randrange(5)))
        assert _cheapest(rows)[:2] == (_everything(rows) or (0, ""))


def test_small_conversations(spark):
    rng = random.Random(5)
    rows = [r for conv in range(300) for r in _made(rng, conv, rng.randrange(1, 9))]
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (2**63 - 1, 2**62, "user", "a."), (2**63 - 1, -(2**63), "user", "b?")]
    rows += [(1000, 1, "user", "Same.")] * 40
    found, expected = _found(spark, rows), _expected(rows)
    expected[2**63 - 1] = (min(expected[2**63 - 1][0], 2**63 - 1), *expected[2**63 - 1][1:])
    assert found == expected


@pytest.mark.parametrize("size", [1, 2, 7])
def test_segments_of_long_conversations(spark, size):
    rng = random.Random(size)
    rows = _made(rng, 1, 250) + _made(rng, 2, 60) + _made(rng, None, 20) + [(7, 1, "user", "Again.")] * 50
    assert _found(spark, rows, size) == _expected(rows)


def test_repaired_rows(spark):
    rows = [(3, k, "user" if k % 3 else "system", f"Text {k}." if k % 5 else "cut") for k in range(40)]
    frame = _frame(spark, rows)
    lines = turns.repaired(turns.repair(turns.damage(frame))).orderBy("part", "segment", "place").collect()
    assert [(r.role, r.text) for r in lines] == _cheapest(_damaged(rows))[2]


def test_empty_tables_and_dropped_rows(spark):
    assert _found(spark, []) == {}
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert _found(spark, [(gone, 0, "user", "x")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_very_long_text(spark):
    rows = [(1, 1, "user", "x" * 3_000_000 + "."), (1, 2, "assistant", "y.")]
    assert _found(spark, rows) == _expected(rows)
