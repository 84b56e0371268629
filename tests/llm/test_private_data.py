import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.llm import private_data

SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def by_hand(text):
    spans, counts = [], []
    for kind, shape in SHAPES.items():
        mine = []
        for m in re.finditer(shape, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                mine.append(f"{kind}:{m.start()}:{m.end()}")
        spans += mine
        counts.append(len(mine))
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest())


TEXTS = [
    "a@b.c_d@e.f x@y.zz\U0001f600 \U0001f600q.w+1@mail-1.example.com, 1.2.3.4.5.6.7.8 300.1.1.1 010.1.1.255",
    "4111 1111 1111 1111 +1 (988) 555-2485. 4111-1111-1111-1111-4111 5500 0000 0000 0004",
    "a@b.c@d.e.f@g.h-@i.j.k. @x.y a@ a@b +12 +1 2 3 4 5 6 7 8 9 +++1-2-3-4-5-6-7-8-9-",
    None,
    "",
    " ",
    "a" * 20000,
    "1" * 20000,
    "1 2-3 " * 3000,
    "x@y.z " * 2000,
    "+1 " + " " * 9000,
    "1.2.3.4" * 500,
    "é 4111111111111111é",
]


def test_base_spans(documents):
    rows = list(enumerate(TEXTS)) + [(1, TEXTS[1]), (None, TEXTS[0])]
    got = private_data.digest(private_data.find(documents(rows))).collect()
    assert len(got) == len(rows)
    texts = dict(enumerate(TEXTS)) | {None: TEXTS[0]}
    for r in got:
        assert tuple(r)[1:6] == by_hand(texts[r.doc_id]), r.doc_id


def test_patterns_discover_unseen_identifiers(documents):
    valid = [str(4000000000000000 + k) for k in range(400) if luhn(str(4000000000000000 + k))]
    rows = [(k, f"word{k} account number: {v} and more") for k, v in enumerate(valid[:20])]
    rows += [(100, "my account number: 9999-1234-88 is new"), (101, "order 9999-1234-88 again"), (102, "room 123456 is free")]
    got = {r.doc_id: r for r in private_data.digest(private_data.find(documents(rows))).collect()}
    assert got[100].spans == "card:19:31" and got[100].n_added == 1 and got[100].n_card == 0
    assert got[101].spans == "card:6:18"
    assert got[102].spans == "" and all(got[k].n_added == 0 for k in range(20))


def test_mixed_contexts_discover_nothing(documents):
    rows = [(k, f"see u{k}@ex.com see 10.0.0.{k} see 12345678{k}") for k in range(30)]
    assert sum(r.n_added for r in private_data.find(documents(rows)).collect()) == 0


def test_empty_table(documents):
    assert private_data.digest(private_data.find(documents([]))).collect() == []


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 2000])
def test_running_sums(spark, n):
    frame = spark.createDataFrame([(list(range(n)),)], "x array<bigint>")
    got = frame.select(private_data.running_sums(F.col("x")).alias("s")).first().s
    assert got == [sum(range(k)) for k in range(n)]


def test_redaction(documents):
    rows = [(1, "mail a@b.cd or 1.2.3.4 now"), (2, "nothing"), (3, None)]
    found = private_data.find(documents(rows, clash=False)).select("doc_id", "spans")
    joined = documents(rows, clash=False).join(found, "doc_id")
    got = dict(map(tuple, joined.select("doc_id", private_data.redact(F.col("text"), F.col("spans"))).collect()))
    assert got == {1: "mail <email> or <ip> now", 2: "nothing", 3: None}


def test_no_python_in_the_plan(documents):
    frame = private_data.digest(private_data.find(documents([(1, "a@b.cd")])))
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def _scored_by_hand(spans):
    """Accepted patterns and strings, by loops over (value, kind, shape, patterns)."""
    strings, contexts, known = {}, {}, {}
    for value, kind, shape, patterns in spans:
        for p in patterns:
            strings.setdefault(p, set()).add(value)
        if kind:
            known[value, kind] = 1.0
        elif patterns:
            contexts.setdefault(value, set()).add((shape, tuple(patterns)))
    seeds, found = dict(known), {}

    def weight(v):
        return 1.0 if any((v, k) in seeds for k in private_data.KINDS) else max(private_data.UNDECIDED, 1 - 1 / len({c for _, c in contexts[v]}))

    for _ in range(private_data.ROUNDS):
        known = {k: max(seeds.get(k, 0), found.get(k, 0)) for k in seeds | found}
        good = {}
        for p, values in strings.items():
            for kind in private_data.KINDS:
                total = sum(known.get((v, kind), 0) for v in values)
                against = sum(weight(v) for v in values if (v, kind) not in known)
                if len(values) >= private_data.SUPPORT <= total and total / (total + against) >= private_data.CONFIDENCE:
                    good[p, kind] = total / (total + against)
        found = {}
        for value, own in contexts.items():
            informed = [c for c in {c for _, c in own} if any(len(strings[p]) >= private_data.SUPPORT for p in c)]
            for kind in private_data.KINDS:
                hits = {}
                for shape, c in own:
                    best = max((good[p, kind] for p in c if (p, kind) in good), default=None)
                    if best is not None and (shape == "address") == (kind == "email"):
                        hits[c] = max(best, hits.get(c, 0))
                if hits and sum(hits.values()) / len(informed) >= private_data.CONFIDENCE and len(hits) >= private_data.SPREAD * len({c for _, c in own}):
                    found[value, kind] = sum(hits.values()) / len(informed)
    return good, found


def test_rounds_against_loops(documents, prose):
    rng = random.Random(8)
    lead = ["call me", "card no", "write to", "host at", "room", "in the", "my id"]
    rows = []
    for k in range(400):
        what = rng.choice(lead)
        value = {
            "call me": rng.choice([f"+1 202 555 0{k:03d}", f"0171 55 {k:04d}"]),
            "card no": rng.choice(["4111 1111 1111 1111", f"40000000000{k:05d}", f"1234 5678 9012 {k:04d}"]),
            "write to": rng.choice([f"u{k}@mail.example.com", f"u{k % 7}@localhost", f"u{k}[at]host.org"]),
            "host at": rng.choice([f"10.0.{k % 256}.1", f"node{k:04d}"]),
        }.get(what, rng.choice([f"{k % 40 + 2000}", f"AB-{k % 20:04d}", f"0171 55 {rng.randrange(400):04d}"]))
        rows.append((k, f"{prose(k, 3)} {what} {value} {rng.choice(['now', 'please', 'then'])} {prose(k + 1, 2)}"))
    spans = private_data.occurrences(private_data.scanned(documents(rows))).cache()
    good, found = private_data.scored(spans)
    wanted_good, wanted_found = _scored_by_hand([(r.value, r.kind, r["shape"], r.patterns) for r in spans.collect()])
    got_good = {(r.pattern, r.kind): r.score for r in good.collect()}
    got_found = {(r.value, r.kind): r.score for r in found.collect()}
    assert got_good.keys() == wanted_good.keys() and len(got_good) >= 3
    assert got_found.keys() == wanted_found.keys() and len(got_found) >= 20
    assert all(got_good[k] == pytest.approx(v) for k, v in wanted_good.items())
    assert all(got_found[k] == pytest.approx(v) for k, v in wanted_found.items())


def found_and_wanted(documents, prose, n=600):
    """Added spans, and the places of planted identifiers, of texts with both and with look-alikes."""
    rng = random.Random(3)
    rows, wanted = [], set()

    def put(doc, text, value, kind):
        start = len(text) + 1
        wanted.add((doc, kind, start, start + len(value)))
        return f"{text} {value}"

    for k in range(n):
        text = prose(k, 12) + rng.choice([" my phone is", " please call", " card number", " mail me:", " address ip"])
        lead = text.rsplit(" ", 1)[1]
        if k % 2 == 0:  # known shapes
            start = f"4{rng.randrange(10**14):014d}"
            valid = next(f"{start}{c}" for c in range(10) if luhn(f"{start}{c}"))
            text += " " + {"is": f"+1 (212) 555-{k:04d}", "call": f"+44 171 555 {k:04d}", "number": valid, "me:": f"u{k}@mail.example.com", "ip": f"10.1.{k % 256}.{k // 256}"}[lead]
        else:
            value, kind = {
                "is": (rng.choice([f"0171 234 {k:04d}", f"(030) 55 {k:04d}"]), "phone"), "call": (f"0{rng.randrange(10**8)}5", "phone"),
                "number": (f"1234 5678 {rng.randrange(10**4):04d} {k:04d}", "card"), "me:": (rng.choice([f"user.{k}@localhost", f"u{k}[at]host.org"]), "email"),
                "ip": (f"node-{k:05d}", "ip"),
            }[lead]
            text = put(k, text, value, kind)
        text += f" {prose(k + 1, 4)} in {2000 + k % 30} there were {rng.randrange(1000, 9999)} of {rng.randrange(10**5)} {prose(k + 2, 3)}"
        rows.append((k, text))
    got = private_data.find(documents(rows, clash=False)).select("doc_id", F.explode(F.array_except("spans", "base")).alias("s")).collect()
    return {(r.doc_id, private_data.KINDS[r.s["rank"] - 1], r.s.start, r.s.end) for r in got}, wanted


def test_precision_and_recall_of_added_spans(documents, prose):
    found, wanted = found_and_wanted(documents, prose)
    assert len(found & wanted) >= 0.95 * len(found) and len(found & wanted) >= 0.95 * len(wanted)


def test_a_number_is_marked_beside_its_pattern_only(documents):
    rows = [(k, f"text {k} card number 400000000000{v} ok") for k, v in enumerate(["0002", "0010", "0028", "0036", "0044", "0051", "0069", "0077"])]
    rows += [(50, "text card number 2024 ok")] + [(60 + k, f"word{k} year 2024 was") for k in range(9)]
    rows += [(70, "x card number 1234 5678 9012 3456 ok")]
    got = {r.doc_id: r.spans for r in private_data.digest(private_data.find(documents(rows))).collect()}
    assert got[50] == "card:17:21" and all(got[60 + k] == "" for k in range(9))
    assert got[70] == "card:14:33"
