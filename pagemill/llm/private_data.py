"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Base spans come from four shapes (email, ip, card, phone) with their checks.
They are the seeds: the words beside them are lexical patterns, and what looks like
an identifier is a candidate: groups of digits with blanks, dots, slashes, dashes or
brackets between them, words of letters and digits, and addresses without a domain's
dot or with a written at sign. Patterns and the strings they stand beside form a
graph that is scored in rounds. A pattern is as good as the share of its distinct
strings that are known to be of one kind, where strings known to be of another count
in full, and strings of which nothing is known by the share of their contexts that
are not this one, ``UNDECIDED`` at least; accepted patterns need ``SUPPORT`` known
strings and ``CONFIDENCE``. A string is as good as its contexts: the mean, over the
different contexts with a pattern that ``SUPPORT`` strings have, of the best accepted
pattern there; if that reaches ``CONFIDENCE``, and ``SPREAD`` of all its contexts are
accepted, it counts for later rounds. Addresses are taken for emails only, the others for
the other kinds.

Candidates beside an accepted pattern are added as spans of its kind, whole; elsewhere the
same string is added only if its own score suffices in the end, so a number that
stands beside a pattern once isn't marked wherever it stands.

Places are code points, the end exclusive. Matches of a kind are leftmost and do
not overlap; those that fail their check are dropped, without a retry. The shapes
are written so that each is found in one pass over a text, however long its runs.

Defined cases: a null text is empty and has no spans; rows that share doc_id and
text get equal results; equal strings in different places are all added; a null
doc_id stays null; an empty table gives an empty result. Only doc_id and text are
read; other columns are kept apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.sources.tables import stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SUPPORT, CONFIDENCE, SPREAD, UNDECIDED = 3, 6, 0.85, 0.5, 0.1
DIGITS, CONTEXT = 4, 80  # least digits of a candidate; code points beside a span that are looked at
BLOCK = 512

_LOCAL, _NAME = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_ID = "A-Za-z0-9._@+-"
# A run is entered at its first character, or where the match before ended.
SHAPES = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_NAME}]++(?:\.[{_NAME}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What may be an identifier, besides.
CANDIDATES = {
    "number": rf"(?<![{_ID}])[(+]?[0-9]++(?:[\x20()./-]{{1,2}}[0-9]++)*+(?![A-Za-z0-9_@])",
    "code": rf"(?:\G|(?<![{_ID}]))(?=[A-Za-z._+-]*+[0-9])(?=[0-9._+-]*+[A-Za-z])[A-Za-z0-9._+-]++",
    "address": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++(?:@|\[at\]|\(at\))[{_NAME}]++(?:\.[{_NAME}]++)*+",
}
ALL = {**SHAPES, **CANDIDATES}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(_IP)
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind in ("number", "code"):
        return F.length(_digits(match)) >= DIGITS
    return F.lit(True)


def _hint(kind: str, text: Column) -> Column:
    """A cheap test that a text without this kind mostly fails."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+")) & text.rlike(r"\+[0-9]")
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]")
    if kind == "address":
        return F.contains(text, F.lit("@")) | text.rlike(r"[\[(]at[\])]")
    return text.rlike("[0-9]")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column) -> Column:
    """Sums of all values before each one, in blocks so that long arrays cost little more than short ones."""
    zero = F.lit(0).cast("bigint")
    add = lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))

    def sums(values: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.ceil(F.size(values) / BLOCK).cast("int") - 1)
        part = lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
        totals = F.transform(blocks, lambda b: F.aggregate(part(b), zero, lambda acc, v: acc + v))
        inside = lambda before: F.transform(
            blocks,
            lambda b: let(part(b), lambda p: F.slice(F.aggregate(p, F.array(F.get(before, b)), add), F.lit(1), F.size(p))),
        )
        return F.flatten(let(F.aggregate(totals, F.array(zero), add), inside))

    return let(values, lambda v: F.when(F.size(v) > 0, sums(v)).otherwise(F.array().cast("array<bigint>")))


SPAN = "array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>"


def spans_of(kind: str, text: Column) -> Column:
    """All matches of a shape that pass its check, with their places and what stands beside them."""
    def span(parts: Column, before: Column, match: Column, i: Column) -> Column:
        start = F.get(before, i) + F.length(F.get(parts.gaps, i))
        return F.struct(
            start.alias("start"),
            (start + F.length(match)).alias("end"),
            match.alias("value"),
            F.substring(F.get(parts.gaps, i), -CONTEXT, CONTEXT).alias("left"),
            F.substring(F.get(parts.gaps, i + 1), 1, CONTEXT).alias("right"),
        )

    def spans(parts: Column) -> Column:
        lengths = F.zip_with(parts.gaps, parts.matches, lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("bigint"))
        before = running_sums(F.slice(lengths, F.lit(1), F.size(parts.matches)))
        return let(before, lambda b: F.transform(parts.matches, lambda m, i: span(parts, b, m, i)))

    matches, gaps = F.regexp_extract_all(text, F.lit(ALL[kind]), F.lit(0)), F.split(text, ALL[kind], -1)
    found = let(F.struct(matches.alias("matches"), gaps.alias("gaps")), spans)
    passing = F.filter(found, lambda s: _passes(kind, s.value))
    return F.when(_hint(kind, text), passing).otherwise(F.array().cast(SPAN)).cast(SPAN)


def key_of(doc_id: Column, text: Column) -> Column:
    """What identifies a row: its id and a hash of its text."""
    whole = F.coalesce(text, F.lit(""))
    hashes = (F.hex(F.xxhash64(whole)), F.hex(F.xxhash64(F.lit(1), whole)))
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), *hashes)


def scanned(docs: DataFrame) -> DataFrame:
    """One narrow row per document: its key, base spans by kind, and candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", key_of(F.col("doc_id"), text).alias("key"), *(spans_of(k, text).alias(k) for k in ALL))


def _patterns(left: Column, right: Column) -> Column:
    """Lexical patterns of what stands beside a span: a word before, two, or one on either side."""
    one = F.lower(F.regexp_extract(left, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1))
    two = F.lower(F.regexp_extract(left, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1))
    after = F.lower(F.regexp_extract(right, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1))
    return F.filter(
        F.array(
            F.when(one != "", F.concat(F.lit("1:"), one)),
            F.when(two != "", F.concat(F.lit("2:"), two)),
            F.when((one != "") & (after != ""), F.concat(F.lit("b:"), one, F.lit(" _ "), after)),
        ),
        lambda p: p.isNotNull(),
    )


def occurrences(found: DataFrame) -> DataFrame:
    """(key, kind, start, end, value, shape, patterns) of every span; candidates have no kind.

    Candidates that overlap a base span are left out, by a join on cells of the text.
    """

    def rows(kind: str) -> DataFrame:
        each = found.where(F.size(kind) > 0).select("key", F.explode(kind).alias("s"))
        label = F.lit(kind if kind in KINDS else None).cast("string")
        return each.select("key", label.alias("kind"), F.lit(kind).alias("shape"), "s.*")

    base = rows(KINDS[0])
    for kind in KINDS[1:]:
        base = base.unionByName(rows(kind))
    other = rows("number").unionByName(rows("code")).unionByName(rows("address")).distinct()
    cell = lambda: F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor((F.col("end") - 1) / 64)))
    taken = base.select(F.col("key").alias("k"), F.col("start").alias("a"), F.col("end").alias("b"), cell().alias("c"))
    placed = other.select("key", "start", "end", cell().alias("cell"))
    same = (F.col("key") == F.col("k")) & (F.col("cell") == F.col("c"))
    hit = placed.join(taken, same & (F.col("start") < F.col("b")) & (F.col("a") < F.col("end")), "left_semi")
    free = other.join(hit.select("key", "start", "end").distinct(), ["key", "start", "end"], "left_anti")
    every = base.distinct().unionByName(free.select(*base.columns))
    return every.select("key", "kind", "start", "end", "value", "shape", _patterns(F.col("left"), F.col("right")).alias("patterns"))


def fits(shape: Column, kind: Column) -> Column:
    """Whether a candidate of this shape may be of this kind."""
    return (shape == "address") == (kind == "email")


def _context(patterns: Column) -> Column:
    return F.array_join(patterns, "\n")


def scored(spans: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, score) of the accepted patterns, and (value, kind, score) of the candidates that count.

    Both are of the last round. The tables of a round are stored, so a hot pattern is a
    skewed join of two tables, which Spark splits.
    """
    edges = spans.where(F.size("patterns") > 0).select("value", "shape", "kind", "patterns").distinct()
    edges = edges.select("value", "shape", "kind", _context(F.col("patterns")).alias("context"), F.explode("patterns").alias("pattern"))
    edges = stored(edges, "private-edges")
    strings = edges.select("value", "pattern").distinct()
    sizes = stored(strings.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT), "private-patterns")
    open_ = edges.where(F.col("kind").isNull()).select("value", "shape", "context", "pattern").distinct()
    open_ = stored(open_.join(sizes, "pattern", "left"), "private-open")
    measured = open_.groupBy("value").agg(
        F.count_distinct("context").alias("contexts"), F.count_distinct(F.when(F.col("n").isNotNull(), F.col("context"))).alias("informed")
    )
    measured = stored(measured, "private-contexts")
    seeds = spans.where(F.col("kind").isNotNull()).select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    seeds = stored(seeds, "private-seeds")
    # What a string counts in its patterns, and all strings of a pattern together.
    weight = F.when(F.col("seed"), 1.0).otherwise(F.greatest(F.lit(UNDECIDED), 1 - 1 / F.col("contexts")))
    is_seed = seeds.select("value").distinct().withColumn("seed", F.lit(True))
    weights = strings.join(sizes, "pattern", "left_semi").join(is_seed, "value", "left").join(measured, "value", "left")
    telling = stored(weights.select("value", "pattern", weight.alias("weight")), "private-telling")
    totals = stored(telling.groupBy("pattern").agg(F.sum("weight").alias("total")), "private-totals")
    found = None
    for _ in range(rounds):
        known = seeds if found is None else seeds.unionByName(found).groupBy("value", "kind").agg(F.max("score").alias("score"))
        sums = telling.join(known, "value").groupBy("pattern", "kind")
        sums = sums.agg(F.sum("score").alias("sum"), F.sum("weight").alias("own")).join(totals, "pattern")
        share = F.col("sum") / (F.col("sum") + F.greatest(F.col("total") - F.col("own"), F.lit(0.0)))
        good = sums.where((F.col("sum") >= SUPPORT) & (share >= CONFIDENCE))
        good = stored(good.select("pattern", "kind", share.alias("score")), "private-good")
        hits = open_.where(F.col("n").isNotNull()).join(good, "pattern").where(fits(F.col("shape"), F.col("kind")))
        hits = hits.groupBy("value", "kind", "context").agg(F.max("score").alias("score"))
        sums = hits.groupBy("value", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("accepted"))
        score = F.col("sum") / F.col("informed")
        enough = (score >= CONFIDENCE) & (F.col("accepted") >= SPREAD * F.col("contexts"))
        found = stored(sums.join(measured, "value").where(enough).select("value", "kind", score.alias("score")), "private-found")
    return good, found


def discovered(spans: DataFrame) -> DataFrame:
    """(key, kind, start, end) of candidates beside accepted patterns, and of strings whose score suffices everywhere."""
    good, found = scored(spans)
    best = F.max_by("kind", F.struct("score", -F.array_position(F.lit(list(KINDS)), F.col("kind"))))
    free = spans.where(F.col("kind").isNull()).drop("kind")
    place = ["key", "start", "end"]
    beside = free.select(*place, "shape", F.explode("patterns").alias("pattern")).join(good, "pattern")
    beside = beside.where(fits(F.col("shape"), F.col("kind"))).select(*place, "kind", "score")
    anywhere = free.join(found, "value").select(*place, "kind", "score")
    return beside.unionByName(anywhere).groupBy(*place).agg(best.alias("kind")).select("key", "kind", "start", "end")


def _written(spans: Column) -> Column:
    """kind:start:end of (rank, start, end) structs, comma-joined in order."""
    name = lambda s: F.element_at(F.lit(list(KINDS)), s.rank)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s.start, s.end)), ",")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_added): arrays of (rank of the kind, start, end)."""
    found = stored(scanned(docs), "private-spans")
    added = discovered(stored(occurrences(found), "private-occurrences"))
    plain = lambda k, c: F.transform(c, lambda s: F.struct(F.lit(KINDS.index(k) + 1).alias("rank"), s.start.alias("start"), s.end.alias("end")))
    rank = F.array_position(F.lit(list(KINDS)), F.col("kind")).cast("int")
    added = added.groupBy(F.col("key").alias("_key")).agg(
        F.collect_set(F.struct(rank.alias("rank"), F.col("start"), F.col("end"))).alias("_added")
    )
    joined = found.join(added, F.col("key") == F.col("_key"), "left")
    base = F.concat(*(plain(k, F.col(k)) for k in KINDS))
    more = F.coalesce(F.col("_added"), F.array().cast("array<struct<rank:int,start:bigint,end:bigint>>"))
    return joined.select(
        "doc_id",
        "key",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS),
        base.alias("base"),
        F.array_sort(F.concat(base, more)).alias("spans"),
        F.size(more).cast("bigint").alias("n_added"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *(f"n_{k}" for k in KINDS),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        "n_added",
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    merged = F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s["rank"].alias("rank")))),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s.end <= acc["at"], acc).otherwise(
            F.struct(
                s.end.alias("at"),
                F.when(
                    s.start >= acc["at"],
                    F.concat(
                        acc["out"],
                        F.array(
                            F.substring(text, (acc["at"] + 1).cast("int"), (s.start - acc["at"]).cast("int")),
                            F.concat(F.lit("<"), F.element_at(F.lit(list(KINDS)), s["rank"]), F.lit(">")),
                        ),
                    ),
                )
                .otherwise(acc["out"])
                .alias("out"),
            )
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, merged).otherwise(text)
