import random

import pytest

# Columns of other people's tables, with the names that the operators use themselves.
CLASHING = ("score", "label", "node", "component", "target", "copies", "spans", "key", "_order", "kind", "start", "size", "value", "n")


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with clashing extra columns."""

    def make(rows, clash=True):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        frame = spark.createDataFrame(
            [(i, t, lang, source, len(t or "")) for i, t, lang, source in full],
            "doc_id bigint, text string, lang string, source string, n_chars bigint",
        )
        if clash:
            for name in CLASHING:
                frame = frame.selectExpr("*", f"'x' as `{name}`")
        return frame

    return make


@pytest.fixture
def prose():
    """Made-up prose: ``prose(seed, n)`` has n words."""

    def make(seed, n, words="ba de fi go lu ma ne po ri su ta vo".split()):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(n))

    return make
