"""Language of a text by sparse multinomial logistic regression on character n-grams.

Features are counts of 1-, 2- and 3-grams of lower-cased characters (all but
letters read as blanks), hashed to ``FEATURES`` places, damped, weighted by inverse
document frequency and scaled to length 1. The regression is trained by
follow-the-regularised-leader with L1 and L2 penalties, which leaves weights of
uninformative places at exactly zero; then one temperature is fitted on a part of
the sample that training did not see, so that the score is a probability.

Fitting takes at most ``SAMPLE_ROWS`` different rows (id and text) of each language, and fewer of each
where there are so many languages that they would be more than ``SAMPLE_TOTAL`` in
all, but one of each at least: every language is learned. Document frequencies are
counted over all documents that fitting may see. Scoring reads every whole text, in bounded pieces.

Defined cases: a null text and a text without a letter give ``und`` with score 0;
so does every text when nothing could be learned. Equal texts get equal results,
and ties between languages go to the first in code point order. Only doc_id, text
and, for fitting, lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.blocks import BLOCK_BYTES, map_blocks, slices
from pagemill.sources.tables import stored

FEATURES = 1 << 12
ORDERS = (1, 2, 3)
SAMPLE_ROWS, SAMPLE_TOTAL = 300, 19_200
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 3
PIECE = 1 << 18  # characters that are worked on at once
UNKNOWN = "und"

_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32
_M = np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - FEATURES.bit_length() + 1)


def counts(text: str) -> np.ndarray:
    """Occurrences of the hashed n-grams of a whole text."""
    out = np.zeros(FEATURES, np.int64)
    text = text.lower()
    longest = max(ORDERS) - 1
    for a in range(0, len(text), PIECE):
        lead = min(a, longest)
        piece = text[a - lead : a + PIECE].encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(piece, np.uint32)
        codes = np.where(codes < 128, _FOLD[np.minimum(codes, 127)], codes)
        h = np.zeros(len(codes), np.uint32)
        for n in ORDERS:  # h[i]: hash of the n-gram that begins at i
            h = (h[: len(codes) - n + 1] * _M + codes[n - 1 :] + np.uint32(n)) if n > 1 else codes + np.uint32(1)
            mine = h[max(lead - n + 1, 0) :] * _M
            mine ^= mine >> np.uint32(15)
            mine *= np.uint32(0x85EBCA77)
            out += np.bincount(mine >> _SHIFT, minlength=FEATURES)
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # FEATURES
    weights: np.ndarray  # FEATURES x languages
    bias: np.ndarray
    temperature: float

    def vectors(self, counted: np.ndarray) -> np.ndarray:
        return weighted(counted, self.idf)

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        return softmax((vectors @ self.weights + self.bias) / self.temperature)


def weighted(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = np.log1p(counted.astype(np.float32)) * idf
    size = np.sqrt((values * values).sum(1, keepdims=True))
    return values / np.maximum(size, 1e-9)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def ftrl(vectors: np.ndarray, classes: np.ndarray, n_classes: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by follow-the-regularised-leader, one text after the other."""
    inputs = np.hstack([vectors, np.ones((len(vectors), 1), np.float32)])
    z = np.zeros((inputs.shape[1], n_classes))
    n = np.zeros_like(z)
    rng = np.random.default_rng(seed)

    def solved(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == FEATURES, 0.0, L1)[:, None]  # the bias is not shrunk
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for i in rng.permutation(len(inputs)):
            at = np.flatnonzero(inputs[i])
            x, w = inputs[i, at], solved(at)
            error = softmax((x @ w)[None])[0]
            error[classes[i]] -= 1
            g = x[:, None] * error
            square = n[at] + g * g
            z[at] += g - (np.sqrt(square) - np.sqrt(n[at])) / ALPHA * w
            n[at] = square
    w = solved(np.arange(FEATURES + 1)).astype(np.float32)
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the least log loss, by golden search on its logarithm."""
    if not len(classes):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(p[np.arange(len(classes)), classes] + 1e-12).mean())

    a, b, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(counted: np.ndarray, languages: list[str], held: np.ndarray, idf: np.ndarray) -> Model:
    """A model of counted texts; the temperature comes from the rows marked in ``held``.

    A language whose rows are all held is learned from its first one.
    """
    names = sorted(set(languages))
    if not names:
        return Model([], np.ones(FEATURES, np.float32), np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    number = {x: k for k, x in enumerate(names)}
    classes = np.array([number[x] for x in languages])
    vectors = weighted(counted, idf)
    held = held.copy()
    lone = np.bincount(classes[~held], minlength=len(names)) == 0
    first = np.unique(classes, return_index=True)[1]
    held[first[lone]] = False
    seen = ~held
    weights, bias = ftrl(vectors[seen], classes[seen], len(names))
    return Model(names, idf, weights, bias, calibrate(vectors[held] @ weights + bias, classes[held]))


def sample(docs: DataFrame, keep: Column, rows: int = SAMPLE_ROWS, total: int = SAMPLE_TOTAL) -> DataFrame:
    """(doc_id, text, lang, draw) of at most ``rows`` documents of each language, fewer if they were over ``total``.

    Rows with the same id and text are one. By a hash of both, rows are thinned to about
    four times the wanted number of each language and 40 more before they are ranked, so no
    task ranks all documents of a language. The rates are as few as the languages.
    """
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"), F.lit(1 << 52))
    allowed = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull())
    narrow = allowed.select("lang", draw.alias("_draw"))
    known = narrow.groupBy("lang").agg(F.approx_count_distinct("_draw", 0.02).alias("count"))
    rows = max(1, min(rows, total // max(known.count(), 1)))
    limit = F.least(F.lit(4.0 * rows + 40) / F.col("count"), F.lit(1.0)) * F.lit(float(1 << 52))
    # A table of its own, so that Spark sends it to all tasks if it is small and splits hot languages if not.
    rates = stored(known.select(F.col("lang").alias("_lang"), limit.alias("_limit")), "language-rates")
    thinned = narrow.join(rates, F.col("lang") == F.col("_lang")).where(F.col("_draw") <= F.col("_limit"))
    ranked = thinned.select("lang", "_draw").distinct().withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_draw")))
    chosen = ranked.where(F.col("_rank") <= rows).select(F.col("_draw").alias("_chosen"), F.col("lang").alias("_of"))
    texts = allowed.select("doc_id", "text", "lang", draw.alias("draw"))
    found = texts.join(F.broadcast(chosen), (F.col("draw") == F.col("_chosen")) & (F.col("lang") == F.col("_of")))
    one = found.groupBy("lang", "draw").agg(F.first(F.struct("doc_id", "text")).alias("_one"))
    return one.select("_one.doc_id", "_one.text", "lang", "draw")


def frequencies(docs: DataFrame, keep: Column) -> np.ndarray:
    """Inverse document frequency of every place, over all texts of the rows that ``keep`` allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)  # the last one: texts
        for block in slices(batches, "text", BLOCK_BYTES):
            for text in block.column("text").to_pylist():
                total[:-1] += counts(text) > 0
                total[-1] += 1
        place = np.flatnonzero(total)
        yield pa.record_batch([pa.array(place, pa.int64()), pa.array(total[place], pa.int64())], ["place", "n"])

    partial = docs.where(keep & F.col("text").isNotNull()).select("text").mapInArrow(run, "place bigint, n bigint")
    seen = np.zeros(FEATURES + 1, np.int64)
    for r in partial.groupBy("place").agg(F.sum("n").alias("n")).collect():
        seen[r.place] = r.n
    return (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1).astype(np.float32)


def train(docs: DataFrame, keep: Column, rows: int = SAMPLE_ROWS) -> Model:
    """A model learned from a bounded sample of the rows that ``keep`` allows."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        counted = [np.minimum(counts(t), 1 << 30).astype(np.int32).tobytes() for t in block.column("text").to_pylist()]
        return pa.record_batch([block.column("draw"), block.column("lang"), pa.array(counted, pa.binary())], ["draw", "lang", "counted"])

    drawn = sample(docs, keep, rows).select("draw", "lang", "text")
    found = map_blocks(drawn, work, "draw bigint, lang string, counted binary").collect()
    found.sort(key=lambda r: (r.draw, r.lang))
    counted = np.array([np.frombuffer(r.counted, np.int32) for r in found]).reshape(-1, FEATURES)
    return fit(counted, [r.lang for r in found], np.arange(len(found)) % 5 == 0, frequencies(docs, keep))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = block.column("text").to_pylist()
        usable = block.column("letters").to_pylist()
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if model.languages:
            mine = [i for i, ok in enumerate(usable) if ok]
            for a in range(0, len(mine), 256):
                part = mine[a : a + 256]
                p = model.probabilities(model.vectors(np.stack([counts(texts[i]) for i in part])))
                for i, best, row in zip(part, p.argmax(1), p):
                    names[i], scores[i] = model.languages[best], row[best]
        return pa.record_batch(
            [block.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            ["doc_id", "lang_pred", "score"],
        )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", "text", letters.alias("letters"))
    return map_blocks(rows, work, "doc_id bigint, lang_pred string, score double")
