"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes
are embedded, learned filters run over each chunk, each filter's largest response
in the chunk is kept (max-pooling), and a linear layer makes one logit of them.
The document's logit is the mean over its chunks; a logistic function makes the
one probability.

Fitting takes at most ``SAMPLE_ROWS`` labelled documents of each class and
``SAMPLE_CHUNKS`` seeded chunks of each; scoring covers every byte of every text.

Defined cases: a null or empty text is one chunk of zero bytes and gets that
chunk's probability; equal texts get equal scores; without labelled rows of both
classes the score is the share of class 1 (0.5 without any). A long text is
worked through in groups of chunks. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.blocks import map_blocks, text_bytes
from pagemill.llm.labelled import class_share, labelled_sample

CHUNK, STEP = 512, 448  # bytes of a chunk, and from one to the next
WIDTH, STRIDE, EMBED, FILTERS = 12, 4, 4, 24
SAMPLE_ROWS, SAMPLE_CHUNKS = 1500, 4
EPOCHS, BATCH, RATE = 8, 64, 0.004
THRESHOLD = 0.3
GROUP = 32  # chunks that are worked on at once
PLACES = (CHUNK - WIDTH) // STRIDE + 1


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray
    offset: float

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """Embedded bytes under each place of the filters: chunks x places x WIDTH * EMBED."""
        flat = self.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
        return np.lib.stride_tricks.sliding_window_view(flat, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and its place."""
        under = np.ascontiguousarray(self.windows(chunks)).reshape(-1, WIDTH * EMBED)
        response = (under @ self.filters).reshape(len(chunks), PLACES, FILTERS)
        place = response.argmax(1)
        return np.take_along_axis(response, place[:, None], 1)[:, 0] + self.bias, place

    def strongest(self, chunks: np.ndarray) -> np.ndarray:
        under = np.ascontiguousarray(self.windows(chunks)).reshape(-1, WIDTH * EMBED)
        response = (self.filters.T @ under.T).reshape(FILTERS, len(chunks), PLACES)
        return response.max(2).T + self.bias

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        return np.maximum(self.strongest(chunks), 0) @ self.out + self.offset


def chunks_of(raw: bytes) -> np.ndarray:
    """Overlapping chunks over all bytes, the last filled up with zero bytes."""
    count = max(1, -(-(len(raw) - CHUNK) // STEP) + 1)
    data = np.zeros((count - 1) * STEP + CHUNK, np.uint8)
    data[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[::STEP]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(chunks: np.ndarray, classes: np.ndarray, prior: float | None = None, seed: int = 7) -> Network:
    """Adam on the mean logistic loss, both classes with the same total weight.

    ``prior`` is the share of class 1 among all labelled rows, of which the
    chunks are a balanced sample; the offset is moved by its log odds.
    """
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.2, FILTERS).astype(np.float32),
        0.0,
    )
    share = classes.mean() if len(classes) else 0.5
    if share in (0.0, 1.0) or not len(classes):
        net.out[:] = 0
        net.offset = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net
    weight = np.where(classes == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    names = ("embed", "filters", "bias", "out")
    moments = {n: (np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))) for n in names}
    first, second, step = 0.0, 0.0, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(chunks))
        for a in range(0, len(order), BATCH):
            mine = order[a : a + BATCH]
            x, y = chunks[mine], classes[mine]
            pooled, place = net.pooled(x)
            active = np.maximum(pooled, 0)
            error = ((sigmoid(active @ net.out + net.offset) - y) * weight[mine] / len(mine)).astype(np.float32)
            back = error[:, None] * net.out * (pooled > 0)
            won = np.take_along_axis(net.windows(x), place[:, :, None], 1)  # chunk x filter x inputs
            at = place[:, :, None] * STRIDE + np.arange(WIDTH)
            used = x[np.arange(len(x))[:, None, None], at]
            to_embed = (back[:, :, None] * net.filters.T).reshape(-1, EMBED)
            grads = {
                "filters": np.einsum("bfk,bf->kf", won, back),
                "bias": back.sum(0),
                "out": error @ active + 1e-4 * net.out,
                "embed": np.stack([np.bincount(used.ravel(), to_embed[:, e], 256) for e in range(EMBED)], 1),
            }
            step += 1
            rate = RATE * (1 - epoch / EPOCHS * 0.8) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for n in names:
                m, v = moments[n]
                m += 0.1 * (grads[n] - m)
                v += 0.001 * (grads[n] ** 2 - v)
                getattr(net, n)[...] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
            g = float(error.sum())
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            net.offset -= float(rate * first / (np.sqrt(second) + 1e-8))
    if prior is not None:
        net.offset += float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
    return net


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of each text. Chunks of all texts are worked on together, a bounded number at once."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    waiting: list[np.ndarray] = []
    owner: list[np.ndarray] = []

    def flush() -> None:
        if waiting:
            mine = np.concatenate(owner)
            np.add.at(total, mine, net.logits(np.concatenate(waiting)))
            np.add.at(count, mine, 1)
            waiting.clear()
            owner.clear()

    held = 0
    for i, raw in enumerate(texts):
        cut = chunks_of(raw)
        for a in range(0, len(cut), GROUP):
            waiting.append(cut[a : a + GROUP])
            owner.append(np.full(len(waiting[-1]), i))
            held += len(waiting[-1])
            if held >= GROUP:
                flush()
                held = 0
    flush()
    return sigmoid(total / np.maximum(count, 1))


def training_chunks(sample: DataFrame, per_text: int = SAMPLE_CHUNKS) -> tuple[np.ndarray, np.ndarray]:
    """At most ``per_text`` evenly spread chunks of each sampled text, with the text's class."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        ids, chosen, classes = [], [], []
        for doc, raw, c in zip(
            block.column("doc_id").to_pylist(), text_bytes(block.column("text")), block.column("label").to_pylist()
        ):
            cut = chunks_of(raw)
            for k in np.unique(np.linspace(0, len(cut) - 1, per_text).astype(int)):
                ids.append(doc)
                chosen.append(cut[k].tobytes())
                classes.append(c)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(chosen, pa.binary()), pa.array(classes, pa.int32())], ["doc_id", "chunk", "label"])

    rows = sorted(map(tuple, map_blocks(sample, work, "doc_id bigint, chunk binary, label int").collect()))
    data = np.frombuffer(b"".join(bytes(r[1]) for r in rows), np.uint8).reshape(-1, CHUNK)
    return data, np.array([r[2] for r in rows], np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int = SAMPLE_ROWS) -> Network:
    """The network fitted to at most ``rows`` documents of each class."""
    chunks, classes = training_chunks(labelled_sample(docs, labels, label, keep, rows))
    return fit(chunks, classes, class_share(labels, label, keep))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score and predicted class of every whole text."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        found = score_texts(net, text_bytes(block.column("text")))
        return pa.record_batch([block.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = map_blocks(docs.select("doc_id", "text"), work, "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
