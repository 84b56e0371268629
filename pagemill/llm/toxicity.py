"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text's words (runs without blanks) are read in overlapping windows of ``WINDOW``
words that cover all of it; a word of more than ``LONG`` bytes is read as pieces of
at most as many, which overlap by half. A word enters as a learned vector of its
own, if it is frequent in the training sample (lower-cased, outer punctuation
removed), plus the mean of the learned vectors of all its byte trigrams (lower-cased
only). So every byte but the blanks reaches the network. Two gated recurrent layers read the window in either direction, attention weighs their
states, and a linear layer makes the window's logit. A text is as toxic as its
worst window; a logistic curve fitted on whole sampled texts makes that a
probability.

Training takes at most ``SAMPLE_ROWS`` labelled documents of each class and
``SAMPLE_WINDOWS`` windows of each. Labels are of documents, not of windows: first
all windows of a document carry its label, then only its worst ones do.

Defined cases: a null, empty or blank text is one window of padding and gets that
window's probability; equal texts get equal scores; without labelled rows of both
classes the score is the share of class 1 (0.5 without any). A long text is
worked through in groups of windows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.blocks import BLOCK_BYTES, map_blocks, slices
from pagemill.llm.labelled import class_share, labelled_sample

WINDOW, STEP = 32, 24  # words
HIDDEN, WORD, CHAR, BUCKETS, VOCABULARY = 8, 8, 8, 2048, 4096
LONG = 20  # bytes of a word that is read in one piece
SAMPLE_ROWS, SAMPLE_WINDOWS = 1500, 40
EPOCHS, WORST_FROM, BATCH, RATE, DECAY, EVIDENCE = 10, 2, 128, 0.01, 1e-3, 2.0
THRESHOLD = 0.3
GROUP = 2048  # windows that are worked on at once
KNOWN_WORDS = 300_000  # words whose inputs a task keeps
PAD, RARE = 0, 1
NONE = -1  # fills the codes of words with fewer trigrams than others


def normal(word: str) -> str:
    """The word in lower case without punctuation around it."""
    return word.strip(punctuation).lower()


def pieces(word: str) -> list[str]:
    """The word, or overlapping pieces of at most ``LONG`` bytes that cover it."""
    if 4 * len(word) <= LONG or len(word.encode("utf-8", "surrogatepass")) <= LONG:
        return [word]
    width = LONG // len(max(word).encode("utf-8", "surrogatepass"))  # characters
    step = width // 2
    return [word[a : a + width] for a in [*range(0, max(len(word) - width, 0), step), max(len(word) - width, 0)]]


def units(text: str) -> list[str]:
    """What windows are made of: the words of a text, long ones in pieces."""
    return [piece for word in text.split() for piece in (pieces(word) if 4 * len(word) > LONG else (word,))]


def trigrams(word: str) -> list[int]:
    """Hashes of all byte trigrams of a word in lower case."""
    marked = f"<{word}>".encode("utf-8", "surrogatepass")
    return [zlib.crc32(marked[k : k + 3]) % BUCKETS for k in range(max(len(marked) - 2, 1))]


def padded(found: list[array]) -> np.ndarray:
    """Codes of words as rows of one length."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    out = np.full((len(found), int(sizes.max())), NONE, np.int16)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(found), np.int16)
    return out


def starts(n_words: int) -> list[int]:
    """First words of the windows over ``n_words``."""
    if n_words <= WINDOW:
        return [0]
    return [*range(0, n_words - WINDOW, STEP), n_words - WINDOW]


def shares(codes: np.ndarray) -> np.ndarray:
    """The part that each trigram of a word has in their mean."""
    there = codes[:, 1:] != NONE
    return there.astype(np.float32) / np.maximum(there.sum(1, keepdims=True), 1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fresh(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    inputs = WORD + CHAR
    r = lambda *shape: rng.normal(0, 0.25, shape).astype(np.float32)
    p = {"word": r(VOCABULARY + 2, WORD), "char": r(BUCKETS, CHAR), "look": r(2 * HIDDEN), "out": r(2 * HIDDEN)}
    for d in "fb":  # forward, backward
        p |= {f"gate_in_{d}": r(inputs, 2 * HIDDEN), f"new_in_{d}": r(inputs, HIDDEN)}
        p |= {f"gate_at_{d}": r(HIDDEN, 2 * HIDDEN), f"new_at_{d}": r(HIDDEN, HIDDEN)}
        p |= {f"gate_0_{d}": np.zeros(2 * HIDDEN, np.float32), f"new_0_{d}": np.zeros(HIDDEN, np.float32)}
    return p | {"offset": np.zeros(1, np.float32)}


@dataclass
class Network:
    vocabulary: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=lambda: _fresh(11))
    slope: float = 1.0  # of the curve over the worst window's logit
    shift: float = 0.0

    def codes(self, word: str) -> array:
        """Number of a word as it stands in a text, and its trigrams."""
        plain = normal(word)
        return array("h", [self.vocabulary.get(plain, RARE), *trigrams(word.lower())])

    def inputs(self, codes: np.ndarray) -> np.ndarray:
        share = shares(codes)
        chars = np.zeros((len(codes), CHAR), self.p["char"].dtype)
        for k in range(share.shape[1]):
            chars += self.p["char"][codes[:, 1 + k]] * share[:, k, None]
        return np.hstack([self.p["word"][codes[:, 0]], chars])

    def tables(self, codes: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """What each word adds to the gates and the new state, by direction."""
        x = self.inputs(codes)
        return {
            d: (x @ self.p[f"gate_in_{d}"] + self.p[f"gate_0_{d}"], x @ self.p[f"new_in_{d}"] + self.p[f"new_0_{d}"])
            for d in "fb"
        }

    def states(self, windows: np.ndarray, tables: dict, d: str, keep: list | None = None) -> np.ndarray:
        """States after each word: WINDOW x windows x HIDDEN. ``keep`` gets what training needs."""
        gates, news = tables[d]
        at_gate, at_new = self.p[f"gate_at_{d}"], self.p[f"new_at_{d}"]
        out = np.empty((WINDOW, len(windows), HIDDEN), np.float32)
        h = np.zeros((len(windows), HIDDEN), np.float32)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            mine = windows[:, t]
            g = gates[mine]
            g += h @ at_gate
            np.negative(g, out=g)
            np.exp(np.minimum(g, 30, out=g), out=g)
            g += 1
            np.reciprocal(g, out=g)
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            n = news[mine]
            was = h @ at_new
            n += r * was
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((t, h, g, n, was))
            h = n + z * (h - n)
            out[t] = h
        return out

    def pool(self, windows: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> tuple:
        """Attention over the words that are not padding: (weights, pooled state, logit)."""
        look = forward @ self.p["look"][:HIDDEN] + backward @ self.p["look"][HIDDEN:]
        real = windows.T != PAD
        real[0] |= ~real.any(0)
        look = np.where(real, look, -1e9)
        weight = np.exp(look - look.max(0))
        weight /= weight.sum(0)
        pooled = np.hstack([np.einsum("tn,tnh->nh", weight, s) for s in (forward, backward)])
        return weight, pooled, pooled @ self.p["out"] + self.p["offset"]

    def logits(self, windows: np.ndarray, tables: dict) -> np.ndarray:
        return self.pool(windows, self.states(windows, tables, "f"), self.states(windows, tables, "b"))[2]

    def gradients(self, windows: np.ndarray, codes: np.ndarray, wanted: np.ndarray, weights: np.ndarray) -> dict:
        """Gradients of the weighted logistic loss of a batch."""
        p, tables = self.p, self.tables(codes)
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self.states(windows, tables, d, kept[d]) for d in "fb"}
        weight, pooled, logit = self.pool(windows, states["f"], states["b"])
        error = ((sigmoid(logit) - wanted) * weights).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        grads["out"] += error @ pooled
        grads["offset"] += error.sum()
        to_pooled = error[:, None] * p["out"]
        to_x = np.zeros((len(codes), WORD + CHAR), np.float32)
        x = self.inputs(codes)
        both = np.concatenate([states["f"], states["b"]], 2)
        to_weight = np.einsum("tnh,nh->tn", both, to_pooled)
        to_look = weight * (to_weight - (weight * to_weight).sum(0))
        grads["look"] += np.einsum("tn,tnh->h", to_look, both)
        to_state = weight[:, :, None] * to_pooled + to_look[:, :, None] * p["look"]
        for k, d in enumerate("fb"):
            at_gate, at_new = p[f"gate_at_{d}"], p[f"new_at_{d}"]
            gate_sum = np.zeros((len(codes), 2 * HIDDEN), np.float32)
            new_sum = np.zeros((len(codes), HIDDEN), np.float32)
            carry = np.zeros((len(windows), HIDDEN), np.float32)
            for t, h, g, n, was in reversed(kept[d]):
                z, r = g[:, :HIDDEN], g[:, HIDDEN:]
                to_h = to_state[t, :, k * HIDDEN : (k + 1) * HIDDEN] + carry
                to_n = to_h * (1 - z) * (1 - n * n)
                to_g = np.hstack([to_h * (h - n), to_n * was]) * g * (1 - g)
                to_was = to_n * r
                carry = to_h * z + to_was @ at_new.T + to_g @ at_gate.T
                grads[f"gate_at_{d}"] += h.T @ to_g
                grads[f"new_at_{d}"] += h.T @ to_was
                np.add.at(gate_sum, windows[:, t], to_g)
                np.add.at(new_sum, windows[:, t], to_n)
            grads[f"gate_0_{d}"] += gate_sum.sum(0)
            grads[f"new_0_{d}"] += new_sum.sum(0)
            grads[f"gate_in_{d}"] += x.T @ gate_sum
            grads[f"new_in_{d}"] += x.T @ new_sum
            to_x += gate_sum @ p[f"gate_in_{d}"].T + new_sum @ p[f"new_in_{d}"].T
        np.add.at(grads["word"], codes[:, 0], to_x[:, :WORD])
        share = shares(codes)
        row, k = np.nonzero(share)
        np.add.at(grads["char"], codes[row, 1 + k], to_x[row, WORD:] * share[row, k, None])
        return grads


class Words(dict):
    """Numbers of the words met so far, with their codes and tables; number 0 is padding."""

    def __init__(self, net: Network) -> None:
        super().__init__()
        self.net = net
        self.found: list[array] = [array("h", [PAD, 0])]
        self.done = 0  # words that the tables hold
        self.held = {d: (np.empty((0, 2 * HIDDEN), np.float32), np.empty((0, HIDDEN), np.float32)) for d in "fb"}

    def __missing__(self, word: str) -> int:
        number = self[word] = self.done + len(self.found)
        self.found.append(self.net.codes(word))
        return number

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def codes(self) -> np.ndarray:
        """Codes of all words, if the tables were never asked for."""
        return padded(self.found)

    def tables(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """The network's tables of all words met so far."""
        if self.found:
            new = self.net.tables(padded(self.found))
            self.held = {d: tuple(np.concatenate(pair) for pair in zip(self.held[d], new[d])) for d in "fb"}
            self.done += len(self.found)
            self.found = []
        return self.held


def windows_of(numbers: np.ndarray) -> np.ndarray:
    """All windows of a text's word numbers, padded to one window at least."""
    if len(numbers) < WINDOW:
        numbers = np.concatenate([numbers, np.full(WINDOW - len(numbers), PAD, np.int64)])
    return np.lib.stride_tricks.sliding_window_view(numbers, WINDOW)[starts(len(numbers))]


def evidence(texts: list[list[str]], classes: np.ndarray, frequent: list[str]) -> np.ndarray:
    """Where each word's first coordinate starts: how surely its documents are of one class.

    The signed root of the likelihood ratio of its counts of documents by class, scaled down.
    """
    place = {w: k for k, w in enumerate(frequent)}
    seen = np.zeros((2, len(frequent)))
    for doc, c in zip(texts, classes):
        for k in {place[n] for window in doc for w in window.split() if (n := normal(w)) in place}:
            seen[int(c), k] += 1
    size = np.array([[(classes == 0).sum()], [(classes == 1).sum()]])
    share = seen.sum(0) / size.sum()
    log = lambda p: np.log(np.clip(p, 1e-9, 1))
    own = seen / size
    ratio = (seen * (log(own) - log(share)) + (size - seen) * (log(1 - own) - log(1 - share))).sum(0)
    return (np.sign(own[1] - own[0]) * np.sqrt(np.maximum(2 * ratio, 0)) / EVIDENCE).astype(np.float32)


def fit(texts: list[list[str]], classes: np.ndarray, prior: float | None = None, seed: int = 3) -> Network:
    """A network for documents given as lists of windows of words, and their classes."""
    seen = Counter(w for doc in texts for w in {normal(x) for window in doc for x in window.split()})
    frequent = sorted((w for w in seen if seen[w] >= 3), key=lambda w: (-seen[w], w))[:VOCABULARY]
    net = Network({w: k + 2 for k, w in enumerate(frequent)})
    for name in ("word", "char"):
        net.p[name] *= 0.2
    share = float(classes.mean()) if len(classes) else 0.5
    if share in (0.0, 1.0) or not len(classes):
        net.slope, net.shift = 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net
    net.p["word"][2 : 2 + len(frequent), 0] = evidence(texts, classes, frequent)
    table = Words(net)
    windows = np.concatenate([windows_of(table.of(w.split()))[:1] for doc in texts for w in doc])
    owner = np.repeat(np.arange(len(texts)), [len(doc) for doc in texts])
    codes, label = table.codes(), classes[owner]
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        chosen = np.flatnonzero(rng.random(len(windows)) < 0.25)
        if epoch >= WORST_FROM:  # of toxic documents the worst window, of the others the worst two and two more
            logit = _logits(net, windows, codes)
            order = np.lexsort((-logit, owner))
            rank = np.empty(len(order), np.int64)
            first = np.searchsorted(owner[order], np.arange(len(texts)))
            rank[order] = np.arange(len(order)) - first[owner[order]]
            chosen = np.flatnonzero(np.where(label == 1, rank < 1, (rank < 2) | (rng.random(len(windows)) < 0.1)))
        even = np.where(label == 1, 0.5 / (label[chosen] == 1).sum(), 0.5 / (label[chosen] == 0).sum()) * len(chosen)
        chosen = rng.permutation(chosen)
        for a in range(0, len(chosen), BATCH):
            mine = chosen[a : a + BATCH]
            used, inverse = np.unique(windows[mine], return_inverse=True)
            local = inverse.reshape(len(mine), WINDOW) + (used[0] != PAD)
            mapped = codes[used] if used[0] == PAD else np.vstack([codes[:1], codes[used]])
            grads = net.gradients(local, mapped, label[mine], even[mine] / len(mine))
            step += 1
            rate = RATE * (1 - 0.8 * epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, (m, v) in moments.items():
                grads[k] += DECAY * net.p[k]
                m += 0.1 * (grads[k] - m)
                v += 0.001 * (grads[k] ** 2 - v)
                net.p[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    worst = np.full(len(texts), -np.inf)  # of the given windows; train() has all windows of the texts
    np.maximum.at(worst, owner, _logits(net, windows, codes))
    share = prior if prior is not None else share
    net.slope, net.shift = _curve(worst, classes, min(max(share, 1e-3), 1 - 1e-3))
    return net


def _logits(net: Network, windows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    tables = net.tables(codes)
    return np.concatenate([net.logits(windows[a : a + GROUP], tables) for a in range(0, len(windows), GROUP)])


def _curve(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, classes weighted to the prior."""
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    inputs = np.stack([x, np.ones(len(x))], 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(inputs @ at)
        slope = inputs.T @ (weight * (p - y)) + np.array([1e-2 * at[0], 0])
        curve = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + 1e-2 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        at = at - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return float(max(at[0], 0.0)), float(at[1])


def worst_of(net: Network, texts: list[str], table: Words) -> np.ndarray:
    """Logit of the worst window of each whole text; windows of all texts are worked on together."""
    numbers = [table.of(units(t)) for t in texts]
    tables = table.tables()
    worst = np.full(len(texts), -np.inf)
    waiting: list[np.ndarray] = []
    owner: list[np.ndarray] = []

    def flush() -> None:
        windows, mine = np.concatenate(waiting), np.concatenate(owner)
        np.maximum.at(worst, mine, net.logits(windows, tables))
        waiting.clear()
        owner.clear()

    held = 0
    for i, mine in enumerate(numbers):
        cut = windows_of(mine)
        for a in range(0, len(cut), GROUP):
            waiting.append(cut[a : a + GROUP])
            owner.append(np.full(len(waiting[-1]), i))
            held += len(waiting[-1])
            if held >= GROUP:
                flush()
                held = 0
    if waiting:
        flush()
    return worst


def score_texts(net: Network, texts: list[str], table: Words) -> np.ndarray:
    """Probability of each whole text."""
    return sigmoid(net.slope * worst_of(net, texts, table) + net.shift)


def training_windows(sample: DataFrame, per_text: int = SAMPLE_WINDOWS) -> tuple[list[list[str]], np.ndarray]:
    """At most ``per_text`` evenly spread windows of each sampled text, with the text's class."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        chosen = []
        for text in block.column("text").to_pylist():
            words = units(text)
            at = starts(len(words))
            picked = [at[k] for k in np.unique(np.linspace(0, len(at) - 1, per_text).astype(int))]
            chosen.append([" ".join(words[a : a + WINDOW]) for a in picked])
        return pa.record_batch(
            [block.column("doc_id"), pa.array(chosen, pa.list_(pa.string())), block.column("label")],
            ["doc_id", "windows", "label"],
        )

    rows = map_blocks(sample, work, "doc_id bigint, windows array<string>, label int").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.windows))
    return [r.windows for r in rows], np.array([r.label for r in rows], np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int = SAMPLE_ROWS) -> Network:
    """The network fitted to at most ``rows`` documents of each class."""
    sample = labelled_sample(docs, labels, label, keep, rows)
    texts, classes = training_windows(sample)
    prior = class_share(labels, label, keep)
    net = fit(texts, classes, prior)
    if len(set(classes.tolist())) == 2:
        net.slope, net.shift = whole_curve(net, sample, prior)
    return net


def whole_curve(net: Network, sample: DataFrame, prior: float) -> tuple[float, float]:
    """The curve over the worst of all windows of the sampled texts."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        found = worst_of(net, block.column("text").to_pylist(), Words(net))
        return pa.record_batch([pa.array(found, pa.float64()), block.column("label")], ["worst", "label"])

    rows = sorted((r.worst, r.label) for r in map_blocks(sample, work, "worst double, label int").collect())
    worst, classes = np.array(rows).T
    return _curve(worst, classes, min(max(prior, 1e-3), 1 - 1e-3))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score and predicted class of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Words(net)
        for block in slices(batches, "text", BLOCK_BYTES):
            if len(table) > KNOWN_WORDS:
                table = Words(net)
            found = score_texts(net, [t or "" for t in block.column("text").to_pylist()], table)
            yield pa.record_batch([block.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
