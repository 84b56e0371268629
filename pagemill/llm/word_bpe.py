"""BPE encoding and decoding of whole texts with a public vocabulary, by batched merge rounds.

The file is a ``tokenizers`` JSON file of a byte-level BPE model with word ends. A
text is cut at its special tokens, normalised (NFC, one blank for white space,
lower case per character), cut into words, and each distinct word of a block of
texts is encoded once. All words of a block lie in one flat array of symbols. In a
round every word finds its pair of lowest rank, by binary search of (left, right)
keys in the sorted keys of all merges, and merges all its occurrences from the left;
words without a mergeable pair leave the array. One merge of a rank at a time gives
the same result, as no merge makes a symbol that an earlier merge takes
(:class:`Vocabulary` checks that). Places where no merge can ever join the bytes on
both sides cut long words first.

A null text is an empty one and has no ids; equal texts and ids give equal rows;
rows without an id are rows like others. Very long texts are taken in pieces that
end before a blank, so only a word must fit in memory at once. Unknown ids are
passed over in decoding. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.blocks import BLOCK_BYTES, map_blocks, slices

PIECE = 1 << 20  # characters of a text that are cut into words at once
NONE = np.int64(1 << 40)  # rank of a pair that does not merge
SHIFT = 20  # bits of an id in a pair key

# Fixed values of the format: the words of a text, by letters, digits and white space of the library.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
NORMALIZERS = ("NFC", "Replace", "Lowercase")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one from 256 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printing else chr(next(rest)) for b in range(256)]


class Words:
    """Texts to normalised words; the character classes are those of the installed library."""

    def __init__(self, specials: list[str]) -> None:
        from tokenizers import Regex, normalizers

        self.nfc = normalizers.NFC()
        lower, classes = normalizers.Lowercase(), ["", "", ""]
        odd = {"Σ": "σ"}  # at the end of a word Python has another form
        for first in range(0, 0x110000, 0x4000):  # in pieces, which keeps the memory small
            every = "".join(chr(c) for c in range(first, first + 0x4000) if not 0xD800 <= c < 0xE000)
            for k, name in enumerate((r"\p{L}", r"\p{N}", r"\s")):
                classes[k] += normalizers.Replace(Regex(f"[^{name}]+"), "").normalize_str(every)
            plain = every.replace("\n", "")
            if plain:
                odd |= {c: low for c, low in zip(plain, lower.normalize_str("\n".join(plain)).split("\n")) if low != c.lower()}
        letters, digits, blanks = classes
        self.odd = {ord(c): low for c, low in odd.items()}
        self.has_odd = re.compile(f"[{_ranges(''.join(odd))}]").search
        letter, digit, blank = _ranges(letters), _ranges(digits), _ranges(blanks)
        marks = "'(?:" + "|".join(c[1:] for c in CONTRACTIONS) + ")"  # all begin with the same character
        self.find_any = re.compile(f"[{letter}]+|{marks}|[{digit}]|[^{blank}{letter}{digit}]+").findall
        self.find_ascii = re.compile(f"[a-z]+|{marks}|[0-9]|[^\\t-\\r a-z0-9]+").findall  # of lower case
        self.cut = re.compile("(" + "|".join(map(re.escape, specials)) + ")").split if specials else None
        self.beyond = re.compile("[^\\x00-˿]").search  # characters below are in normal form as they are

    def __call__(self, text: str) -> Iterator[list[str]]:
        """Words in order, special tokens as words of their own, a list for each piece of the text."""
        at = 0
        while at < len(text):
            end = text.find(" ", at + PIECE) if len(text) - at > PIECE else len(text)
            end = len(text) if end < 0 else end
            piece = text[at:end]
            at = end
            if self.cut is None or "<" not in piece:
                yield self.find(piece)
                continue
            words: list[str] = []
            for k, part in enumerate(self.cut(piece)):
                words += [part] if k % 2 else self.find(part)
            yield words

    def find(self, text: str) -> list[str]:
        if text.isascii():
            return self.find_ascii(text.lower())
        return self.find_any(self.normal(text))

    def normal(self, text: str) -> str:
        """The text in lower case; white space stays as it is, as words end there anyway."""
        if self.beyond(text):
            text = self.nfc.normalize_str(text)
            if self.has_odd(text):
                text = text.translate(self.odd)
                return "".join(c if c < "\x80" and not "A" <= c <= "Z" else c.lower() for c in text)
        return text.lower()


def _ranges(characters: str) -> str:
    """The inside of a character class of a regular expression."""
    points = np.array([ord(c) for c in sorted(set(characters))])
    cuts = np.flatnonzero(np.diff(points) != 1)
    first, last = points[np.r_[0, cuts + 1]], points[np.r_[cuts, len(points) - 1]]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last.tolist()))


class Vocabulary:
    """Merges and tokens of a vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, added = whole["model"], whole["added_tokens"]
        steps = [x["type"] for x in (whole["normalizer"] or {}).get("normalizers", [])]
        given = (model["type"], model.get("dropout"), model.get("unk_token"), model.get("byte_fallback"), model.get("ignore_merges"))
        if given != ("BPE", None, None, False, False) or tuple(steps) != NORMALIZERS or whole["decoder"] is not None:
            raise ValueError(f"not a byte-level BPE file of the kind that is read here: {path}")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError("special tokens must be matched as they stand")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {a["content"]: a["id"] for a in added}
        tokens = {i: t for t, i in {**vocab, **self.special}.items()}
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]
        signs = byte_symbols()
        self.inner = np.array([vocab[c] for c in signs], np.int64)
        self.last = np.array([vocab[c + end] for c in signs], np.int64)
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left << SHIFT | right, kind="stable")
        self.keys, self.rank, self.made = (left << SHIFT | right)[order], order.astype(np.int64), made
        first_use = np.full(len(self.tokens), len(pairs), np.int64)
        np.minimum.at(first_use, left, np.arange(len(pairs)))
        np.minimum.at(first_use, right, np.arange(len(pairs)))
        if (first_use[made] <= np.arange(len(pairs))).any() or len(np.unique(self.keys)) < len(pairs):
            raise ValueError("a merge takes a symbol that a later one makes")
        place = {c: b for b, c in enumerate(signs)}
        self.joins = np.zeros((256, 256), bool)  # bytes that some merge joins
        for a, b in pairs:
            self.joins[place[a.removesuffix(end)[-1]], place[b[0]]] = True
        raw = [(t or "").encode() + b" " if t is not None else b"" for t in self.tokens]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NONE where no merge takes it."""
        key = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids before each word and of all); no word is empty."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        apart = np.zeros(len(data), bool)  # nothing joins this place and the one before
        apart[1:] = ~self.joins[data[:-1], data[1:]]
        apart[np.r_[0, ends[:-1]]] = True
        done, at = merge(self, symbols, np.cumsum(apart) - 1)
        owner = np.repeat(np.arange(len(words)), sizes)[at]
        for k in (k for k, word in enumerate(words) if word in self.special):
            first, after = np.searchsorted(owner, [k, k + 1])
            done[first] = self.special[words[k]]
            at[first + 1 : after] = -1
        owner, done = owner[at >= 0], done[at >= 0]
        return done, np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all tokens, a blank after each; bytes of each token)."""
        ids = ids[(ids >= 0) & (ids < len(self.tokens))]
        sizes = self.sizes[ids]
        shift = self.first[ids] - (np.cumsum(sizes) - sizes)
        return self.bytes[np.arange(sizes.sum()) + np.repeat(shift, sizes)], sizes


def merge(vocabulary: Vocabulary, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of all words, whose numbers ascend; (symbols, place of the first byte of each)."""
    place = np.arange(len(symbols))
    out = [(symbols[:0], place[:0])]
    rank = np.full(len(symbols), NONE)  # of a symbol and the next one of its word
    if len(symbols) > 1:
        rank[:-1] = np.where(word[1:] == word[:-1], vocabulary.ranks(symbols[:-1], symbols[1:]), NONE)
    while len(symbols):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        sizes = np.diff(np.r_[starts, len(word)])
        best = np.minimum.reduceat(rank, starts)
        ended = best == NONE
        if ended.any():
            over = np.repeat(ended, sizes)
            out.append((symbols[over], place[over]))
            symbols, place, word, rank = symbols[~over], place[~over], word[~over], rank[~over]
            if not len(symbols):
                break
            best, sizes = best[~ended], sizes[~ended]
        hit = np.flatnonzero(rank == np.repeat(best, sizes))
        run = np.r_[True, np.diff(hit) > 1]  # of hits side by side every other one merges
        hit = hit[(np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
        symbols[hit] = vocabulary.made[rank[hit]]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        moved = hit - np.arange(len(hit))
        symbols, place, word, rank = symbols[keep], place[keep], word[keep], rank[keep]
        near = np.r_[moved, moved[moved > 0] - 1]
        inside = near[near < len(symbols) - 1]
        rank[near] = NONE
        fresh = vocabulary.ranks(symbols[inside], symbols[inside + 1])
        rank[inside] = np.where(word[inside] == word[inside + 1], fresh, NONE)
    symbols, place = (np.concatenate([o[k] for o in out]) for k in (0, 1))
    order = np.argsort(place, kind="stable")
    return symbols[order], place[order]


@functools.cache
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.cache
def words_of(path: str) -> Words:
    return Words(list(vocabulary_of(path).special))


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    vocabulary, cut = vocabulary_of(path), words_of(path)
    number: dict[str, int] = {}
    parts = [[_numbers(words, number) for words in cut(text)] for text in texts]
    if not number:
        return [b""] * len(texts)
    ids, before = vocabulary.encode(list(number))
    ids = ids.astype("<u4")
    out = []
    for text_parts in parts:
        words = np.concatenate(text_parts) if text_parts else np.zeros(0, np.int64)
        sizes = before[words + 1] - before[words]
        shift = before[words] - (np.cumsum(sizes) - sizes)
        out.append(ids[np.arange(sizes.sum()) + np.repeat(shift, sizes)].tobytes())
    return out


def _numbers(words: list[str], number: dict[str, int]) -> np.ndarray:
    for word in set(words):
        number.setdefault(word, len(number))
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def decode_ids(stored: list[bytes], path: str) -> list[bytes]:
    """The text of each run of ids as UTF-8: its tokens with a blank between them."""
    vocabulary = vocabulary_of(path)
    return [vocabulary.decode(np.frombuffer(ids, "<u4").astype(np.int64))[0].tobytes()[:-1] for ids in stored]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every document."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        ids = encode_texts([t or "" for t in block.column("text").to_pylist()], path)
        counts = pa.array([len(i) // 4 for i in ids], pa.int64())
        return pa.record_batch([block.column("doc_id"), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_blocks(docs.select("doc_id", "text"), work, f"doc_id {kind}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` and the text of their ids, as UTF-8 in the column ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in slices(batches, "ids", BLOCK_BYTES):
            decoded = decode_ids([i or b"" for i in block.column("ids").to_pylist()], path)
            yield pa.record_batch([*block.columns, pa.array(decoded, pa.binary())], [*block.schema.names, "decoded"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded text."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
