"""BPE encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def _same(texts):
    ids = word_bpe.encode_texts(texts, PATH)
    decoded = word_bpe.decode_ids(ids, PATH)
    for text, own, back, theirs in zip(texts, ids, decoded, LIBRARY.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(own, "<u4").tolist() == theirs.ids, text[:80]
        assert back.decode() == LIBRARY.decode(theirs.ids, skip_special_tokens=False)


def test_chosen_texts():
    _same(["", " ", "Hello wOrld", "aaaaaaa aa a", "I'm we'll 'S ''t", "x<|endoftext|>Y <|startoftext|>", "<|endoftext", "ΑΣ ΑΣ. İ ǅ", "é 가"])


def test_every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    _same([f"a{''.join(points[k : k + 7])} {'! '.join(points[k : k + 7])}" for k in range(0, len(points), 7)])


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text(text):
    _same([text, text + " " + text, text.upper()])


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdeé 'st\n<|>中", k=3000)), "".join(rng.choices("abcdefgh", k=20_000)), "<|endoftext|> " * 500]
    _same(texts)
    monkeypatch.setattr(word_bpe, "PIECE", 50)
    _same(texts)


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        word_bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_unknown_ids_are_passed_over():
    assert word_bpe.decode_ids([np.array([0, 4_000_000, 1], "<u4").tobytes(), b""], PATH) == [b'! "', b""]


def test_rows(documents):
    docs = documents([(1, "Two words"), (1, "Two words"), (None, None), (3, ""), (2**63 - 1, "x" * 3000)])
    rows = word_bpe.digest(word_bpe.decode(word_bpe.encode(docs, PATH), PATH)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows)[:4] == [(0, 0), (1, 2), (1, 2), (3, 0)]
    assert {r.ids_sha256 for r in rows if r.n_tokens == 0} == {r.decoded_sha256 for r in rows if r.n_tokens == 0} == {empty}
    assert next(r for r in rows if r.doc_id == 1).decoded_sha256 == hashlib.sha256(b"two</w> words</w>").hexdigest()
    assert word_bpe.digest(word_bpe.decode(word_bpe.encode(docs.limit(0), PATH), PATH)).collect() == []
