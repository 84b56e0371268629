import hashlib
import zlib

import numpy as np

from pagemill.llm import audio

TEXTS = [None, "", "x", "y" * 64, "z" * 65, "é" * 3000, "word and more " * 20000]


def test_round_trip(documents):
    rows = list(enumerate(TEXTS)) + [(None, "x"), (2, "x")]
    got = audio.features(audio.store(documents(rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (TEXTS[r.doc_id] if r.doc_id is not None else "x") or ""
        raw = raw.encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert audio.read_wav(bytes(r.media)).tobytes() == payload and len(r.media) == len(payload) + 44
        table = audio.read_tensors(bytes(r.tensors))
        assert table.schema.field("block").type == audio._TENSOR
        assert table.num_rows == -(-r.n_frames // audio.FRAMES)
        end = table.column("end_s").to_pylist()[-1]
        assert all(0 <= s.start_s < s.end_s <= end + 1e-9 for s in r.segments)
    digests = audio.digest(audio.features(audio.store(documents(rows)))).collect()
    x = [r for r in digests if r.doc_id is None or r.doc_id == 2]
    assert len({r.feature for r in x}) == 1 and len({r.media_sha256 for r in x}) == 1


def test_empty_table(documents):
    assert audio.features(audio.store(documents([]))).collect() == []


def test_blocks_do_not_change_features(monkeypatch):
    samples = np.random.default_rng(1).integers(0, 256, 50_000).astype(np.uint8)
    whole = np.concatenate([b for b, _ in audio.log_mel(samples)])
    monkeypatch.setattr(audio, "STEP", 64)
    assert np.allclose(whole, np.concatenate([b for b, _ in audio.log_mel(samples)]), atol=1e-4)


def test_resampling_keeps_a_slow_tone():
    t = np.arange(8000) / audio.RATE
    samples = np.round(128 + 100 * np.sin(2 * np.pi * 200 * t)).astype(np.uint8)
    got = audio.resample(samples, 0, 5000)[100:4900]
    want = 100 / 128 * np.sin(2 * np.pi * 200 * (np.arange(5000) / audio.OUT_RATE))[100:4900]
    best = min(np.abs(got[20:-20] - np.roll(want, k)[20:-20]).max() for k in range(-10, 11))
    assert best < 0.15


def test_hysteresis():
    loud = np.array([0, 0, 0.5, 1.5, 0.5, 0.5, 0.1, 0, 2, 0, 0, 0, 0, 0.5, 0.5, 0.5, 0.5, 0.0, 0.0])
    assert audio.segments(loud) == [(3, 6)]
