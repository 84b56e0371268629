"""Audio columns: lossless 8-bit samples, log-mel features and energy segments.

``store`` turns bytes into a WAV column: one channel of unsigned 8-bit samples at
8 kHz, so that the samples are the payload bytes and nothing is lost. ``features``
reads the stored bytes back, resamples them by a polyphase filter, takes
overlapped log-mel filterbanks, and finds the loud segments by an energy
threshold with hysteresis. Features are fixed-shape Arrow tensors: one tensor of
64 frames x 24 bands per block of frames, the last one filled up with the floor
value, each with its time span, as an Arrow stream in a binary column.

Defined cases: a null text is the empty text; the payload of an empty text is 64
zero bytes; equal texts give equal values in every column but the id; a long
text is worked through in blocks of a bounded number of samples; rows and ids may
repeat or be null, and an empty table gives an empty result. Only doc_id and text
are read.
"""

from __future__ import annotations

import hashlib
import io
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.blocks import map_blocks

RATE = 8000
PAD = 64
UP, DOWN, TAPS = 2, 3, 12  # 8,000 samples a second become 5,333
FRAME, HOP, BANDS = 256, 128, 24
FRAMES = 64  # of a tensor
OPEN, CLOSE = 1.0, 0.25  # dB over the median energy of a recording: a segment starts, ends
LEAST_FRAMES = 3  # of a segment
FLOOR = 1e-6
STEP = FRAMES * 32  # frames that are worked on at once

OUT_RATE = RATE * UP / DOWN
SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint,"
    " media binary, n_frames bigint, tensors binary, segments array<struct<start_s:double,end_s:double>>"
)


def _little(value: Column, size: int) -> Column:
    """The low ``size`` bytes of an integer column, lowest first."""
    digits = F.lpad(F.hex(value), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * (size - k) - 1, 2) for k in range(size)]))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: the text's bytes, padded to a multiple of 64, as a WAV file."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length(raw)
    room = F.greatest(F.ceil(size / PAD), F.lit(1)).cast("bigint") * PAD
    zeros = F.unhex(F.repeat(F.lit("00"), (room - size).cast("int")))
    head = F.concat(
        F.lit(b"RIFF"), _little(room + 36, 4), F.lit(b"WAVEfmt "),
        F.lit((16).to_bytes(4, "little") + b"\x01\x00\x01\x00" + RATE.to_bytes(4, "little") * 2 + b"\x01\x00\x08\x00"),
        F.lit(b"data"), _little(room, 4),
    )
    return docs.select("doc_id", size.cast("bigint").alias("n_bytes"), F.concat(head, raw, zeros).alias("media"))


def read_wav(media: bytes) -> np.ndarray:
    """The 8-bit samples of a stored recording."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[34:36] != b"\x08\x00":
        raise ValueError("not a WAV file of 8-bit samples")
    size = int.from_bytes(media[40:44], "little")
    samples = np.frombuffer(media, np.uint8, offset=44)
    if len(samples) != size:
        raise ValueError("a WAV file of another length than it states")
    return samples


def _phases() -> np.ndarray:
    """The low-pass filter's taps by phase; each phase sums to 1."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    taps = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    phases = taps.reshape(TAPS, UP).T
    return (phases / phases.sum(1, keepdims=True)).astype(np.float32)


def resample(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """``count`` output samples from number ``first``; silence lies before and after the input."""
    at = (first + np.arange(count, dtype=np.int64)) * DOWN
    lowest, highest = int(at[0] // UP) - TAPS + 1, int(at[-1] // UP)
    part = np.full(highest - lowest + 1, 128, np.uint8)
    a, b = max(lowest, 0), min(highest + 1, len(samples))
    if a < b:
        part[a - lowest : b - lowest] = samples[a:b]
    wave = (part.astype(np.float32) - 128) / 128
    out = np.empty(count, np.float32)
    phases = _PHASES
    for start in range(UP):  # outputs of one phase lie DOWN inputs apart
        mine = at[start::UP]
        if not len(mine):
            continue
        base, taps = int(mine[0] // UP) - lowest, phases[int(mine[0] % UP)]
        total = np.zeros(len(mine), np.float32)
        for k in range(TAPS):
            total += taps[k] * wave[base - k : base - k + DOWN * (len(mine) - 1) + 1 : DOWN]
        out[start::UP] = total
    return out


def _mel() -> np.ndarray:
    """Triangular bands, evenly spaced in mel, as FFT bins x bands."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(OUT_RATE / 2), BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / OUT_RATE)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.clip(np.minimum((f - low) / (mid - low), (high - f) / (high - mid)), 0, None).astype(np.float32)


_PHASES = _phases()
_BANDS = _mel()
_WINDOW = np.hanning(FRAME).astype(np.float32)
_TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, BANDS))
TENSOR_SCHEMA = pa.schema([("block", _TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64())])


def n_frames(n_samples: int) -> int:
    """Frames over the whole recording; the last one may run over its end."""
    resampled = -(-n_samples * UP // DOWN)
    return max(1, math.ceil((resampled - FRAME) / HOP) + 1)


def log_mel(samples: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(frames x bands of log energy, dB of each frame), in blocks of ``STEP`` frames."""
    total = n_frames(len(samples))
    for first in range(0, total, STEP):
        count = min(STEP, total - first)
        wave = resample(samples, first * HOP, (count - 1) * HOP + FRAME)
        frames = np.lib.stride_tricks.sliding_window_view(wave, FRAME)[::HOP] * _WINDOW
        power = np.fft.rfft(frames)
        power = power.real**2 + power.imag**2
        bands = np.log(power.astype(np.float32) @ _BANDS + FLOOR)
        yield bands, 10 * np.log10((frames * frames).mean(1) + FLOOR)


def segments(decibels: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames [start, end) that rise ``OPEN`` over the median and stay ``CLOSE`` over it."""
    middle = np.median(decibels)
    state = np.where(decibels >= middle + OPEN, 1, np.where(decibels < middle + CLOSE, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(known >= 0, state[known], 0) == 1
    edge = np.flatnonzero(np.diff(on.astype(np.int8), prepend=0, append=0))
    return [(a, b) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()) if b - a >= LEAST_FRAMES]


def _blocks(bands: np.ndarray) -> bytes:
    """The tensors of a recording as an Arrow stream."""
    count = -(-len(bands) // FRAMES)
    full = np.full((count * FRAMES, BANDS), np.float32(math.log(FLOOR)), np.float32)
    full[: len(bands)] = bands
    values = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), FRAMES * BANDS)
    start = np.arange(count) * FRAMES * HOP / OUT_RATE
    end = (np.minimum(np.arange(1, count + 1) * FRAMES, len(bands)) - 1) * HOP / OUT_RATE + FRAME / OUT_RATE
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, TENSOR_SCHEMA) as stream:
        stream.write_batch(
            pa.record_batch([pa.ExtensionArray.from_storage(_TENSOR, values), start, end], schema=TENSOR_SCHEMA)
        )
    return sink.getvalue()


def read_tensors(stored: bytes) -> pa.Table:
    """Tensors and time spans of one recording."""
    return pa.ipc.open_stream(stored).read_all()


def _describe(media: bytes) -> tuple:
    samples = read_wav(media)
    payload = samples.tobytes()
    bands, loud = zip(*log_mel(samples))
    spans = segments(np.concatenate(loud))
    return (
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-PAD:]),
        sum(map(len, bands)),
        _blocks(np.concatenate(bands)),
        [{"start_s": a * HOP / OUT_RATE, "end_s": ((b - 1) * HOP + FRAME) / OUT_RATE} for a, b in spans],
    )


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()), ("media", pa.binary()), ("n_frames", pa.int64()), ("tensors", pa.binary()),
        ("segments", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))),
    ]
)


def _work(block: pa.RecordBatch) -> pa.RecordBatch:
    found = [_describe(media) for media in block.column("media").to_pylist()]
    size, sha, crc, frames, tensors, spans = zip(*found)
    columns = [block.column("doc_id"), block.column("n_bytes"), size, sha, crc, block.column("media"), frames, tensors, spans]
    return pa.record_batch(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW
    )


def features(media: DataFrame) -> DataFrame:
    """What is read back from stored media: payload digests, tensors and loud segments."""
    return map_blocks(media, _work, SCHEMA, column="media")


def digest(found: DataFrame) -> DataFrame:
    """The figures of a recording in place of its bytes."""
    spans = F.concat_ws(",", F.transform("segments", lambda s: F.concat_ws("-", F.round(s.start_s, 3), F.round(s.end_s, 3))))
    return found.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ":", F.lit("logmel"), F.col("n_frames"), F.size("segments"), F.sha2("tensors", 256), F.sha2(spans.cast("binary"), 256)
        ).alias("feature"),
    )
