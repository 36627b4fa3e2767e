"""Media columns: 8-bit audio of byte payloads, with polyphase resampling, log-mel tensors and energy segments.

A payload is stored as the samples of a WAV file (8-bit PCM, one channel), read back from those bytes, resampled by 2/3
with a polyphase filter, and framed into overlapping windows for a log-mel filterbank. Frames are stored as tensors of a
fixed shape with the time span of each; segments begin where the energy rises over a high threshold and end where it falls
under a lower one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, tune

UNIT, FILL = 576, b"\xff"
RATE, UP, DOWN, TAPS = 8000, 2, 3, 24
FRAME, HOP, MELS = 256, 128, 24
#: Frames of one stored tensor; the last one of a text is filled with the floor.
SPAN, FLOOR = 64, -12.0
#: Energies over the median of a text, in decibels, at which a segment begins and ends.
HIGH, LOW = 1.5, 0.5


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + FILL * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_wav(samples: bytes) -> bytes:
    """Mono 8-bit PCM; the samples as they are."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def from_wav(wav: bytes) -> bytes:
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(wav):
        name, n = struct.unpack_from("<4sI", wav, at)
        if name == b"data":
            return wav[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


@cache
def _phases() -> np.ndarray:
    """The low-pass filter's UP phases of TAPS / UP taps."""
    t = np.arange(TAPS) - (TAPS - 1) / 2
    h = np.sinc(t / DOWN) * np.hamming(TAPS)
    return (h * (UP / h.sum())).reshape(-1, UP).T[:, ::-1].astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """UP / DOWN times the rate: output m is the phase (m * DOWN) % UP of the filter at sample m * DOWN // UP."""
    taps, n = TAPS // UP, -(-len(x) * UP // DOWN)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(DOWN, np.float32)]), taps)
    out = np.empty(n, np.float32)
    for m in range(UP):
        own = windows[m * DOWN // UP :: DOWN][: len(out[m::UP])]
        out[m::UP] = own @ _phases()[m * DOWN % UP]
    return out


@cache
def _mel() -> np.ndarray:
    """Triangular filters, equally wide on the mel scale."""
    top = RATE * UP / DOWN / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(top), MELS + 2) / 2595) - 1)
    f = np.linspace(0, top, FRAME // 2 + 1)
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log energies, energy of each frame in decibels) of overlapping Hann windows."""
    x = np.pad(x, (0, max(0, FRAME - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mel, energy = [], []
    for i in range(0, len(frames), 1024):
        own = frames[i : i + 1024]
        power = np.abs(np.fft.rfft(own * np.hanning(FRAME).astype(np.float32), axis=1)).astype(np.float32) ** 2
        mel.append(np.maximum(np.log(power @ _mel() + 1e-6), FLOOR))
        energy.append(10 * np.log10((own * own).mean(1) + 1e-6))
    return np.concatenate(mel), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[float, float]]:
    """Spans in seconds: on from HIGH over the median energy, off under LOW over it."""
    level = energy - np.median(energy)
    mark = np.where(level >= HIGH, 1, np.where(level < LOW, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (at >= 0) & (mark[at] == 1), [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    step = HOP * DOWN / (RATE * UP)
    return [(a * step, b * step) for a, b in edges.reshape(-1, 2).tolist()]


def analyse(stored: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    x = (np.frombuffer(from_wav(stored), np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x))
    return mel, segments(energy)


def spans(mel: np.ndarray) -> tuple[pa.FixedShapeTensorArray, list[float], list[float]]:
    """SPAN x MELS tensors of a text's frames, the last one filled with the floor, and their time spans in seconds."""
    step, n = HOP * DOWN / (RATE * UP), -(-len(mel) // SPAN)
    full = np.full((n * SPAN, MELS), FLOOR, np.float32)
    full[: len(mel)] = mel
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, SPAN, MELS))
    return tensor, [k * SPAN * step for k in range(n)], [min((k + 1) * SPAN, len(mel)) * step for k in range(n)]


def tensors(docs: DataFrame) -> DataFrame:
    """(doc_id, span, t0, t1, mel): fixed SPAN x MELS tensors, row by row, with their time spans in seconds.

    A null or empty text is one unit of fill; a very long one gives a batch of its own; rows that repeat an id give tensors
    each; columns other than doc_id and text are not looked at; an empty table gives none.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tensor, t0, t1 = spans(analyse(to_wav(payload(t)[1]))[0])
                n = len(tensor)
                mel = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * SPAN * MELS), tensor.storage.flatten())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(t0), pa.array(t1), mel],
                    ["doc_id", "span", "t0", "t1", "mel"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, span int, t0 double, t1 double, mel array<float>"
    )


def as_tensor_column(mel: pa.Array) -> pa.ExtensionArray:
    """The column of `tensors` as an Arrow fixed-shape tensor."""
    flat = pa.concat_arrays(mel.chunks).flatten() if isinstance(mel, pa.ChunkedArray) else mel.flatten()
    storage = pa.FixedSizeListArray.from_arrays(flat, SPAN * MELS)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), [SPAN, MELS]), storage)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: one narrow pass.

    A null text counts as empty: one unit of fill. Equal texts give equal values; rows, null ids too, stay one for one; an
    empty table gives an empty one. `feature` names the shape of the log-mel values, the number and length of segments, the
    number of tensors and the digest of their values to a hundredth.
    """
    tune(docs.sparkSession)

    def row(text: str | None) -> tuple:
        n, raw = payload(text)
        stored = to_wav(raw)
        back = from_wav(stored)
        mel, active = analyse(stored)
        tensor, _, _ = spans(mel)
        digest = hashlib.sha256(np.rint(tensor.to_numpy_ndarray() * 100).astype("<i2").tobytes()).hexdigest()
        feature = f"mel={len(mel)}x{MELS};segments={len(active)};active={sum(b - a for a, b in active):.3f};tensors={len(tensor)};sha256={digest[:32]}"
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            cols = [*zip(*map(row, b.column(1).to_pylist()), strict=True)] or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
