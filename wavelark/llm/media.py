"""Media columns: payloads kept as WAV, read back, and fingerprinted by pairs of spectral peaks.

Each text becomes a payload of 8-bit samples in a mono WAV file made by the `wave` module. The
stored bytes are read back; a short-time Fourier transform over the samples gives each frame's
strongest peaks; each peak is paired with a few that follow, and a pair (earlier peak's bin, later
peak's bin, distance in frames) is kept with the frame it starts at: `fp_time[i]` and `fp_hash[i]`.

Defined cases: a null or empty text gives one block of padding, a constant signal without peaks,
hence empty arrays. Ties: of peaks of one frame that are equally strong the lower bins count, and on a
level stretch its first bin is the peak; a null doc_id stays null. Repeated rows give repeated results. A long text is transformed in blocks of
frames, so memory follows the payload alone, never its spectrogram. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, map_arrow

BLOCK, RATE = 576, 8000
HOP, FRAMES_AT_ONCE = BLOCK // 2, 2048
#: Peaks a frame, pairs a peak, frames that a pair may span.
PEAKS, FAN_OUT, SPAN = 2, 3, 63
WINDOW = np.hanning(BLOCK).astype(np.float32)

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, fp_time array<int>, fp_hash array<int>"
)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length of the text, and its bytes padded with 255 up to a positive multiple of BLOCK."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * ((-len(raw)) % BLOCK or (0 if raw else BLOCK))


def store(payload: bytes) -> bytes:
    """The payload as a mono 8-bit WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the spectral peaks, by frame and then bin."""
    x = np.frombuffer(samples, np.uint8)
    n = 1 + (len(x) - BLOCK) // HOP
    frames = np.lib.stride_tricks.sliding_window_view(x, BLOCK)[::HOP]
    at, bins = [], []
    for lo in range(0, n, FRAMES_AT_ONCE):
        block = (frames[lo : lo + FRAMES_AT_ONCE].astype(np.float32) - 128.0) * WINDOW
        mag = np.abs(np.fft.rfft(block, axis=1)).astype(np.float32)
        mag[:, :4] = 0  # the mean and its leakage
        inner = mag[:, 1:-1]
        top = (inner > mag[:, :-2]) & (inner >= mag[:, 2:]) & (inner > 2 * mag.mean(axis=1, keepdims=True))
        masked = np.where(top, inner, 0)
        for _ in range(PEAKS):
            k = masked.argmax(axis=1)
            row = np.arange(len(k))
            there = np.flatnonzero(masked[row, k] > 1.0)
            at.append(lo + there)
            bins.append(k[there] + 1)
            masked[row, k] = 0
    t, f = np.concatenate(at), np.concatenate(bins)
    order = np.lexsort((f, t))
    return t[order], f[order]


def fingerprints(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time code and hash of each pair of peaks: 9 bits for either bin and 6 for the distance."""
    t, f = peaks(samples)
    first = np.searchsorted(t, t + 1)
    times, hashes = [], []
    for k in range(FAN_OUT):
        j = first + k
        i = np.flatnonzero(j < len(t))
        j = j[i]
        near = t[j] - t[i] <= SPAN
        i, j = i[near], j[near]
        times.append(t[i])
        hashes.append(f[i] << 15 | f[j] << 6 | (t[j] - t[i]))
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order].astype(np.int32), h[order].astype(np.int32)


def describe(text: str | None) -> tuple:
    n, payload = payload_of(text)
    media = store(payload)
    back = read_back(media)
    times, hashes = fingerprints(back)
    feature = hashlib.sha256(times.astype("<i4").tobytes() + hashes.astype("<i4").tobytes()).hexdigest()
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(times)}:{feature}", times, hashes


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): digests of payload and stored form, and the fingerprints."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols = list(zip(*map(describe, batch.column(1).to_pylist())))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

        return run

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_text()), make, SCHEMA)
