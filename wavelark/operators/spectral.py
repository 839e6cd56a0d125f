"""Spectral and dynamic features of windows held as arrays: one Arrow kernel, one transform a window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

BLOCK = 256


def magnitudes(x: np.ndarray) -> np.ndarray:
    """Magnitude spectra of rows under a symmetric Hann window."""
    return np.abs(np.fft.rfft(x * np.hanning(x.shape[1]), axis=1))


def features(x: np.ndarray, rate: float, cfg: Config = DEFAULT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Layering, crest and flux of each row of samples."""
    mag = magnitudes(x)
    hz = np.fft.rfftfreq(x.shape[1], 1.0 / rate)
    edges = np.array(cfg.band_edges_hz) * rate / cfg.band_rate
    energy = np.zeros((len(x), len(edges) - 1))
    for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = (hz >= lo) & (hz < hi)
        if inside.any():
            energy[:, b] = np.sqrt((mag[:, inside] ** 2).mean(axis=1))
    total = energy.sum(axis=1)
    share = energy / np.where(total > 1e-9, total, 1)[:, None]
    entropy = -np.where(share > 0, share * np.log(np.where(share > 0, share, 1)), 0).sum(axis=1)
    layering = np.where(total > 1e-9, entropy / np.log(energy.shape[1]), 0.0)
    crest = mag.max(axis=1) / (mag.mean(axis=1) + 1e-9)
    frame = max(1, int(cfg.flux_frame_seconds * rate))
    n = x.shape[1] // frame
    if n < 2:
        return layering, crest, np.zeros(len(x))
    rms = np.sqrt((x[:, : n * frame].reshape(len(x), n, frame) ** 2).mean(axis=2) + 1e-12)
    return layering, crest, np.abs(np.diff(rms, axis=1)).mean(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), -1)


def window_features(windows: DataFrame, rate: float, cfg: Config = DEFAULT) -> DataFrame:
    """recording_id, window_idx, layering_raw, distinctiveness_raw, temporal_interest_raw of (.., samples); all arrays of one length."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                cols = features(_matrix(part.column(2)), rate, cfg)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, cols)], names=["recording_id", "window_idx", "layering_raw", "distinctiveness_raw", "temporal_interest_raw"])

    return windows.select("recording_id", "window_idx", "samples").mapInArrow(run, "recording_id string, window_idx long, layering_raw double, distinctiveness_raw double, temporal_interest_raw double")


def magnitude_spectrum(windows: DataFrame) -> DataFrame:
    """recording_id, window_idx, bin, magnitude."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                mag = magnitudes(_matrix(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(mag), pa.list_(pa.float64()))], names=["recording_id", "window_idx", "m"])

    rows = windows.select("recording_id", "window_idx", "samples").mapInArrow(run, "recording_id string, window_idx long, m array<double>")
    return rows.select("recording_id", "window_idx", F.posexplode("m").alias("bin", "magnitude"))


def temporal_flux(windows: DataFrame, frame: int) -> DataFrame:
    """recording_id, window_idx, flux: mean step between frame levels, with built-in functions alone."""
    n = F.floor(F.size("samples") / frame).cast("int")
    level = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.sqrt(F.aggregate(F.slice("samples", k * frame + 1, F.lit(frame)), F.lit(0.0), lambda s, x: s + x * x) / frame + 1e-12))
    steps = F.zip_with(F.slice("_l", F.lit(2), F.size("_l") - 1), F.slice("_l", F.lit(1), F.size("_l") - 1), lambda a, b: F.abs(a - b))
    rows = windows.withColumn("_l", F.when(n >= 2, level))
    return rows.select("recording_id", "window_idx", F.when(F.col("_l").isNull(), 0.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / (F.size("_l") - 1)).alias("flux"))
