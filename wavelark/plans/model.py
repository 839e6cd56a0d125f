"""Models of windows behind one interface, loaded once in each Python worker and only where they are used.

A model is what `load()` returns: a function from a batch of windows (a matrix, a row a window) to class scores and
embeddings (two matrices). `WindowModel` makes it a step of a plan: windows go through it in batches of BATCH,
by Arrow, and nothing of it is on the driver. `load` must be importable, so that workers find it by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Classify = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Windows that a model gets at once.
BATCH = 32
_LOADED: dict[str, Classify] = {}
LOADS: list[str] = []  # names as they are loaded in this process


def loaded(load: Callable[[], Classify]) -> Classify:
    """The model of this process; made when it is asked for first."""
    name = f"{load.__module__}.{load.__qualname__}"
    if name not in _LOADED:
        _LOADED[name] = load()
        LOADS.append(name)
    return _LOADED[name]


@dataclass(frozen=True)
class WindowModel:
    load: Callable[[], Classify]
    labels: tuple[str, ...]

    def indexes(self, wanted: DataFrame, column: str = "label") -> DataFrame:
        """label_idx of the model's labels that a table names."""
        spark = wanted.sparkSession
        mine = spark.createDataFrame(list(enumerate(self.labels)), "label_idx int, label string")
        return mine.join(wanted.select(F.col(column).alias("label")), "label", "left_semi").select("label_idx")

    def __call__(self, windows: DataFrame) -> DataFrame:
        """(recording_id, window_idx, scores, embedding) of windows (recording_id, window_idx, samples); all samples of one length."""
        load, n_labels = self.load, len(self.labels)

        def run(batches):
            classify = None
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    part = batch.slice(at, BATCH)
                    classify = classify or loaded(load)
                    x = np.stack([np.asarray(s.values, np.float64) for s in part.column(2)])
                    scores, embeddings = classify(x)
                    if scores.shape != (len(x), n_labels) or len(embeddings) != len(x):
                        raise ValueError(f"the model gave scores of {scores.shape} for {len(x)} windows and {n_labels} labels")
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(scores.astype(np.float64)), pa.list_(pa.float64())), pa.array(list(embeddings.astype(np.float64)), pa.list_(pa.float64()))], names=["recording_id", "window_idx", "scores", "embedding"])

        return windows.select("recording_id", F.col("window_idx").cast("long"), F.col("samples").cast("array<double>")).mapInArrow(run, "recording_id string, window_idx long, scores array<double>, embedding array<double>")


#: Labels of the spectral model: shares of the spectrum in three bands of bins.
SPECTRAL_LABELS, SPECTRAL_EDGES, SPECTRAL_DIM = ("low", "middle", "high"), (0, 4, 16, 33), 8


def spectral_model() -> Classify:
    """A model without weights: scores are shares of the magnitudes in three bands, embeddings the first magnitudes."""

    def classify(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = np.abs(np.fft.rfft(x * np.hanning(x.shape[1]), axis=1))
        bands = np.stack([m[:, a:b].sum(axis=1) for a, b in zip(SPECTRAL_EDGES, SPECTRAL_EDGES[1:])], axis=1)
        total = bands.sum(axis=1, keepdims=True)
        return np.divide(bands, total, out=np.zeros_like(bands), where=total > 0), m[:, :SPECTRAL_DIM]

    return classify
