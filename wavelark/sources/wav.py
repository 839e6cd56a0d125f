"""PCM WAV files as DataFrames: metadata, whole and partial decoding, and writing, over the data source of `wavsource`."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .wavsource import register, to_float, to_pcm

__all__ = ["blocks", "channels", "encode", "encoded", "recordings", "signal", "to_float", "write"]


def _load(spark: SparkSession, path: str, table: str, options: dict) -> DataFrame:
    register(spark)
    return spark.read.format("wav").options(table=table, **{k: v for k, v in options.items() if v is not None}).load(path)


def recordings(spark: SparkSession, path: str, **options) -> DataFrame:
    """recording_id, filename, path, duration_seconds, rate, channels, n_frames, width of the files under `path`, from their headers alone."""
    return _load(spark, path, "recordings", options)


def blocks(spark: SparkSession, path: str, start: float = 0.0, seconds: float | None = None, **options) -> DataFrame:
    """recording_id, first_sample, samples (mono, [-1, 1)): mean of channels, in blocks, from `start` for `seconds`."""
    return _load(spark, path, "blocks", options | {"start": start, "seconds": seconds})


def signal(spark: SparkSession, path: str, start: float = 0.0, seconds: float | None = None, **options) -> DataFrame:
    """recording_id, sample_idx, value; a filter on sample_idx or recording_id reaches the files."""
    return _load(spark, path, "samples", options | {"start": start, "seconds": seconds})


def channels(spark: SparkSession, path: str, **options) -> DataFrame:
    """recording_id, sample_idx, value, channel: as `signal`, channels apart."""
    return _load(spark, path, "samples", options | {"channels": "each"})


def write(clips: DataFrame, path: str, rate: int, mode: str = "append", width: int = 2) -> None:
    """Writes mono PCM files, one for each name: rows (name, samples), or (name, first_sample, samples) for files in blocks.

    A file's blocks meet in one task in order, since a file is written from its beginning to its end;
    gaps between them are silence. A name that isn't one block long must have `first_sample`. All files appear, or none.
    """
    register(clips.sparkSession)
    first = F.col("first_sample").cast("long") if "first_sample" in clips.columns else F.lit(0).cast("long")
    rows = clips.select("name", first.alias("first_sample"), F.col("samples").cast("array<double>").alias("samples"))
    rows = rows.withColumn("n_frames", F.max(F.col("first_sample") + F.coalesce(F.size("samples"), F.lit(0))).over(Window.partitionBy("name")))
    rows.sortWithinPartitions("name", "first_sample").write.format("wav").options(rate=rate, width=width).mode(mode).save(path)


def encode(samples: np.ndarray, rate: int) -> bytes:
    """Mono PCM16."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(to_pcm(samples, 2))
    return out.getvalue()


def encoded(clips: DataFrame, rate: int) -> DataFrame:
    """`clips` (name, samples) as (name, content): WAV bytes, to be kept in a table like any other column."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(x.values.to_numpy(), rate) for x in batch.column(1)], pa.binary())], names=["name", "content"])

    return clips.select("name", F.col("samples").cast("array<double>")).mapInArrow(run, "name string, content binary")
