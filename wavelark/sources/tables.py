"""The given tables seen as recordings: windows with embeddings, waves, signals, decisions and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ANCHOR = 16
#: Windows of a recording (two seconds apart), and its samples at 100 Hz.
WINDOWS, SAMPLES = 128, 25_600


def recording(number: F.Column, of: int) -> F.Column:
    return F.concat(F.lit("rec"), F.floor(number / of).cast("string"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, window_idx, start_seconds, has_speech, embedding: WINDOWS vectors make a recording.

    Embeddings are anchored: each is the first of its block of 16 plus a fifth of its own, so that
    neighbours are alike as they are in a recording.
    """
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    first = e.filter(F.col("vec_id") % ANCHOR == 0).select(F.col("vec_id").alias("anchor"), F.col("e").alias("a"))
    joined = e.join(first, (e.vec_id - e.vec_id % ANCHOR) == first.anchor)
    return joined.select(
        recording(F.col("vec_id"), WINDOWS).alias("recording_id"), F.col("vec_id").alias("window_idx"), (F.col("vec_id") % WINDOWS * 2.0).alias("start_seconds"), (F.col("label") == 0).alias("has_speech"),
        F.zip_with("a", "e", lambda a, x: a + x * 0.20).alias("embedding"),
    )


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, window_idx, samples: each raw vector as one window of 64 samples at 16 Hz."""
    return read(spark, sf_dir, "embeddings").select(recording(F.col("vec_id"), WINDOWS).alias("recording_id"), F.col("vec_id").alias("window_idx"), F.col("embedding").cast("array<double>").alias("samples"))


def signal(spark: SparkSession, sf_dir: str, samples: int = SAMPLES) -> DataFrame:
    """recording_id, sample_idx, value: event values in order, at 100 Hz, `samples` to a recording."""
    return read(spark, sf_dir, "events").select(recording(F.col("event_id"), samples).alias("recording_id"), (F.col("event_id") % samples).alias("sample_idx"), "value")


def span(spark: SparkSession, sf_dir: str, first: int, last: int) -> DataFrame:
    """As `signal`, the samples of events `first` to `last` alone: the bounds reach the scan."""
    return read(spark, sf_dir, "events").filter(F.col("event_id").between(first, last)).select(recording(F.col("event_id"), SAMPLES).alias("recording_id"), (F.col("event_id") % SAMPLES).alias("sample_idx"), "value")


def user_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `signal`, one recording a user."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("recording_id"), (F.row_number().over(w) - 1).cast("long").alias("sample_idx"), "value")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, candidate_id, decision, decided_at, event_id of all events but views."""
    e = read(spark, sf_dir, "events").filter("event_type <> 'view'")
    kept = F.when(F.col("event_type").isin("purchase", "signup"), "kept").otherwise("discarded")
    return e.select(F.col("user_id").alias("run_id"), (1 + F.col("event_id") % 10).alias("candidate_id"), kept.alias("decision"), F.col("ts").alias("decided_at"), "event_id")


def analysis_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, analysis_number, at: each view starts an analysis."""
    w = Window.partitionBy("user_id").orderBy("ts")
    return read(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("user_id").alias("run_id"), F.row_number().over(w).cast("long").alias("analysis_number"), F.col("ts").alias("at"))
