"""Whole plans: a recording's analysis, verified candidates, and re-ranking with history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import clipping, framing, regions, scoring, selection, spectral
from ..storage import kept, log_folder, remove, shared_folder

__all__ = ["analyse", "counters", "kept", "log_folder", "ranked", "remove", "rerank", "shared_folder", "shortlisted", "shown", "verified"]

#: A model takes windows (recording_id, window_idx, samples) and gives (recording_id, window_idx, scores, embedding).
Model = Callable[[DataFrame], DataFrame]


def analyse(signal: DataFrame, model: Model, speech_indexes: list[int], rate: int, cfg: Config = DEFAULT, recordings: DataFrame | None = None) -> DataFrame:
    """One row a window: start, speech flag, embedding and raw features."""
    windows = framing.window_arrays(signal, int(cfg.window_seconds * rate), int(cfg.hop_seconds * rate), recordings)
    out = spectral.window_features(windows, rate, cfg).join(model(windows), ["recording_id", "window_idx"])
    return out.withColumn("start_seconds", F.col("window_idx") * cfg.hop_seconds).withColumn("has_speech", scoring.has_speech(F.col("scores"), speech_indexes, cfg)).drop("scores")


def ranked(windows: DataFrame, features: DataFrame, dim: int, seed: int | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Pool with scores and regions."""
    return regions.regions(scoring.composite_score(scoring.candidate_pool(windows, features, dim, cfg), seed, cfg), cfg)


def shortlisted(windows: DataFrame, features: DataFrame, dim: int, seed: int | None = None, prior: DataFrame | None = None, cfg: Config = DEFAULT, count: int | None = None) -> DataFrame:
    return selection.shortlist(regions.representatives(ranked(windows, features, dim, seed, cfg)), count or cfg.shortlist, prior, cfg)


def verified(short: DataFrame, signal: DataFrame, sub_window_scores: Callable[[DataFrame], DataFrame], rate: int, cfg: Config = DEFAULT, order: str = "chronological") -> DataFrame:
    """Final candidates with their clips: bounds, the second speech gate, and the first of the rest.

    `sub_window_scores` takes (recording_id, window_idx, sub_idx, sub_start, sub_end) and adds speech_score.
    """
    clips = clipping.clip_bounds(clipping.event_spans(short, signal, rate, cfg), cfg)
    failed = clipping.clips_with_speech(sub_window_scores(clipping.check_windows(clips, cfg)), cfg)
    return selection.final(short, failed, cfg, order).join(clips, ["recording_id", "window_idx"])


def shown(history: DataFrame | None, final: DataFrame, windows: DataFrame) -> DataFrame:
    """What was shown so far: the history with the final candidates' windows and embeddings."""
    new = final.select("recording_id", "window_idx").join(windows.select("recording_id", "window_idx", "embedding"), ["recording_id", "window_idx"])
    return new if history is None else history.unionByName(new).dropDuplicates(["recording_id", "window_idx"])


def rerank(windows: DataFrame, features: DataFrame, dim: int, failed: DataFrame, history: DataFrame | None = None, seed: int | None = None, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """One more analysis of the same windows: the final candidates, and the history with what is shown now.

    `failed` (recording_id, window_idx): what the second gate refuses. `history` (recording_id,
    window_idx, embedding) is what earlier analyses have shown.
    """
    short = kept(shortlisted(windows, features, dim, seed, history, cfg))
    out = selection.final(short, failed, cfg)
    return out, shown(history, out, windows)


def counters(windows: DataFrame, segmented: DataFrame, short: DataFrame, final: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """A run's counters by recording, as its log has them."""
    a = windows.groupBy("recording_id").agg(F.count(F.lit(1)).alias("total_windows_analyzed"), F.count_if("has_speech").alias("excluded_speech_windows"))
    b = segmented.groupBy("recording_id").agg(F.count(F.lit(1)).alias("pool_size"), F.countDistinct("region_id").alias("region_count"))
    c = short.groupBy("recording_id").agg(F.count(F.lit(1)).alias("shortlist_size"))
    d = final.groupBy("recording_id").agg(F.count(F.lit(1)).alias("final_count"))
    out = a.join(b, "recording_id", "left").join(c, "recording_id", "left").join(d, "recording_id", "left")
    if excluded is not None:
        out = out.join(excluded, "recording_id", "left")
    return out.na.fill(0)
