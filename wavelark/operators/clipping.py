"""Where a candidate's sound begins and ends, and whether its clip holds speech."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Config
from ..functions.scalars import centred

KEY = ("recording_id", "window_idx")


def range_join(ranges: DataFrame, signal: DataFrame, block: int) -> DataFrame:
    """Samples of each range (recording_id, lo, hi, ..; hi exclusive), joined by equal block numbers and then cut exactly.

    A range explodes into the few blocks it touches, so the join is on keys, never on inequality alone.
    """
    spans = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.greatest(F.col("hi"), F.col("lo") + 1) - 1) / block))))
    blocks = signal.withColumn("_block", F.floor(F.col("sample_idx") / block))
    return spans.join(blocks, ["recording_id", "_block"]).filter((F.col("sample_idx") >= F.col("lo")) & (F.col("sample_idx") < F.col("hi"))).drop("_block")


def durations(signal: DataFrame, rate: int) -> DataFrame:
    return signal.groupBy("recording_id").agg(((F.max("sample_idx") + 1) / rate).alias("duration"))


def search_ranges(candidates: DataFrame, length: DataFrame, rate: int, cfg: Config = DEFAULT) -> DataFrame:
    """Candidates with duration, search_start, search_end and the samples lo..hi to look at."""
    s = F.col("start_seconds")
    rows = candidates.join(length, "recording_id")
    rows = rows.withColumn("search_start", F.greatest(F.lit(0.0), s - cfg.search_padding_seconds)).withColumn("search_end", F.least(F.col("duration"), s + (cfg.window_seconds + cfg.search_padding_seconds)))
    return rows.withColumn("lo", F.bround(F.col("search_start") * rate).cast("long")).withColumn("hi", F.bround(F.col("search_end") * rate).cast("long"))


def event_spans(candidates: DataFrame, signal: DataFrame, rate: int, cfg: Config = DEFAULT) -> DataFrame:
    """recording_id, window_idx, start_seconds, duration, span_start, span_end (null where nothing is active in the window).

    Frames are numbered from the search range's start. Active frames form islands; the span runs from
    the start of the island of the window's first active frame to the end of the last one's.
    """
    frame = max(1, int(cfg.frame_seconds * rate))
    ranges = search_ranges(candidates.select(*KEY, "start_seconds"), durations(signal, rate), rate, cfg)
    long_enough = ranges.filter(F.col("search_end") - F.col("search_start") >= 0.5)
    at = F.floor((F.col("sample_idx") - F.col("lo")) / frame)
    levels = range_join(long_enough, signal, 8 * frame * 20).groupBy(*KEY, "start_seconds", "search_start", at.alias("frame")).agg(F.avg(F.col("value") * F.col("value")).alias("p"), F.count(F.lit(1)).alias("n"))
    levels = levels.filter((F.col("n") == frame) | (F.col("frame") == 0)).withColumn("rms", F.sqrt(F.col("p") + 1e-12))
    mine = Window.partitionBy(*KEY)
    marked = levels.withColumn("active", F.col("rms") > F.percentile("rms", 0.2).over(mine) * cfg.active_ratio)
    marked = marked.withColumn("island", F.sum(F.when(F.col("active"), 0).otherwise(1)).over(mine.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)))
    first = F.greatest(F.lit(0).cast("long"), ((F.col("start_seconds") - F.col("search_start")) / cfg.frame_seconds).cast("long"))
    last = ((F.col("start_seconds") + cfg.window_seconds - F.col("search_start")) / cfg.frame_seconds).cast("long")
    marked = marked.filter("active").withColumn("seed", (F.col("frame") >= first) & (F.col("frame") <= last))
    islands = marked.groupBy(*KEY, "search_start", "island").agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.bool_or("seed").alias("seed")).filter("seed")
    spans = islands.groupBy(*KEY, "search_start").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    spans = spans.select(*KEY, (F.col("search_start") + F.col("a") * cfg.frame_seconds).alias("span_start"), (F.col("search_start") + (F.col("b") + 1) * cfg.frame_seconds).alias("span_end"))
    return ranges.select(*KEY, "start_seconds", "duration").join(spans, list(KEY), "left")


def clip_bounds(spans: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """recording_id, window_idx, clip_start, clip_end of rows of `event_spans`."""
    dur, a, b = F.col("duration"), F.col("span_start"), F.col("span_end")
    d0, d1 = centred(F.col("start_seconds") + cfg.window_seconds / 2, dur, cfg.clip_seconds)
    lo, hi = F.greatest(F.lit(0.0), a - cfg.edge_pad_seconds), F.least(dur, b + cfg.edge_pad_seconds)
    rows = spans.withColumn("_lo", lo).withColumn("_hi", hi)
    length = F.col("_hi") - F.col("_lo")
    s0, s1 = centred((F.col("_lo") + F.col("_hi")) / 2, dur, cfg.clip_seconds)
    start = F.when(a.isNull(), d0).when(length <= cfg.clip_seconds, s0).otherwise(F.col("_lo"))
    end = F.when(a.isNull(), d1).when(length <= cfg.clip_seconds, s1).when(length > cfg.max_clip_seconds, F.col("_lo") + cfg.max_clip_seconds).otherwise(F.col("_hi"))
    return rows.select(*KEY, start.alias("clip_start"), end.alias("clip_end"))


def clip_samples(clips: DataFrame, signal: DataFrame, rate: int) -> DataFrame:
    """Samples of each clip, numbered anew from its start."""
    ranges = clips.withColumn("lo", F.bround(F.col("clip_start") * rate).cast("long")).withColumn("hi", F.bround(F.col("clip_end") * rate).cast("long"))
    return range_join(ranges, signal, 8 * rate).select(*KEY, (F.col("sample_idx") - F.col("lo")).alias("sample_idx"), "value")


def clips_with_speech(sub_windows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Clips (recording_id, window_idx) of which any sub-window (.., speech_score) reaches the threshold."""
    found = sub_windows.groupBy(*KEY).agg(F.bool_or(F.col("speech_score") >= cfg.speech_threshold).alias("speech"))
    return found.filter("speech").select(*KEY)


def check_windows(clips: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Sub-windows of each clip, (.., sub_idx, sub_start, sub_end), the last one as far as the clip goes."""
    length = F.col("clip_end") - F.col("clip_start")
    n = F.when(length <= cfg.check_window_seconds, F.lit(1)).otherwise(F.ceil((length - cfg.check_window_seconds) / cfg.check_hop_seconds - 1e-9) + 1)
    rows = clips.withColumn("sub_idx", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    start = F.col("clip_start") + F.col("sub_idx") * cfg.check_hop_seconds
    return rows.select(*KEY, "sub_idx", start.alias("sub_start"), F.least(F.col("clip_end"), start + cfg.check_window_seconds).alias("sub_end"))
