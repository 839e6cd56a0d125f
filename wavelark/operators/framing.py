"""Tumbling and sliding frames over signals in long form (recording_id, sample_idx, value).

Every aggregate is keyed by recording and frame, so one huge recording spreads over all tasks; no
operator needs a recording's length, a join, or its samples in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def energy_envelope(signal: DataFrame, frame: int) -> DataFrame:
    """recording_id, frame, rms: root mean square of each whole frame, or of all samples if no frame is whole."""
    at = F.floor(F.col("sample_idx") / frame)
    by = signal.groupBy("recording_id", at.alias("frame")).agg(F.avg(F.col("value") * F.col("value")).alias("power"), F.count(F.lit(1)).alias("n"))
    return by.filter((F.col("n") == frame) | (F.col("frame") == 0)).select("recording_id", "frame", F.sqrt(F.col("power") + 1e-12).alias("rms"))


def covering(window: int, hop: int) -> F.Column:
    """Indexes of the windows that cover a sample."""
    i = F.col("sample_idx")
    first = F.greatest(F.floor((i - window) / hop) + 1, F.lit(0).cast("long"))
    return F.sequence(first, F.floor(i / hop))


def sliding(signal: DataFrame, window: int, hop: int, *aggs: F.Column) -> DataFrame:
    """`aggs` over each window (recording_id, window_idx); columns: value, sample_idx, offset in the window.

    A window past the first exists only if samples are left that the one before does not reach:
    then one of its own lies at offset window - hop or later.
    """
    long = signal.withColumn("window_idx", F.explode(covering(window, hop))).withColumn("offset", F.col("sample_idx") - F.col("window_idx") * hop)
    out = long.groupBy("recording_id", "window_idx").agg(F.max("offset").alias("_last"), *aggs)
    return out.filter((F.col("window_idx") == 0) | (F.col("_last") >= window - hop)).drop("_last")


def window_arrays(signal: DataFrame, window: int, hop: int, recordings: DataFrame | None = None) -> DataFrame:
    """recording_id, window_idx, samples: zero-padded arrays of `window` samples.

    With `recordings`, those without samples have one window of zeros.
    """
    sorted_ = F.array_sort(F.collect_list(F.struct("offset", "value")))
    rows = sliding(signal, window, hop, sorted_.alias("s"))
    pad = F.array_repeat(F.lit(0.0), window)
    out = rows.select("recording_id", "window_idx", F.slice(F.concat(F.transform("s", lambda x: x["value"].cast("double")), pad), 1, window).alias("samples"))
    if recordings is None:
        return out
    empty = recordings.select("recording_id").join(signal.select("recording_id").distinct(), "recording_id", "left_anti")
    return out.unionByName(empty.select("recording_id", F.lit(0).cast("long").alias("window_idx"), pad.alias("samples")))


def window_count(total: F.Column, window: int, hop: int) -> F.Column:
    """Windows of a signal with `total` samples."""
    return F.when(total <= window, F.lit(1).cast("long")).otherwise(F.ceil((total - window) / hop) + 1)


#: Steps of the logarithm of a level that a histogram has to a unit.
STEPS = 512


def exact_percentile(rows: DataFrame, column: str, share: float, name: str) -> DataFrame:
    """recording_id and the column's exact percentile, straight between neighbours; the column is positive.

    A histogram over the logarithm finds the one or two bars that hold the ranks looked for; only
    these bars' values are then sorted, so that no task needs all values of a recording.
    """
    bar = F.floor(F.log(F.col(column)) * STEPS)
    upto = Window.partitionBy("recording_id").orderBy("_bar")
    bars = rows.groupBy("recording_id", bar.alias("_bar")).agg(F.count(F.lit(1)).alias("_n"))
    bars = bars.withColumn("_before", F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).withColumn("_at", (F.sum("_n").over(Window.partitionBy("recording_id")) - 1) * F.lit(share))
    bars = bars.filter((F.col("_before") <= F.ceil("_at")) & (F.col("_before") + F.col("_n") > F.floor("_at"))).drop("_n")
    held = rows.withColumn("_bar", bar).join(bars, ["recording_id", "_bar"]).groupBy("recording_id", "_bar", "_before", "_at", F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    held = held.withColumn("_last", F.col("_before") + F.sum("_n").over(Window.partitionBy("recording_id", "_bar").orderBy("_v")) - 1)
    at = lambda rank: F.min(F.when(F.col("_last") >= rank, F.col("_v")))
    found = held.groupBy("recording_id").agg(at(F.floor("_at")).alias("_lo"), at(F.ceil("_at")).alias("_hi"), F.first("_at").alias("_at"))
    return found.select("recording_id", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))).alias(name))


def noise_floor(envelope: DataFrame, ratio: float) -> DataFrame:
    """recording_id, frame, rms, floor (exact 20th percentile by recording), active (above ratio times the floor)."""
    floor = exact_percentile(envelope, "rms", 0.2, "floor")
    return envelope.join(floor, "recording_id").withColumn("active", F.col("rms") > F.col("floor") * ratio)


def usable_bounds(signal: DataFrame, frame: int, rate: int, ratio: float) -> DataFrame:
    """recording_id, onset, trailing_silence, duration; nothing active: (0, 0, duration)."""
    marked = noise_floor(energy_envelope(signal, frame), ratio)
    edges = marked.groupBy("recording_id").agg(F.min(F.when(F.col("active"), F.col("frame"))).alias("first"), F.max(F.when(F.col("active"), F.col("frame"))).alias("last"))
    length = signal.groupBy("recording_id").agg(((F.max("sample_idx") + 1) / rate).alias("duration"))
    step = frame / rate
    return length.join(edges, "recording_id", "left").select(
        "recording_id", F.coalesce(F.col("first") * step, F.lit(0.0)).alias("onset"), F.when(F.col("last").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("duration") - (F.col("last") + 1) * step)).alias("trailing_silence"), "duration"
    )


def downmix(channels: DataFrame) -> DataFrame:
    """Mean over channels of (recording_id, channel, sample_idx, value)."""
    return channels.groupBy("recording_id", "sample_idx").agg(F.avg("value").alias("value"))


def decimate(signal: DataFrame, factor: int) -> DataFrame:
    """A lower rate by averaging each `factor` samples: a plain resampler, not a filter bank."""
    at = F.floor(F.col("sample_idx") / factor)
    return signal.groupBy("recording_id", at.alias("sample_idx")).agg(F.avg("value").alias("value"))
