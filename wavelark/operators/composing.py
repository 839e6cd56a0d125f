"""Compositions of any length: first a table of joins, then one rendering pass over samples.

How two neighbours meet depends on the mix so far: on its length, and on the silence it ends with,
which is judged against the noise floor of all of it. So joins are planned in rounds, the k-th for the
k-th clip of all runs at once (a run has ten clips at most). What a round needs of the mix is its
levels, a row a frame; frames before the ramp of a join never change again, so a round computes those of the
new clip and of the last stretch before it alone. Samples are never gathered: a level is a sum by
frame, an output sample a sum by its place.

A join says: of the mix, `cut` samples stay; the last `ramp` of them fade out; the clip, without its
first `skip` samples, begins at `start` and fades in over `ramp`. Where it overlaps the mix this is a
crossfade, else a splice without a click. An output sample is the sum, over the clips that reach
its place, of the sample times its ramps, so the order of rounds plays no part in rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scalars import declick_seconds
from ..storage import kept
from .framing import energy_envelope, noise_floor

JOIN = ["run_id", "n", "position", "skip", "cut", "ramp", "start", "stop", "length"]


def _frame(rate: int, cfg: Config) -> int:
    return max(1, int(cfg.frame_seconds * rate))


def silence(levels: DataFrame, cfg: Config) -> DataFrame:
    """recording_id, first and last active frame of levels (recording_id, frame, rms); null where none is active."""
    marked = noise_floor(levels, cfg.active_ratio).filter("active")
    return marked.groupBy("recording_id").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


def clips(items: DataFrame, samples: DataFrame, rate: int, cfg: Config = DEFAULT) -> DataFrame:
    """Each clip with its number in the run from 1 (n), its samples' count (size), whether it is crossfaded with the one before, and its onset in seconds."""
    order = Window.partitionBy("run_id").orderBy("position")
    rows = items.select("run_id", "position", F.row_number().over(order).alias("n"), F.coalesce(F.lag("crossfade_into_next").over(order), F.lit(False)).alias("cross"))
    at = samples.select(F.struct("run_id", "position").alias("recording_id"), "sample_idx", "value")
    onset = silence(energy_envelope(at, _frame(rate, cfg)), cfg).select("recording_id.*", (F.col("first") * cfg.frame_seconds).alias("onset"))
    size = samples.groupBy("run_id", "position").agg((F.max("sample_idx") + 1).alias("size"))
    out = rows.join(size, ["run_id", "position"], "left").join(onset, ["run_id", "position"], "left")
    return out.withColumn("size", F.coalesce("size", F.lit(0).cast("long"))).withColumn("onset", F.coalesce("onset", F.lit(0.0)))


def _joined(state: DataFrame, rate: int, cfg: Config) -> DataFrame:
    """The joins of clips that come next to mixes of `length` seconds and `held` samples, of which `quiet` seconds are silence at the end."""
    col, samples_of = F.col, lambda seconds: F.bround(seconds * rate).cast("long")
    limit, pad = cfg.boundary_silence_seconds, cfg.boundary_pad_seconds
    late, early = col("quiet") > limit, col("onset") > limit
    rows = state.withColumn("before", F.when(late, F.greatest(F.lit(0.05), col("length") - col("quiet") + pad)).otherwise(col("length")))
    rows = rows.withColumn("cut", F.when(late, F.least(samples_of(col("before")), col("held"))).otherwise(col("held")))
    rows = rows.withColumn("away", F.when(early, col("onset") - pad).otherwise(0.0)).withColumn("skip", F.least(samples_of(col("away")), col("size")))
    rows = rows.withColumn("own", col("size") / rate - col("away")).withColumn("left", col("size") - col("skip"))
    rows = rows.withColumn("fade", F.when(col("cross"), F.least(F.lit(cfg.crossfade_seconds), col("before") * 0.9, col("own") * 0.9)).otherwise(0.0)).withColumn("over", col("fade") > 0.05)
    click = declick_seconds(col("before"), col("own"), cfg)
    width = F.when(col("over"), samples_of(col("fade"))).otherwise(samples_of(click))
    rows = rows.withColumn("ramp", F.least(width, col("cut"), col("left"))).withColumn("start", F.when(col("over"), col("cut") - col("ramp")).otherwise(col("cut")))
    length = col("before") + col("own") - F.when(col("over"), col("fade")).otherwise(0.0)
    return rows.withColumn("stop", col("start") + col("left")).withColumn("length", length).select(*JOIN)


def render(joins: DataFrame, samples: DataFrame, since: Column | None = None) -> DataFrame:
    """run_id, sample_idx, value of the compositions that `joins` describe; samples: (run_id, position, sample_idx, value).

    With `since`, a column of `joins`, each run's output from that place on alone.
    """
    every = F.sort_array(F.collect_list(F.struct("n", "cut", "ramp"))).alias("all")
    mine = joins.join(joins.groupBy("run_id").agg(every), "run_id").withColumn("later", F.filter("all", lambda j: j["n"] > F.col("n")))
    keep = ["run_id", "position", "n", "skip", "ramp", "start", "later"]
    mine = mine.select(*keep, (since if since is not None else F.lit(None)).cast("long").alias("since"))
    rows = samples.select("run_id", "position", "sample_idx", F.col("value").cast("double").alias("value")).join(mine, ["run_id", "position"])
    within, out = F.col("sample_idx") - F.col("skip"), F.col("place")
    rows = rows.withColumn("place", F.col("start") + within).filter((within >= 0) & (F.col("since").isNull() | (out >= F.col("since"))) & F.forall("later", lambda j: out < j["cut"]))
    up = F.when((F.col("n") > 1) & (within < F.col("ramp")), within / F.col("ramp")).otherwise(1.0)
    down = F.aggregate("later", F.lit(1.0), lambda g, j: g * F.when(out >= j["cut"] - j["ramp"], 1.0 - (out - (j["cut"] - j["ramp"])) / j["ramp"]).otherwise(1.0))
    return rows.groupBy("run_id", out.alias("sample_idx")).agg(F.sum(F.col("value") * up * down).alias("value"))


def plan(items: DataFrame, samples: DataFrame, rate: int, cfg: Config = DEFAULT) -> DataFrame:
    """JOIN rows of items (run_id, position, crossfade_into_next) and their clips' samples (run_id, position, sample_idx, value)."""
    frame = _frame(rate, cfg)
    parts = kept(clips(items, samples, rate, cfg))
    rounds = parts.agg(F.max("n")).first()[0] or 0
    zero = F.lit(0).cast("long")
    joins = kept(parts.filter("n = 1").select("run_id", "n", "position", zero.alias("skip"), zero.alias("cut"), zero.alias("ramp"), zero.alias("start"), F.col("size").alias("stop"), (F.col("size") / rate).alias("length")))
    levels = None
    for k in range(2, rounds + 1):
        going = parts.filter(F.col("n") == k)
        last = joins.filter(F.col("n") == k - 1).select("run_id", "length", F.col("stop").alias("held"), F.greatest(F.lit(0), F.col("cut") - F.col("ramp")).alias("fades"))
        last = last.withColumn("since", F.col("fades") - F.col("fades") % frame).drop("fades")
        now = joins.join(going.select("run_id"), "run_id", "left_semi").join(last.select("run_id", "since"), "run_id")
        fresh = energy_envelope(render(now, samples, F.col("since")).withColumnRenamed("run_id", "recording_id"), frame)
        old = None if levels is None else levels.join(last.select(F.col("run_id").alias("recording_id"), "since"), "recording_id").filter(F.col("frame") * frame < F.col("since")).drop("since")
        levels = kept(fresh if old is None else old.unionByName(fresh))
        quiet = silence(levels, cfg).select(F.col("recording_id").alias("run_id"), "last")
        state = going.join(last, "run_id").join(quiet, "run_id", "left")
        tail = F.when(F.col("last").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("held") / rate - (F.col("last") + 1) * cfg.frame_seconds))
        joins = kept(joins.unionByName(_joined(state.withColumn("quiet", tail), rate, cfg)))
    return joins


def lengths(joins: DataFrame) -> DataFrame:
    """run_id, duration (on the timeline) and n_samples of each composition."""
    return joins.groupBy("run_id").agg(F.max_by("length", "n").alias("duration"), F.max_by("stop", "n").alias("n_samples"))
