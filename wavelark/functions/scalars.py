"""Scalar functions: times, clip windows, gains, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def format_timestamp(seconds: Column) -> Column:
    """HH:MM:SS, half seconds to the even second."""
    s = F.bround(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def download_name(rank: Column, start: Column) -> Column:
    """candidate_RR_MMmSSs.wav; minutes go on beyond 59."""
    s = F.floor(start)
    return F.format_string("candidate_%02d_%02dm%02ds.wav", rank, F.floor(s / 60), s % 60)


def centred(center: Column, duration: Column, length: float) -> tuple[Column, Column]:
    """(start, end) of a window of `length` around `center`, moved to stay inside [0, duration]."""
    start = F.greatest(F.lit(0.0), center - length / 2)
    end = F.least(duration, start + length)
    return F.greatest(F.lit(0.0), end - length), end


def gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def semitones(n: Column) -> Column:
    return F.pow(F.lit(2.0), n / 12.0)


def trim_floor(start: Column, end: Column, duration: Column, cfg: Config = DEFAULT) -> Column:
    """The end of a trim that is no shorter than the least trim, unless the clip ends."""
    return F.when(end - start < cfg.min_trim_seconds, F.least(duration, start + cfg.min_trim_seconds)).otherwise(end)


def fade_seconds(a: Column, b: Column, crossfade: Column, cfg: Config = DEFAULT) -> Column:
    """Length of a crossfade between parts of these durations; 0 where the parts are only joined."""
    fade = F.least(F.lit(cfg.crossfade_seconds), a * 0.9, b * 0.9)
    return F.when(crossfade & (fade > 0.05), fade).otherwise(0.0)


def declick_seconds(a: Column, b: Column, cfg: Config = DEFAULT) -> Column:
    d = F.least(F.lit(cfg.declick_seconds), a * 0.2, b * 0.2)
    return F.when(d > 0.002, d).otherwise(0.0)


def order_label(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit("[Sound "), i.cast("string"), F.lit("]"))), " → ")


def short_id(*parts: Column) -> Column:
    """Eight hex digits that the parts determine, where an id must not change when a task is run again."""
    return F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8)


def result_status(n: Column, wanted: int) -> Column:
    """What a run has found: none, fewer than wanted, or all."""
    return F.when(n == 0, "none").when(n < wanted, "fewer").otherwise("all")
