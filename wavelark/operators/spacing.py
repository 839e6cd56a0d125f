"""Spacing without a fold over a whole recording: maps of blocks, composed in a tree.

A start is kept if it lies more than `spacing` after the last one kept. That makes every stretch of time a
map from the last start kept before it to the last one kept up to its end. Such a map is a step function
with few steps: what came before lies before the stretch, so only starts in the first `spacing` of it, and
the first one after these, can be the one it goes on with. Maps compose, and composing is associative, so
a recording is cut into blocks of FAN times the spacing, FAN blocks make one of the next level, and so on to
one block. Then the way back: from the last start kept before a block, each of its parts gets its own,
down to the starts themselves. Every group, on each level, has the rows of one block; a recording of n
starts takes about log(n) / log(FAN) levels each way, and none of its tasks holds all of it.
"""

from __future__ import annotations

from bisect import bisect_right
from math import ceil, inf, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept

FAN = 64

MAPS = "recording_id string, block long, entries array<double>, lasts array<double>"
_MAPS = pa.schema([("recording_id", pa.string()), ("block", pa.int64()), ("entries", pa.list_(pa.float64())), ("lasts", pa.list_(pa.float64()))])


def step(entries: list[float], lasts: list[float], last: float, spacing: float) -> float:
    """The last start kept after a block, from the last one before it. lasts: for each entry the last start kept if the block goes on with it."""
    i = bisect_right(entries, last + spacing)
    return lasts[i] if i < len(entries) else last


def through(starts: list[float], at: int, spacing: float) -> list[int]:
    """Places of the starts kept if the one at `at` is."""
    out = []
    while at < len(starts):
        out.append(at)
        at = bisect_right(starts, starts[at] + spacing)
    return out


def _needed(entries: list[float], begin: float, spacing: float) -> list[float]:
    """The entries that what lies before `begin` can lead to."""
    return entries[: bisect_right(entries, begin + spacing) + 1]


def spaced(starts: DataFrame, spacing: float) -> DataFrame:
    """Rows of (recording_id, start_seconds, ...) at more than `spacing` after the last row kept, in order.

    Of rows that start together one is kept, any. Rows without a start go; a negative spacing keeps all others.
    """
    starts = starts.filter("start_seconds IS NOT NULL")
    if spacing < 0:
        return starts
    width = FAN * spacing if spacing > 0 else float(FAN)
    key = F.col("recording_id").cast("string").alias("recording_id")
    times = kept(starts.select(key, F.col("start_seconds").cast("double").alias("s")).distinct().withColumn("block", F.floor(F.col("s") / width)))
    low, high = times.agg(F.min("block"), F.max("block")).first()
    if low is None:
        return starts
    levels = max(1, ceil(log(max(high - low + 1, 2)) / log(FAN) + 1e-9))

    def of_starts(key: tuple, rows: pa.Table) -> pa.Table:
        s = sorted(rows["s"].to_pylist())
        entries = _needed(s, key[1].as_py() * width, spacing)
        return pa.Table.from_pylist([{"recording_id": key[0].as_py(), "block": key[1].as_py(), "entries": entries, "lasts": [s[through(s, i, spacing)[-1]] for i in range(len(entries))]}], _MAPS)

    def children(rows: pa.Table) -> list[tuple]:
        return sorted(zip(*(rows[c].to_pylist() for c in ("block", "entries", "lasts")), strict=True))

    def of_blocks(wide: float):
        def compose(key: tuple, rows: pa.Table) -> pa.Table:
            parts = children(rows)
            entries = _needed([e for _, es, _ in parts for e in es], key[1].as_py() * wide, spacing)
            lasts = []
            for e in entries:
                last = e - spacing  # any value that leads to e, were it not for rounding
                for _, es, ls in parts:
                    if es and es[0] <= e <= es[-1] and e in es:
                        last = ls[es.index(e)]
                    elif es and es[0] > e:
                        last = step(es, ls, last, spacing)
                lasts.append(last)
            return pa.Table.from_pylist([{"recording_id": key[0].as_py(), "block": key[1].as_py(), "entries": entries, "lasts": lasts}], _MAPS)

        return compose

    maps = [kept(times.groupBy("recording_id", "block").applyInArrow(of_starts, MAPS))]
    for k in range(1, levels + 1):
        up = maps[-1].withColumn("above", F.floor(F.col("block") / FAN))
        maps.append(kept(up.groupBy("recording_id", "above").applyInArrow(of_blocks(width * FAN**k), MAPS)))

    def down(key: tuple, rows: pa.Table, given: pa.Table) -> pa.Table:
        last, out = given["last"][0].as_py() if given.num_rows else -inf, []
        for block, es, ls in children(rows):
            out.append({"recording_id": key[0].as_py(), "block": block, "last": last})
            last = step(es, ls, last, spacing)
        return pa.Table.from_pylist(out, pa.schema([("recording_id", pa.string()), ("block", pa.int64()), ("last", pa.float64())]))

    # The top level may have two blocks, on either side of zero; they are gone through in order.
    before = maps[-1].groupBy("recording_id").applyInArrow(lambda key, rows: down(key, rows, pa.table({"last": pa.array([], pa.float64())})), "recording_id string, block long, last double")
    for below in reversed(maps[:-1]):
        rows = below.withColumn("above", F.floor(F.col("block") / FAN))
        before = rows.groupBy("recording_id", "above").cogroup(before.groupBy("recording_id", "block")).applyInArrow(down, "recording_id string, block long, last double")

    def choose(key: tuple, rows: pa.Table, given: pa.Table) -> pa.Table:
        s = sorted(rows["s"].to_pylist())
        found = through(s, bisect_right(s, given["last"][0].as_py() + spacing), spacing)
        return pa.table({"recording_id": pa.repeat(key[0], len(found)), "s": pa.array([s[i] for i in found], pa.float64())})

    chosen = times.groupBy("recording_id", "block").cogroup(before.groupBy("recording_id", "block")).applyInArrow(choose, "recording_id string, s double")
    match = (F.col("a.recording_id").cast("string") == F.col("b.recording_id")) & (F.col("a.start_seconds").cast("double") == F.col("b.s"))
    return starts.alias("a").join(chosen.alias("b"), match, "left_semi").dropDuplicates(["recording_id", "start_seconds"])
