"""Edit lists: splices and crossfades of sample streams, composition with boundary cuts, edit replay."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Config
from ..functions.scalars import declick_seconds, fade_seconds
from ..storage import kept
from . import composing


def timeline(items: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """`items` (run_id, position, duration, crossfade_into_next) plus fade into the item and its start on the timeline.

    For items without boundary cuts: a running sum of durations less fades.
    """
    w = Window.partitionBy("run_id").orderBy("position")
    rows = items.withColumn("_before", F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("fade", F.coalesce(fade_seconds(F.lag("duration").over(w), F.col("duration"), F.lag("crossfade_into_next").over(w), cfg), F.lit(0.0)))
    return rows.withColumn("start", F.col("_before") - F.sum("fade").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_before")


def crossfade(a: DataFrame, b: DataFrame, n_a: int, fade: int) -> DataFrame:
    """(recording_id, sample_idx, value) of two streams to a recording, overlapped by `fade` samples under straight ramps: one sum by output position."""
    ramp = F.when(F.col("sample_idx") >= n_a - fade, 1.0 - (F.col("sample_idx") - (n_a - fade)) / F.lit(float(fade))).otherwise(1.0)
    left = a.select("recording_id", "sample_idx", (F.col("value") * ramp).alias("value"))
    rise = F.when(F.col("sample_idx") < fade, F.col("sample_idx") / F.lit(float(fade))).otherwise(1.0)
    right = b.select("recording_id", (F.col("sample_idx") + (n_a - fade)).alias("sample_idx"), (F.col("value") * rise).alias("value"))
    return left.unionAll(right).groupBy("recording_id", "sample_idx").agg(F.sum("value").alias("value"))


def declick_concat(a: DataFrame, b: DataFrame, n_a: int, ramp: int) -> DataFrame:
    """(recording_id, sample_idx, value) of one stream after the other, each faded over `ramp` samples at the join."""
    down = F.when(F.col("sample_idx") >= n_a - ramp, 1.0 - (F.col("sample_idx") - (n_a - ramp)) / F.lit(float(max(ramp, 1)))).otherwise(1.0) if ramp else F.lit(1.0)
    up = F.when(F.col("sample_idx") < ramp, F.col("sample_idx") / F.lit(float(max(ramp, 1)))).otherwise(1.0) if ramp else F.lit(1.0)
    return a.select("recording_id", "sample_idx", (F.col("value") * down).alias("value")).unionAll(b.select("recording_id", (F.col("sample_idx") + n_a).alias("sample_idx"), (F.col("value") * up).alias("value")))


def compose(items: DataFrame, rate: int, cfg: Config = DEFAULT, runs: DataFrame | None = None) -> DataFrame:
    """run_id, duration, samples of items (run_id, position, samples of the trimmed clip, crossfade_into_next).

    For compositions that fit into a row; `composing` has the same in long form. With `runs` (run_id), a run without items is an error.
    """
    if runs is not None:
        runs = runs.select(F.col("run_id").cast("string").alias("run_id")).distinct()
        items = runs.join(items, "run_id", "left").withColumn("samples", F.coalesce("samples", F.raise_error(F.lit("a composition needs at least one clip")).cast("array<double>")))
    items = kept(items)
    samples = items.select("run_id", "position", F.posexplode("samples").alias("i", "value")).select("run_id", "position", F.col("i").cast("long").alias("sample_idx"), "value")
    joins = composing.plan(items, samples, rate, cfg)
    mix = composing.render(joins, samples).groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))), lambda x: x["value"]).alias("samples"))
    return composing.lengths(joins).join(mix, "run_id", "left").select("run_id", "duration", F.coalesce("samples", F.array().cast("array<double>")).alias("samples"))


EDIT_STATE = "run_id string, status string, position int, candidate_id int, trim_start double, trim_end double, crossfade_into_next boolean"
EDIT_LISTS = (
    "final_order array<int>, removed array<int>, "
    "items array<struct<candidate_id:int,original_start_seconds:double,original_end_seconds:double,trim_start:double,trim_end:double,edited_duration:double,crossfade_into_next:boolean>>"
)
STATE_SCHEMA = pa.schema([("run_id", pa.string()), ("status", pa.string()), ("position", pa.int32()), ("candidate_id", pa.int32()), ("trim_start", pa.float64()), ("trim_end", pa.float64()), ("crossfade_into_next", pa.bool_())])
ITEM = pa.struct([("candidate_id", pa.int32()), *((n, pa.float64()) for n in ("original_start_seconds", "original_end_seconds", "trim_start", "trim_end", "edited_duration")), ("crossfade_into_next", pa.bool_())])
LISTS_SCHEMA = pa.schema([("run_id", pa.string()), ("final_order", pa.list_(pa.int32())), ("removed", pa.list_(pa.int32())), ("items", pa.list_(ITEM))])


class Edit:
    """The clips of one edit in their order, and those removed: [candidate, trim start, trim end, crossfade, original start, original end]."""

    def __init__(self, cfg: Config):
        self.ids: list[int] = []  # of those in `live`
        self.live: list[list] = []
        self.gone: list[list] = []
        self.least = cfg.min_trim_seconds

    def apply(self, command: str, candidate: int, a: float, b: float, duration: float) -> None:
        place = self.ids.index(candidate) if candidate in self.ids else None
        if command == "add" and place is None:
            self.ids.append(candidate)
            self.live.append([candidate, 0.0, duration, False, a, b])
        elif command == "restore":
            if back := next((x for x in self.gone if x[0] == candidate), None):
                self.gone.remove(back)
                self.ids.append(candidate)
                self.live.append(back)
        elif place is None:
            return
        elif command == "trim":
            self.live[place][1:3] = a, b if b - a >= self.least else min(duration, a + self.least)
        elif command in ("up", "down"):
            to = place + (1 if command == "down" else -1)
            if 0 <= to < len(self.live):
                for xs in (self.ids, self.live):
                    xs[place], xs[to] = xs[to], xs[place]
        elif command == "remove":
            self.ids.pop(place)
            self.gone.append(self.live.pop(place))
        elif command == "crossfade":
            self.live[place][3] = bool(a)


def _state_rows(runs: list[tuple[str, Edit]]) -> pa.RecordBatch:
    """As EDIT_STATE has them."""
    rows = [(run, s, k, *x[:4]) for run, edit in runs for s, xs in (("kept", edit.live), ("removed", edit.gone)) for k, x in enumerate(xs)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), STATE_SCHEMA)], schema=STATE_SCHEMA)


def _list_rows(runs: list[tuple[str, Edit]]) -> pa.RecordBatch:
    """A row a run, as EDIT_LISTS has it."""
    live, gone = ([getattr(edit, of) for _, edit in runs] for of in ("live", "gone"))

    def lists(values: pa.Array, of: list[list]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, of))], pa.int32()), values)

    items = [x for xs in live for x in xs]
    candidate, start, end, cross, first, last = ([x[k] for x in items] for k in range(6))
    columns = candidate, first, last, start, end, [b - a for a, b in zip(start, end)], cross
    ids, removed = pa.array(candidate, pa.int32()), pa.array([x[0] for xs in gone for x in xs], pa.int32())
    struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ITEM)], fields=list(ITEM))
    return pa.RecordBatch.from_arrays([pa.array([run for run, _ in runs], pa.string()), lists(ids, live), lists(removed, gone), lists(struct, live)], schema=LISTS_SCHEMA)


def _folded(edits: DataFrame, batch_of: Callable, schema: str, together: bool, cfg: Config) -> DataFrame:
    def values(column):  # by way of numpy where nothing is null, which is many times faster
        return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()

    def run(batches):
        now, edit, done, size = None, Edit(cfg), [], 0
        for batch in batches:
            for of, *step in zip(*map(values, batch.columns)):
                if of != now:
                    if n := len(edit.live) + len(edit.gone):
                        done.append((now, edit))
                        size += n
                    if size > 10_000:
                        yield batch_of(done)
                        done, size = [], 0
                    now, edit = of, Edit(cfg)
                edit.apply(*step)
        if edit.live or edit.gone:
            done.append((now, edit))
        if done:
            yield batch_of(done)

    ordered = (edits if together else edits.repartition("run_id")).sortWithinPartitions("run_id", "sequence")
    return ordered.select("run_id", "command", "candidate_id", "a", "b", "duration").mapInArrow(run, schema)


def replay(edits: DataFrame, cfg: Config = DEFAULT, together: bool = False) -> DataFrame:
    """EDIT_STATE after all edits (run_id, sequence, command, candidate_id, a, b, duration) in order.

    Commands: add (a, b: where the clip lies in its recording), trim (a, b), up, down, remove, restore
    (at the end), crossfade (a: 0 or 1). Unknown ids and moves past an end change nothing. Edits are
    sorted by run in each task and read in one pass; what a task holds is one run's state. `together`:
    a run's edits are in one partition already, and aren't shuffled.
    """
    return _folded(edits, _state_rows, EDIT_STATE, together, cfg)


def replayed_lists(edits: DataFrame, cfg: Config = DEFAULT, together: bool = False) -> DataFrame:
    """As `replay`, with a row a run: run_id and EDIT_LISTS. Runs that end without any clip have no row."""
    return _folded(edits, _list_rows, f"run_id string, {EDIT_LISTS}", together, cfg)


def swap_neighbours(items: DataFrame, candidate_id: int, down: bool) -> DataFrame:
    """`items` (run_id, position, candidate_id) with one item moved by one place, by window functions alone."""
    w = Window.partitionBy("run_id").orderBy("position")
    mine = F.col("candidate_id") == candidate_id
    other = (F.lag if down else F.lead)("candidate_id").over(w) == candidate_id
    there = (F.lead if down else F.lag)("position").over(w)
    back = (F.lag if down else F.lead)("position").over(w)
    return items.withColumn("position", F.when(mine & there.isNotNull(), there).when(other, back).otherwise(F.col("position")))


def declicked(a: F.Column, b: F.Column, cfg: Config = DEFAULT) -> F.Column:
    return declick_seconds(a, b, cfg)
