"""Operators that used to be folds over a whole recording or run, against the fold itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.config import DEFAULT
from wavelark.operators import composing, logs, selection, spacing, timeline


def fold(starts, least):
    out, last = [], float("-inf")
    for s in sorted(starts):
        if s > last + least:
            out.append(s)
            last = s
    return out


@pytest.mark.parametrize("least,n,span", [(0.5, 1000, 200.0), (0.05, 500, 60.0), (3.0, 500, 20000.0), (0.0, 50, 5.0), (50.0, 200, 100.0)])
def test_spacing_is_the_fold(spark, least, n, span, monkeypatch):
    monkeypatch.setattr(spacing, "FAN", 4)
    rng = np.random.default_rng(n)
    rows = [(r, float(x)) for r in "ab" for x in np.concatenate([rng.uniform(-span / 3, span, n), np.arange(min(n, 20)) * least, [span] * 3])]
    df = spark.createDataFrame([*rows, ("a", None), ("c", None)], "recording_id string, start_seconds double").repartition(3)
    got = spacing.spaced(df, least).collect()
    for r in "abc":
        assert sorted(x.start_seconds for x in got if x.recording_id == r) == fold([s for q, s in rows if q == r], least)


def test_spacing_of_nothing(spark):
    none = spark.createDataFrame([], "recording_id string, start_seconds double")
    assert spacing.spaced(none, 1.0).count() == 0 and spacing.spaced(spark.createDataFrame([("a", 1.0), ("a", 1.0)], none.schema), -1.0).count() == 2


def active(x, rate):
    """First active frame's begin and last one's end in seconds, or None."""
    frame = max(1, int(DEFAULT.frame_seconds * rate))
    level = [np.sqrt(np.mean(np.square(x[i : i + frame])) + 1e-12) for i in range(0, len(x) - frame + 1, frame)]
    on = [k for k, v in enumerate(level) if v > np.percentile(level, 20) * DEFAULT.active_ratio]
    return (on[0] * DEFAULT.frame_seconds, (on[-1] + 1) * DEFAULT.frame_seconds) if on else None


def by_definition(parts, cross, rate):
    """The mix made clip after clip: its silent end and the clip's silent begin are cut, then they overlap or are spliced."""
    mix, seconds = np.array(parts[0]), len(parts[0]) / rate
    for part, fades in zip(parts[1:], cross):
        part, own = np.array(part), len(part) / rate
        end, begin = active(mix, rate), active(part, rate)
        if end and len(mix) / rate - end[1] > 0.5:
            seconds = max(0.05, seconds - (len(mix) / rate - end[1]) + 0.15)
            mix = mix[: round(seconds * rate)]
        if begin and begin[0] > 0.5:
            own -= begin[0] - 0.15
            part = part[round((begin[0] - 0.15) * rate) :]
        fade = min(0.4, 0.9 * seconds, 0.9 * own) if fades else 0
        click = min(0.01, 0.2 * seconds, 0.2 * own)
        over = fade > 0.05
        k = min(round(fade * rate) if over else round(click * rate) if click > 0.002 else 0, len(mix), len(part))
        up = np.arange(k) / max(k, 1)
        mix[len(mix) - k :] *= 1 - up
        part[:k] *= up
        at = len(mix) - k if over else len(mix)
        out = np.zeros(at + len(part))
        out[: len(mix)] += mix
        out[at:] += part
        mix, seconds = out, seconds + own - (fade if over else 0)
    return mix, seconds


@pytest.mark.parametrize("seed", range(3))
def test_composition_by_joins_is_the_mix_clip_by_clip(spark, seed):
    rng, rate, runs = np.random.default_rng(seed), 100, {}
    for run in ("a", "b", "c"):
        parts = []
        for _ in range(rng.integers(1, 6)):
            n = int(rng.choice([3, 40, 130, 250]))
            x = rng.normal(size=n)
            if rng.random() < 0.6:
                x[int(n * rng.uniform(0.2, 0.7)) :] = 0.0
            if rng.random() < 0.4:
                x[: int(n * rng.uniform(0.1, 0.6))] = 0.0
            parts.append(x)
        runs[run] = (parts, [bool(rng.random() < 0.5) for _ in parts])
    items = spark.createDataFrame([(r, 10 * p, x.tolist(), c) for r, (xs, cs) in runs.items() for p, (x, c) in enumerate(zip(xs, cs))], "run_id string, position long, samples array<double>, crossfade_into_next boolean")
    got = {r.run_id: r for r in timeline.compose(items, rate).collect()}
    for run, (parts, cross) in runs.items():
        mix, seconds = by_definition(parts, cross, rate)
        assert got[run].duration == pytest.approx(seconds) and len(got[run].samples) == len(mix)
        assert np.abs(np.array(got[run].samples) - mix).max() < 1e-9


def test_rounds_render_only_what_changes(spark):
    """A join's row tells all that rendering needs."""
    items = spark.createDataFrame([("a", 0, True), ("a", 1, False)], "run_id string, position long, crossfade_into_next boolean")
    samples = spark.createDataFrame([("a", p, i, 1.0 + i % 2) for p in (0, 1) for i in range(200)], "run_id string, position long, sample_idx long, value double")
    joins = composing.plan(items, samples, 100)
    assert [(j.n, j.skip, j.cut, j.ramp, j.start, j.stop, round(j.length, 6)) for j in joins.orderBy("n").collect()] == [(1, 0, 0, 0, 0, 200, 2.0), (2, 0, 200, 40, 160, 360, 3.6)]
    late = composing.render(joins, samples, F.lit(350)).orderBy("sample_idx").collect()
    assert [r.sample_idx for r in late] == list(range(350, 360))


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_as_of_in_ranges_is_as_of(spark, blocks):
    rng = np.random.default_rng(blocks)
    events = spark.createDataFrame([(k, float(t), i) for i, (k, t) in enumerate([("hot", t) for t in rng.integers(0, 300, 400)] + [(k, t) for k in ("b", None, "none") for t in rng.integers(0, 300, 20)])], "run string, t double, id int").repartition(3)
    states = spark.createDataFrame([(k, float(t), int(v)) for k, n in (("hot", 25), ("b", 4), (None, 3), ("idle", 5)) for t, v in zip(rng.choice(300, n, replace=False), range(n))], "run string, at double, v int").repartition(2)
    plain, spread = ({r.id: (r.run, r.t, r.v) for r in f(events, states, ["run"], "t", "at", ["v"]).collect()} for f in (logs.as_of, lambda *a: logs.as_of_long_runs(*a, blocks=blocks)))
    assert plain == spread and len(plain) == 460 and sum(v is None for *_, v in plain.values()) > 0
    assert logs.as_of_long_runs(events.limit(0), states, ["run"], "t", "at", ["v"]).count() == 0
    if blocks == 16:  # the one key that holds most rows is in many ranges
        hot = spark.createDataFrame([("hot", float(t), t) for t in range(2000)], "run string, t double, id int")
        ranges = hot.repartitionByRange(16, "run", "t").groupBy(F.spark_partition_id()).count().collect()
        assert len(ranges) > 8 and max(r[1] for r in ranges) < 400


@pytest.mark.parametrize("first", [2, 8, 256])
def test_shortlists_of_many_are_the_greedy_ones(spark, first):
    rng = np.random.default_rng(first)
    rows = [(r, i, i, 2.0 * i, float(rng.choice([0.2, 0.5, rng.random()])), [float(x) for x in rng.normal(size=4)], 1) for r, n in (("a", 120), ("b", 30), ("c", 1), ("d", 60)) for i in range(n)]
    reps = spark.createDataFrame(rows, "recording_id string, region_id long, window_idx long, start_seconds double, score double, embedding array<double>, region_window_count long").repartition(3)
    prior = reps.filter("window_idx % 11 = 3 AND recording_id <> 'b'")
    for before in (None, prior):
        a, b = (sorted(map(tuple, f(reps, 25, before).collect())) for f in (selection.shortlist, lambda *x: selection.shortlist_of_many(*x, first=first)))
        assert a == b and len(a) > 25
    assert selection.shortlist_of_many(reps.limit(0), 25).count() == 0
