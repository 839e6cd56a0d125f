"""Micro fixtures with results worked out by hand, and properties."""

import gzip
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavelark.config import DEFAULT, SPEECH_LABELS, speech_indexes
from wavelark.functions import scalars
from wavelark.operators import clipping, effects, framing, logs, regions, scoring, selection, spacing, spectral, timeline
from wavelark.plans import analysis
from wavelark.sources import wav
from wavelark.streaming import live


def sig(spark, values, rec="r"):
    return spark.createDataFrame([(rec, i, float(v)) for i, v in enumerate(values)], "recording_id string, sample_idx long, value double")


@pytest.mark.parametrize("total,n", [(0, 1), (4, 1), (4.01, 2), (60, 29), (61, 30), (2700, 1349)])
def test_window_grid_counts(spark, total, n):
    samples = round(total * 100)
    assert spark.range(1).select(framing.window_count(F.lit(samples), 400, 200).alias("n")).first().n == n


def test_windows_are_padded_and_empty_recordings_have_one(spark):
    s = sig(spark, [1] * 9)
    got = {(r.recording_id, r.window_idx): r.samples for r in framing.window_arrays(s, 4, 2, spark.createDataFrame([("r",), ("none",)], "recording_id string")).collect()}
    assert got == {("r", 0): [1] * 4, ("r", 1): [1] * 4, ("r", 2): [1] * 4, ("r", 3): [1, 1, 1, 0], ("none", 0): [0] * 4}


def test_envelope_of_less_than_a_frame(spark):
    assert framing.energy_envelope(sig(spark, [3, 4]), 5).first().rms == pytest.approx(math.sqrt(12.5))
    assert [r.frame for r in framing.energy_envelope(sig(spark, range(12)), 5).orderBy("frame").collect()] == [0, 1]


def test_min_max(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 5.0), ("b", 3.0), ("b", 3.0)], "recording_id string, x double")
    got = sorted((r.recording_id, r.y) for r in scoring.min_max({"y": "x"}, rows).collect())
    assert got == [("a", 0.0), ("a", 0.25), ("a", 1.0), ("b", 0.5), ("b", 0.5)]


def vectors(spark, rows):
    return spark.createDataFrame([("r", i, s, e) for i, (s, e) in enumerate(rows)], "recording_id string, window_idx long, start_seconds double, embedding array<double>")


def test_novelty_and_contrast(spark):
    v = vectors(spark, [(0.0, [1.0, 0.0]), (2.0, [1.0, 0.0]), (4.0, [1.0, 0.0]), (6.0, [0.0, 1.0])])
    nov = [r.novelty_raw for r in scoring.novelty(v, 2).orderBy("window_idx").collect()]
    con = [r.contrast_raw for r in scoring.contrast(v, 2).orderBy("window_idx").collect()]
    assert nov == pytest.approx([0.051317] * 3 + [0.683772], abs=1e-6) and con == pytest.approx([0.105573] * 3 + [1.0], abs=1e-6)
    for starts, want in (((0.0,), [0.0]), ((0.0, 30.0), [1.0, 1.0]), ((0.0, 30.01), [0.0, 0.0])):
        v = vectors(spark, list(zip(starts, ([1.0, 0.0], [0.0, 1.0]))))
        assert [r.contrast_raw for r in scoring.contrast(v, 2).orderBy("window_idx").collect()] == want
    assert scoring.novelty(vectors(spark, [(0.0, [0.0, 0.0])]), 2).first().novelty_raw == 1.0


def test_features_of_a_tone_and_of_silence():
    x = np.stack([np.cos(2 * np.pi * 8 * np.arange(64) / 64), np.zeros(64)])
    layering, crest, flux = spectral.features(x, 16)
    assert layering == pytest.approx([0.015528, 0], abs=1e-6) and crest == pytest.approx([16.127842, 0], abs=1e-6)
    steps = np.repeat([0.0, 1.0, 1.0, 0.0], 8)[None]
    assert spectral.features(steps, 16)[2] == pytest.approx([0.666666], abs=1e-6)
    assert spectral.features(steps[:, :8], 16)[2] == [0]


def test_speech_gate(spark):
    rows = spark.createDataFrame([([0.15, 0.0],), ([0.1499, 0.0],), ([0.0, 0.9],)], "s array<double>")
    assert [r[0] for r in rows.select(scoring.has_speech(F.col("s"), [0])).collect()] == [True, False, False]
    assert not any(r[0] for r in rows.select(scoring.has_speech(F.col("s"), [])).collect())
    assert speech_indexes(["Rain", "Speech", "Yell"]) == [1, 2] and len(SPEECH_LABELS) == 14


def test_regions_by_gap_and_likeness(spark):
    angle, at, rows = 0.0, [0.0, 2.0, 4.0, 8.0, 10.0], []
    for s, c in zip(at, (1, 0.95, 0.91, 0.99, 0.95)):
        angle += math.acos(c)
        rows.append((s, [math.cos(angle), math.sin(angle)]))
    got = regions.regions(vectors(spark, rows))
    assert [r.region_id for r in got.orderBy("start_seconds").collect()] == [0, 0, 1, 2, 2]
    assert [r.region_id for r in regions.regions(vectors(spark, [(0.0, [1.0, 0.0]), (2.5, [1.0, 0.0])])).collect()] == [0, 0]


def by_definition(starts, es, base, count, prior, shown):
    """The choice by its formula: over the windows that may still be picked, the greatest worth, the earliest of equals."""
    unit = es / np.maximum(np.linalg.norm(es, axis=1, keepdims=True), 1e-300)
    like, apart = unit @ unit.T, np.abs(np.subtract.outer(starts, starts))
    known = np.max([unit @ (e / max(np.linalg.norm(e), 1e-300)) for e in prior], axis=0) if prior else np.full(len(starts), -np.inf)
    worth = base - 0.2 * np.where(np.isinf(known), 0, known) - 0.5 * np.isin(np.arange(len(starts)), list(shown))
    out: list[int] = []
    while len(out) < count:
        may = (known < 0.97) & (apart[:, out] >= 8).all(axis=1) & (like[:, out] < 0.97).all(axis=1) & ~np.isin(np.arange(len(starts)), out)
        if not may.any():
            break
        out.append(int(np.where(may, worth - 0.2 * (like[:, out].max(axis=1) if out else 0), -np.inf).argmax()))
    return out


def test_greedy_choice_is_its_definition():
    rng = np.random.default_rng(1)
    for k in range(60):
        n = int(rng.integers(0, 30))
        es = rng.normal(size=(n, 3)) * (rng.random((n, 1)) > 0.05)
        starts = np.cumsum(rng.choice([2.0, 4.0, 8.0, 10.0], n))
        base = rng.choice([0.1, 0.2, 0.5, 0.9], n) + rng.random(n) * (k % 2)
        rows = pd.DataFrame({"window_idx": range(n), "start_seconds": starts, "score": base, "embedding": list(es)})
        prior = rows.iloc[: k % 3][["window_idx", "embedding"]]
        if n:
            assert selection.pick(rows, prior, 25, DEFAULT) == by_definition(starts, es, base, 25, list(prior["embedding"]), set(prior["window_idx"]))


def test_final_takes_the_earliest(spark):
    short = spark.createDataFrame([("r", 26 - i, i, i, 8.0 * i, 0.1 * i, 1) for i in range(1, 26)], selection.SHORTLIST)
    bad = spark.createDataFrame([("r", 2), ("r", 5)], "recording_id string, window_idx long")
    assert [r.window_idx for r in selection.final(short, bad).orderBy("candidate_id").collect()] == [1, 3, 4, 6, 7, 8, 9, 10, 11, 12]
    assert [r.window_idx for r in selection.final(short, bad, order="score").orderBy("candidate_id").collect()] == list(range(16, 26))


def test_log_entries(spark, tmp_path):
    short = spark.createDataFrame([("r", 26 - i, i, i, 8.0 * i, 0.1 * i, 1) for i in range(1, 26)], selection.SHORTLIST)
    bad = spark.createDataFrame([("r", 2), ("r", 5), ("r", 20)], "recording_id string, window_idx long")
    final, excluded = selection.final(short, bad), selection.excluded_in_clips(short, bad)
    assert excluded.first().excluded_speech_in_clip == 2
    pool = short.select("recording_id", "window_idx", *[F.lit(0.5).alias(c) for c in scoring.COMPONENTS])
    counted = spark.createDataFrame([("r", 30, 5, 25, 25, 25, 10)], "recording_id string, total_windows_analyzed long, excluded_speech_windows long, pool_size long, region_count long, shortlist_size long, final_count long")
    rows = logs.analysis_entries(counted, excluded, final, pool, "run", 2, 1, 5.0, "Table")
    logs.append(rows, f"{tmp_path}/a", "analysis")
    back = logs.read(spark, f"{tmp_path}/a", "analysis")
    r = back.first()
    assert (r.run_id, r.analysis_number, r.jitter_seed, r.excluded_speech_in_clip, len(r.final_candidates)) == ("run", 2, 1, 2, 10)
    assert [x.start_seconds for x in logs.surfaced(back).orderBy("candidate_id").collect()] == [8.0 * i for i in (1, 3, 4, 6, 7, 8, 9, 10, 11, 12)]
    state = spark.createDataFrame([("run", "kept", 1, 3, 0.5, 2.0, False), ("run", "kept", 0, 9, 0.0, 5.0, True), ("run", "removed", 0, 4, 0.0, 5.0, False)], timeline.EDIT_STATE)
    clips = spark.createDataFrame([("run", 3, 10.0, 15.0), ("run", 9, 30.0, 35.0)], "run_id string, candidate_id int, start_seconds double, end_seconds double")
    logs.append(logs.composition_entries(state, clips, 6.0), f"{tmp_path}/c", "composition")
    c = logs.read(spark, f"{tmp_path}/c", "composition").first()
    assert (c.final_order, c.removed, [x.edited_duration for x in c.items]) == ([9, 3], [4], [5.0, 1.5])


def test_jitter_draws():
    w, _ = scoring.jittered_weights(1)
    assert list(w.values()) == pytest.approx([0.141587, 0.25575, 0.242356, 0.160912, 0.199395], abs=1e-6)
    assert scoring.jitter_factors(1, 3) == pytest.approx([0.984847, 1.045478, 1.086617], abs=1e-6)
    with pytest.raises(KeyError):
        scoring.jittered_weights(None, weights={"novelty": 1.0})


def test_event_span_and_bounds(spark):
    active = [0, 1, 1, 0, 1, 1, 1, 0, 1, 0]
    values = [v for a in active for v in [10.0 * a + 1] * 5] + [1.0] * 450
    cand = spark.createDataFrame([("r", 0, 0.1)], "recording_id string, window_idx long, start_seconds double")
    cfg = type(DEFAULT)(window_seconds=0.15)
    r = clipping.event_spans(cand, sig(spark, values), 100, cfg).first()
    assert (r.span_start, r.span_end) == pytest.approx((0.05, 0.35))
    rows = spark.createDataFrame([("r", i, 10.0, 100.0, a, b) for i, (a, b) in enumerate([(10.15, 11.85), (10.0, 15.5), (10.0, 18.0), (None, None)])], "recording_id string, window_idx long, start_seconds double, duration double, span_start double, span_end double")
    got = [(r.clip_start, r.clip_end) for r in clipping.clip_bounds(rows).orderBy("window_idx").collect()]
    assert [x for g in got for x in g] == pytest.approx([8.5, 13.5, 9.85, 15.65, 9.85, 16.35, 9.5, 14.5])


@pytest.mark.parametrize("center,dur,want", [(1, 100, (0, 5)), (99, 100, (95, 100)), (1.5, 3, (0, 3))])
def test_centred_window(spark, center, dur, want):
    assert tuple(spark.range(1).select(*scalars.centred(F.lit(float(center)), F.lit(float(dur)), 5.0)).first()) == want


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(scalars.format_timestamp(F.lit(s))) for s in (0.5, 1.5, 2.5, 59.5, 3599.6)] == ["00:00:00", "00:00:02", "00:00:02", "00:01:00", "01:00:00"]
    fade = lambda a, b, x=True: one(scalars.fade_seconds(F.lit(a), F.lit(b), F.lit(x)))
    assert [fade(5.0, 5.0), fade(0.2, 5.0), fade(0.05, 5.0), fade(5.0, 5.0, False)] == pytest.approx([0.4, 0.18, 0, 0])
    assert one(scalars.declick_seconds(F.lit(5.0), F.lit(5.0))) == 0.01 and one(scalars.declick_seconds(F.lit(0.005), F.lit(5.0))) == 0
    assert one(scalars.trim_floor(F.lit(1.0), F.lit(1.05), F.lit(5.0))) == 1.2 and one(scalars.trim_floor(F.lit(4.95), F.lit(5.0), F.lit(5.0))) == 5.0


def test_render_cuts_silence_at_joins(spark):
    rate, tone = 1000, lambda s: np.sin(np.arange(int(s * 1000)))
    quiet = lambda s: np.full(int(s * 1000), 1e-4)
    clips = [("cut", [np.concatenate([tone(2), quiet(1)]), np.concatenate([quiet(1), tone(2)])], False), ("fade", [tone(2), tone(3)], True)]
    items = spark.createDataFrame([(run, k, x.tolist(), cross) for run, xs, cross in clips for k, x in enumerate(xs)], "run_id string, position long, samples array<double>, crossfade_into_next boolean")
    got = {r.run_id: (r.duration, len(r.samples)) for r in timeline.compose(items, rate).collect()}
    assert got["cut"] == (pytest.approx(2.15 + 2.15), 4300) and got["fade"] == (pytest.approx(4.6), 4600)


def test_edit_replay(spark):
    rows = [("r", k, *x) for k, x in enumerate([("add", 1, 0.0, 0.0, 5.0), ("add", 2, 0.0, 0.0, 5.0), ("add", 3, 0.0, 0.0, 5.0), ("down", 1, 0.0, 0.0, 5.0), ("remove", 2, 0.0, 0.0, 5.0), ("trim", 3, 1.0, 1.05, 5.0), ("restore", 2, 0.0, 0.0, 5.0), ("crossfade", 1, 1.0, 0.0, 5.0), ("up", 1, 0.0, 0.0, 5.0), ("remove", 3, 0.0, 0.0, 5.0), ("trim", 9, 0.0, 1.0, 1.0)])]
    got = timeline.replay(spark.createDataFrame(rows, "run_id string, sequence int, command string, candidate_id int, a double, b double, duration double")).collect()
    assert sorted((r.status, r.position, r.candidate_id, r.trim_start, r.trim_end, r.crossfade_into_next) for r in got) == [("kept", 0, 1, 0, 5, True), ("kept", 1, 2, 0, 5, False), ("removed", 0, 3, 1, 1.2, False)]


def test_compositions_from_one_shuffle(spark, tmp_path, monkeypatch):
    """Lines are dealt out once for edits and compositions alike; the log is compressed, in files that several tasks can read."""
    from wavelark import catalog

    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert shuffles(catalog.QUERIES["edit_replay"](spark, "/root/testdata/sf0.001")) == 1
    edits = catalog._edits(spark, "/root/testdata/sf0.001")
    entries = logs.composition_entries(edits, 0.0, together=True)
    assert shuffles(entries) == 1
    monkeypatch.setattr(logs, "LINES", 200)
    logs.append(entries, f"{tmp_path}/c", "composition")
    files, lines = list((tmp_path / "c").glob("part-*")), entries.count()
    text = sum(len(gzip.decompress(f.read_bytes())) for f in files)
    assert len(files) >= lines / 200 > 4 and sum(f.stat().st_size for f in files) < text / 4
    back = logs.read(spark, f"{tmp_path}/c", "composition")
    assert back.count() == lines and not back.exceptAll(entries.select(back.columns)).count()
    want = timeline.replay(edits).filter("status = 'kept'").select("run_id", "position", "candidate_id", "trim_start", "trim_end", "crossfade_into_next")
    got = back.select("run_id", F.posexplode("items").alias("position", "i")).select("run_id", "position", "i.candidate_id", "i.trim_start", "i.trim_end", "i.crossfade_into_next")
    assert want.count() == got.count() and not want.exceptAll(got).count()


def test_edits_are_sorted_in_parts_of_bounded_size(spark, monkeypatch):
    from wavelark import catalog

    monkeypatch.setattr(catalog, "LINES_A_TASK", 500)
    assert catalog._edits(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 12


def test_composition_entries(spark):
    """Runs without a clip in the end, with removed ones alone, restored ones and a null name."""
    steps = {"all gone": [("add", 1, 2.0, 7.0), ("remove", 1, 0.0, 0.0)], "none": [("trim", 1, 0.0, 1.0)], None: [("add", 5, 1.0, 6.0), ("crossfade", 5, 1.0, 0.0)]}
    steps["back"] = [("add", 1, 10.0, 15.0), ("add", 2, 20.0, 25.0), ("add", 1, 99.0, 99.0), ("trim", 1, 1.0, 1.05), ("remove", 1, 0.0, 0.0), ("restore", 1, 0.0, 0.0), ("up", 1, 0.0, 0.0), ("remove", 2, 0.0, 0.0), ("add", 3, None, None)]
    rows = [(run, k, command, c, a, b, 5.0) for run, xs in steps.items() for k, (command, c, a, b) in enumerate(xs)]
    edits = spark.createDataFrame(rows, "run_id string, sequence int, command string, candidate_id int, a double, b double, duration double")
    got = {r.run_id: (r.final_order, r.removed, [tuple(x) for x in r["items"]]) for r in logs.composition_entries(edits, 0.0).collect()}
    assert got == {
        "all gone": ([], [1], []), None: ([5], [], [(5, 1.0, 6.0, 0.0, 5.0, 5.0, True)]),
        "back": ([1, 3], [2], [(1, 10.0, 15.0, 1.0, 1.2, pytest.approx(0.2), False), (3, None, None, 0.0, 5.0, 5.0, False)]),
    }


def test_tones_and_gates():
    assert len(effects.TONES) == 12
    a, b = effects.draw("dreamy", 1, "a.wav"), effects.draw("dreamy", 1, "a.wav")
    assert a[0] == b[0] != effects.draw("dreamy", 2, "a.wav")[0]
    plan = effects.graph(effects.stages(a[0]))
    assert plan.startswith("[0:a]aformat=channel_layouts=stereo[n0];") and plan.endswith("alimiter=limit=0.97[out]") and "extrastereo" not in plan
    rng = random.Random("calm:1:x")
    assert effects.draw("calm", 1, "x")[0][0][1][0] == 0.98 * (1 + rng.uniform(-0.015, 0.015))
    params, rng = effects.draw("tense", 1, "x")
    assert effects.gate_plan(params, rng, 2 * 400, 1000) == []
    assert all(0 < lo < hi < 4000 and hi - lo > 2 * fade for lo, hi, fade, _ in effects.gate_plan(params, rng, 4000, 1000))


def test_logs_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r", 1, "kept", 1.0, 0), ("r", 1, "discarded", 2.0, 1)], "run_id string, candidate_id int, decision string, decided_at double, sequence int")
    for _ in range(2):
        logs.append(rows, f"{tmp_path}/d", "decisions")
    back = logs.read(spark, f"{tmp_path}/d", "decisions")
    assert back.count() == 4 and back.filter("analysis_number is not null").count() == 0
    assert logs.latest_decisions(back, ["run_id", "candidate_id"], "decided_at").first().decision == "discarded"


def test_wav_source(spark, tmp_path):
    x = np.sin(np.arange(200_000) / 10) / 2
    (tmp_path / "a.wav").write_bytes(wav.encode(x, 32_000))
    (tmp_path / "b.txt").write_text("no")
    r = wav.recordings(spark, str(tmp_path)).collect()
    assert [(q.filename, q.rate, q.channels, q.duration_seconds) for q in r] == [("a.wav", 32_000, 1, 6.25)]
    got = wav.signal(spark, str(tmp_path), start=1.0, seconds=0.5).orderBy("sample_idx").toPandas()
    assert got["sample_idx"].tolist() == list(range(32_000, 48_000)) and np.abs(got["value"] - x[32_000:48_000]).max() < 1e-4


def test_analyse_end_to_end(spark):
    rng = np.random.default_rng(0)
    s = sig(spark, rng.normal(size=16 * 61))

    def model(windows):
        return windows.select("recording_id", "window_idx", F.array(F.get("samples", F.lit(0)), F.lit(0.0)).alias("scores"), F.slice("samples", 1, 8).alias("embedding"))

    rows = analysis.analyse(s, model, [1], 16)
    assert rows.count() == 30 and not rows.filter("has_speech").count()
    short = analysis.shortlisted(rows.select("recording_id", "window_idx", "start_seconds", "has_speech", "embedding"), rows.select("recording_id", "window_idx", "layering_raw", "distinctiveness_raw", "temporal_interest_raw"), 8)
    starts = sorted(r.start_seconds for r in short.collect())
    assert starts and all(b - a >= 8 for a, b in zip(starts, starts[1:]))


def test_streams(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(ev.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = live.windowed_levels(stream).writeStream.format("memory").queryName("levels").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    assert spark.sql("select sum(n) from levels").first()[0] == 2 * ev.count()
    rows = [("r", 0.0, 0.1, [1.0, 0.0]), ("r", 2.0, 0.5, [1.0, 0.0]), ("r", 4.0, 0.2, [0.0, 1.0]), ("r", 20.0, 0.2, [0.0, 1.0])]
    w = spark.createDataFrame(rows, "recording_id string, start_seconds double, score double, embedding array<double>")
    w.write.parquet(f"{tmp_path}/w")
    q = live.live_regions(spark.readStream.schema(w.schema).parquet(f"{tmp_path}/w")).writeStream.format("memory").queryName("regions").outputMode("append").trigger(availableNow=True).start()
    for _ in range(60):  # idle timeouts keep this one running
        if q.awaitTermination(1) or spark.sql("select * from regions").count() == 2:
            break
    q.stop()
    assert sorted((r.first_start, r.last_start, r.best_start, r.n) for r in spark.sql("select * from regions").collect()) == [(0, 2, 2, 2), (4, 4, 4, 1)]


def test_plans_have_no_cross_joins(spark):
    from wavelark import catalog

    for name, query in catalog.QUERIES.items():
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    plan = catalog.QUERIES["region_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id,250)" in plan


def test_blocks_of_time_change_nothing(spark, monkeypatch):
    """Regions, contrast and noise floors over many blocks and bars are those over one."""
    from wavelark import catalog

    d, names = "/root/testdata/sf0.001", ("sound_regions", "contrast", "noise_floor_activity")
    want = [sorted(map(repr, catalog.QUERIES[n](spark, d).collect())) for n in names]
    monkeypatch.setattr(regions, "BLOCK", 7.0)
    monkeypatch.setattr(scoring, "BLOCK_MS", 9_000)
    monkeypatch.setattr(framing, "STEPS", 1)
    assert [sorted(map(repr, catalog.QUERIES[n](spark, d).collect())) for n in names] == want


def test_percentile_with_ties(spark):
    rows = spark.createDataFrame([(r, float(v)) for r, vs in (("a", [1] * 50 + [2, 3]), ("b", [5]), ("c", range(1, 12)), ("d", [1, 1000])) for v in vs], "recording_id string, x double")
    got = {r.recording_id: r.q for r in framing.exact_percentile(rows, "x", 0.2, "q").collect()}
    assert got == pytest.approx({"a": 1, "b": 5, "c": 3, "d": 200.8})


def test_spacing_and_downmix(spark):
    rows = spark.createDataFrame([("r", x) for x in (0.0, 0.5, 1.0, 1.2, 5.0)], "recording_id string, start_seconds double")
    assert [r.start_seconds for r in spacing.spaced(rows, 0.9).orderBy("start_seconds").collect()] == [0.0, 1.0, 5.0]
    two = spark.createDataFrame([("r", c, i, float(c * 10 + i)) for c in (0, 1) for i in range(3)], "recording_id string, channel int, sample_idx long, value double")
    assert [r.value for r in framing.downmix(two).orderBy("sample_idx").collect()] == [5.0, 6.0, 7.0]


def test_queries_without_twins_take_all_rows(spark):
    from wavelark import catalog

    d = "/root/testdata/sf0.001"
    run, parts = catalog.QUERIES, spark.read.parquet(f"{d}/part.parquet").count()
    assert run["tone_params"](spark, d).select("basename").distinct().count() == run["effect_plan"](spark, d).select("basename").distinct().count() == parts > 50
    runs, events = run["composition_render"](spark, d).collect(), spark.read.parquet(f"{d}/events.parquet")
    assert len(runs) == len({r.run_id for r in runs}) == events.selectExpr("floor(event_id / 1000) as k").distinct().count()


def test_parameters_are_drawn_without_plans(spark):
    rows = [(f"{k} é.wav", tone, k) for k in range(3) for tone in effects.TONES]
    requests = spark.createDataFrame(rows, "basename string, tone string, version int")  # no n_samples: no plan can be made
    got = sorted((r.basename, r.tone, r.version, r.draw, r.name, r["values"]) for r in effects.parameters(requests).collect())
    assert got == sorted((b, t, v, k, name, values) for b, t, v in rows for k, (name, values) in enumerate(effects.draw(t, v, b)[0]))


def test_plans_have_the_parameters_and_gates_of_their_draws(spark):
    requests = spark.createDataFrame([("a.wav", tone, 2, n) for tone in effects.TONES for n in (1000, 200_000)], "basename string, tone string, version int, n_samples long")
    got = {(r.tone, len(r.gates) > 0): r for r in effects.effect_plans(requests).collect()}
    for tone in effects.TONES:
        params, rng = effects.draw(tone, 2, "a.wav")
        gates = effects.gate_plan(params, rng, 200_000, 32_000)
        r = got[(tone, bool(gates))]
        assert [(p.name, p["values"]) for p in r.params] == params and r.graph == effects.graph(effects.stages(params)) and [tuple(g) for g in r.gates] == gates


def test_edits_number_their_lines_once(spark):
    from wavelark import catalog

    plan = catalog._edits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1


def test_pitch_is_made_up_for_by_tempo():
    plan = effects.stages([("pitch_semitones", [12.0]), ("tempo", [1.0]), ("volume_db", [0.0])], 32_000)
    assert plan == ["aformat=channel_layouts=stereo", "asetrate=64000", "aresample=32000", "atempo=0.5000", "alimiter=limit=0.97"]
    assert effects.stages([("tempo", [1.0]), ("volume_db", [0.0])]) == [plan[0], plan[-1]]


def test_an_empty_composition_is_an_error(spark):
    items = spark.createDataFrame([("a", 0, [0.5] * 300, False)], "run_id string, position long, samples array<double>, crossfade_into_next boolean")
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    assert [r.run_id for r in timeline.compose(items, 100, runs=runs.filter("run_id = 'a'")).collect()] == ["a"]
    with pytest.raises(Exception, match="at least one clip"):
        timeline.compose(items, 100, runs=runs).collect()


def test_clips_are_written_as_wav(spark):
    x = np.sin(np.arange(1000) / 5) / 2
    rows = spark.createDataFrame([("c.wav", x.tolist())], "name string, samples array<double>")
    r = wav.encoded(rows, 8000).first()
    import io
    import wave

    with wave.open(io.BytesIO(r.content)) as w:
        assert (w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()) == (8000, 1, 2, 1000)
        assert np.abs(wav.to_float(w.readframes(1000), 2) - x).max() < 1e-4


def test_late_rows_sessions_logs_and_progress(spark, tmp_path):
    """Micro-batch by micro-batch: a row behind the watermark is dropped, sessions close after their gap, decisions land in the log once."""
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "user_id long, ts timestamp, value double"
    batches = [[(1, at(0), 1.0), (1, at(1), 1.0)], [(1, at(100), 3.0)], [(1, at(1), 9.0), (1, at(300), 5.0)], [(1, at(900), 7.0)]]
    seen = live.Progress()
    spark.streams.addListener(seen)
    queries = {"levels": lambda s: live.windowed_levels(s), "sessions": lambda s: live.sessions(s, "30 seconds", "10 seconds")}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for name, f in queries.items():
            stream = f(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
            stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp_{name}").queryName(f"{name}{k}").trigger(availableNow=True).start(f"{tmp_path}/{name}").awaitTermination(60)
    levels = {(r.start - at(0)).total_seconds(): r.n for r in spark.read.parquet(f"{tmp_path}/levels").collect()}
    assert levels[0.0] == 2 and levels[98.0] == levels[100.0] == 1  # the late row at second 1 isn't in its window
    got = sorted((r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/sessions").collect())
    assert (2, 2.0) in got and (1, 3.0) in got and (1, 9.0) not in got
    decisions = spark.createDataFrame([("r", i, "kept", float(i), i) for i in range(6)], "run_id string, candidate_id int, decision string, decided_at double, sequence int")
    decisions.write.parquet(f"{tmp_path}/dec")
    for _ in range(2):
        live.append_log(spark.readStream.schema(decisions.schema).parquet(f"{tmp_path}/dec"), f"{tmp_path}/log", "decisions", f"{tmp_path}/cp_log").awaitTermination(60)
    assert logs.read(spark, f"{tmp_path}/log", "decisions").count() == 6
    spark.streams.removeListener(seen)
    assert any(name and name.startswith("levels") and rows for name, _, rows in seen.seen)


def test_tones_as_a_table_function(spark):
    from wavelark.operators import recipes

    recipes.register(spark)
    spark.createDataFrame([(1, "a.wav", "calm", 1), (2, "a.wav", "mysterious", 1), (3, None, "calm", 1), (4, "a.wav", "calm", 2)], "id int, basename string, tone string, version int").createOrReplaceTempView("asked")
    got = spark.sql("SELECT * FROM tone_params(TABLE(asked) PARTITION BY basename) ORDER BY id, draw").collect()
    assert [(r.name, r["values"]) for r in got if r.id == 1] == effects.draw("calm", 1, "a.wav")[0] and {r.id for r in got} == {1, 2, 4}
    assert [r["values"] for r in spark.sql("SELECT * FROM tone_params(TABLE(asked) PARTITION BY id, only => 'eq') ORDER BY draw").collect()] == [v for n, v in effects.draw("mysterious", 1, "a.wav")[0] if n == "eq"]
    for sql, why in (("tone_params(1)", "takes a table"), ("tone_params(TABLE(SELECT 1 AS tone))", "needs the columns"), ("tone_params(TABLE(SELECT *, 1 AS draw FROM asked))", "there already"), ("tone_params(TABLE(asked), only => 'loudness')", "no tone has")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM {sql}").collect()
    with pytest.raises(Exception, match="is no tone"):
        spark.sql("SELECT * FROM tone_params(TABLE(SELECT 'a' AS basename, 'odd' AS tone, 1 AS version))").collect()


def test_a_model_is_loaded_once_a_worker(spark):
    from wavelark.plans import model

    m = model.WindowModel(model.spectral_model, model.SPECTRAL_LABELS)
    rows = spark.createDataFrame([("r", i, [float(j % (i + 2)) for j in range(64)]) for i in range(100)] + [("r", 100, [0.0] * 64)], "recording_id string, window_idx long, samples array<double>").coalesce(1)
    got = {r.window_idx: r for r in m(rows).collect()}
    assert len(got) == 101 and sum(got[3].scores) == pytest.approx(1) and got[100].scores == [0, 0, 0] and len(got[5].embedding) == model.SPECTRAL_DIM
    x = np.array([[float(j % 5) for j in range(64)]])
    assert got[3].embedding == pytest.approx(model.spectral_model()(x)[1][0].tolist())
    model._LOADED.clear(), model.LOADS.clear()
    assert model.loaded(model.spectral_model) is model.loaded(model.spectral_model) and len(model.LOADS) == 1
    assert [r.label_idx for r in m.indexes(spark.createDataFrame([("high",), ("odd",)], "label string")).collect()] == [2]
    with pytest.raises(Exception, match="3 labels|4 labels|the model gave"):
        model.WindowModel(model.spectral_model, ("a", "b")).__call__(rows).collect()
