"""The WAV data source and its sink, and resampling."""

import io
import math
import struct
import wave
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

from wavelark.operators import resampling
from wavelark.sources import wav, wavsource


def pcm(x, rate=8000, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(wavsource.to_pcm(np.asarray(x).reshape(-1), width))
    return out.getvalue()


def tone(n, k=50.0):
    return np.sin(np.arange(n) / k) / 2


def reader(path, *filters, **options):
    r = wavsource.WavReader({"path": str(path), "id": "stem"} | {k: str(v) for k, v in options.items()})
    left = list(r.pushFilters(list(filters)))
    rows = [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]
    return r, left, rows


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("split", [1000, 4096, 1 << 20])
def test_every_frame_is_read_once_whatever_the_ranges(tmp_path, width, split):
    x = tone(5000)
    (tmp_path / "a.wav").write_bytes(pcm(x, width=width))
    (tmp_path / "b.WAV").write_bytes(pcm(np.stack([x, -x], axis=1), width=width, channels=2))
    _, _, rows = reader(tmp_path, splitBytes=split, blockFrames=700)
    a = sorted((r["sample_idx"], r["value"]) for r in rows if r["recording_id"] == "a")
    assert [i for i, _ in a] == list(range(5000)) and np.abs(np.array([v for _, v in a]) - x).max() < 2.0 ** (2 - 8 * width) + 1e-6
    b = sorted((r["sample_idx"], r["value"]) for r in rows if r["recording_id"] == "b")
    assert [i for i, _ in b] == list(range(5000)) and np.abs([v for _, v in b]).max() < 2.0 ** (2 - 8 * width)
    _, _, each = reader(tmp_path, splitBytes=split, channels="each")
    assert sorted((r["sample_idx"], r["channel"]) for r in each if r["recording_id"] == "b") == [(i, c) for i in range(5000) for c in (0, 1)]


def test_bytes_read_follow_the_range(tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.wav").write_bytes(pcm(tone(200_000)))
    whole, _, _ = reader(tmp_path, splitBytes=1 << 16)
    assert whole.bytes_read >= 800_000
    place, rec = ("sample_idx",), ("recording_id",)
    some, left, rows = reader(tmp_path, IsNotNull(place), GreaterThanOrEqual(place, 70_000), LessThan(place, 70_010), splitBytes=1 << 16)
    assert left == [] and sorted({r["sample_idx"] for r in rows}) == list(range(70_000, 70_010)) and some.bytes_read < 2_000
    one, left, rows = reader(tmp_path, EqualTo(rec, "b"), GreaterThan(place, 9), LessThanOrEqual(place, 11), EqualTo(("value",), 0.0), splitBytes=1 << 16)
    assert len(left) == 1 and [(r["recording_id"], r["sample_idx"]) for r in rows] == [("b", 10), ("b", 11)] and one.bytes_read < 1_000
    assert reader(tmp_path, In(rec, ("a", "c")), EqualTo(place, 5))[2] == [{"recording_id": "a", "sample_idx": 5, "value": pytest.approx(tone(6)[5], abs=1e-4)}]
    assert reader(tmp_path, EqualTo(rec, "a"), EqualTo(rec, "b"))[2] == []
    assert reader(tmp_path, table="recordings")[0].bytes_read < 100


def test_headers_of_other_kinds(tmp_path):
    x = tone(100).astype("<f4")
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 3, 1, 100, 400, 4, 32)
    extra = struct.pack("<4sI", b"LIST", 3) + b"abc\0"
    (tmp_path / "float.wav").write_bytes(struct.pack("<4sI4s", b"RIFF", 0, b"WAVE") + extra + fmt + struct.pack("<4sI", b"data", 0) + x.tobytes())
    ext = struct.pack("<4sIHHIIHHHHI", b"fmt ", 40, 0xFFFE, 1, 100, 200, 2, 16, 22, 16, 4) + struct.pack("<H", 1) + bytes(14)
    (tmp_path / "ext.wav").write_bytes(struct.pack("<4sI4s", b"RIFF", 0, b"WAVE") + ext + struct.pack("<4sI", b"data", 0xFFFFFFFF) + (x * 32768).astype("<i2").tobytes())
    (tmp_path / "wide.wav").write_bytes(struct.pack("<4sI4s", b"RF64", 0xFFFFFFFF, b"WAVE") + struct.pack("<4sIQQQI", b"ds64", 28, 0, 60, 30, 0) + ext + struct.pack("<4sI", b"data", 0xFFFFFFFF) + (x * 32768).astype("<i2").tobytes())
    (tmp_path / "empty.wav").write_bytes(pcm([])[:44])
    rows = reader(tmp_path)[2]
    count = {n: sum(r["recording_id"] == n for r in rows) for n in ("float", "ext", "wide", "empty")}
    assert count == {"float": 100, "ext": 100, "wide": 30, "empty": 0}
    assert np.abs(np.array([r["value"] for r in rows if r["recording_id"] == "float"]) - x).max() == 0
    (tmp_path / "bad.wav").write_bytes(b"not one")
    with pytest.raises(ValueError, match="bad.wav: not a WAV file"):
        reader(tmp_path)
    assert len(reader(tmp_path, ignoreCorrupt="true")[2]) == 230
    with pytest.raises(FileNotFoundError):
        reader(tmp_path / "none")


def test_headers_that_are_written():
    assert wavsource.pcm_header(100, 8000, 2) == pcm([0] * 100)[:44]
    large = wavsource.pcm_header(1 << 32, 8000, 2)
    import pyarrow as pa

    h = wavsource.read_header(pa.BufferReader(large), len(large) + (1 << 33))
    assert (h.n_frames, h.data, h.rate, h.width) == (1 << 32, len(large), 8000, 2)


def test_in_spark_bounds_are_pushed_and_ranges_are_tasks(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(pcm(tone(300_000)))
    s = wav.signal(spark, str(tmp_path), id="stem", splitBytes=1 << 16)
    assert s.rdd.getNumPartitions() == 10 and s.count() == 300_000
    part = s.filter(F.col("sample_idx").between(1000, 1999) & (F.col("recording_id") == "a"))
    assert part.count() == 1000 and "Filter (" not in part._jdf.queryExecution().executedPlan().toString()
    blocks = wav.blocks(spark, str(tmp_path), blockFrames=1 << 14)
    assert blocks.agg(F.sum(F.size("samples"))).first()[0] == 300_000
    assert wav.blocks(spark, str(tmp_path), start=2.0, seconds=1.0).agg(F.min("first_sample"), F.sum(F.size("samples"))).first()[:] == (16_000, 8_000)


def test_files_are_written_from_blocks(spark, tmp_path):
    x = tone(10_000)
    rows = [("long", i, x[i : i + 1000].tolist()) for i in range(0, 10_000, 1000) if i != 3000] + [("sub/short.wav", 0, [0.5, -1.0, 2.0]), ("none", 0, [])]
    df = spark.createDataFrame(rows, "name string, first_sample long, samples array<double>").repartition(5)
    wav.write(df, str(tmp_path / "out"), 8000)
    r = {q.path.split("/out/")[1]: q.n_frames for q in wav.recordings(spark, str(tmp_path / "out")).collect()}
    assert r == {"long.wav": 10_000, "sub/short.wav": 3, "none.wav": 0}
    got = wav.signal(spark, str(tmp_path / "out"), id="stem").filter("recording_id = 'long'").orderBy("sample_idx").toPandas()["value"].to_numpy()
    x[3000:4000] = 0
    assert np.abs(got - x).max() < 1e-4
    assert [q.value for q in wav.signal(spark, str(tmp_path / "out"), id="stem").filter("recording_id = 'short'").orderBy("sample_idx").collect()] == [0.5, -1.0, 1 - 2**-15]
    more = spark.createDataFrame([("long", [0.0])], "name string, samples array<double>")
    with pytest.raises(Exception, match="already there"):
        wav.write(more, str(tmp_path / "out"), 8000)
    assert sorted(p.name for p in (tmp_path / "out").rglob("*")) == ["long.wav", "none.wav", "short.wav", "sub"]
    wav.write(more, str(tmp_path / "out"), 8000, "overwrite", width=3)
    assert [(q.filename, q.n_frames, q.width) for q in wav.recordings(spark, str(tmp_path / "out")).collect()] == [("long.wav", 1, 3)]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = [(f"f{i}", [0.1] * 100) for i in range(20)]
    df = spark.createDataFrame(rows, "name string, samples array<double>").repartition(4)
    bad = df.withColumn("samples", F.when(F.col("name") == "f7", F.array(F.raise_error(F.lit("lost")).cast("double"))).otherwise(F.col("samples")))
    for rows in (bad, df.withColumn("name", F.when(F.col("name") == "f7", "../f7").otherwise(F.col("name"))), df.withColumn("name", F.when(F.col("name") != "f7", F.col("name")))):
        with pytest.raises(Exception):
            wav.write(rows, str(tmp_path / "out"), 8000)
        assert not [p for p in Path(tmp_path).rglob("*.wav")] and not (tmp_path / "out" / "_temporary").exists()
    twice = df.withColumn("name", F.lit("same"))
    with pytest.raises(Exception, match="came after|more than once"):
        wav.write(twice, str(tmp_path / "out"), 8000)
    assert not [p for p in Path(tmp_path).rglob("*.wav")]


def plain_resample(x, up, down, zeros=resampling.ZEROS):
    share, out = min(1.0, up / down), []
    for n in range(math.ceil(len(x) * up / down)):
        base, phase = divmod(n * down, up)
        h = {}
        for k in range(-200, 201):
            t = (k - phase / up) * share
            if abs(t) < zeros:
                h[k] = share * np.sinc(t) * (0.5 + 0.5 * math.cos(math.pi * t / zeros))
        out.append(sum(v * x[base + k] for k, v in h.items() if 0 <= base + k < len(x)) / sum(h.values()))
    return np.array(out)


@pytest.mark.parametrize("up,down,n", [(4, 5, 1000), (3, 2, 777), (1, 3, 1000), (2, 1, 301), (6, 4, 400), (147, 160, 500), (1, 1, 50), (4, 5, 1)])
def test_resampling_is_the_convolution(spark, up, down, n):
    x = np.random.default_rng(up * n).normal(size=n)
    s = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)] + [("one", 0, 1.0)], "recording_id string, sample_idx long, value double").repartition(3)
    got = resampling.resample(s, up, down, block=128).orderBy("sample_idx").toPandas()
    y = got[got.recording_id == "r"]
    g = math.gcd(up, down)
    want = plain_resample(x, up // g, down // g)
    assert y["sample_idx"].tolist() == list(range(len(want))) and np.abs(y["value"].to_numpy() - want).max() < 1e-9


def test_resampling_keeps_what_the_lower_rate_can_hold(spark):
    """A tone below the lower rate's half comes through, one above it is gone, and a constant stays."""
    for hz, kept in ((5.0, 1.0), (45.0, 0.0), (0.0, 1.0)):
        x = np.cos(2 * np.pi * hz * np.arange(2000) / 100)
        s = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)], "recording_id string, sample_idx long, value double")
        y = resampling.resample(s, 4, 5, block=500).orderBy("sample_idx").toPandas()["value"].to_numpy()[50:-50]
        want = kept * np.cos(2 * np.pi * hz * np.arange(1600) / 80)[50:-50]
        assert np.abs(y - want).max() < 1e-2
    with pytest.raises(ValueError):
        resampling.resample(s, 0, 1)
