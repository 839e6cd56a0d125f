"""Regions of a stream in disorder are those of the batch form."""

import numpy as np
from pyspark.sql import functions as F

from wavelark.operators import regions
from wavelark.streaming import live

SCHEMA = "recording_id string, ts timestamp, start_seconds double, score double, embedding array<double>"


def windows(seed):
    rng, out = np.random.default_rng(seed), []
    for r in ("a", "b", "c"):
        at, angle = 0.0, 0.0
        for _ in range(40):
            at += float(rng.choice([2.0, 2.0, 2.0, 2.5, 6.0]))
            angle += float(rng.choice([0.02, 0.05, 1.2], p=[0.5, 0.4, 0.1]))
            out.append((r, at, float(rng.choice([0.1, 0.5, 0.9])), [float(np.cos(angle)), float(np.sin(angle))]))
    return out


def run(spark, tmp_path, batches, name, late):
    """Each batch is a file, taken one after another; the last one moves the watermark past everything."""
    for k, rows in enumerate([*batches, [("end", 100_000.0, 0.0, [1.0, 0.0])]]):
        df = spark.createDataFrame(rows, "recording_id string, start_seconds double, score double, embedding array<double>")
        df = df.select("recording_id", F.timestamp_millis((F.col("start_seconds") * 1000).cast("long") + 1_700_000_000_000).alias("ts"), "start_seconds", "score", "embedding")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = live.regions_in_order(stream, late).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return sorted((r.recording_id, r.first_start, r.last_start, r.best_start, r.best_score, r.n) for r in spark.sql(f"select * from {name}").collect())


def batch_form(spark, rows):
    df = spark.createDataFrame([(r, i, *x) for i, (r, *x) in enumerate(rows)], "recording_id string, window_idx long, start_seconds double, score double, embedding array<double>")
    segmented = regions.regions(df)
    ends = segmented.groupBy("recording_id", "region_id").agg(F.min("start_seconds").alias("a"), F.max("start_seconds").alias("b"))
    reps = regions.representatives(segmented).join(ends, ["recording_id", "region_id"])
    return sorted((r.recording_id, r.a, r.b, r.start_seconds, r.score, r.region_window_count) for r in reps.collect())


def test_disorder_gives_the_batch_result(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows, rng = windows(1), np.random.default_rng(2)
    arrival = sorted(rows, key=lambda x: x[1] + float(rng.uniform(0, 20)))  # out of order by 20 seconds at most
    batches = [arrival[i : i + 20] for i in range(0, len(arrival), 20)]
    got = run(spark, tmp_path, batches, "ordered", "25 seconds")
    assert got == batch_form(spark, rows) and len(got) > 12


def test_late_windows_are_left_out(spark, tmp_path):
    e = [1.0, 0.0]
    batches = [[("a", 0.0, 0.1, e), ("a", 2.0, 0.2, e)], [("a", 50.0, 0.3, e)], [("a", 60.0, 0.4, e)], [("a", 4.0, 0.9, e), ("a", 61.0, 0.5, e)]]
    got = run(spark, tmp_path, batches, "late", "5 seconds")
    assert got == [("a", 0.0, 2.0, 2.0, 0.2, 2), ("a", 50.0, 50.0, 50.0, 0.3, 1), ("a", 60.0, 61.0, 61.0, 0.5, 2)]
