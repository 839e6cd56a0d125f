"""Regions: runs of like neighbours, and the window that stands for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Config
from ..functions.vectors import cosine
from ..storage import kept


#: Seconds of the blocks that time is cut into.
BLOCK = 300.0


def regions(pool: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """`pool` plus region_id, from 0 in each recording: a new one after a gap, or where neighbours are unlike.

    A window looks no further back than the longest gap, so time is cut into blocks with as much of
    the block before; regions are counted within blocks, and blocks' totals added up.
    """
    s = F.col("start_seconds")
    own, key = F.floor(s / BLOCK), ["recording_id", "_block"]
    rows = pool.withColumn("_block", F.explode(F.sequence(own, F.floor((s + cfg.region_gap_seconds) / BLOCK))))
    w = Window.partitionBy(*key).orderBy("start_seconds")
    same = (s - F.lag("start_seconds").over(w) <= cfg.region_gap_seconds) & (cosine(F.lag("embedding").over(w), F.col("embedding")) >= cfg.region_similarity)
    rows = rows.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).filter(F.col("_block") == own)
    # read twice below, for its rows and for blocks' totals: made once, pool and all
    rows = kept(rows.withColumn("_in", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    before = Window.partitionBy("recording_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*key).agg(F.sum("_new").alias("_total")).select(*key, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return rows.join(blocks, key).withColumn("region_id", F.col("_before") + F.col("_in") - 1).select(*pool.columns, "region_id")


def representatives(scored: DataFrame) -> DataFrame:
    """One row a region (recording_id, region_id): its best window, the earliest of equals, and region_window_count."""
    best = F.max_by(F.struct("window_idx", "start_seconds", "score", "embedding"), F.struct("score", -F.col("start_seconds")))
    out = scored.groupBy("recording_id", "region_id").agg(best.alias("b"), F.count(F.lit(1)).alias("region_window_count"))
    return out.select("recording_id", "region_id", "b.*", "region_window_count")


def count_regions(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("recording_id").agg(F.countDistinct("region_id").alias("regions"))
