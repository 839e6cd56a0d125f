"""Diverse shortlists: greedy picks among region representatives, and the verified final ones."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Config
from ..functions.vectors import cosine
from ..storage import kept

SHORTLIST = "recording_id string, pick long, region_id long, window_idx long, start_seconds double, score double, region_window_count long"


def _unit(v: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(x, np.float64) for x in v])
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def pick(reps: pd.DataFrame, prior: pd.DataFrame, count: int, cfg: Config) -> list[int]:
    """Positions in `reps` (by start) in the order they are picked.

    Likeness to what is picked only grows, so one running maximum serves penalty and guard alike.
    """
    unit, start, base = _unit(reps["embedding"]), reps["start_seconds"].to_numpy(), reps["score"].to_numpy(np.float64).copy()
    open_ = np.ones(len(reps), bool)
    if len(prior):
        like = (unit @ _unit(prior["embedding"]).T).max(axis=1)
        open_ &= like < cfg.duplicate_similarity
        base -= cfg.prior_weight * like
        base -= cfg.prior_penalty * reps["window_idx"].isin(prior["window_idx"]).to_numpy()
    return greedy(unit, start, base, open_, count, cfg)[0]


def greedy(unit: np.ndarray, start: np.ndarray, base: np.ndarray, open_: np.ndarray, count: int, cfg: Config, rest: float = -np.inf) -> tuple[list[int], bool]:
    """Places in the order they are picked, and whether all picks there can be are among them.

    rest: the highest base that any row besides these has. What such a row is worth is at most `rest` for the first pick, and
    for others that plus the diversity weight, since likeness is at least -1; a pick that isn't worth more ends the list.
    """
    closest, picked, open_ = np.full(len(unit), -np.inf), [], open_.copy()
    while len(picked) < count:
        if not open_.any():
            return picked, rest == -np.inf
        value = np.where(open_, base - (cfg.diversity_weight * closest if picked else 0.0), -np.inf)
        i = int(value.argmax())
        if value[i] <= rest + (cfg.diversity_weight if picked else 0.0):
            return picked, False
        picked.append(i)
        closest = np.maximum(closest, unit @ unit[i])
        open_ &= (np.abs(start - start[i]) >= cfg.min_separation_seconds) & (closest < cfg.duplicate_similarity)
        open_[i] = False
    return picked, True


def shortlist(reps: DataFrame, count: int, prior: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Up to `count` representatives of each recording as SHORTLIST; `pick` is the order of choice.

    Greedy choice depends on itself, hence one grouped task a recording, over representatives alone.
    `prior`: (recording_id, window_idx, embedding) shown before.
    """
    names = [x.split()[0] for x in SHORTLIST.split(", ")]

    def choose(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=names)
        rows = rows.sort_values("start_seconds", kind="stable").reset_index(drop=True)
        order = pick(rows, before, count, cfg)
        return rows.iloc[order].assign(pick=range(1, len(order) + 1))[names]

    if prior is None:
        return reps.groupBy("recording_id").applyInPandas(lambda rows: choose(rows, rows.iloc[:0]), SHORTLIST)
    return reps.groupBy("recording_id").cogroup(prior.select("recording_id", "window_idx", "embedding").toDF("recording_id", "window_idx", "embedding").groupBy("recording_id")).applyInPandas(choose, SHORTLIST)


def shortlist_of_many(reps: DataFrame, count: int, prior: DataFrame | None = None, cfg: Config = DEFAULT, first: int = 256) -> DataFrame:
    """As `shortlist`, for recordings with any number of representatives: the same picks, and no task holds them all.

    A round takes the representatives of the highest base value of each recording, `first` of them, and picks
    as long as none of the others can be worth more. Recordings whose list isn't complete then go on with four times as many.
    What has been shown before (as many rows as there were picks) is an array beside each representative.
    """
    names = [x.split()[0] for x in SHORTLIST.split(", ")]
    rows = reps.withColumn("_base", F.col("score").cast("double"))
    if prior is not None:
        shown = prior.groupBy("recording_id").agg(F.collect_list("embedding").alias("_shown"), F.collect_set("window_idx").alias("_again"))
        like = F.array_max(F.transform("_shown", lambda p: cosine(p, F.col("embedding"))))
        rows = rows.join(shown, "recording_id", "left").withColumn("_like", like).filter(F.col("_like").isNull() | (F.col("_like") < cfg.duplicate_similarity))
        again = F.when(F.array_contains("_again", F.col("window_idx")), cfg.prior_penalty).otherwise(0.0)
        rows = rows.withColumn("_base", F.when(F.col("_like").isNull(), F.col("_base")).otherwise(F.col("_base") - cfg.prior_weight * F.col("_like") - again)).drop("_shown", "_again", "_like")
    rows, out, most = kept(rows), [], first
    best = Window.partitionBy("recording_id").orderBy(F.desc("_base"), "start_seconds")

    def choose(most: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            ranked = pdf.sort_values(["_base", "start_seconds"], ascending=[False, True], kind="stable")
            rest = float(ranked["_base"].iloc[most]) if len(ranked) > most else -np.inf
            seen = ranked.iloc[:most].sort_values("start_seconds", kind="stable").reset_index(drop=True)
            order, whole = greedy(_unit(seen["embedding"]), seen["start_seconds"].to_numpy(), seen["_base"].to_numpy(np.float64), np.ones(len(seen), bool), count, cfg, rest)
            if not whole:
                return pd.DataFrame([{"recording_id": pdf["recording_id"].iloc[0]}], columns=names)  # without a pick: not yet
            return seen.iloc[order].assign(pick=range(1, len(order) + 1))[names]

        return run

    while True:
        found = kept(rows.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= most + 1).groupBy("recording_id").applyInPandas(choose(most), SHORTLIST))
        out.append(found.filter("pick IS NOT NULL"))
        open_ = found.filter("pick IS NULL").select("recording_id")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, out)
        rows, most = rows.join(open_, "recording_id", "left_semi"), 4 * most


def final(short: DataFrame, failed: DataFrame, cfg: Config = DEFAULT, order: str = "chronological") -> DataFrame:
    """The first max_candidates of the shortlist without those that `failed` (recording_id, window_idx).

    In time order by default, as results are defined; order="score" takes them as they were picked.
    """
    left = short.join(failed.select("recording_id", "window_idx"), ["recording_id", "window_idx"], "left_anti")
    by = Window.partitionBy("recording_id").orderBy("start_seconds" if order == "chronological" else "pick")
    left = left.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= cfg.max_candidates)
    rank = Window.partitionBy("recording_id").orderBy("start_seconds")
    return left.withColumn("candidate_id", F.row_number().over(rank)).drop("_n")


def excluded_in_clips(short: DataFrame, failed: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """recording_id, excluded_speech_in_clip: shortlisted ones that fail the gate before max_candidates have passed, in time order; later ones are never looked at."""
    bad = failed.select("recording_id", "window_idx").distinct().withColumn("_bad", F.lit(True))
    before = Window.partitionBy("recording_id").orderBy("start_seconds").rowsBetween(Window.unboundedPreceding, -1)
    rows = short.join(bad, ["recording_id", "window_idx"], "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    rows = rows.withColumn("_passed", F.coalesce(F.count_if(~F.col("_bad")).over(before), F.lit(0)))
    return rows.groupBy("recording_id").agg(F.count_if(F.col("_bad") & (F.col("_passed") < cfg.max_candidates)).alias("excluded_speech_in_clip"))
