"""The candidate pool: speech gate, novelty, contrast, normalised components, composite score with jitter."""

from __future__ import annotations

import random
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Config
from ..functions.vectors import cosine

COMPONENTS = ("novelty", "contrast", "layering", "distinctiveness", "temporal_interest")


def has_speech(scores: F.Column, speech_indexes: list[int], cfg: Config = DEFAULT) -> F.Column:
    """Whether any speech class reaches the threshold; no speech classes: never."""
    if not speech_indexes:
        return F.lit(False)
    return F.coalesce(F.greatest(*[F.get(scores, F.lit(i)) for i in speech_indexes], F.lit(float("-inf"))) >= cfg.speech_threshold, F.lit(False))


def eligible(windows: DataFrame) -> DataFrame:
    return windows.filter(~F.col("has_speech"))


def novelty(windows: DataFrame, dim: int) -> DataFrame:
    """`windows` plus novelty_raw: one less the cosine with the recording's mean embedding.

    The mean is dim plain averages, combined before the shuffle; what joins back is one row a recording.
    """
    e = F.col("embedding")
    mean = windows.groupBy("recording_id").agg(*[F.avg(e[i]).alias(f"m{i}") for i in range(dim)])
    mean = mean.select("recording_id", F.array(*[f"m{i}" for i in range(dim)]).alias("_mean"))
    return windows.join(mean, "recording_id").withColumn("novelty_raw", 1.0 - cosine(e, F.col("_mean"))).drop("_mean")


#: Milliseconds of the blocks that time is cut into where windows look at their surroundings.
BLOCK_MS = 300_000


def contrast(windows: DataFrame, dim: int, cfg: Config = DEFAULT) -> DataFrame:
    """`windows` plus contrast_raw: one less the cosine with the mean of the neighbours within contrast_seconds, itself left out; no neighbour: 0.

    Cosine doesn't see the mean's divisor, so the frame's sums less the row itself will do. Time is cut
    into blocks, each with what lies within reach of it, so that a long recording spreads over tasks.
    """
    e = F.col("embedding")
    reach = round(cfg.contrast_seconds * 1000)  # frames take whole bounds, so times are in milliseconds
    block = lambda shift: F.floor((F.col("_ms") + shift) / BLOCK_MS)
    rows = windows.withColumn("_ms", F.bround(F.col("start_seconds") * 1000).cast("long")).withColumn("_block", F.explode(F.sequence(block(-reach), block(reach))))
    near = Window.partitionBy("recording_id", "_block").orderBy("_ms").rangeBetween(-reach, reach)
    rows = rows.select("*", F.count(F.lit(1)).over(near).alias("_n"), *[(F.sum(e[i]).over(near) - e[i]).alias(f"_s{i}") for i in range(dim)])
    rows = rows.filter(F.col("_block") == block(0)).withColumn("_sum", F.array(*[f"_s{i}" for i in range(dim)]))
    return rows.withColumn("contrast_raw", F.when(F.col("_n") == 1, 0.0).otherwise(1.0 - cosine(e, F.col("_sum")))).select(*windows.columns, "contrast_raw")


def min_max(columns: dict[str, str], rows: DataFrame) -> DataFrame:
    """`rows` plus each new column: the raw one over its range in the recording, 0.5 where there is no range."""
    edges = rows.groupBy("recording_id").agg(*[f(c).alias(f"_{f.__name__}_{new}") for new, c in columns.items() for f in (F.min, F.max)])
    out = rows.join(edges, "recording_id")
    for new, c in columns.items():
        lo, hi = F.col(f"_min_{new}"), F.col(f"_max_{new}")
        out = out.withColumn(new, F.when(hi - lo < 1e-9, 0.5).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0))))
    return out.drop(*[x for x in edges.columns if x != "recording_id"])


def candidate_pool(windows: DataFrame, features: DataFrame, dim: int, cfg: Config = DEFAULT) -> DataFrame:
    """Eligible windows with their five components in [0, 1]."""
    rows = eligible(windows).join(features, ["recording_id", "window_idx"])
    rows = contrast(novelty(rows, dim), dim, cfg)
    raw = dict(zip(COMPONENTS, ("novelty_raw", "contrast_raw", "layering_raw", "distinctiveness_raw", "temporal_interest_raw")))
    return min_max(raw, rows).select("recording_id", "window_idx", "start_seconds", "embedding", *COMPONENTS)


def jittered_weights(seed: int | None, cfg: Config = DEFAULT, weights: dict[str, float] | None = None) -> tuple[dict[str, float], random.Random | None]:
    """Weights for a seed, and the generator as it stands after them. A missing component is an error; others take a draw."""
    out = dict(weights or cfg.weights)
    rng = random.Random(seed) if seed is not None else None
    if rng:
        out = {k: w * (1.0 + rng.uniform(-cfg.weight_jitter, cfg.weight_jitter)) for k, w in out.items()}
        total = sum(out.values()) or 1.0
        out = {k: w / total for k, w in out.items()}
    for c in COMPONENTS:
        if c not in out:
            raise KeyError(c)
    return out, rng


def jitter_factors(seed: int, n: int, cfg: Config = DEFAULT, weights: dict[str, float] | None = None) -> list[float]:
    """The factors of a pool's first n windows in time order."""
    rng = jittered_weights(seed, cfg, weights)[1]
    return [1.0 + rng.uniform(-cfg.score_jitter, cfg.score_jitter) for _ in range(n)]


def composite_score(pool: DataFrame, seed: int | None = None, cfg: Config = DEFAULT, weights: dict[str, float] | None = None) -> DataFrame:
    """`pool` plus score. Jitter draws go by the row's place in its recording; each recording replays the generator in one pass over its numbers, windows stay where they are."""
    w, _ = jittered_weights(seed, cfg, weights)
    score = F.lit(0.0)
    for c in COMPONENTS:
        score = score + F.lit(w[c]) * F.col(c)
    rows = pool.withColumn("score", score)
    if seed is None:
        return rows
    place = Window.partitionBy("recording_id").orderBy("start_seconds")
    rows = rows.withColumn("_place", (F.row_number().over(place) - 1).cast("long"))

    import pandas as pd

    def draw(batches):
        known: list[float] = []
        source = (1.0 + rng.uniform(-cfg.score_jitter, cfg.score_jitter) for rng in [jittered_weights(seed, cfg, weights)[1]] for _ in count())
        for pdf in batches:
            while len(pdf) and len(known) <= pdf["_place"].max():
                known.append(next(source))
            yield pd.DataFrame({"_place": pdf["_place"], "_factor": [known[i] for i in pdf["_place"]]})

    factors = rows.select("_place").distinct().mapInPandas(draw, "_place long, _factor double")
    return rows.join(factors, "_place").withColumn("score", F.col("score") * F.col("_factor")).drop("_place", "_factor")
