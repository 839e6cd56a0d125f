"""Queries over the given tables, by name, and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .config import DEFAULT
from .functions import scalars
from .functions.vectors import cosine
from .operators import clipping, composing, effects, framing, logs, recipes, regions, resampling, scoring, selection, spacing, spectral, timeline
from .plans import analysis, model
from .plans import oracle as O
from .sources import tables as T
from .sources import wav
from .streaming import live

DIM, WAVE_RATE, RATE = 64, 16, 100
FRAME = 5
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; columns that are doubles are rounded to 6 places on both sides."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str) -> list[F.Column]:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return spectral.window_features(T.waves(spark, d), WAVE_RATE)


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return scoring.candidate_pool(T.windows(spark, d), _features(spark, d), DIM)


def _segmented(spark: SparkSession, d: str, seed: int | None = None) -> DataFrame:
    return analysis.ranked(T.windows(spark, d), _features(spark, d), DIM, seed)


PLAIN, JITTERED = O.scored([0.2] * 5), O.scored(*O.jitter(1, T.WINDOWS))


# Signals


@query(f"WITH {O.ENVELOPE} SELECT rec AS recording_id, frame, {s6('rms')} FROM env")
def energy_envelope(spark, d):
    return framing.energy_envelope(T.signal(spark, d), FRAME).select("recording_id", "frame", *r6("rms"))


@query("WITH s AS (SELECT user_id::VARCHAR AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS v FROM events) SELECT recording_id, i // 5 AS frame, round(sqrt(avg(v * v) + 1e-12), 6) AS rms FROM s GROUP BY 1, 2 HAVING count(*) = 5 OR i // 5 = 0")
def energy_envelope_by_user(spark, d):
    return framing.energy_envelope(T.user_signals(spark, d), FRAME).select("recording_id", "frame", *r6("rms"))


def _grid_sql(window: int, hop: int) -> str:
    return f"""WITH {O.SIGNAL}, n AS (SELECT rec, CASE WHEN count(*) <= {window} THEN 1 ELSE ceil((count(*) - {window}) / {hop}.0)::BIGINT + 1 END AS n FROM sig GROUP BY rec), g AS (SELECT rec, unnest(range(0, n)) AS window_idx FROM n)
SELECT g.rec AS recording_id, window_idx, window_idx * {hop} / 100.0::DOUBLE AS start_seconds, count(*) AS n_samples, round(sqrt(sum(v * v) / {window}), 6) AS rms FROM g JOIN sig ON g.rec = sig.rec AND i >= window_idx * {hop} AND i < window_idx * {hop} + {window} GROUP BY ALL"""


def _grid(spark, d, window: int, hop: int) -> DataFrame:
    rows = framing.sliding(T.signal(spark, d), window, hop, F.count(F.lit(1)).alias("n_samples"), F.sqrt(F.sum(F.col("value") * F.col("value")) / window).alias("rms"))
    return rows.select("recording_id", "window_idx", (F.col("window_idx") * hop / float(RATE)).alias("start_seconds"), "n_samples", *r6("rms"))


@query(_grid_sql(400, 200))
def window_grid(spark, d):
    return _grid(spark, d, 400, 200)


@query(_grid_sql(6000, 5800))
def chunk_grid(spark, d):
    return _grid(spark, d, 6000, 5800)


@query(_grid_sql(200, 100))
def fixed_sub_windows(spark, d):
    return _grid(spark, d, 200, 100)


@query("SELECT user_id::VARCHAR AS recording_id, CASE WHEN count(*) <= 40 THEN 1 ELSE ceil((count(*) - 40) / 20.0)::BIGINT + 1 END AS windows FROM events GROUP BY user_id")
def window_counts(spark, d):
    return framing.sliding(T.user_signals(spark, d), 40, 20).groupBy("recording_id").agg(F.count(F.lit(1)).alias("windows"))


@query(f"WITH {O.ENVELOPE}, f AS (SELECT *, quantile_cont(rms, 0.2) OVER (PARTITION BY rec) AS floor FROM env) SELECT rec AS recording_id, frame, {s6('rms', 'floor')}, rms > floor * 1.6::DOUBLE AS active FROM f")
def noise_floor_activity(spark, d):
    return framing.noise_floor(framing.energy_envelope(T.signal(spark, d), FRAME), DEFAULT.active_ratio).select("recording_id", "frame", *r6("rms", "floor"), "active")


@query("""WITH s AS (SELECT user_id::VARCHAR AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS v FROM events),
env AS (SELECT recording_id, i // 5 AS frame, sqrt(avg(v * v) + 1e-12) AS rms FROM s GROUP BY recording_id, i // 5 HAVING count(*) = 5 OR i // 5 = 0),
act AS (SELECT *, rms > quantile_cont(rms, 0.2) OVER (PARTITION BY recording_id) * 1.6::DOUBLE AS active FROM env),
e AS (SELECT recording_id, min(frame) FILTER (active) AS a, max(frame) FILTER (active) AS b FROM act GROUP BY 1), l AS (SELECT recording_id, count(*) / 100.0::DOUBLE AS duration FROM s GROUP BY 1)
SELECT recording_id, round(coalesce(a * 0.05::DOUBLE, 0), 6) AS onset, round(CASE WHEN b IS NULL THEN 0 ELSE greatest(0, duration - (b + 1) * 0.05::DOUBLE) END, 6) AS trailing_silence, round(duration, 6) AS duration FROM l LEFT JOIN e USING (recording_id)""")
def usable_bounds(spark, d):
    return framing.usable_bounds(T.user_signals(spark, d), FRAME, RATE, DEFAULT.active_ratio).select("recording_id", *r6("onset", "trailing_silence", "duration"))


@query(f"WITH {O.SIGNAL} SELECT rec AS recording_id, i // 4 AS sample_idx, round(avg(v), 6) AS value FROM sig GROUP BY ALL")
def decimated_signal(spark, d):
    return framing.decimate(T.signal(spark, d), 4).select("recording_id", "sample_idx", *r6("value"))


@query("SELECT event_id AS sample_idx, value FROM events WHERE event_id BETWEEN 250 AND 899")
def region_scan(spark, d):
    return T.span(spark, d, 250, 899).select("sample_idx", "value")


# Features


@query(f"WITH {O.FEATURES} SELECT window_idx, {s6('flux')} FROM feats")
def temporal_flux(spark, d):
    return spectral.temporal_flux(T.waves(spark, d), 8).select("window_idx", *r6("flux"))


@query(f"WITH {O.SPECTRUM} SELECT vec_id AS window_idx, k::INTEGER AS bin, round(m, 6) AS magnitude FROM dft")
def magnitude_spectrum(spark, d):
    return spectral.magnitude_spectrum(T.waves(spark, d)).select("window_idx", "bin", *r6("magnitude"))


@query(f"WITH {O.FEATURES} SELECT window_idx, {s6('layering')} FROM feats")
def layering(spark, d):
    return _features(spark, d).select("window_idx", F.round("layering_raw", 6).alias("layering"))


@query(f"WITH {O.FEATURES} SELECT window_idx, {s6('crest')} FROM feats")
def crest(spark, d):
    return _features(spark, d).select("window_idx", F.round("distinctiveness_raw", 6).alias("crest"))


@query("SELECT count(*) AS windows, count(*) FILTER (label = 0) AS with_speech, count(*) FILTER (label <> 0) AS eligible FROM embeddings")
def speech_gate(spark, d):
    return T.windows(spark, d).agg(F.count(F.lit(1)).alias("windows"), F.count_if("has_speech").alias("with_speech"), F.count_if(~F.col("has_speech")).alias("eligible"))


@query("SELECT vec_id AS window_idx, greatest(embedding[3], embedding[8], embedding[41]) >= 0.15::FLOAT AS has_speech FROM embeddings")
def speech_by_class_scores(spark, d):
    return T.read(spark, d, "embeddings").select(F.col("vec_id").alias("window_idx"), scoring.has_speech(F.col("embedding").cast("array<double>"), [2, 7, 40]).alias("has_speech"))


@query(f"""WITH {O.SPECTRUM}, b AS (SELECT vec_id, sum(m) AS t, sum(m) FILTER (k < 4) AS low, sum(m) FILTER (k >= 16) AS high, list(m ORDER BY k)[1:8] AS e FROM dft GROUP BY vec_id)
SELECT vec_id AS window_idx, round(low / t, 6) AS low, round(high / t, 6) AS high, round(list_sum(e), 6) AS embedded, round(e[3], 6) AS third FROM b""")
def model_scores(spark, d):
    """A model behind its interface, loaded once a worker: the labels that are wanted are looked up as a table."""
    m = model.WindowModel(model.spectral_model, model.SPECTRAL_LABELS)
    rows = m(T.waves(spark, d)).select("window_idx", F.posexplode("scores").alias("label_idx", "score"), "embedding")
    wanted = m.indexes(spark.createDataFrame([("low",), ("high",), ("none",)], "label string"))
    out = rows.join(F.broadcast(wanted), "label_idx", "left_semi").groupBy("window_idx").agg(F.max(F.when(F.col("label_idx") == 0, F.col("score"))).alias("low"), F.max(F.when(F.col("label_idx") == 2, F.col("score"))).alias("high"), F.any_value("embedding").alias("e"))
    return out.select("window_idx", *r6("low", "high"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 6).alias("embedded"), F.round(F.col("e")[2], 6).alias("third"))


# Pool and selection


@query(f"WITH {O.WINDOWS}, {O.EMBEDDED} SELECT window_idx, {s6('novelty')} FROM nov")
def novelty(spark, d):
    return scoring.novelty(scoring.eligible(T.windows(spark, d)), DIM).select("window_idx", F.round("novelty_raw", 6).alias("novelty"))


@query(f"WITH {O.WINDOWS}, {O.EMBEDDED} SELECT window_idx, {s6('contrast')} FROM con")
def contrast(spark, d):
    return scoring.contrast(scoring.eligible(T.windows(spark, d)), DIM).select("window_idx", F.round("contrast_raw", 6).alias("contrast"))


@query(f"WITH {O.POOL} SELECT window_idx, start_seconds, {s6(*scoring.COMPONENTS)} FROM pool")
def candidate_pool(spark, d):
    return _pool(spark, d).select("window_idx", "start_seconds", *r6(*scoring.COMPONENTS))


@query(f"WITH {PLAIN} SELECT window_idx, {s6('score')} FROM scored")
def composite_score(spark, d):
    return scoring.composite_score(_pool(spark, d)).select("window_idx", *r6("score"))


@query(f"WITH {JITTERED} SELECT window_idx, {s6('score')} FROM scored")
def score_jitter(spark, d):
    return scoring.composite_score(_pool(spark, d), 1).select("window_idx", *r6("score"))


@query(f"WITH {PLAIN}, {O.REGIONS} SELECT window_idx, region_id FROM reg")
def sound_regions(spark, d):
    return _segmented(spark, d).select("window_idx", "region_id")


@query(f"WITH {PLAIN}, {O.REGIONS} SELECT rec AS recording_id, count(DISTINCT region_id) AS regions FROM reg GROUP BY rec")
def region_count(spark, d):
    return regions.count_regions(_segmented(spark, d)).select("recording_id", "regions")


@query(f"WITH {PLAIN}, {O.REGIONS} SELECT rec AS recording_id, region_id, window_idx, start_seconds, {s6('score')}, region_window_count FROM reps")
def region_representatives(spark, d):
    return regions.representatives(_segmented(spark, d)).select("recording_id", "region_id", "window_idx", "start_seconds", *r6("score"), "region_window_count")


SHORT_COLUMNS = "rec AS recording_id, pick, region_id, window_idx, start_seconds, round(score, 6) AS score, region_window_count"


def _short(spark, d) -> DataFrame:
    return analysis.shortlisted(T.windows(spark, d), _features(spark, d), DIM)


@query(f"WITH RECURSIVE {PLAIN}, {O.REGIONS}, {O.greedy(25)} SELECT {SHORT_COLUMNS} FROM short")
def shortlist_25(spark, d):
    return _short(spark, d).select("recording_id", "pick", "region_id", "window_idx", "start_seconds", *r6("score"), "region_window_count")


@query(f"WITH RECURSIVE {JITTERED}, {O.REGIONS}, prior AS (SELECT rec, window_idx, embedding FROM reps WHERE region_id % 9 = 0), {O.greedy(25, 'prior')} SELECT {SHORT_COLUMNS} FROM short")
def shortlist_prior_history(spark, d):
    reps = regions.representatives(_segmented(spark, d, 1))
    return selection.shortlist(reps, DEFAULT.shortlist, reps.filter("region_id % 9 = 0")).select("recording_id", "pick", "region_id", "window_idx", "start_seconds", *r6("score"), "region_window_count")


@query(f"""WITH RECURSIVE {PLAIN}, {O.REGIONS}, reps2 AS (SELECT 'all' AS rec, window_idx AS region_id, window_idx, start_seconds + 256.0::DOUBLE * (window_idx // 128) AS start_seconds, embedding, score, region_window_count FROM reps),
{O.greedy(25, None, "2")} SELECT pick, window_idx, start_seconds, round(score, 6) AS score, region_window_count FROM short2""")
def shortlist_as_one_recording(spark, d):
    """The representatives of all recordings as one long recording's, picked in rounds from those of the highest score."""
    reps = regions.representatives(_segmented(spark, d))
    one = reps.select(F.lit("all").alias("recording_id"), F.col("window_idx").alias("region_id"), "window_idx", (F.col("start_seconds") + 256.0 * F.floor(F.col("window_idx") / 128)).alias("start_seconds"), "score", "embedding", "region_window_count")
    return selection.shortlist_of_many(one, DEFAULT.shortlist, first=64).select("pick", "window_idx", "start_seconds", *r6("score"), "region_window_count")


@query(f"WITH RECURSIVE {PLAIN}, {O.REGIONS}, {O.greedy(25)}, ok AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY start_seconds) AS n FROM short WHERE window_idx % 7 <> 3) SELECT rec AS recording_id, n::INTEGER AS candidate_id, window_idx, start_seconds, {s6('score')} FROM ok WHERE n <= 10")
def final_10(spark, d):
    short = _short(spark, d)
    failed = T.windows(spark, d).filter("window_idx % 7 = 3")
    return selection.final(short, failed).select("recording_id", "candidate_id", "window_idx", "start_seconds", *r6("score"))


@query(f"WITH RECURSIVE {PLAIN}, {O.REGIONS}, {O.greedy(25)}, ok AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY pick) AS n FROM short WHERE window_idx % 7 <> 3) SELECT rec AS recording_id, row_number() OVER (PARTITION BY rec ORDER BY start_seconds)::INTEGER AS candidate_id, window_idx, pick FROM ok WHERE n <= 10")
def final_10_best_first(spark, d):
    return selection.final(_short(spark, d), T.windows(spark, d).filter("window_idx % 7 = 3"), order="score").select("recording_id", "candidate_id", "window_idx", "pick")


@query(f"""WITH RECURSIVE {PLAIN}, {O.REGIONS}, {O.greedy(25)},
a AS (SELECT rec, count(*) AS total_windows_analyzed, count(*) FILTER (has_speech) AS excluded_speech_windows FROM w GROUP BY rec),
b AS (SELECT rec, count(*) AS pool_size, count(DISTINCT region_id) AS region_count FROM reg GROUP BY rec),
t AS (SELECT *, window_idx % 7 = 3 AS bad, coalesce(sum(CASE WHEN window_idx % 7 <> 3 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY start_seconds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM short),
c AS (SELECT rec, count(*) AS shortlist_size, least(10, count(*) FILTER (NOT bad)) AS final_count, count(*) FILTER (bad AND passed < 10) AS excluded_speech_in_clip FROM t GROUP BY rec)
SELECT rec AS recording_id, total_windows_analyzed, excluded_speech_windows, coalesce(pool_size, 0) AS pool_size, coalesce(region_count, 0) AS region_count, coalesce(shortlist_size, 0) AS shortlist_size, coalesce(final_count, 0) AS final_count, coalesce(excluded_speech_in_clip, 0) AS excluded_speech_in_clip FROM a LEFT JOIN b USING (rec) LEFT JOIN c USING (rec)""")
def run_counters(spark, d):
    """The ranked pool is made once; regions, shortlist and final candidates are read from it."""
    windows, failed = T.windows(spark, d), T.windows(spark, d).filter("window_idx % 7 = 3")
    pool = analysis.kept(_segmented(spark, d))
    short = analysis.kept(selection.shortlist(regions.representatives(pool), DEFAULT.shortlist))
    return analysis.counters(windows, pool, short, selection.final(short, failed), selection.excluded_in_clips(short, failed))


@query(f"WITH {O.WINDOWS}, p AS (SELECT *, lag(embedding) OVER (PARTITION BY rec ORDER BY window_idx) AS pe FROM w) SELECT window_idx, round({O.cos('pe', 'embedding')}, 6) AS similarity FROM p WHERE pe IS NOT NULL")
def adjacent_similarity(spark, d):
    rows = T.windows(spark, d).withColumn("p", F.lag("embedding").over(Window.partitionBy("recording_id").orderBy("window_idx")))
    return rows.filter("p is not null").select("window_idx", F.round(cosine(F.col("p"), F.col("embedding")), 6).alias("similarity"))


FINAL = "SELECT rec, n AS candidate_id, window_idx, start_seconds, score, embedding FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY start_seconds) AS n FROM short{0} WHERE window_idx % 7 <> 3) WHERE n <= 10"


@query(f"""WITH RECURSIVE {PLAIN}, {O.REGIONS}, {O.greedy(25)}, final AS ({FINAL.format("")}),
{O.score(*O.jitter(1, T.WINDOWS), "2")}, {O.regions("2")}, {O.greedy(25, "final", "2")}, final2 AS ({FINAL.format("2")})
SELECT rec AS recording_id, candidate_id::INTEGER AS candidate_id, window_idx, {s6('score')}, (SELECT count(*) FROM (SELECT rec, window_idx FROM final UNION SELECT rec, window_idx FROM final2) u WHERE u.rec = final2.rec) AS shown FROM final2""")
def rerank_with_history(spark, d):
    """Two analyses of the same windows: the second, with a seed, knows what the first has shown."""
    windows, features = analysis.kept(T.windows(spark, d)), analysis.kept(_features(spark, d))
    failed = windows.filter("window_idx % 7 = 3")
    first, history = analysis.rerank(windows, features, DIM, failed)
    second, history = analysis.rerank(windows, features, DIM, failed, analysis.kept(history), 1)
    n = history.groupBy("recording_id").agg(F.count(F.lit(1)).alias("shown"))
    return second.join(n, "recording_id").select("recording_id", "candidate_id", "window_idx", *r6("score"), "shown")


@query(f"WITH RECURSIVE {PLAIN}, {O.REGIONS}, {O.greedy(25)}, final AS ({FINAL.format('')}), n AS (SELECT r.rec, count(f.rec) AS n FROM (SELECT DISTINCT rec FROM w) r LEFT JOIN final f ON f.rec = r.rec GROUP BY r.rec) SELECT rec AS recording_id, n, CASE WHEN n = 0 THEN 'none' WHEN n < 10 THEN 'fewer' ELSE 'all' END AS status FROM n")
def result_status(spark, d):
    windows = T.windows(spark, d)
    final = selection.final(_short(spark, d), windows.filter("window_idx % 7 = 3")).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"))
    rows = windows.select("recording_id").distinct().join(final, "recording_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return rows.select("recording_id", "n", scalars.result_status(F.col("n"), DEFAULT.max_candidates).alias("status"))


@query(f"WITH RECURSIVE {PLAIN}, {O.REGIONS}, {O.greedy(25)}, final AS ({FINAL.format('')}), kept AS (SELECT DISTINCT 'rec' || (user_id % 8) AS rec, 1 + event_id % 10 AS candidate_id FROM events WHERE event_type = 'signup' AND user_id % 3 = 0 AND event_id % 7 = 0) SELECT rec AS run_id, candidate_id::INTEGER AS candidate_id, start_seconds, {s6('score')} FROM final ANTI JOIN kept USING (rec, candidate_id)")
def surfaced_undecided(spark, d):
    """What the log of analyses has surfaced and no decision kept: candidates are numbered by their place in the logged list."""
    windows = T.windows(spark, d)
    failed, pool = windows.filter("window_idx % 7 = 3"), analysis.kept(_segmented(spark, d))
    short = analysis.kept(selection.shortlist(regions.representatives(pool), DEFAULT.shortlist))
    final = selection.final(short, failed)
    counted = analysis.counters(windows, pool, short, final)
    entries = logs.analysis_entries(counted, selection.excluded_in_clips(short, failed), final, pool, F.col("recording_id"), 1, None, 0.0, "Table")
    folder = f"{analysis.log_folder(spark)}/analyses"
    logs.append(entries, folder, "analysis")
    kept = T.read(spark, d, "events").filter("event_type = 'signup' and user_id % 3 = 0 and event_id % 7 = 0").select(F.concat(F.lit("rec"), (F.col("user_id") % 8).cast("string")).alias("run_id"), (1 + F.col("event_id") % 10).cast("int").alias("candidate_id"))
    return logs.surfaced(logs.read(spark, folder, "analysis")).join(kept, ["run_id", "candidate_id"], "left_anti").select("run_id", "candidate_id", "start_seconds", *r6("score"))


WAVES = """grid AS (SELECT rec, CASE WHEN count(*) <= 400 THEN 1 ELSE ceil((count(*) - 400) / 200.0)::BIGINT + 1 END AS n FROM sig GROUP BY rec), each AS (SELECT rec, unnest(range(0, n)) AS window_idx FROM grid),
place AS (SELECT rec, window_idx, unnest(range(0, 400)) AS n FROM each),
smp AS (SELECT place.rec || ':' || window_idx AS vec_id, n, coalesce(v, 0) AS x FROM place LEFT JOIN sig ON sig.rec = place.rec AND sig.i = window_idx * 200 + n)"""


@query(f"""WITH {O.SIGNAL}, {O.features(400, 100, WAVES)}, sp AS (SELECT vec_id, max(x) FILTER (n IN (0, 5)) >= 95 AS has_speech FROM smp GROUP BY vec_id)
SELECT split_part(window_idx, ':', 1) AS recording_id, split_part(window_idx, ':', 2)::BIGINT AS window_idx, 2.0::DOUBLE * split_part(window_idx, ':', 2)::BIGINT AS start_seconds, has_speech, {s6('layering', 'crest', 'flux')} FROM feats JOIN sp ON sp.vec_id = feats.window_idx""")
def analysis_windows(spark, d):
    """From samples to rows of windows; the model's stand-in scores two samples."""

    def model(windows: DataFrame) -> DataFrame:
        return windows.select("recording_id", "window_idx", F.array(F.get("samples", F.lit(0)) * 0.15 / 95, F.get("samples", F.lit(5)) * 0.15 / 95).alias("scores"), F.slice("samples", 1, 8).alias("embedding"))

    rows = analysis.analyse(T.signal(spark, d), model, [0, 1], RATE)
    return rows.select("recording_id", "window_idx", "start_seconds", "has_speech", F.round("layering_raw", 6).alias("layering"), F.round("distinctiveness_raw", 6).alias("crest"), F.round("temporal_interest_raw", 6).alias("flux"))


@query("SELECT 'rec' || (vec_id // 128) AS recording_id, 2.0::DOUBLE * (vec_id % 128) AS start_seconds FROM embeddings WHERE vec_id % 2 = 0")
def spaced_starts(spark, d):
    """Starts more than three seconds after the last one kept."""
    return spacing.spaced(T.windows(spark, d).select("recording_id", "start_seconds"), 3.0)


@query("""WITH RECURSIVE s AS (SELECT DISTINCT 'rec' || (event_id // 25600) AS rec, event_id % 25600 / 100.0::DOUBLE + value / 1000 AS t FROM events), f AS (SELECT rec, min(t) AS t FROM s GROUP BY rec),
n AS MATERIALIZED (SELECT a.rec, a.t, b.t AS next FROM s a ASOF JOIN s b ON a.rec = b.rec AND a.t + 0.37::DOUBLE < b.t), k AS (SELECT rec, t FROM f UNION ALL SELECT k.rec, n.next FROM k JOIN n ON n.rec = k.rec AND n.t = k.t)
SELECT rec AS recording_id, round(t, 6) AS start_seconds FROM k""")
def spaced_events(spark, d):
    """Events at irregular times: those at more than 0.37 seconds after the last one kept."""
    rows = T.signal(spark, d).select("recording_id", (F.col("sample_idx") / 100 + F.col("value") / 1000).alias("start_seconds"))
    return spacing.spaced(rows, 0.37).select("recording_id", *r6("start_seconds"))


@query("SELECT 'rec' || (event_id // 25600) AS recording_id, event_id % 25600 // 2 AS sample_idx, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def downmixed_signal(spark, d):
    """Two channels, one sample each in turn."""
    two = T.signal(spark, d).select("recording_id", (F.col("sample_idx") % 2).alias("channel"), F.floor(F.col("sample_idx") / 2).alias("sample_idx"), "value")
    return framing.downmix(two).select("recording_id", "sample_idx", *r6("value"))


# Clips


def _candidates(spark, d) -> DataFrame:
    length = clipping.durations(T.signal(spark, d), RATE)
    return scoring.eligible(T.windows(spark, d)).join(length, "recording_id").filter(F.col("start_seconds") < F.col("duration")).select("recording_id", "window_idx", "start_seconds")


def _clips(spark, d) -> DataFrame:
    return clipping.clip_bounds(clipping.event_spans(_candidates(spark, d), T.signal(spark, d), RATE))


@query(f"WITH {O.WINDOWS}, {O.SIGNAL}, {O.SPANS} SELECT window_idx, {s6('span_start', 'span_end')} FROM spans")
def event_span(spark, d):
    return clipping.event_spans(_candidates(spark, d), T.signal(spark, d), RATE).select("window_idx", *r6("span_start", "span_end"))


@query(f"WITH {O.WINDOWS}, {O.SIGNAL}, {O.BOUNDS} SELECT window_idx, {s6('clip_start', 'clip_end')} FROM clips")
def clip_bounds(spark, d):
    return _clips(spark, d).select("window_idx", *r6("clip_start", "clip_end"))


@query(f"WITH {O.WINDOWS}, {O.SIGNAL}, {O.BOUNDS} SELECT window_idx, count(*) AS n_samples, round(sum(v), 6) AS total FROM clips JOIN sig ON clips.rec = sig.rec AND i >= round_even(clip_start * 100, 0) AND i < round_even(clip_end * 100, 0) GROUP BY window_idx")
def clip_samples(spark, d):
    return clipping.clip_samples(_clips(spark, d), T.signal(spark, d), RATE).groupBy("window_idx").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.sum("value"), 6).alias("total"))


def _sub_scores(spark, d):
    """A stand-in for the model: the share of a sub-window's samples above 95."""

    def score(subs: DataFrame) -> DataFrame:
        ranges = subs.withColumn("lo", F.bround(F.col("sub_start") * RATE).cast("long")).withColumn("hi", F.bround(F.col("sub_end") * RATE).cast("long"))
        hit = clipping.range_join(ranges, T.signal(spark, d), 8 * RATE)
        return hit.groupBy("recording_id", "window_idx", "sub_idx").agg(F.avg(F.when(F.col("value") > 95, 1.0).otherwise(0.0)).alias("speech_score"))

    return score


@query(f"WITH {O.WINDOWS}, {O.SIGNAL}, {O.BOUNDS}, {O.RECHECK} SELECT window_idx FROM refused")
def clip_speech_recheck(spark, d):
    return clipping.clips_with_speech(_sub_scores(spark, d)(clipping.check_windows(_clips(spark, d)))).select("window_idx")


@query(f"""WITH RECURSIVE {O.scored([0.2] * 5, pool=f"{O.INSIDE}, {O.POOLED}")}, {O.REGIONS}, {O.greedy(25)}, {O.BOUNDS}, {O.RECHECK},
ok AS (SELECT short.*, row_number() OVER (PARTITION BY rec ORDER BY start_seconds) AS n FROM short WHERE window_idx NOT IN (SELECT window_idx FROM refused))
SELECT ok.rec AS recording_id, n::INTEGER AS candidate_id, window_idx, ok.start_seconds, {s6('clip_start', 'clip_end')} FROM ok JOIN clips USING (window_idx) WHERE n <= 10""")
def verified_candidates(spark, d):
    length = clipping.durations(T.signal(spark, d), RATE)
    inside = T.windows(spark, d).join(length, "recording_id").filter(F.col("start_seconds") + 4 <= F.col("duration")).drop("duration")
    short = analysis.kept(analysis.shortlisted(inside, _features(spark, d), DIM))
    out = analysis.verified(short, T.signal(spark, d), _sub_scores(spark, d), RATE)
    return out.select("recording_id", "candidate_id", "window_idx", "start_seconds", *r6("clip_start", "clip_end"))

# WAV files


def _as_wav(spark, d) -> str:
    """The signal as WAV files in the shared folder, one a recording, written in blocks of 4,096 samples. Values are scaled by 1/1024."""
    folder, at = f"{analysis.log_folder(spark)}/wav", F.floor(F.col("sample_idx") / 4096)
    blocks = T.signal(spark, d).groupBy(F.col("recording_id").alias("name"), (at * 4096).alias("first_sample")).agg(F.array_sort(F.collect_list(F.struct("sample_idx", F.col("value") / 1024))).alias("s"))
    wav.write(blocks.select("name", "first_sample", F.transform("s", lambda x: x["col2"]).alias("samples")), folder, RATE)
    return folder


def _read_once(df: DataFrame, folder: str) -> DataFrame:
    """`df`, which reads files under `folder`, made at once; the files go."""
    out = analysis.kept(df)
    analysis.remove(df.sparkSession, folder)
    return out


PCM = "round_even(least(greatest(value / 1024, -1), 1 - pow(2, -15)) * 32768, 0) / 32768"


@query(f"SELECT 'rec' || (event_id // 25600) AS recording_id, event_id % 25600 AS sample_idx, round({PCM}, 6) AS value FROM events")
def wav_samples(spark, d):
    """Written as WAV files by the sink and read back by the source, in ranges of 16 KB."""
    folder = _as_wav(spark, d)
    return _read_once(wav.signal(spark, folder, id="stem", splitBytes=1 << 14).select("recording_id", "sample_idx", *r6("value")), folder)


@query(f"SELECT 'rec' || (event_id // 25600) AS recording_id, event_id % 25600 AS sample_idx, round({PCM}, 6) AS value FROM events WHERE event_id % 25600 BETWEEN 250 AND 899")
def wav_region_scan(spark, d):
    """A stretch of every recording; the bounds reach the files."""
    folder = _as_wav(spark, d)
    return _read_once(wav.signal(spark, folder, id="stem").filter(F.col("sample_idx").between(250, 899)).select("recording_id", "sample_idx", *r6("value")), folder)


@query("SELECT 'rec' || (event_id // 25600) AS recording_id, 100::INTEGER AS rate, 1::INTEGER AS channels, count(*) AS n_frames, count(*) / 100.0::DOUBLE AS duration_seconds FROM events GROUP BY event_id // 25600")
def wav_recordings(spark, d):
    """What the headers say."""
    folder = _as_wav(spark, d)
    return _read_once(wav.recordings(spark, folder, id="stem").select("recording_id", "rate", "channels", "n_frames", "duration_seconds"), folder)


@query(f"""WITH {O.WINDOWS}, {O.SIGNAL}, {O.BOUNDS}, c AS (SELECT window_idx, {PCM.replace('value', 'v')} AS v FROM clips JOIN sig ON clips.rec = sig.rec AND i >= round_even(clip_start * 100, 0) AND i < round_even(clip_end * 100, 0))
SELECT window_idx, count(*) AS n_frames, round(sum(v), 6) AS total FROM c GROUP BY window_idx""")
def wav_clips(spark, d):
    """Each candidate's clip as a WAV file of its own, read back."""
    folder = f"{analysis.log_folder(spark)}/clips"
    rows = clipping.clip_samples(_clips(spark, d), T.signal(spark, d), RATE).groupBy("window_idx").agg(F.array_sort(F.collect_list(F.struct("sample_idx", F.col("value") / 1024))).alias("s"))
    wav.write(rows.select(F.format_string("clip_%d.wav", "window_idx").alias("name"), F.transform("s", lambda x: x["col2"]).alias("samples")), folder, RATE)
    back = wav.signal(spark, folder, id="stem").groupBy(F.regexp_extract("recording_id", r"\d+", 0).cast("long").alias("window_idx"))
    return _read_once(back.agg(F.count(F.lit(1)).alias("n_frames"), F.round(F.sum("value"), 6).alias("total")), folder)


# 100 Hz to 80 Hz: four outputs to five inputs, each the weighted sum of the inputs less than 20 away.
RESAMPLED = """n AS (SELECT rec, max(i) + 1 AS n FROM sig GROUP BY rec), o AS (SELECT rec, unnest(range(0, ceil(n * 4 / 5.0)::BIGINT)) AS o FROM n),
taps AS (SELECT p, k, 0.8 * CASE WHEN t = 0 THEN 1 ELSE sin(pi() * 0.8 * t) / (pi() * 0.8 * t) END * CASE WHEN abs(0.8 * t) < 16 THEN 0.5 + 0.5 * cos(pi() * 0.8 * t / 16) ELSE 0 END AS h
  FROM (SELECT p, k, k - p / 4.0::DOUBLE AS t FROM range(0, 4) a(p), range(-19, 21) b(k))),
unit AS (SELECT p, k, h / sum(h) OVER (PARTITION BY p) AS h FROM taps),
need AS MATERIALIZED (SELECT rec, o, o * 5 // 4 + k AS i, h FROM o JOIN unit ON p = o * 5 % 4)"""


@query(f"WITH {O.SIGNAL}, {RESAMPLED} SELECT rec AS recording_id, o AS sample_idx, round(sum(h * v), 6) AS value FROM need JOIN sig USING (rec, i) GROUP BY ALL")
def resampled_signal(spark, d):
    return resampling.resample(T.signal(spark, d), 4, 5, block=4096).select("recording_id", "sample_idx", *r6("value"))


# Scalars


@query("WITH t AS (SELECT doc_id, round_even(n_chars / 2.0, 0)::BIGINT AS s FROM documents) SELECT doc_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS stamp FROM t")
def format_timestamp(spark, d):
    return T.read(spark, d, "documents").select("doc_id", scalars.format_timestamp(F.col("n_chars") / 2.0).alias("stamp"))


@query("SELECT doc_id, printf('candidate_%02d_%02dm%02ds.wav', doc_id % 25, floor(n_chars / 2.0)::BIGINT // 60, floor(n_chars / 2.0)::BIGINT % 60) AS name FROM documents")
def download_names(spark, d):
    return T.read(spark, d, "documents").select("doc_id", scalars.download_name(F.col("doc_id") % 25, F.col("n_chars") / 2.0).alias("name"))


@query("SELECT p_partkey, round(pow(10, (p_size - 25) / 20.0), 6) AS gain, round(pow(2, (p_size - 25) / 12.0), 6) AS ratio FROM part")
def gain_and_pitch(spark, d):
    x = F.col("p_size") - 25
    return T.read(spark, d, "part").select("p_partkey", F.round(scalars.gain(x), 6).alias("gain"), F.round(scalars.semitones(x), 6).alias("ratio"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN e - s < 0.2 THEN least(c, s + 0.2) ELSE e END, 6) AS trim_end FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 AS s, l_discount * 10 + l_tax AS e, 1.0 AS c FROM lineitem)")
def trim_floor(spark, d):
    s = F.col("l_discount") * 10
    return T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(scalars.trim_floor(s, s + F.col("l_tax"), F.lit(1.0)), 6).alias("trim_end"))


@query("SELECT l_orderkey, '[Sound ' || string_agg(l_linenumber::VARCHAR, '] → [Sound ' ORDER BY l_linenumber) || ']' AS label FROM lineitem GROUP BY l_orderkey")
def order_labels(spark, d):
    return T.read(spark, d, "lineitem").groupBy("l_orderkey").agg(scalars.order_label(F.array_sort(F.collect_list("l_linenumber"))).alias("label"))


# Timeline


ITEMS_SQL = "items AS (SELECT l_orderkey AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p, l_quantity / 10 AS d, l_returnflag = 'R' AS x FROM lineitem)"


def _items(spark, d) -> DataFrame:
    return T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long").alias("position"), (F.col("l_quantity") / 10).alias("duration"), (F.col("l_returnflag") == "R").alias("crossfade_into_next"))


@query(f"""WITH {ITEMS_SQL}, l AS (SELECT *, lag(d) OVER k AS pd, lag(x) OVER k AS px FROM items WINDOW k AS (PARTITION BY run ORDER BY p)),
f AS (SELECT *, CASE WHEN px AND least(0.4, pd * 0.9, d * 0.9) > 0.05 THEN least(0.4, pd * 0.9, d * 0.9) ELSE 0 END AS fade FROM l)
SELECT run AS run_id, p AS position, round(fade, 6) AS fade, round(coalesce(sum(d) OVER (PARTITION BY run ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - sum(fade) OVER (PARTITION BY run ORDER BY p ROWS UNBOUNDED PRECEDING), 6) AS start FROM f""")
def composition_timeline(spark, d):
    return timeline.timeline(_items(spark, d)).select("run_id", "position", *r6("fade", "start"))


#: The whole signal in runs of 900 samples, the first 400 of each as one stream and the others as the next.
HALVES = "a AS (SELECT event_id // 900 AS run, event_id % 900 AS i, value AS v FROM events WHERE event_id % 900 < 400), b AS (SELECT event_id // 900 AS run, event_id % 900 - 400 AS i, value AS v FROM events WHERE event_id % 900 >= 400)"


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    s = T.signal(spark, d, 900)
    return s.filter("sample_idx < 400"), s.filter("sample_idx >= 400").withColumn("sample_idx", F.col("sample_idx") - 400)


@query(f"""WITH {HALVES}, u AS (SELECT run, i, v * CASE WHEN i >= 360 THEN 1 - (i - 360) / 40.0 ELSE 1 END AS v FROM a UNION ALL SELECT run, i + 360, v * CASE WHEN i < 40 THEN i / 40.0 ELSE 1 END FROM b)
SELECT 'rec' || run AS recording_id, i AS sample_idx, round(sum(v), 6) AS value FROM u GROUP BY ALL""")
def crossfade_mix(spark, d):
    return timeline.crossfade(*_halves(spark, d), 400, 40).select("recording_id", "sample_idx", *r6("value"))


@query(f"""WITH {HALVES} SELECT 'rec' || run AS recording_id, i AS sample_idx, round(v * CASE WHEN i >= 398 THEN 1 - (i - 398) / 2.0 ELSE 1 END, 6) AS value FROM a
UNION ALL SELECT 'rec' || run, i + 400, round(v * CASE WHEN i < 2 THEN i / 2.0 ELSE 1 END, 6) FROM b""")
def declick_concat(spark, d):
    return timeline.declick_concat(*_halves(spark, d), 400, 2).select("recording_id", "sample_idx", *r6("value"))


# The mix as a list that grows clip by clip; its levels are taken anew each time.
def _levels(x: str) -> str:
    return f"list_transform(range(0, len({x}) // 5), lambda f: sqrt(list_avg(list_transform({x}[f * 5 + 1:f * 5 + 5], lambda y: y * y)) + 1e-12))"


def _active(x: str) -> str:
    return f"list_filter(range(1, len({x}) + 1), lambda f: {x}[f] > list_aggregate({x}, 'quantile_cont', 0.2) * 1.6::DOUBLE)"


COMPOSED = f"""s AS (SELECT event_id // 1000 AS run, event_id % 1000 // 100 AS p, event_id % 100 AS i, value AS x FROM events),
c AS (SELECT run, p, list(CASE WHEN p % 3 = 1 AND i >= 35 OR p % 4 = 2 AND i < 65 THEN 0.001 ELSE x END ORDER BY i) AS xs FROM s GROUP BY run, p),
o AS (SELECT *, {_levels('xs')} AS lv FROM c), n AS (SELECT run, p, xs, coalesce((list_min({_active('lv')}) - 1) * 0.05::DOUBLE, 0) AS onset FROM o),
m AS (SELECT run, p, xs, onset FROM n WHERE p = 0),
r AS (SELECT run, 0::BIGINT AS p, xs AS mix, len(xs) / 100.0::DOUBLE AS length FROM m
  UNION ALL SELECT run, p, CASE WHEN f > 0.05 THEN list_concat(list_concat(mix[1:len(mix) - k], list_transform(range(1, k + 1), lambda i: mix[len(mix) - k + i] * (1 - (i - 1) / k::DOUBLE) + xs[i] * ((i - 1) / k::DOUBLE))), xs[k + 1:])
      ELSE list_concat(list_concat(mix[1:len(mix) - k], list_transform(range(1, k + 1), lambda i: mix[len(mix) - k + i] * (1 - (i - 1) / k::DOUBLE))), list_concat(list_transform(range(1, k + 1), lambda i: xs[i] * ((i - 1) / k::DOUBLE)), xs[k + 1:])) END, length + own - CASE WHEN f > 0.05 THEN f ELSE 0 END
  FROM (SELECT *, least(CASE WHEN f > 0.05 THEN round_even(f * 100, 0) WHEN least(0.01, length * 0.2, own * 0.2) > 0.002 THEN round_even(least(0.01, length * 0.2, own * 0.2) * 100, 0) ELSE 0 END, len(mix), len(xs))::BIGINT AS k
    FROM (SELECT run, p, mix, length, xs, own, CASE WHEN p % 2 = 1 THEN least(0.4, length * 0.9, own * 0.9) ELSE 0 END AS f
      FROM (SELECT run, p, CASE WHEN quiet > 0.5 THEN mix[1:round_even(greatest(0.05, length - quiet + 0.15) * 100, 0)::BIGINT] ELSE mix END AS mix, CASE WHEN quiet > 0.5 THEN greatest(0.05, length - quiet + 0.15) ELSE length END AS length,
          CASE WHEN onset > 0.5 THEN xs[round_even((onset - 0.15) * 100, 0)::BIGINT + 1:] ELSE xs END AS xs, len(xs) / 100.0::DOUBLE - CASE WHEN onset > 0.5 THEN onset - 0.15 ELSE 0 END AS own
        FROM (SELECT *, coalesce(greatest(0, len(mix) / 100.0::DOUBLE - list_max({_active('lv')}) * 0.05::DOUBLE), 0) AS quiet
          FROM (SELECT r.run, n.p, r.mix, r.length, n.xs, n.onset, {_levels('r.mix')} AS lv FROM r JOIN n ON n.run = r.run AND n.p = r.p + 1)))))),
z AS (SELECT run, mix, length FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY p DESC) = 1)"""


@query(f"WITH RECURSIVE {COMPOSED} SELECT 'rec' || run AS run_id, round(length, 6) AS duration, len(mix)::BIGINT AS n_samples, round(list_sum(mix), 4) AS total, round(list_sum(list_transform(range(1, len(mix) + 1), lambda i: mix[i] * i)) / len(mix), 4) AS centre FROM z")
def composition_render(spark, d):
    """The whole signal in runs of ten clips; some end in silence and some begin with it, so that joins cut."""
    i = F.col("sample_idx") % 100
    s = T.signal(spark, d, 1000).select(F.col("recording_id").alias("run_id"), F.floor(F.col("sample_idx") / 100).alias("position"), i.alias("sample_idx"), "value")
    still = ((F.col("position") % 3 == 1) & (F.col("sample_idx") >= 35)) | ((F.col("position") % 4 == 2) & (F.col("sample_idx") < 65))
    s = s.withColumn("value", F.when(still, 0.001).otherwise(F.col("value")))
    items = s.select("run_id", "position").distinct().withColumn("crossfade_into_next", F.col("position") % 2 == 0)
    joins = composing.plan(items, s, RATE)
    totals = composing.render(joins, s).groupBy("run_id").agg(F.sum("value").alias("total"), F.sum(F.col("value") * (F.col("sample_idx") + 1)).alias("moment"))
    out = composing.lengths(joins).join(totals, "run_id")
    return out.select("run_id", F.round("duration", 6).alias("duration"), "n_samples", F.round("total", 4).alias("total"), F.round(F.col("moment") / F.col("n_samples"), 4).alias("centre"))


@query("WITH i AS (SELECT l_orderkey AS run_id, l_linenumber AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS c FROM lineitem) SELECT run_id, CASE WHEN c = 2 AND max(c) OVER (PARTITION BY run_id) > 2 THEN 3 WHEN c = 3 THEN 2 ELSE c END AS position, c AS candidate_id FROM i")
def move_down(spark, d):
    rows = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).cast("long").alias("position"))
    return timeline.swap_neighbours(rows.withColumn("candidate_id", F.col("position")), 2, True).select("run_id", "position", "candidate_id")


@query("""WITH g(lo, hi, fade, depth) AS (VALUES (100, 200, 20, 0.1), (150, 260, 30, 0.25)), s AS (SELECT event_id // 1000 AS rec, event_id % 1000 AS i, value AS v FROM events),
f AS (SELECT i AS p, product(CASE WHEN i - lo < fade THEN 1 - (i - lo) * (1 - depth) / (fade - 1)
WHEN i - lo >= hi - lo - fade THEN depth + (i - lo - (hi - lo - fade)) * (1 - depth) / (fade - 1) ELSE depth END) AS m FROM range(0, 1000) q(i) JOIN g ON i >= lo AND i < hi GROUP BY i)
SELECT 'rec' || rec AS recording_id, i AS sample_idx, round(v * coalesce(m, 1), 6) AS value FROM s LEFT JOIN f ON i = p""")
def gating_envelope(spark, d):
    """The signal in recordings of 1,000 samples, each with the same two gates."""
    s = T.signal(spark, d, 1000)
    two = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("lo", "hi", "fade", "depth"), g))) for g in ((100, 200, 20, 0.1), (150, 260, 30, 0.25))))
    gates = s.select("recording_id").distinct().select("recording_id", F.explode(two).alias("g")).select("recording_id", *(F.col(f"g.{n}").cast("long").alias(n) for n in ("lo", "hi", "fade")), "g.depth")
    return effects.apply_gates(s, gates, 800).select("recording_id", "sample_idx", *r6("value"))


REPLAYED = """l AS (SELECT l_orderkey AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, count(*) OVER (PARTITION BY l_orderkey) AS of, l_quantity / 10 AS d, l_discount * 10 AS a, l_discount * 10 + l_tax AS b, l_returnflag = 'R' AS gone, l_linestatus = 'O' AS x, l_partkey % 1000 / 10.0::DOUBLE AS o FROM lineitem),
m AS (SELECT *, CASE WHEN n = 1 AND of > 1 THEN 2 WHEN n = 2 THEN 1 ELSE n END AS place FROM l)"""


#: Lines whose edits a task sorts in memory (about 100 MB), whatever the session's number of partitions.
LINES_A_TASK = 250_000


def _edits(spark, d) -> DataFrame:
    """The commands of each order's lines, all in one partition: lines are dealt by order and numbered once, and with what edits need alone."""
    zero, start, lies, duration = F.lit(0.0), F.col("l_discount") * 10, F.col("l_partkey") % 1000 / 10, (F.col("l_quantity") / 10).cast("double")

    def step(k: int, command: str, which: F.Column, a: F.Column = zero, b: F.Column = zero) -> F.Column:
        columns = (F.lit(100 * k) + F.col("n")).cast("int").alias("sequence"), F.lit(command).alias("command"), F.col("n").cast("int").alias("candidate_id"), a.cast("double").alias("a"), b.cast("double").alias("b"), duration.alias("duration")
        return F.when(which, F.struct(*columns))

    columns = "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"
    rows = T.read(spark, d, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // LINES_A_TASK))
    lines = rows.select(*columns, (F.col("l_returnflag") == "R").alias("returned"), (F.col("l_linestatus") == "O").alias("open")).repartition(tasks, "l_orderkey")
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    steps = F.array(step(0, "add", F.lit(True), lies, lies + duration), step(1, "trim", F.lit(True), start, start + F.col("l_tax")), step(2, "down", F.col("n") == 1), step(3, "remove", F.col("returned")), step(4, "crossfade", F.col("open"), F.lit(1.0)))
    return lines.select(F.col("l_orderkey").cast("string").alias("run_id"), F.explode(steps).alias("e")).filter("e IS NOT NULL").select("run_id", "e.*")


@query(f"""WITH {REPLAYED} SELECT run::VARCHAR AS run_id, CASE WHEN gone THEN 'removed' ELSE 'kept' END AS status, (row_number() OVER (PARTITION BY run, gone ORDER BY CASE WHEN gone THEN n ELSE place END) - 1)::INTEGER AS position, n::INTEGER AS candidate_id, round(a, 6) AS trim_start,
  round(CASE WHEN b - a < 0.2 THEN least(d, a + 0.2) ELSE b END, 6) AS trim_end, x AND NOT gone AS crossfade_into_next FROM m""")
def edit_replay(spark, d):
    """Each order's lines as an edit: all are added and trimmed, the first is moved down, returned ones are removed, open ones fade into the next."""
    return timeline.replay(_edits(spark, d), together=True).select("run_id", "status", "position", "candidate_id", *r6("trim_start", "trim_end"), "crossfade_into_next")


@query(f"""WITH {REPLAYED}, k AS (SELECT *, CASE WHEN b - a < 0.2 THEN least(d, a + 0.2) ELSE b END AS e, row_number() OVER (PARTITION BY run, gone ORDER BY place) - 1 AS p, count(*) FILTER (gone) OVER (PARTITION BY run) AS removed FROM m)
SELECT run::VARCHAR AS run_id, removed::INTEGER AS n_removed, p::INTEGER AS place, n::INTEGER AS candidate_id, round(o, 6) AS original_start, round(o + d, 6) AS original_end, round(a, 6) AS trim_start, round(e - a, 6) + 0.0 AS edited_duration, x AS crossfade_into_next FROM k WHERE NOT gone""")
def composition_log_items(spark, d):
    """Each order's edit as a composition in the log, read back: what is kept, from where in its recording, and how much of it."""
    folder = f"{analysis.log_folder(spark)}/compositions"
    logs.append(logs.composition_entries(_edits(spark, d), 0.0, together=True), folder, "composition")
    rows = logs.read(spark, folder, "composition").select("run_id", F.size("removed").alias("n_removed"), F.posexplode("items").alias("place", "i"))
    rows = rows.select("run_id", "n_removed", "place", "i.candidate_id", F.col("i.original_start_seconds").alias("original_start"), F.col("i.original_end_seconds").alias("original_end"), "i.trim_start", "i.edited_duration", "i.crossfade_into_next")
    return rows.select("run_id", "n_removed", "place", "candidate_id", *r6("original_start", "original_end", "trim_start"), (F.round("edited_duration", 6) + 0.0).alias("edited_duration"), "crossfade_into_next")


def _requests(spark, d) -> DataFrame:
    clips = T.read(spark, d, "part").select(F.concat(F.lit("clip_"), F.col("p_partkey").cast("string"), F.lit(".wav")).alias("basename"), (F.col("p_size") * 3200 + 96_000).cast("long").alias("n_samples"))
    return clips.withColumn("tone", F.explode(F.array(*map(F.lit, effects.TONES)))).withColumn("version", F.lit(1))


@query()
def tone_params(spark, d):
    rows = effects.parameters(_requests(spark, d))
    return rows.select("basename", "tone", "draw", "name", F.transform("values", lambda x: F.round(x, 6)).alias("values"))


BRANDS = [f"clip_Brand#{n}.wav" for n in range(1, 26)]


@query(f"""WITH {O.tone_draws(BRANDS)}, r AS (SELECT p_partkey, 'clip_' || p_brand || '.wav' AS basename, ({list(effects.TONES)!r})[p_partkey % {len(effects.TONES)} + 1] AS tone FROM part)
SELECT p_partkey, tone, k AS draw, name, j AS place, round(CASE kind WHEN 's' THEN value * (1 + (-spread + 2 * spread * us[d])) WHEN 'm' THEN value + (-spread + 2 * spread * us[d]) ELSE value END, 6) AS value FROM r JOIN spec USING (tone) JOIN draws USING (basename, tone)""")
def tone_params_by_brand(spark, d):
    """Each part as a clip of its brand in one tone, through the table function. The twin has the random numbers as values, and draws from them on its own."""
    recipes.register(spark)
    tones = F.array(*map(F.lit, effects.TONES))
    T.read(spark, d, "part").select("p_partkey", F.concat(F.lit("clip_"), "p_brand", F.lit(".wav")).alias("basename"), F.element_at(tones, (F.col("p_partkey") % len(effects.TONES) + 1).cast("int")).alias("tone"), F.lit(1).alias("version")).createOrReplaceTempView("tone_requests")
    rows = spark.sql("SELECT p_partkey, tone, draw, name, posexplode(values) AS (place, value) FROM tone_params(TABLE(tone_requests) PARTITION BY (basename, tone))")
    return rows.select("p_partkey", "tone", "draw", "name", "place", *r6("value"))


@query()
def effect_plan(spark, d):
    return effects.effect_plans(_requests(spark, d)).select("basename", "tone", "version", "graph", F.size("gates").alias("n_gates"))


# Logs

RUNS = "runs AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS analysis_number, ts AS at_ FROM events WHERE event_type = 'view')"
DECS = "decs AS (SELECT user_id AS run_id, 1 + event_id % 10 AS candidate_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'kept' ELSE 'discarded' END AS decision, ts AS decided_at, event_id FROM events WHERE event_type <> 'view')"
ASOF = f"{RUNS}, {DECS}, dec AS (SELECT d.*, r.analysis_number FROM decs d ASOF LEFT JOIN runs r ON d.run_id = r.run_id AND d.decided_at >= r.at_)"


def _asof(spark, d) -> DataFrame:
    return logs.as_of(T.decisions(spark, d), T.analysis_runs(spark, d), ["run_id"], "decided_at", "at", ["analysis_number"])


@query(f"WITH {ASOF} SELECT event_id, run_id, candidate_id, decision, analysis_number FROM dec")
def decision_asof_run(spark, d):
    return _asof(spark, d).select("event_id", "run_id", "candidate_id", "decision", "analysis_number")


@query(f"WITH {ASOF} SELECT run_id, analysis_number, candidate_id, arg_max(decision, event_id) AS decision, count(*) AS n_decisions FROM dec GROUP BY ALL")
def latest_decision(spark, d):
    return logs.latest_decisions(_asof(spark, d), ["run_id", "analysis_number", "candidate_id"], "event_id")


@query(f"WITH {DECS}, v AS (SELECT ts AS at_, user_id FROM events WHERE event_type = 'view' AND user_id % 2 = 0), u AS (SELECT at_, max(user_id) AS user_id, count(*) AS n FROM v GROUP BY at_) SELECT d.event_id, d.run_id, u.n AS starts, u.user_id AS started_by FROM decs d ASOF LEFT JOIN u ON d.decided_at >= u.at_")
def decision_asof_all(spark, d):
    """All decisions as one run: each with the last analysis that any user of an even number has started."""
    views = T.read(spark, d, "events").filter("event_type = 'view' AND user_id % 2 = 0").groupBy(F.col("ts").alias("at")).agg(F.max("user_id").alias("started_by"), F.count(F.lit(1)).alias("starts"))
    one = lambda df: df.withColumn("everyone", F.lit("all"))
    rows = logs.as_of_long_runs(one(T.decisions(spark, d)), one(views), ["everyone"], "decided_at", "at", ["started_by", "starts"])
    return rows.select("event_id", "run_id", "starts", "started_by")


@query(f"WITH {ASOF}, l AS (SELECT run_id, analysis_number, candidate_id, arg_max(decision, event_id) AS decision FROM dec GROUP BY ALL) SELECT run_id, count(*) AS candidates, count(*) FILTER (decision = 'kept') AS kept, count(*) FILTER (decision = 'discarded') AS discarded FROM l GROUP BY run_id")
def decision_funnel(spark, d):
    return logs.funnel(logs.latest_decisions(_asof(spark, d), ["run_id", "analysis_number", "candidate_id"], "event_id"))


@query(f"WITH {ASOF}, l AS (SELECT run_id, analysis_number, candidate_id, arg_max(decision, event_id) AS decision FROM dec GROUP BY ALL) SELECT run_id, analysis_number, c AS candidate_id FROM runs, range(1, 11) q(c) EXCEPT SELECT run_id, analysis_number, candidate_id FROM l WHERE decision = 'kept'")
def surfaced_minus_kept(spark, d):
    kept = logs.latest_decisions(_asof(spark, d), ["run_id", "analysis_number", "candidate_id"], "event_id").filter("decision = 'kept'")
    out = T.analysis_runs(spark, d).select("run_id", "analysis_number", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))).alias("candidate_id"))
    return out.subtract(kept.select("run_id", "analysis_number", "candidate_id"))


@query(f"WITH {DECS}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) - 1 AS k FROM decs) SELECT run_id::VARCHAR AS run_id, candidate_id::INTEGER AS candidate_id, arg_max(decision, k) AS decision, count(*) AS n_decisions FROM n GROUP BY run_id, candidate_id")
def decision_log_readback(spark, d):
    """Decisions appended to the log as JSON lines and read back by its schema: the last of each candidate."""
    rows = T.decisions(spark, d).withColumn("sequence", F.row_number().over(Window.partitionBy("run_id").orderBy("event_id")) - 1)
    folder = f"{analysis.log_folder(spark)}/decisions"
    logs.append(rows.withColumn("decided_at", F.unix_micros(F.col("decided_at").cast("timestamp")) / 1e6), folder, "decisions")
    return logs.latest_decisions(logs.read(spark, folder, "decisions"), ["run_id", "candidate_id"], "sequence")


@query("SELECT md5(l_orderkey || '|' || l_linenumber)[1:8] AS clip_id, l_orderkey, l_linenumber FROM lineitem")
def clip_ids(spark, d):
    return T.read(spark, d, "lineitem").select(scalars.short_id(F.col("l_orderkey"), F.col("l_linenumber")).alias("clip_id"), "l_orderkey", "l_linenumber")


@query("""WITH e AS (SELECT epoch_us(ts) AS u, value FROM events), w AS (SELECT (u // 2000000 - k) * 2 AS s, value FROM e, range(0, 2) q(k))
SELECT s::BIGINT AS start_epoch, count(*) AS n, round(sqrt(avg(value * value) + 1e-12), 6) AS rms FROM w GROUP BY s""")
def sliding_levels(spark, d):
    """The streaming form's windows, of a table."""
    return live.windowed_levels(T.read(spark, d, "events")).select(F.col("start").cast("long").alias("start_epoch"), "n", *r6("rms"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, '{\"event_id\":' || event_id || ',\"k\":' || json_extract(props, '$.k')::BIGINT || '}' AS line FROM events")
def log_json_roundtrip(spark, d):
    rows = T.read(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))
    return rows.withColumn("line", F.to_json(F.struct("event_id", "k")))


@query("SELECT user_id, count(*) AS n_starts FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events) WHERE g IS NULL OR g >= INTERVAL 30 MINUTE GROUP BY user_id")
def session_counts(spark, d):
    rows = T.read(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_starts"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY ALL")
def hourly_levels(spark, d):
    rows = T.read(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"))
    return rows.select(F.col("w.start").alias("hour"), "event_type", "n", "rms")
