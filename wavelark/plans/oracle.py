"""SQL blocks for DuckDB that the queries' twins are built from. Written on their own: no code is shared with the plans."""

from __future__ import annotations

import random

from ..operators.effects import TONES

WINDOWS = """w AS (SELECT e.vec_id AS window_idx, 'rec' || (e.vec_id // 128) AS rec, 2.0::DOUBLE * (e.vec_id % 128) AS start_seconds, e.label = 0 AS has_speech,
  list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE + e.embedding[i]::DOUBLE * 0.2::DOUBLE) AS embedding
  FROM embeddings e JOIN embeddings a ON a.vec_id = e.vec_id - e.vec_id % 16)"""
RAW = "smp AS (SELECT vec_id, i - 1 AS n, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i))"


def spectrum(n: int, samples: str = RAW) -> str:
    """Magnitudes of windows of n samples; `samples` names smp (vec_id, n, x)."""
    return f"""{samples},
hann AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * n / {n - 1})) AS xh FROM smp),
dft AS (SELECT vec_id, k, sqrt(pow(sum(xh * cos(2 * pi() * k * n / {n})), 2) + pow(sum(xh * sin(2 * pi() * k * n / {n})), 2)) AS m FROM hann, range(0, {n // 2 + 1}) q(k) GROUP BY vec_id, k)"""


def features(n: int, rate: int, samples: str = RAW) -> str:
    """Layering, crest and flux of windows of n samples at a rate."""
    edges = [x * rate / 32000 for x in (20, 150, 400, 1000, 2500, 6000, 16000)]
    bands = ", ".join(f"({b}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for b, (lo, hi) in enumerate(zip(edges, edges[1:])))
    return f"""{spectrum(n, samples)},
bands(b, lo, hi) AS (VALUES {bands}),
band AS (SELECT vec_id, b, sqrt(avg(m * m)) AS e FROM dft JOIN bands ON k * {rate / n!r}::DOUBLE >= lo AND k * {rate / n!r}::DOUBLE < hi GROUP BY vec_id, b),
share AS (SELECT vec_id, e / nullif(sum(e) OVER (PARTITION BY vec_id), 0) AS p, sum(e) OVER (PARTITION BY vec_id) AS t FROM band),
lay AS (SELECT vec_id, CASE WHEN any_value(t) <= 1e-9 THEN 0 ELSE -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(6) END AS layering FROM share GROUP BY vec_id),
cre AS (SELECT vec_id, max(m) / (avg(m) + 1e-9) AS crest FROM dft GROUP BY vec_id),
flev AS (SELECT vec_id, n // {rate // 2} AS f, sqrt(avg(x * x) + 1e-12) AS r FROM smp GROUP BY vec_id, f),
flu AS (SELECT vec_id, avg(abs(d)) AS flux FROM (SELECT vec_id, r - lag(r) OVER (PARTITION BY vec_id ORDER BY f) AS d FROM flev) GROUP BY vec_id),
feats AS (SELECT vec_id AS window_idx, layering, crest, flux FROM lay JOIN cre USING (vec_id) JOIN flu USING (vec_id))"""


SPECTRUM, FEATURES = spectrum(64), features(64, 16)


def cos(a: str, b: str) -> str:
    length = f"(sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x))))"
    return f"coalesce(list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i])) / nullif({length}, 0), 0)"


EMBEDDED = f"""el AS (SELECT * FROM w WHERE NOT has_speech),
gm AS (SELECT rec, list(v ORDER BY i) AS mean FROM (SELECT rec, i, avg(embedding[i]) AS v FROM el, range(1, 65) r(i) GROUP BY rec, i) GROUP BY rec),
nov AS (SELECT window_idx, 1 - {cos("embedding", "mean")} AS novelty FROM el JOIN gm USING (rec)),
nb AS (SELECT a.window_idx, i, sum(b.embedding[i]) AS s FROM el a JOIN el b ON a.rec = b.rec AND abs(a.start_seconds - b.start_seconds) <= 30 AND a.window_idx <> b.window_idx, range(1, 65) r(i) GROUP BY a.window_idx, i),
nbm AS (SELECT window_idx, list(s ORDER BY i) AS local FROM nb GROUP BY window_idx),
con AS (SELECT el.window_idx, CASE WHEN local IS NULL THEN 0 ELSE 1 - {cos("embedding", "local")} END AS contrast FROM el LEFT JOIN nbm USING (window_idx))"""


def _unit(c: str) -> str:
    lo, hi = f"min({c}) OVER (PARTITION BY rec)", f"max({c}) OVER (PARTITION BY rec)"
    return f"CASE WHEN {hi} - {lo} < 1e-9 THEN 0.5 ELSE ({c} - {lo}) / ({hi} - {lo}) END"


POOLED = f"""{FEATURES}, {EMBEDDED},
pool AS (SELECT window_idx, rec, start_seconds, embedding, {_unit("novelty")} AS novelty, {_unit("contrast")} AS contrast, {_unit("layering")} AS layering, {_unit("crest")} AS distinctiveness, {_unit("flux")} AS temporal_interest
  FROM el JOIN nov USING (window_idx) JOIN con USING (window_idx) JOIN feats USING (window_idx))"""
POOL = f"{WINDOWS}, {POOLED}"


def jitter(seed: int, places: int) -> tuple[list[float], list[float]]:
    """The five weights that a seed makes of equal ones, and the factors of a recording's first places."""
    draw = random.Random(seed).uniform
    raw = [0.2 * (1 + draw(-0.4, 0.4)) for _ in range(5)]
    return [x / sum(raw) for x in raw], [1 + draw(-0.15, 0.15) for _ in range(places)]


def score(weights: list[float], factors: list[float] | None = None, tag: str = "") -> str:
    """Table scored of pool; `tag` ends its name."""
    names = ("novelty", "contrast", "layering", "distinctiveness", "temporal_interest")
    total = " + ".join(f"{w!r}::DOUBLE * {c}" for w, c in zip(weights, names))
    place = f"* ([{', '.join(map(repr, factors))}]::DOUBLE[])[row_number() OVER (PARTITION BY rec ORDER BY start_seconds)]" if factors else ""
    return f"scored{tag} AS (SELECT *, ({total}) {place} AS score FROM pool)"


def scored(weights: list[float], factors: list[float] | None = None, pool: str = POOL) -> str:
    return f"{pool},\n{score(weights, factors)}"


def regions(tag: str = "") -> str:
    """Regions and their representatives of scored; `tag` ends all these names."""
    return f"""lagged{tag} AS (SELECT *, lag(start_seconds) OVER (PARTITION BY rec ORDER BY start_seconds) AS ps, lag(embedding) OVER (PARTITION BY rec ORDER BY start_seconds) AS pe FROM scored{tag}),
fresh{tag} AS (SELECT *, CASE WHEN ps IS NULL THEN 0 WHEN start_seconds - ps > 2.5 OR {cos("pe", "embedding")} < 0.92 THEN 1 ELSE 0 END AS new FROM lagged{tag}),
reg{tag} AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY start_seconds ROWS UNBOUNDED PRECEDING)::BIGINT AS region_id FROM fresh{tag}),
reps{tag} AS (SELECT *, count(*) OVER (PARTITION BY rec, region_id) AS region_window_count FROM reg{tag} QUALIFY row_number() OVER (PARTITION BY rec, region_id ORDER BY score DESC, start_seconds) = 1)"""


REGIONS = regions()


def greedy(count: int, prior: str | None = None, tag: str = "") -> str:
    """Recursive choice among each recording's reps, as short; `prior` names a table (rec, window_idx, embedding) shown before, `tag` ends the names made and read here."""
    before = f"pri{tag} AS (SELECT r.rec, r.region_id, max(CASE WHEN p.window_idx IS NULL THEN 0 ELSE {cos('r.embedding', 'p.embedding')} END) AS like_, coalesce(bool_or(r.window_idx = p.window_idx), false) AS again FROM reps{tag} r LEFT JOIN {prior} p ON p.rec = r.rec GROUP BY r.rec, r.region_id)," if prior else ""
    base = "r.score - 0.2::DOUBLE * like_ - CASE WHEN again THEN 0.5::DOUBLE ELSE 0 END" if prior else "r.score"
    source = f"reps{tag} r JOIN pri{tag} USING (rec, region_id) WHERE like_ < 0.97" if prior else f"reps{tag} r"
    return f"""{before}
open{tag} AS MATERIALIZED (SELECT rec, r.region_id AS id, r.start_seconds AS s, r.embedding AS e, {base} AS base FROM {source}),
sim{tag} AS MATERIALIZED (SELECT a.rec, a.id AS i, b.id AS j, {cos("a.e", "b.e")} AS c, abs(a.s - b.s) AS dt FROM open{tag} a JOIN open{tag} b ON a.rec = b.rec),
g{tag}(rec, step, sel) AS (SELECT DISTINCT rec, 0, []::BIGINT[] FROM open{tag} UNION ALL SELECT rec, step + 1, list_append(sel, pick) FROM (
  SELECT rec, step, sel, arg_max(id, row(value, -id)) AS pick FROM (
    SELECT g.rec, g.step, g.sel, r.id, r.base - 0.2::DOUBLE * coalesce(max(s.c), 0) AS value, min(s.dt) AS near, max(s.c) AS like_
    FROM g{tag} g JOIN open{tag} r ON r.rec = g.rec LEFT JOIN sim{tag} s ON s.rec = r.rec AND s.i = r.id AND list_contains(g.sel, s.j) WHERE g.step < {count} AND NOT list_contains(g.sel, r.id) GROUP BY g.rec, g.step, g.sel, r.id, r.base)
  WHERE coalesce(near >= 8, true) AND coalesce(like_ < 0.97, true) GROUP BY rec, step, sel) WHERE pick IS NOT NULL),
best{tag} AS (SELECT rec, arg_max(sel, step) AS sel FROM g{tag} GROUP BY rec),
picks{tag} AS (SELECT rec, unnest(range(1, len(sel) + 1)) AS pick, unnest(sel) AS region_id FROM best{tag}),
short{tag} AS (SELECT pick, r.* FROM picks{tag} JOIN reps{tag} r USING (rec, region_id))"""


SIGNAL = "sig AS (SELECT 'rec' || (event_id // 25600) AS rec, event_id % 25600 AS i, value AS v FROM events), len AS (SELECT rec, (max(i) + 1) / 100.0::DOUBLE AS duration FROM sig GROUP BY rec)"
ENVELOPE = SIGNAL + ", env AS (SELECT rec, i // 5 AS frame, sqrt(avg(v * v) + 1e-12) AS rms FROM sig GROUP BY rec, frame HAVING count(*) = 5 OR frame = 0)"
#: Windows of which the signal holds all.
INSIDE = f"{WINDOWS.replace('w AS', 'whole AS', 1)}, {SIGNAL}, w AS (SELECT whole.* FROM whole JOIN len USING (rec) WHERE start_seconds + 4 <= duration)"
SPANS = """cand AS (SELECT window_idx, rec, start_seconds, duration, greatest(0, start_seconds - 2.5::DOUBLE) AS ss, least(duration, start_seconds + 6.5::DOUBLE) AS se FROM w JOIN len USING (rec) WHERE NOT has_speech AND start_seconds < duration),
lim AS (SELECT *, round_even(ss * 100, 0)::BIGINT AS lo, round_even(se * 100, 0)::BIGINT AS hi FROM cand),
lev AS (SELECT window_idx, start_seconds, ss, (i - lo) // 5 AS frame, sqrt(avg(v * v) + 1e-12) AS rms, count(*) AS n FROM lim JOIN sig ON lim.rec = sig.rec AND i >= lo AND i < hi WHERE se - ss >= 0.5 GROUP BY window_idx, start_seconds, ss, (i - lo) // 5 HAVING count(*) = 5 OR (i - lo) // 5 = 0),
act AS (SELECT *, rms > quantile_cont(rms, 0.2) OVER (PARTITION BY window_idx) * 1.6::DOUBLE AS active FROM lev),
isl AS (SELECT *, sum(CASE WHEN active THEN 0 ELSE 1 END) OVER (PARTITION BY window_idx ORDER BY frame) AS island FROM act),
hit AS (SELECT window_idx, ss, island, min(frame) AS a, max(frame) AS b, bool_or(frame >= greatest(0, trunc((start_seconds - ss) / 0.05::DOUBLE)) AND frame <= trunc((start_seconds + 4 - ss) / 0.05::DOUBLE)) AS seed FROM isl WHERE active GROUP BY ALL),
span AS (SELECT window_idx, any_value(ss) + min(a) * 0.05::DOUBLE AS span_start, any_value(ss) + (max(b) + 1) * 0.05::DOUBLE AS span_end FROM hit WHERE seed GROUP BY window_idx),
spans AS (SELECT c.window_idx, c.rec, start_seconds, duration, span_start, span_end FROM cand c LEFT JOIN span USING (window_idx))"""
BOUNDS = f"""{SPANS},
pad AS (SELECT *, greatest(0, span_start - 0.15::DOUBLE) AS lo2, least(duration, span_end + 0.15::DOUBLE) AS hi2 FROM spans),
mid AS (SELECT *, CASE WHEN span_start IS NULL THEN start_seconds + 2 WHEN hi2 - lo2 <= 5 THEN (lo2 + hi2) / 2 END AS c FROM pad),
clips AS (SELECT window_idx, rec, CASE WHEN c IS NULL THEN lo2 ELSE greatest(0, least(duration, greatest(0, c - 2.5) + 5) - 5) END AS clip_start,
  CASE WHEN c IS NOT NULL THEN least(duration, greatest(0, c - 2.5) + 5) WHEN hi2 - lo2 > 6.5 THEN lo2 + 6.5 ELSE hi2 END AS clip_end FROM mid)"""
#: Clips that the second gate refuses: two-second sub-windows, one second apart, of which a share of 0.15 lies above 95.
RECHECK = """cnt AS (SELECT *, CASE WHEN clip_end - clip_start <= 2 THEN 1 ELSE ceil(clip_end - clip_start - 2 - 1e-9)::BIGINT + 1 END AS n FROM clips),
sub AS (SELECT window_idx, rec, unnest(range(0, n)) AS k, clip_start, clip_end FROM cnt),
sc AS (SELECT window_idx, k, avg(CASE WHEN v > 95 THEN 1.0 ELSE 0.0 END) AS s FROM sub JOIN sig ON sub.rec = sig.rec AND i >= round_even((clip_start + k) * 100, 0) AND i < round_even(least(clip_end, clip_start + k + 2) * 100, 0) GROUP BY ALL),
refused AS (SELECT window_idx FROM sc GROUP BY window_idx HAVING max(s) >= 0.15)"""


def tone_draws(basenames: list[str], version: int = 1) -> str:
    """Tables spec (tone, k, name, j, kind, value, spread, d) of what tones draw, and draws (basename, tone, us), the random numbers as they come for each clip."""
    spec, draws = [], []
    for tone, params in TONES.items():
        d = 0
        for k, (name, values) in enumerate(params):
            for j, v in enumerate(values):
                kind = {"Scaled": "s", "Moved": "m"}.get(type(v).__name__, "c")
                spec.append(f"('{tone}', {k}, '{name}', {j}, '{kind}', {v[0] if kind != 'c' else v!r}::DOUBLE, {v[1] if kind != 'c' else 0.0!r}::DOUBLE, {d + 1 if kind != 'c' else 0})")
                d += kind != "c"
        for b in basenames:
            rng = random.Random(f"{tone}:{version}:{b}")
            draws.append(f"('{b}', '{tone}', [{', '.join(repr(rng.random()) for _ in range(d))}]::DOUBLE[])")
    return f"spec(tone, k, name, j, kind, value, spread, d) AS (VALUES {', '.join(spec)}),\ndraws(basename, tone, us) AS (VALUES {', '.join(draws)})"
