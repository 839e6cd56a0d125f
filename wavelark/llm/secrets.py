"""Secret scans, in DataFrame functions alone.

Three pattern kinds (`assign`, `access`, `hex`) are matched leftmost and without overlap over the
whole text. The entropy method adds spans: candidate strings are maximal runs of a character class;
a window slides over each run, the counts of its characters are kept incrementally (one in, one
out) together with the sum of c*log2(c), so each step's Shannon entropy costs a constant; windows
at or above the class's threshold make a span, from the first such window to the end of the last.
Runs that an allow-list knows to be harmless are suppressed, and spans inside a pattern's span add
nothing. Positions are code points, ends exclusive.

Defined cases: a null or empty text has no spans (and `redact` leaves null null). Equal texts give
equal spans. Each row has a result of its own, whatever its doc_id: repeated ids and null ids give as
many rows as there are, in SQL too. Ties: spans that start together are told in the order of kinds.
Everything is local to a row: no shuffle, no Python, no collected group. Positions
come from prefix sums over the split text, in chunks, so many matches in a long text stay cheap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
#: A whole run of the class decides, so the least length can stand in the pattern itself.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

WINDOW = 24
#: kind: (run, alphabet, what a run must have, bits that a window of WINDOW characters must reach)
CLASSES = {
    "entropy_hex": (r"(?<![A-Za-z0-9])[0-9A-Fa-f]{24,}(?![A-Za-z0-9])", "0123456789abcdefABCDEF", r"(?=.*[0-9])(?=.*[A-Fa-f])", 2.9),
    "entropy_mixed": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", 3.85),
}
KINDS = ["assign", "access", "hex", *CLASSES]
#: Runs that are no secrets: ids with dashes, ordered alphabets, placeholders, a character many times over.
ALLOWED_RUN = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$|0123456789|(?i:abcdefghij|example|placeholder|changeme|your[_-]|xxxx|dummy|redacted)|(.)\1{7}"
)
#: Text right before a run that says it is an address, a digest of a public file, or inlined media.
ALLOWED_BEFORE = r"(?:://[^\s]*|www\.[^\s]*|sha(?:1|256|384|512)[-:=]|;base64,)$"
CHUNK = 256


def prefix_sums(lengths: Column) -> Column:
    """Sum of all elements before each, chunk by chunk: linear but for a factor CHUNK."""
    n = F.size(lengths)
    chunks = F.when(n == 0, F.array().cast("array<array<int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest((n - 1).cast("int") / CHUNK, F.lit(0)).cast("int")), lambda k: F.slice(lengths, k * CHUNK + 1, F.lit(CHUNK)))
    )
    start = lambda zero: F.struct(zero.cast("int").alias("pos"), F.array().cast("array<int>").alias("at"))
    bases = F.aggregate(chunks, start(F.lit(0)), lambda a, c: F.struct((a.pos + F.aggregate(c, F.lit(0), lambda x, y: x + y)).alias("pos"), F.array_append(a.at, a.pos).alias("at"))).at
    within = lambda c, b: F.aggregate(c, start(b), lambda a, x: F.struct((a.pos + x).alias("pos"), F.array_append(a.at, a.pos).alias("at"))).at
    return F.flatten(F.zip_with(chunks, bases, within))


def _cut(df: DataFrame, kind: str, pattern: str) -> DataFrame:
    """Adds p_kind, the text between matches, m_kind, the matches, and s_kind, where they start."""
    p, m, s = f"p_{kind}", f"m_{kind}", f"s_{kind}"
    df = df.withColumn(p, F.split("_text", pattern, -1))
    df = df.withColumn(m, F.when(F.size(p) > 1, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    steps = F.transform(F.arrays_zip(F.col(p).alias("p"), F.col(m).alias("m")), lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
    starts = F.zip_with(prefix_sums(steps), F.col(p), lambda at, x: at + F.length(x))
    return df.withColumn(s, F.when(F.size(p) > 1, F.slice(starts, F.lit(1), F.size(m))).otherwise(F.array().cast("array<int>")))


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.cast("int").alias("end"))


def hot_windows(run: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """First and last end (1-based positions, 0: none) of the windows whose entropy reaches `bits`.

    One fold over the run. The state holds the count of each character of the alphabet within the
    window and the sum of c*log2(c); H = log2(window) - sum / window.
    """
    # An element at index 0 stands for a character outside the alphabet; none is.
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    w = lambda c: F.element_at(weight, c + 1)
    chars = F.transform(F.split(run, ""), lambda c: F.greatest(F.instr(F.lit(alphabet), c), F.lit(1)))
    init = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(a: Column, x: Column) -> Column:
        full = x["i"] > window
        same = full & (x["add"] == x["drop"])
        added, dropped = F.element_at(a["counts"], x["add"]), F.element_at(a["counts"], x["drop"])
        counts = F.when(same, a["counts"]).otherwise(
            F.transform(a["counts"], lambda c, k: c + F.when(k + 1 == x["add"], 1).otherwise(0) - F.when(full & (k + 1 == x["drop"]), 1).otherwise(0))
        )
        total = F.when(same, a["sum"]).otherwise(a["sum"] + w(added + 1) - w(added) + F.when(full, w(dropped - 1) - w(dropped)).otherwise(0.0))
        hot = (x["i"] >= window) & (math.log2(window) - total / window >= bits)
        return F.struct(
            counts.alias("counts"), total.alias("sum"), F.when((a["first"] == 0) & hot, x["i"]).otherwise(a["first"]).alias("first"), F.when(hot, x["i"]).otherwise(a["last"]).alias("last")
        )

    # each step: position, the character that enters, and the one that leaves (the same where none does)
    steps = lambda cs: F.transform(cs, lambda c, k: F.struct((k + 1).alias("i"), c.alias("add"), F.when(k >= window, F.element_at(cs, F.greatest(k - window + 1, F.lit(1)))).otherwise(c).alias("drop")))
    return F.aggregate(F.flatten(F.transform(F.array(chars), steps)), init, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` plus `base` and `found`: sorted arrays of (start, rank of the kind, end); `found` has all spans."""
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    spans = {}
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        df = _cut(df, kind, pattern)
        found = F.zip_with(F.col(f"s_{kind}"), F.col(f"m_{kind}"), lambda s, m: F.struct(_span(kind, s, s + F.length(m)).alias("span"), m.alias("m")))
        if kind == "assign":
            found = F.filter(found, lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_LEAST)
        spans[kind] = F.transform(found, lambda x: x["span"])
    keep = [*docs.columns, "_text"]
    df = df.select(*keep, F.array_sort(F.concat(*spans.values())).alias("base"))
    more = []
    for kind, (pattern, alphabet, must, bits) in CLASSES.items():
        df = _cut(df, kind, pattern)
        runs = F.transform(F.arrays_zip(F.col(f"s_{kind}").alias("s"), F.col(f"m_{kind}").alias("m"), F.slice(F.col(f"p_{kind}"), F.lit(1), F.size(f"m_{kind}")).alias("p")), lambda x: x)
        runs = F.filter(runs, lambda x: x["m"].rlike(must) & ~x["m"].rlike(ALLOWED_RUN) & ~F.right(x["p"], F.lit(200)).rlike(ALLOWED_BEFORE))
        df = df.withColumn(f"h_{kind}", F.transform(runs, lambda x: F.struct(x["s"].alias("s"), hot_windows(x["m"], alphabet, bits).alias("h"))))
        hot = F.filter(F.col(f"h_{kind}"), lambda x: x["h"]["first"] > 0)
        more.append(F.transform(hot, lambda x: _span(kind, x["s"] + x["h"]["first"] - WINDOW, x["s"] + x["h"]["last"])))
    new = F.filter(F.concat(*more), lambda e: ~F.exists(F.col("base"), lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"])))
    df = df.select(*keep, "base", F.array_distinct(new).alias("_new"))
    return df.select(*keep, "base", F.array_sort(F.concat("base", "_new")).alias("found"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the pattern kinds, digest of their spans, and all spans."""
    df = find_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return df.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), (F.size("found") - F.size("base")).cast("long").alias("n_entropy")
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """`docs` with each stretch that spans cover replaced by `mask`, and n_chars (if a column) set anew."""
    # The columns travel as one, so none of theirs can clash with those made here.
    df = find_secrets(docs.select(F.struct("*").alias("row"), "text"))
    start = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda a: F.element_at(a, -1)
    merged = F.aggregate(
        "found", start,
        lambda a, x: F.when((F.size(a) > 0) & (F.when(F.size(a) > 0, last(a)["end"]) >= x["start"]),
            F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.when(F.size(a) > 0, last(a)["start"]).alias("start"), F.greatest(F.when(F.size(a) > 0, last(a)["end"]), x["end"]).alias("end")))))
        .otherwise(F.array_append(a, F.struct(x["start"].alias("start"), x["end"].alias("end")))),
    )
    df = df.withColumn("_merged", F.when(F.size("found") > 0, merged).otherwise(start))
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform("_merged", lambda x: x["end"])), F.concat(F.transform("_merged", lambda x: x["start"]), F.array(F.length("_text"))),
        lambda a, b: F.substring(F.col("_text"), a + 1, b - a),
    )
    clean = F.when(F.size("_merged") > 0, F.array_join(gaps, mask)).otherwise(F.col("text"))
    out = df.withColumn("_clean", clean)
    new_length = F.when(F.size("_merged") > 0, F.length("_clean").cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else None).alias("n_chars")
    made = {"text": F.col("_clean").alias("text"), "n_chars": new_length}
    return out.select(*[made[c] if c in made else F.col("row")[c].alias(c) for c in docs.columns])


def _matches_sql(name: str, pattern: str, keep: str) -> str:
    """Table `name` (rid, s, m): where matches start, and what they are."""
    q = pattern.replace("'", "''")
    return f"""{name}_l AS (SELECT rid, string_split_regex(x, '{q}') AS ps, regexp_extract_all(x, '{q}') AS ms FROM t),
{name}_i AS (SELECT rid, ps, ms, unnest(range(1, len(ms) + 1)) AS i FROM {name}_l),
{name} AS (SELECT rid, (coalesce(list_sum(list_transform(ps[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0))::BIGINT AS s, ms[i] AS m FROM {name}_i WHERE {keep})"""


def _entropy_sql(name: str, rank: int, run: str, letters: str, must: list[str], bits: float) -> str:
    """Table `name` (rid, s, r, e) of entropy spans: every window counted afresh."""
    has = " AND ".join(f"regexp_matches(m, '{x}')" for x in must)
    allowed = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$|0123456789|(?i:abcdefghij|example|placeholder|changeme|your[_-]|xxxx|dummy|redacted)"
    return f"""{_matches_sql(name + "_a", run, "true")},
{name}_c AS (SELECT rid, s, m, coalesce(lag(s + length(m)) OVER (PARTITION BY rid ORDER BY s), 0) AS p FROM {name}_a WHERE regexp_full_match(m, '{letters}')),
{name}_w AS (SELECT rid, s, list_filter(range(1, length(m) - {WINDOW - 2}), lambda i: list_aggregate(string_split(substr(m, i, {WINDOW}), ''), 'entropy') >= {bits}) AS hot FROM {name}_c JOIN t USING (rid)
  WHERE {has} AND NOT regexp_matches(m, '{allowed}') AND NOT regexp_matches(right(substr(x, p + 1, s - p), 200), '{ALLOWED_BEFORE}')
  AND len(list_filter(range(1, length(m) - 6), lambda i: substr(m, i, 8) = repeat(substr(m, i, 1), 8))) = 0),
{name} AS (SELECT rid, s + hot[1] - 1 AS s, {rank} AS r, s + hot[len(hot)] - 1 + {WINDOW} AS e FROM {name}_w WHERE len(hot) > 0)"""


_FULL = ASSIGN.replace("'", "''")
ORACLE_SQL = f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
{_matches_sql("a", ASSIGN, f"length(regexp_extract(ms[i], '{_FULL}', 2)) >= {ASSIGN_LEAST}")},
{_matches_sql("k", ACCESS, "true")},
{_matches_sql("h", HEX, "true")},
{_entropy_sql("eh", 3, "[A-Za-z0-9]{24,}", "[0-9A-Fa-f]+", ["[0-9]", "[A-Fa-f]"], CLASSES["entropy_hex"][3])},
{_entropy_sql("em", 4, "[A-Za-z0-9+/_-]{24,}", ".*", ["[0-9]", "[A-Z]", "[a-z]"], CLASSES["entropy_mixed"][3])},
base AS (SELECT rid, s, 0 AS r, s + length(m) AS e FROM a UNION ALL SELECT rid, s, 1, s + length(m) FROM k UNION ALL SELECT rid, s, 2, s + length(m) FROM h),
new AS (SELECT * FROM (SELECT * FROM eh UNION ALL SELECT * FROM em) n WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = n.rid AND b.s <= n.s AND n.e <= b.e)),
said AS (SELECT rid, s, r, e, false AS new, (['assign', 'access', 'hex', 'entropy_hex', 'entropy_mixed'])[r + 1] || ':' || s || ':' || e AS y FROM base
  UNION ALL SELECT rid, s, r, e, true, (['assign', 'access', 'hex', 'entropy_hex', 'entropy_mixed'])[r + 1] || ':' || s || ':' || e FROM new)
SELECT t.doc_id, count(y) FILTER (r = 0) AS n_assign, count(y) FILTER (r = 1) AS n_access, count(y) FILTER (r = 2) AS n_hex,
  sha256(coalesce(string_agg(y, ',' ORDER BY s, r) FILTER (NOT new), '')) AS base_sha256, coalesce(string_agg(y, ',' ORDER BY s, r), '') AS spans, count(y) FILTER (new) AS n_entropy
FROM t LEFT JOIN said USING (rid) GROUP BY t.rid, t.doc_id"""
