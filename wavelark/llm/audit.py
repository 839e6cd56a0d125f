"""Audit of how filters interact, by inclusion-exclusion.

Five filters look at each document (whole texts). For each of the 32 sets of filters one number is
aggregated: of how many documents all of the set's filters fail, as the sum of the product of their
flags. Nothing else about the documents is needed after that:

* survivors of a set of filters, in whatever order they ran: the alternating sum over its subsets;
* what a filter removes after others: the difference of two survivors' counts, so all 120 orders follow;
* what fails a filter alone: the alternating sum over the sets that hold it (Moebius inversion upwards);
* redundancy: its failures less what it removes;
* Shapley: the game "removed by a set" has the Harsanyi dividend (-1)^(|S|+1) N(S), shared evenly by the
  members of S; times 120 this is whole.

Each is counted for all documents, for those labelled good and for those labelled toxic.

Scale: a document's text is read once, for its four flags and a SHA-256 (equal texts have equal ones);
what travels is some 60 bytes a document. Equal texts meet as partial minima, and hot texts are looked
up apart. Rows are counted by (doc_id, part, flags) before they meet labels, so repeated or missing
ids don't pile up. The 96 sums are combined before their shuffle: a row a part and task.

Defined cases: a null text is empty (it fails A, and E if an earlier one is empty or null). B fails on
no text without words. A null source is the empty one. A row without a doc_id has no smaller one and is
smaller than none: E never fails on it, nor on others because of it. Rows of one doc_id don't
duplicate each other. A document with several label rows is good if one says so and toxic if one does.
Labels without a document count for nothing. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from string import ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, look_up

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
SHARES = {1: 120, 2: 60, 3: 40, 4: 30, 5: 24}  # of the orders, by the size of a set


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails A to D. It mustn't be null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "n_words": F.size(words), "n_distinct": F.size(F.array_distinct(words)), "n_capitals": F.length(text) - F.length(F.translate(text, ascii_uppercase, "")),
        "n_points": F.length(text), "has_sign": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, a, b, c, d, e) of each document, flags as longs; durable."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", F.sha2("text", 256).alias("same"), *[v.alias(k) for k, v in text_failures(F.col("text")).items()])
    fails = {"a": "n_words < 200", "b": "100L * n_distinct < 50L * n_words", "c": "100L * n_capitals > 2L * n_points", "d": "has_sign"}
    rows = durable(rows.select("doc_id", "part", "same", *[F.expr(v).cast("long").alias(k) for k, v in fails.items()]))
    first = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("same", "first")
    later = look_up(rows.select("doc_id", "same", "part", *"abcd"), "same", durable(first))
    once = rows.join(first, "same", "left_anti")
    e = F.coalesce((F.col("doc_id") > F.col("first")).cast("long"), F.lit(0)).alias("e")
    return later.select("doc_id", "part", *"abcd", e).unionByName(once.select("doc_id", "part", *"abcd", F.lit(0).cast("long").alias("e")))


def joint_failures(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a part: arrays n, good and toxic of 32 counts, at place s those of documents that fail all filters of the set s."""
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.groupBy("doc_id").agg(F.max(F.coalesce("good", F.lit(False))).cast("long").alias("good"), F.max(F.coalesce("toxic", F.lit(False))).cast("long").alias("toxic"))
    cells = rows.groupBy("doc_id", "part", *"abcde").agg(F.count(F.lit(1)).alias("n")).join(said, "doc_id", "left").fillna(0, ["good", "toxic"])

    def counts(of: Column) -> Column:
        product = lambda s: reduce(lambda x, y: x * y, [F.col(f) for i, f in enumerate("abcde") if s >> i & 1], of)
        return F.array(*[F.sum(product(s)) for s in SETS])

    n = F.col("n")
    return cells.groupBy("part").agg(counts(n).alias("n"), counts(n * F.col("good")).alias("good"), counts(n * F.col("toxic")).alias("toxic"))


def signed(joint: str, sets: list[tuple[int, int]]) -> Column:
    """The sum of the joint failures of sets, each with its factor."""
    return reduce(lambda x, y: x + y, [F.col(joint)[s] * f for s, f in sets])


def sign(s: int) -> int:
    return -1 if s.bit_count() % 2 else 1


def inverted(joint: DataFrame) -> DataFrame:
    """Per part: survivors of each set of filters (three arrays of 32), and for each filter its failures, unique failures and Shapley value."""
    subsets = lambda p: [(s, sign(s)) for s in SETS if s & p == s]
    holding = lambda f: [s for s in SETS if s >> f & 1]
    filters = range(len(FILTERS))
    return joint.select(
        "part", *[F.array(*[signed(of, subsets(p)) for p in SETS]).alias(f"kept_{of}") for of in ("n", "good", "toxic")],
        F.array(*[F.col("n")[1 << f] for f in filters]).alias("fails"),
        F.array(*[signed("n", [(s, -sign(s)) for s in holding(f)]) for f in filters]).alias("unique"),
        F.array(*[signed("n", [(s, -sign(s) * SHARES[s.bit_count()]) for s in holding(f)]) for f in filters]).alias("shapley"),
    )


def orders(parts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    df = parts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = lambda i: F.ascii(F.substring(F.col("filter_order"), i, F.lit(1))) - ord("A")
    bit = lambda i: F.call_function("shiftleft", F.lit(1), place(i))
    before = F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda s, i: F.when(i < F.col("step"), s + bit(i)).otherwise(s))
    df = df.withColumn("before", before).withColumn("after", F.col("before") + bit(F.col("step"))).withColumn("f", place(F.col("step")))
    removed = lambda of: F.col(f"kept_{of}")[F.col("before")] - F.col(f"kept_{of}")[F.col("after")]
    of_filter = lambda c: F.col(c)[F.col("f")]
    return df.select(
        "part", "filter_order", "step", F.col("kept_n")[F.col("after")].alias("kept"), removed("n").alias("removed"), (of_filter("fails") - removed("n")).alias("redundant"),
        of_filter("unique").alias("unique_fails"), removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), of_filter("shapley").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How five filters interact on `docs`: for each part, order and step what is kept, removed and lost."""
    return orders(inverted(joint_failures(flagged(docs), labels)))


# Filters run in each order, document by document.
ORACLE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS words, coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) AS e FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x), regexp_matches(x, '[#$%&*|]'), e] AS fails,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM o),
p AS (SELECT DISTINCT part FROM c),
r AS (SELECT s.filter_order, s.step, c.*, substr(s.filter_order, s.step, 1) AS k, fails[ascii(substr(s.filter_order, s.step, 1)) - 64] AS now,
  len(list_filter(range(1, s.step), lambda i: fails[ascii(substr(s.filter_order, i, 1)) - 64])) > 0 AS before FROM s, c),
g AS (SELECT part, filter_order, step, any_value(k) AS k, sum(CASE WHEN NOT before AND NOT now THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT before AND now THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN before AND now THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN now AND len(list_filter(fails, lambda y: y)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN NOT before AND now AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT before AND now AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM g"""
