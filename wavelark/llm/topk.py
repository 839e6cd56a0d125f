"""Exact top-k search by inner product: term-at-a-time accumulation over blocks.

A component x of a vector counts as the whole number floor(256 * x). Queries are sparse rows of
(term, weight), terms being places in the vector; candidates are dealt into blocks, and a block is an
inverted index: for each term the postings (row, weight) of the rows whose weight isn't zero. For some
queries at a time there is a dense array of scores, a row a query and a column a candidate. Term after
term, the postings' weights times the queries' weights are scattered into it; after the last term
every score is there, none estimated and none skipped. A partition selection takes the k best of each
row, and a last step merges what the blocks have found.

Queries and candidates are both dealt into blocks of a bounded size, and each pair of blocks is a
group of its own, so no task holds more than two blocks and CELLS scores, whatever the table's size.
A candidate travels once for each block of queries, a query once for each block of candidates: the
larger the blocks, the less of it. Rows are dealt by their place, not by vec_id, so repeated ids
spread as others do. The merge gets k rows a query and block, and prunes them before it shuffles.

Defined cases: vectors that are null or hold a null, infinite or NaN component take no part. A row is
never its own candidate, but other rows of its vec_id are; each row of a repeated vec_id is a query of
its own. Rows whose vec_id is null are candidates, last among equals, and no queries. A vector that is
shorter than another has zeros in the missing places; an empty one scores 0 with all. Ties go to the
smaller vec_id. Scores are exact whole numbers at any size; one that no long can hold is ranked by its
true value and told as the nearest long. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SCALE = 256
#: Rows, and components, of a block at most (a single longer vector is a block's only excess).
BLOCK_ROWS, BLOCK_PARTS = 16384, 1 << 21
#: Scores that a task holds at once.
CELLS = 1 << 20
#: Below so many rows, a block isn't cut for the sake of more tasks.
LEAST_ROWS = 1024

FOUND = "query_row long, query_id long, row long, vec_id long, score long, exact string"
LONG = (1 << 63) - 1


def whole_numbers(parts: np.ndarray, exact: bool) -> np.ndarray:
    """floor(SCALE * x) of each component: doubles that are whole, or Python's integers where those could lose digits."""
    if not exact:
        return np.floor(SCALE * parts)
    return np.array([SCALE * int(x) if abs(x) >= 2.0**53 else int(np.floor(SCALE * x)) for x in parts], object)


def sparse(vectors: pa.Array, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of all weights that aren't zero, by term and row."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    weights = whole_numbers(pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64), exact)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    terms = np.arange(len(weights)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = np.flatnonzero(weights != 0)
    some = some[np.argsort(terms[some], kind="stable")]
    return rows[some], terms[some], weights[some]


def by_term(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Postings: for each term its rows and their weights."""
    cuts = np.flatnonzero(np.diff(terms)) + 1
    return {int(t[0]): (r, w) for t, r, w in zip(np.split(terms, cuts), np.split(rows, cuts), np.split(weights, cuts), strict=True) if len(t)}


def accumulate(queries: dict, postings: dict, n_queries: int, n_rows: int, kind: type) -> np.ndarray:
    """The dense scores of all queries with all rows of a block, summed up term after term."""
    scores = np.zeros((n_queries, n_rows), kind)
    for term, (q, wq) in queries.items():
        if term not in postings:
            continue
        rows, w = postings[term]
        if len(rows) == n_rows:  # the term is in each row: the places are the columns themselves
            if len(q) == n_queries:
                scores += wq[:, None] * w
            else:
                scores[q] += wq[:, None] * w
        else:
            scores[q[:, None], rows] += wq[:, None] * w
    return scores


def best(scores: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the columns of its k highest scores; ties to the smaller column. own: each query's column, or -1."""
    n = scores.shape[1]
    if scores.dtype == object:
        return [np.array(sorted((c for c in range(n) if c != o), key=lambda c: (-s[c], c))[:k], np.int64) for s, o in zip(scores, own, strict=True)]
    keys = scores.astype(np.int64) * n + np.arange(n - 1, -1, -1)  # all different, so a partition is exact
    keys[np.flatnonzero(own >= 0), own[own >= 0]] = -LONG
    top = np.argpartition(keys, n - k, axis=1)[:, n - k :] if k < n else np.tile(np.arange(n), (len(keys), 1))
    return [t[t != o] for t, o in zip(top, own, strict=True)]


def search_block(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of a block for each of some queries."""
    rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # columns stand in the order that decides ties; nulls are last
    vectors, asked = rows["embedding"].combine_chunks(), queries["embedding"].combine_chunks()
    largest = [float(SCALE * np.abs(pc.list_flatten(v).to_numpy(zero_copy_only=False).astype(np.float64)).max(initial=0)) + 1 for v in (vectors, asked)]
    longest = max(pc.max(pc.list_value_length(vectors)).as_py() or 0, 1)
    bound = largest[0] * largest[1] * longest
    exact = not bound * max(rows.num_rows, 1) < 2.0**62
    kind = object if exact else np.int32 if bound < 2.0**31 else np.int64
    cast = lambda x: x if exact else x.astype(kind)
    r, t, w = sparse(vectors, exact)
    postings = by_term(r, t, cast(w))
    qr, qt, qw = sparse(asked, exact)
    ids, query_ids, places = rows["row"].to_numpy(), queries["row"].to_numpy(), rows["row"].to_pylist()
    column = {place: i for i, place in enumerate(places)}
    step, out = max(1, CELLS // rows.num_rows), []
    for at in range(0, queries.num_rows, step):
        n = min(step, queries.num_rows - at)
        mine = (qr >= at) & (qr < at + n)
        scores = accumulate(by_term(qr[mine] - at, qt[mine], cast(qw[mine])), postings, n, rows.num_rows, kind)
        own = np.array([column.get(int(i), -1) for i in query_ids[at : at + n]])
        for i, columns in enumerate(best(scores, own, k)):
            out += [(at + i, int(c), scores[i, c]) for c in columns]
    q, c = np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64)
    told = [max(-LONG - 1, min(LONG, int(x[2]))) for x in out]
    large = [f"{int(x[2]) + (1 << 2200):0700d}" if abs(int(x[2])) > LONG else None for x in out]
    return pa.table([pa.array(query_ids[q], pa.int64()), queries["vec_id"].combine_chunks().take(pa.array(q)), pa.array(ids[c], pa.int64()), rows["vec_id"].combine_chunks().take(pa.array(c)), pa.array(told, pa.int64()), pa.array(large, pa.string())], [x.split()[0] for x in FOUND.split(", ")])


def usable(vector: str = "embedding") -> Column:
    """Whether a vector and all its components are there and finite."""
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def top_k(table: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `table` (vec_id, embedding) that score highest with each row for which `queries` holds."""
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(usable()).select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = durable(rows)  # a row's place is given once
    n, parts, asked, asked_parts = (x or 0 for x in rows.agg(F.count(F.lit(1)), F.sum(F.size("embedding")), F.count_if("asks"), F.sum(F.when(F.col("asks"), F.size("embedding")))).first())
    blocks = lambda n, parts: max(1, -(-n // BLOCK_ROWS), -(-parts // BLOCK_PARTS))
    across = blocks(asked, asked_parts)
    down = max(blocks(n, parts), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_ROWS)))
    block = lambda of: F.pmod(F.xxhash64("row"), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    tasks = min(across * down, 1 << 16)
    a = rows.filter("asks").select("row", "vec_id", "embedding", block(across).alias("q"), each(down).alias("c")).repartition(tasks, "q", "c")
    b = rows.select("row", "vec_id", "embedding", each(across).alias("q"), block(down).alias("c")).repartition(tasks, "q", "c")
    empty = pa.table([pa.array([], pa.string() if x.endswith("string") else pa.int64()) for x in FOUND.split(", ")], [x.split()[0] for x in FOUND.split(", ")])
    found = a.groupBy("q", "c").cogroup(b.groupBy("q", "c")).applyInArrow(lambda x, y: search_block(x, y, k) if x.num_rows and y.num_rows else empty, FOUND)
    # `exact` is null unless a long can't hold the score
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc_nulls_last("exact"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_nth(n: int = 50) -> Column:
    """Rows whose vec_id is divisible by n."""
    return F.col("vec_id") % n == 0


ORACLE_SQL = f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.place, q.vec_id AS query_id, c.vec_id, c.place AS other, list_inner_product(q.v, c.v)::BIGINT AS score FROM t q, t c WHERE q.vec_id % 50 = 0 AND q.place <> c.place)
SELECT query_id, (row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST, other))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5"""
