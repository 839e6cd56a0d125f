import duckdb
import numpy as np

from wavelark.llm import topk

D = "/root/testdata/sf0.01"


def brute(rows, n, k=5):
    """(query_id, [(score, vec_id)]) by Python's integers, for each row of a query in turn."""
    out = []
    good = [(i, v, [256 * int(x) if abs(x) >= 2**53 else int(np.floor(256 * x)) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    for i, v, e in good:
        if v is not None and v % n == 0:
            scores = [(-sum(a * b for a, b in zip(e, f)), w is None, w or 0, j) for j, w, f in good if j != i]
            out.append((v, [(-s, None if none else w) for s, none, w, _ in sorted(scores)[:k]]))
    return sorted(out, key=repr)


def check(spark, rows, n=2, k=5):
    table = spark.createDataFrame([(v, e, 1, "x") for v, e in rows], "vec_id long, embedding array<double>, score long, row string").repartition(3)
    got = {}
    for r in topk.top_k(table, topk.every_nth(n), k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], max(-topk.LONG - 1, r.score), r.vec_id))
    want = {}
    clip = lambda s: max(-topk.LONG - 1, min(topk.LONG, s))
    for q, best in brute(rows, n, k):
        if best:
            want.setdefault(q, []).extend((i + 1, clip(s), w) for i, (s, w) in enumerate(best))
    key = lambda x: (x[0], x[1], str(x[2]))
    assert {q: sorted(v, key=key) for q, v in got.items()} == {q: sorted(v, key=key) for q, v in want.items()}
    return got


def test_against_brute_force_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) if rng.random() < 0.6 else 0.0 for x in rng.normal(size=8)]) for i in range(300)]
    whole = check(spark, rows, 7)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "LEAST_ROWS", 8)
    monkeypatch.setattr(topk, "CELLS", 64)
    assert check(spark, rows, 7) == whole
    monkeypatch.setattr(topk, "BLOCK_PARTS", 40)
    assert check(spark, rows, 7) == whole


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (2, [1.0, nan]), (4, None), (6, [None, 1.0]), (8, [inf, 1.0]), (None, [9.0, 9.0]), (None, [9.0, 9.0]), (10, []), (12, [0.5]), (14, [-1.0, -2.0, 4.0]), (0, [1.0, 2.0]), (3, [0.001, -0.001])]
    got = check(spark, rows)
    assert set(got) == {0, 10, 12, 14} and len(got[0]) == 10
    assert got[12][0][2] is None  # without an id, but the best
    assert check(spark, [(0, [1.0])]) == {} and check(spark, []) == {}
    assert [len(v) for v in check(spark, [(0, [1.0]), (1, [1.0]), (2, [3.0])]).values()] == [2, 2]


def test_ties_go_to_smaller_ids(spark, monkeypatch):
    rows = [(i, [1.0, 1.0]) for i in range(60)] + [(100 + i, [2.0, 0.0]) for i in range(60)]
    got = check(spark, rows, 50)
    assert [x[2] for x in sorted(got[0])] == [1, 2, 3, 4, 5] and [x[2] for x in sorted(got[50])] == [0, 1, 2, 3, 4]
    monkeypatch.setattr(topk, "LEAST_ROWS", 4)
    assert check(spark, rows, 50) == got


def test_scores_that_no_long_holds(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [-1e12, 0.5]), (3, [1e300, 0.0]), (4, [2e300, 0.0]), (5, [1.0, 1.0]), (6, [3e9, 3e9]), (7, [3e9, 3e9])]
    got = check(spark, rows)
    assert [x[2] for x in sorted(got[0])][:2] == [4, 3] and sorted(got[0])[0][1] == topk.LONG


def test_terms_are_accumulated_where_postings_are():
    q = topk.by_term(*topk.sparse(topk.pa.array([[1.0, 0.0, 2.0], [0.0, 1.0]]), False))
    p = topk.by_term(*topk.sparse(topk.pa.array([[1.0, 1.0, 1.0], [0.0, 3.0], [2.0]]), False))
    assert q[0][0].tolist() == [0] and q[1][0].tolist() == [1] and p[0][0].tolist() == [0, 2]
    scores = topk.accumulate(q, p, 2, 3, np.float64) / 256**2
    assert scores.tolist() == [[3, 0, 2], [1, 3, 0]]


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{D}/embeddings.parquet'")
    got = topk.top_k(spark.read.parquet(f"{D}/embeddings.parquet"), topk.every_nth())
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.sql(topk.ORACLE_SQL).fetchall())
