import glob
import random
import re
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest
from llmfixtures import ODD

from wavelark.llm import phrases

D = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, covered=50, top=2000):
    """By the definition; rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                f.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {}
    candidates = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    for (lang, *words), a in candidates.items():
        inside = [c for (other, *long), c in candidates.items() if other == lang and len(long) > len(words) and any(long[i : i + len(words)] == words for i in range(len(long) - len(words) + 1))] if len(words) == 2 else []
        if any(100 * c >= covered * a for c in inside):
            continue
        cuts = [(1000000 * a * a // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, some in found.items() for i, (s, a, p, l, r) in enumerate(sorted(some)[:top])}


def mined(df, **k):
    rows = phrases.collocations(df, **k).collect()
    got = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows}
    assert len(got) == len(rows)
    return got


def texts(seed, n):
    rng = random.Random(seed)
    words = ["red", "House", "tree", "RED", "été", "東京", "x y", "a-b", "the", "of", "new\x1cline", "in"]
    out = []
    for _ in range(n):
        out.append("".join(rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " ", " "]) + rng.choice(words[: rng.choice([3, 6, 12])]) for _ in range(rng.choice([0, 5, 60]))))
    return out


@pytest.mark.parametrize("chunk,least,covered", [(1 << 22, 10, 50), (200, 10, 50), (200, 3, 90), (200, 40, 10)])
def test_against_the_definition(spark, monkeypatch, chunk, least, covered):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rng = random.Random(chunk + least)
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in [*ODD, *texts(5, 150)]]
    df = spark.createDataFrame([(lang, t, "x", 1) for lang, t in rows], "lang string, text string, phrase string, n int").repartition(3)
    got = mined(df, least=least, covered=covered)
    assert got == plain(rows, least, covered) and len(got) > 10
    assert mined(df, least=least, covered=covered, top=5) == plain(rows, least, covered, 5)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert mined(none) == set()
    assert mined(spark.createDataFrame([("en", "a b c"), ("en", None), (None, ""), (None, ".,;")], "lang string, text string")) == set()
    ten = spark.createDataFrame([("en", "a b. " * 10), (None, "lone " * 3)], "lang string, text string")
    assert mined(ten) == {("en", 1, "a b", 10, 10, 10, 20, 1000000)}


def test_pieces_and_overlaps(spark):
    rows = [("en", "a a a a"), ("en", "a a, a"), ("en", "a\na"), ("de", "x y z. " * 12 + "x y. " * 5)] * 4
    df = spark.createDataFrame(rows, "lang string, text string")
    got = mined(df)
    assert got == plain(rows) and ("en", "a a", 16) in {(r[0], r[2], r[3]) for r in got}
    de = {r[2]: r for r in got if r[0] == "de"}
    assert set(de) == {"x y z"} and de["x y z"][3:6] == (48, 68, 48)  # both cuts score alike or the second less: x y | z


def test_row_groups_have_a_few_chunks(spark):
    folder = phrases.Folder(spark)
    chunks = spark.range(0, 100, 1, 2).selectExpr("id AS chunk", "'en' AS lang", "array(id) AS names", "cast(repeat('x', 1000) AS binary) AS places")
    assert folder.put(chunks, "names1").count() == 100
    files = glob.glob(f"{folder.path.removeprefix('file:')}/names1/*.parquet")
    sizes = [meta.row_group(i).num_rows for meta in map(pq.read_metadata, files) for i in range(meta.num_row_groups)]
    folder.drop()
    assert sum(sizes) == 100 and max(sizes) <= phrases.ROWS


def test_counts_beyond_64_bits(spark):
    f = 4_000_000_000_000
    row = spark.range(1).selectExpr(f"{f}L AS f", f"array({f + 1}L, {2 * f}L, {f}L) AS heads", f"array({3 * f}L, {f + 5}L, {f}L) AS tails").selectExpr(f"{phrases.LOWEST_CUT} AS c").first().c
    cuts = [(1000000 * f * f // ((f + 1) * (f + 5)), 1), (1000000 * f * f // (2 * f * 3 * f), 2)]
    assert (row.score, row.k) == min(cuts)


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    got = phrases.collocations(spark.read.parquet(f"{D}/documents.parquet"))
    want = con.sql(phrases.ORACLE_SQL)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
