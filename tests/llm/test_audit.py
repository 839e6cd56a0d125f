import random
import re
from collections import Counter
from itertools import permutations

import duckdb
from llmfixtures import ODD

from wavelark.llm import audit

D = "/root/testdata/sf0.01"


def plain(rows, labels):
    """The audit by running the filters in each order. rows: (doc_id, text, source)."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    docs = []
    for i, t, source in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None, "E": i is not None and i > first.get(t, i),
        }
        docs.append((source or "", {f for f in fails if fails[f]}, i in good and i is not None, i in toxic and i is not None))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        left = docs
        for step, f in enumerate(order, 1):
            gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
            for part in {d[0] for d in docs}:
                of = lambda some: sum(d[0] == part for d in some)
                fails = [d for d in docs if f in d[1]]
                out[part, order, step] = [of(left), of(gone), of(fails) - of(gone), of([d for d in docs if d[1] == {f}]), of([d for d in gone if d[2]]), of([d for d in gone if d[3]])]
                shapley[part, f] += of(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audited(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def table(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, e int, same string").repartition(3)
    return docs, spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")


def test_against_the_filters_themselves(spark):
    rng = random.Random(3)
    kinds = ["word number {0} is here ", "AB cd {0} ", "same same ", "x$ {0} ", "Ünder ß 東京 "]
    texts = ["".join(rng.choice(kinds).format(rng.randint(0, 300)) for _ in range(rng.choice([3, 60, 120]))) for _ in range(40)]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (199, 200, 201)] + ["A" * n + "b" * (100 - n) for n in (1, 2, 3)] + ["a b\x0bc\x1cd e " * 50]
    rows = [(i, t, rng.choice(["s", "t", None, ""])) for i, t in enumerate([*ODD, *texts, *texts[:15], *texts[:5]])]
    rows += [(None, texts[0], "s"), (None, texts[0], "s"), (3, texts[1], "s"), (3, texts[1], "u"), (3, None, "t")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (9999, 1, 1)]
    assert audited(audit.audit(*table(spark, rows, labels))) == plain(rows, labels)


def test_empty_tables_and_hot_rows(spark, monkeypatch):
    docs, labels = table(spark, [], [])
    assert audit.audit(docs, labels).count() == 0
    rows = [(i // 3, "copy", "s") for i in range(300)] + [(None, "copy", None)] * 100
    docs, labels = table(spark, rows, [(5, 1, 1)] * 50)
    from wavelark.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 8)
    got = audited(audit.audit(docs, labels))
    assert got == plain(rows, [(5, 1, 1)] * 50)
    assert got["s", "EABCD", 1][:2] == (3, 297)


def test_inversion_on_counts(spark):
    """Two filters fail together on 3 documents, one alone on 4, the other alone on 5, none on 6."""
    n = [0] * 32
    for s in range(32):
        n[s] = sum(c for t, c in ((0b00011, 3), (0b00001, 4), (0b00010, 5), (0, 6)) if t & s == s)
    from pyspark.sql import functions as F

    joint = spark.range(1).select(F.lit("p").alias("part"), *[F.array(*[F.lit(x).cast("long") for x in n]).alias(c) for c in ("n", "good", "toxic")])
    got = audited(audit.orders(audit.inverted(joint)))
    assert got["p", "ABCDE", 1] == (11, 7, 0, 4, 7, 7, 120 * 4 + 60 * 3) and got["p", "ABCDE", 2] == (6, 5, 3, 5, 5, 5, 120 * 5 + 60 * 3)
    assert got["p", "BACDE", 2] == (6, 4, 3, 4, 4, 4, 660) and got["p", "CDEBA", 1] == (18, 0, 0, 0, 0, 0, 0)


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = audit.audit(*(spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels")))
    want = con.sql(audit.ORACLE_SQL)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
