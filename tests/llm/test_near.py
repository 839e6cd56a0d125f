import random

import numpy as np

from wavelark.llm import near, simhash

DATA = "/root/testdata"


def plain_set(text):
    words = near.words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_classes(texts):
    """Least index reachable by links of similarity 0.8, texts without words apart."""
    sets, root, by = [plain_set(t) for t in texts], list(range(len(texts))), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def classes_of(spark, texts, **kw):
    rows = spark.createDataFrame(list(enumerate(texts)), "place long, text string").repartition(4)
    firsts = {}
    root = [firsts.setdefault(b" ".join(near.words_of(t)), i) for i, t in enumerate(texts)]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near.links(rows, **kw).collect():
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) if near.words_of(t) else i for i, t in enumerate(texts)]


def edited(rng, words, share):
    return [w if rng.random() > share else f"z{rng.randrange(10**6)}" for w in words]


def families(rng, n, copies, share, passage=0):
    common, out = [f"p{i}" for i in range(passage)], []
    for f in range(n):
        words = common + [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 150, 400)))]
        out += [" ".join(edited(rng, words, share)) for _ in range(copies)]
    rng.shuffle(out)
    return out


def test_links_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    texts = families(rng, 30, 4, 0.01) + families(rng, 30, 3, 0.025) + [None, "", " \n", "few words", "Few words", "a b c d e", "a b c d e f"]
    assert classes_of(spark, texts) == plain_classes(texts)


def test_whole_table(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    want = plain_classes(texts)
    assert classes_of(spark, texts) == want and len(set(want)) < len({(t or "").lower() for t in texts})


def test_large_groups_and_common_passages(spark):
    rng = random.Random(6)
    texts = families(rng, 2, 60, 0.002) + families(rng, 40, 2, 0.002, passage=500)
    want = plain_classes(texts)
    assert classes_of(spark, texts, largest=8) == want


def test_forest_joins_what_may_be_similar():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, (3, 256), np.uint8)
    rows = []
    for b in base:
        for flips in (0, 5, 30):
            x = b.copy()
            x[rng.choice(256, flips, replace=False)] ^= 1
            rows.append(x)
    edges, leaders = near.forest(np.packbits(np.array(rows), axis=1).view(np.uint64))
    assert sorted({tuple(sorted((i // 3, j // 3))) for i, j in edges}) == [(0, 0), (1, 1), (2, 2)] and len(edges) == 6 and leaders == [0, 2, 3, 5, 6, 8]


def test_one_of_each_family_is_kept(spark, make_docs):
    rng = random.Random(7)
    texts = families(rng, 10, 5, 0.01) + ["alone here with words of my own", None]
    kept = sorted(r.doc_id for r in simhash.keep_one(make_docs(texts)).collect())
    assert kept == sorted(set(plain_classes(texts)))
    assert near.links(make_docs(["x"]).limit(0).select("text", near.F.col("doc_id").alias("place"))).count() == 0
