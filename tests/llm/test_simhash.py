import random

import numpy as np
import xxhash
DATA = "/root/testdata"

from wavelark.llm import common, simhash

from llmfixtures import ODD


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def rows_of(docs, **kw):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, **kw).collect()}


def test_odd_documents(make_docs):
    got = rows_of(make_docs(ODD))
    fps = [plain_fingerprint(t) for t in ODD]
    roots = plain_components(fps)
    assert got == {i: (f"{fps[i]:016x}", roots[i]) for i in range(len(ODD))}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    fps = [plain_fingerprint(r.text) for r in rows]
    roots = plain_components(fps)
    assert rows_of(docs) == {r.doc_id: (f"{fps[i]:016x}", rows[roots[i]].doc_id) for i, r in enumerate(rows)}


def families(rng, n, step):
    """Fingerprints in clouds and chains around a few centres, and strangers."""
    out = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(n):
            out.add(x)
            if rng.random() < 0.1:
                x = rng.choice(sorted(out))
            for _ in range(rng.randint(1, step)):
                x ^= 1 << rng.randrange(64)
    return sorted(out | {rng.getrandbits(64) for _ in range(n)})


def test_links_have_the_components_of_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    for pairwise, largest, step in ((256, 1 << 20, 3), (4, 1 << 20, 2), (4, 8, 2), (256, 12, 3)):
        monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
        fps = families(rng, 40, step)
        signed = [int(x) for x in np.array(fps, np.uint64).view(np.int64)]
        edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(2), largest)
        got = {r.node: r.label for r in simhash.components(edges).collect()}
        roots, want = plain_components(fps), {}
        for i, x in enumerate(signed):
            want.setdefault(roots[i], []).append(x)
        expected = {x: min(group) for group in want.values() if len(group) > 1 for x in group}
        assert got == expected


def test_stars_by_probing_equal_stars_by_pairs(monkeypatch):
    rng = random.Random(8)
    for bit in (0, 5, 31, 32, 47, 63):
        base, free = rng.getrandbits(64), [b for b in (range(32) if bit >= 32 else range(32, 64))]
        fps = {base}
        for _ in range(120):
            x = rng.choice(sorted(fps))
            for b in rng.sample([*free, bit], rng.randint(1, 2)):
                x ^= 1 << b
            fps.add(x)
        x = np.array(sorted(fps), np.uint64)
        out = []
        for limit in (1, 1000):
            monkeypatch.setattr(simhash, "PAIRWISE", limit)
            out.append(sorted(map(tuple, np.stack(simhash.stars(bit, x)).T.tolist())))
        assert out[0] == out[1] and out[0]


def test_ties_repeats_and_missing_ids(make_docs):
    text = "some words that make a text of their own"
    got = simhash.near_duplicates(make_docs([(7, text), (7, text), (None, text), (3, text + "."), (9, None), (None, "alone in here")])).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.component_id is None, r.component_id or 0) for r in got)) == sorted([(False, 7, False, 7), (False, 7, False, 7), (True, 0, False, 7), (False, 3, False, 3), (False, 9, False, 9), (True, 0, True, 0)])
    kept = simhash.keep_one(make_docs([(7, text), (7, text), (8, text), (None, text), (9, None)]))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [7, 9]
    assert kept.columns == make_docs(["x"]).columns


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs(["x"]).limit(0)).count() == 0


def test_rows_of_one_id_with_different_texts_stay(make_docs):
    rows = [(5, "one text with words of its own"), (5, "quite another text that has nothing of it"), (None, "a third one without any id at all"), (None, "a third one without any id at all"), (6, None), (6, "")]
    kept = simhash.keep_one(make_docs(rows)).collect()
    assert sorted(r.text or "" for r in kept) == sorted(["", rows[0][1], rows[1][1], rows[2][1]])


def test_hot_keys_are_looked_up_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT", 10)
    rows = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(100)] + [(None, 1), (99, 2)], "k int, x int")
    table = spark.createDataFrame([(k, -k) for k in range(7)], "k int, y int")
    assert sorted(map(tuple, common.look_up(rows, "k", table).select("k", "x", "y").collect())) == sorted((r.k, r.x, -r.k) for r in rows.collect() if r.k is not None and r.k < 7)


def test_dropped_rows_beyond_a_broadcast(make_docs, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 1)
    docs = make_docs(["the same words here"] * 9 + ["other words, they are", None])
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 9, 10]
