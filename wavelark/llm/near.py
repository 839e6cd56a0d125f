"""Near copies by five-word shingles: links between texts with a Jaccard similarity of 0.8 or more.

What SimHash over 64 bits can't tell apart (at 0.8 two fingerprints differ in some ten bits, too many
for segments that still select), the pipeline's second stage links by this. Each different text gets
256 least values of its set of shingles under as many permutations, in 32 bands of eight; texts that
share a band are candidates (at 0.8 a pair shares one with a probability of 0.997, at 0.85 of 0.9999).
One bit of each least value makes a sketch of 256 bits. Within a band's group sketches choose a
spanning forest, likely links first; its edges are then verified on the whole sets of shingles.

Groups over `largest` members are dealt by salt, a leader for each cluster of a part goes on, and
parts that don't shrink so (many texts with a passage in common) are dealt anew by their other bands.
So a task holds about `largest` sketches at once, and a group's edges are fewer than its members. What this
can lose: a chosen edge that fails where another between the same parts would have held, and links
between members of different parts of a large group whose leaders aren't linked.

Defined cases: texts of fewer than five words are one shingle, those without words have none and no
link. Copies (equal words, A-Z in lower case) are one text. An empty table gives no links.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, durable, map_arrow

SHINGLE, SIMILAR, SEED = 5, 0.8, 42
BANDS, ROWS, BLOCK = 32, 8, 1024
BITS = BANDS * ROWS
#: Differing bits of two sketches: (1 - similarity) / 2 of all on average. SURE is similar by two, MAYBE unlike by three standard deviations.
SURE, MAYBE = 17, 41
LARGEST, FEW, STREAM = 2048, 2_000_000, 1000
SKETCH = ["s0", "s1", "s2", "s3"]
_rng = np.random.default_rng(11)
_FACTOR, _PLUS = (_rng.integers(0, 1 << 63, BITS, np.uint64) * np.uint64(2) + np.uint64(1))[:, None], _rng.integers(0, 1 << 63, BITS, np.uint64)[:, None]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes]) -> np.ndarray:
    """Different hashes of the shingles, sorted."""
    line = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    n, digest = max(1, len(words) - SHINGLE + 1), xxhash.xxh64_intdigest
    ends = ends[SHINGLE - 1 :] or ends[-1:]
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def signature(hashes: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The bands' keys and the sketch (four words)."""
    low = np.full(BITS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), BLOCK):
        low = np.minimum(low, (_FACTOR * hashes[at : at + BLOCK] + _PLUS).min(axis=1))
    raw = low.tobytes()
    keys = [xxhash.xxh64_intdigest(raw[i * ROWS * 8 : (i + 1) * ROWS * 8], i) - (1 << 63) for i in range(BANDS)]
    return keys, np.packbits(((low * _MIX) >> np.uint64(63)).astype(np.uint8)).view(np.int64)


def sketches(rows: DataFrame) -> DataFrame:
    """(place, h, bands, s0..s3) of each row (place, text) with words; h names the text."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            place, h, bands, sketch = [], [], [], []
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if words := words_of(t):
                    keys, s = signature(shingles(words))
                    place.append(p)
                    h.append(xxhash.xxh64_intdigest(b" ".join(words), SEED) - (1 << 63))
                    bands.append(keys)
                    sketch.append(s)
            s = np.array(sketch, np.int64).reshape(-1, 4)
            return pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(h, pa.int64()), pa.array(bands, pa.list_(pa.int64())), *(pa.array(s[:, i]) for i in range(4))], names=["place", "h", "bands", *SKETCH])

        return run

    return map_arrow(rows.select("place", doc_text()), make, "place long, h long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH))


def forest(sketch: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges of a spanning forest of likely links, and the leaders of its clusters of sure ones."""
    n = len(sketch)
    label, edges, leaders = np.full(n, -1), [], []
    apart = lambda i: np.bitwise_count(sketch ^ sketch[i]).sum(axis=1, dtype=np.int16)
    for i in range(n):
        if label[i] < 0:
            near = (label < 0) & (apart(i) <= SURE)
            near[i] = True
            label[near] = len(leaders)
            leaders.append(i)
            edges += [(i, int(j)) for j in np.flatnonzero(near) if j != i]
    m = len(leaders)
    if m > 1:
        best = np.full((m, m), BITS, np.int16)
        ends = np.zeros((2, m, m), np.int16)
        for i in range(n):
            d = apart(i)
            for j in np.flatnonzero((d <= MAYBE) & (label > label[i])):
                if d[j] < best[label[i], label[j]]:
                    best[label[i], label[j]], ends[0, label[i], label[j]], ends[1, label[i], label[j]] = d[j], i, j
        root = list(range(m))

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        a, b = np.nonzero(best <= MAYBE)
        for k in np.argsort(best[a, b], kind="stable"):
            x, y = find(int(a[k])), find(int(b[k]))
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((int(ends[0, a[k], b[k]]), int(ends[1, a[k], b[k]])))
    return edges, leaders


def grouped(rows: DataFrame) -> DataFrame:
    """(key, a, b) over rows (key, sub, h, s0..s3): forests' edges, and (key, a, a) for leaders where sub is not -1."""

    def run(batches):
        held_key, held = None, []

        def flush(out):
            if not held:
                return
            part = np.concatenate(held, axis=1)
            h, first = np.unique(part[0], return_index=True)
            edges, leaders = forest(np.ascontiguousarray(part[1:, first].T).view(np.uint64))
            out += [(held_key[0], int(h[min(e)]), int(h[max(e)])) for e in edges]
            if held_key[1] >= 0:
                out += [(held_key[0], int(h[i]), int(h[i])) for i in leaders]

        for batch in batches:
            if not batch.num_rows:
                continue
            key, sub = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values, out = np.stack([c.to_numpy() for c in batch.columns[2:]]), []
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(key)]):
                if (this := (int(key[lo]), int(sub[lo]))) != held_key:
                    flush(out)
                    held_key, held = this, []
                held.append(values[:, lo:hi])
            if out:
                yield batch_of(out)
        out = []
        flush(out)
        if out:
            yield batch_of(out)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["key", "a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("key", "sub", "h", *SKETCH).repartition(n, "key", "sub").sortWithinPartitions("key", "sub").mapInArrow(run, "key long, a long, b long")


def small(df: DataFrame) -> DataFrame:
    """`df`, durable, broadcast if it has at most FEW rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def candidates(texts: DataFrame, largest: int) -> DataFrame:
    """Distinct (a, b), a < b: durable edges between texts (h, bands, s0..s3) that may be similar."""
    keyed = texts.select(F.explode("bands").alias("key"), "h", *SKETCH)
    found, before = None, None
    while True:
        shared = durable(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        again = shared.filter(F.col("n") > largest)
        if before is not None and not again.isEmpty():
            # Parts whose leaders are still more than half of what they were are dealt by a second band.
            slow = durable(again.join(before, "key").filter("n * 2 > was").select("key"))
            if not slow.isEmpty():
                other = keyed.join(small(slow), "key").join(texts.select("h", "bands"), "h")
                dealt = other.select(F.col("key").alias("old"), F.explode("bands").alias("band"), "h", *SKETCH).withColumn("key", F.xxhash64("old", "band"))
                # A band that all members of a key share would be that key again: its members are dealt by the others alone.
                size = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
                was = other.groupBy("key").agg(F.count(F.lit(1)).alias("w")).withColumnRenamed("key", "old")
                fresh = dealt.join(size, "key").join(was, "old").filter("m > 1 and m < w").select("key", "h", *SKETCH)
                keyed = durable(keyed.join(small(slow), "key", "left_anti").unionByName(fresh))
                before = None
                continue
        rows = keyed.join(small(shared), "key")
        sub = F.when(F.col("n") > largest, F.pmod(F.xxhash64("h", "key"), F.ceil(F.col("n") / largest))).otherwise(F.lit(-1)).cast("long")
        made = durable(grouped(rows.withColumn("sub", sub)))
        edges = made.filter("a <> b").select("a", "b")
        found = edges if found is None else found.union(edges)
        leaders = made.filter("a = b").select("key", F.col("a").alias("h"))
        if leaders.isEmpty():
            return durable(found.distinct())
        before = durable(again.select("key", F.col("n").alias("was")))
        keyed = durable(leaders.join(texts.select("h", *SKETCH), "h").select("key", "h", *SKETCH))


def similar(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (a, b) whose sets (h, hashes) have a Jaccard similarity of SIMILAR or more. A text with many edges is dealt by salt."""

    def run(batches):
        root = None
        for batch in batches:
            a_out, b_out = [], []
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                mine = np.frombuffer(raw, np.uint64)
                if b is None:
                    root = mine
                    continue
                both = len(np.intersect1d(root, mine, assume_unique=True))
                if both >= SIMILAR * (len(root) + len(mine) - both) - 1e-9:
                    a_out.append(a)
                    b_out.append(b)
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    many = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STREAM).alias("parts"))
    roots = many.select(F.col("a").alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
    roots = roots.join(sets, "h").select(F.col("h").alias("a"), "salt", F.lit(None).cast("long").alias("b"), "hashes")
    members = edges.join(many, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("salt"), F.col("b").alias("h")).join(sets, "h").select("a", "salt", F.col("h").alias("b"), "hashes")
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return roots.unionByName(members).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def links(rows: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(a, b): places of rows (place, text) with similar texts, one place for each text. `rows` must give the same each time."""
    texts = durable(sketches(rows).groupBy("h").agg(F.min(F.struct("place", "bands", *SKETCH)).alias("t")).select("h", "t.*"))
    edges = candidates(texts, largest)
    want = durable(edges.select(F.col("a").alias("h")).union(edges.select("b")).distinct().join(texts.select("h", "place"), "h"))

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(words_of(t)).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["h", "hashes"])

        return run

    sets = durable(map_arrow(rows.join(small(want), "place").select("h", doc_text()), make, "h long, hashes binary"))
    good = durable(similar(edges, sets))
    at = lambda c: want.select(F.col("h").alias(c), F.col("place").alias(f"p{c}"))
    return durable(good.join(at("a"), "a").join(at("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
