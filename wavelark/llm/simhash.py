"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most two
bits, one of the segments differs in at most one; so each segment is indexed with one bit deleted,
for every bit in turn (64 keys a fingerprint), keys are joined by equality, and candidates are
verified on all 64 bits. Fingerprints are first made distinct, so copies cost nothing.

Within a key the members agree on 31 bits. Small groups compare pairs; larger ones probe, for each
member, the few values at the allowed distance, so work follows the members, not their square. A
group that outgrows LARGEST is dealt anew by thirds of the other segment (one of which agrees),
after which at most 2**23 different members can meet. Groups give stars, not pairs; components are
found by hooking and pointer jumping over durable tables.

Defined cases: null or empty text, and text of white space alone, has fingerprint zero and links
like any other. Fewer words than a shingle make one shingle. Repeated rows share a component. A
null doc_id gets its component's id but never names one (null if no member has an id). Long texts
are hashed in blocks. An empty table gives no rows; extra columns are ignored. Where one row of each
component is kept, it is that of the least doc_id (those without one last), the first of equals; rows
are told apart by their place in the table, so rows of one doc_id with different texts are different.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near
from .common import doc_text, durable, look_up, map_arrow

SHINGLE, SEED, DISTANCE = 3, 42, 2
BLOCK = 1 << 15
PAIRWISE, LARGEST = 256, 1 << 20


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash over 3-word shingles with their repeats."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - SHINGLE + 1)
    ends = ends[SHINGLE - 1 :] or ends[-1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, BLOCK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[lo : min(lo + BLOCK, n)], ends[lo : lo + BLOCK])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and further long columns."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names=["doc_id", "fp", *more])

        return run

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_text(), *more), make, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))


def keys(fps: DataFrame) -> DataFrame:
    """(key, sub, fp): the 64 deletion variants. Key: segment, deleted bit, the segment without it."""
    seg = lambda s: F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF))
    bit = F.col("bit")
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    value = F.when(bit >= 32, seg(1)).otherwise(seg(0))
    mask = F.lit(0xFFFFFFFF).bitwiseXOR(F.element_at(F.array(*[F.lit(1 << b) for b in range(32)]), (bit % 32 + 1).cast("int")))
    return rows.select((bit.cast("long") * F.lit(1 << 32) + value.bitwiseAND(mask)).alias("key"), F.lit(0).alias("sub"), "fp")


def masks(bit: int) -> np.ndarray:
    """Differences that a pair of the group with this deleted bit answers for.

    Bit 0 of a segment answers for equal segments too; any other only for pairs that differ at it.
    """
    other = [np.uint64(1) << np.uint64(b) for b in (range(32) if bit >= 32 else range(32, 64))]
    own = np.uint64(1) << np.uint64(bit)
    out = [own, *(own | o for o in other)]
    if bit % 32 == 0:
        out += [*other, *(a | b for i, a in enumerate(other) for b in other[:i])]
    return np.array(out, np.uint64)


def stars(bit: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) for the components that the group's links make. fps: sorted, distinct, unsigned."""
    n = len(fps)
    if n <= PAIRWISE:
        x = fps[:, None] ^ fps[None, :]
        ok = np.bitwise_count(x) <= DISTANCE
        if bit % 32:
            ok &= (x >> np.uint64(bit)) & np.uint64(1) == 1
        i, j = np.nonzero(np.triu(ok, 1))
    else:
        ii, jj = [], []
        for m in masks(bit):
            there = np.searchsorted(fps, y := fps ^ m)
            hit = np.flatnonzero((there < n) & (fps[np.minimum(there, n - 1)] == y) & (y > fps))
            ii.append(hit)
            jj.append(there[hit])
        i, j = np.concatenate(ii), np.concatenate(jj)
    root = np.arange(n)
    while len(i):
        lo = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], lo)
        np.minimum.at(root, root[j], lo)
        while (root != root[root]).any():
            root = root[root]
        if (before == root).all():
            break
    member = np.flatnonzero(root != np.arange(n))
    return fps[root[member]], fps[member]


def thirds(bit: int, fps: np.ndarray) -> list[np.ndarray]:
    """Labels that deal a group anew: the three thirds of the segment that the key leaves free."""
    other = (fps >> np.uint64(0 if bit >= 32 else 32)) & np.uint64(0xFFFFFFFF)
    return [((other >> np.uint64(s)) & np.uint64(w - 1)).astype(np.int64) + 1 + (k << 12) for k, (s, w) in enumerate(((0, 2048), (11, 2048), (22, 1024)))]


def link(keyed: DataFrame, largest: int | None) -> DataFrame:
    """(key, sub, a, b): star edges a-b with sub 0, and members b of groups over `largest` under their new labels."""

    def run(batches):
        held_key, held, over = None, [], False

        def flush(out):
            if held_key is not None and not over:
                fps = np.concatenate(held)
                if len(fps) > 1:
                    a, b = stars(held_key[0] >> 32, np.sort(fps))
                    out.append((np.full(len(a), held_key[0]), np.zeros(len(a), np.int64), a, b))

        def defer(out, key, fps):
            for label in thirds(key >> 32, fps):
                out.append((np.full(len(fps), key), label, fps, fps))

        def batch_of(out):
            cols = [np.concatenate(c) for c in zip(*out)]
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in cols], names=["key", "sub", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, sub = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            fp = batch.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
            lo, hi, out = np.r_[0, cuts], np.r_[cuts, len(key)], []
            # Whole groups of one member, away from the batch's ends, have nothing to link.
            busy = (hi - lo > 1) | (lo == 0) | (hi == len(key))
            for a, b in zip(lo[busy], hi[busy]):
                this = (int(key[a]), int(sub[a]))
                if this != held_key:
                    flush(out)
                    held_key, held, over = this, [], False
                held.append(fp[a:b])
                if over:
                    defer(out, this[0], held.pop())
                elif largest and sum(map(len, held)) > largest:
                    defer(out, this[0], np.concatenate(held))
                    held, over = [], True
            if out:
                yield batch_of(out)
        out = []
        flush(out)
        if out:
            yield batch_of(out)

    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "key", "sub").sortWithinPartitions("key", "sub").mapInArrow(run, "key long, sub long, a long, b long")


def links(fps: DataFrame, largest: int = LARGEST) -> DataFrame:
    """Distinct edges (a, b), durable, whose components are those of all links within DISTANCE bits. fps: distinct fp."""
    first = durable(link(keys(fps), largest))
    found = first.filter("sub = 0").select("a", "b")
    if not first.filter("sub > 0").isEmpty():
        found = found.union(link(first.filter("sub > 0").select("key", F.col("sub").cast("int").alias("sub"), F.col("b").alias("fp")), None).select("a", "b"))
    return durable(found.distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b): label is the component's least node.

    Each round hooks a node to the least label next to it, then follows labels once; the number of
    rounds grows with the logarithm of the longest path. Every round ends in a durable table. Nodes
    with many edges and labels of many nodes are looked up apart, so that none fills a task.
    """
    both = durable(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")))
    labels = durable(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"))
    while True:
        near = look_up(both, "v", labels.withColumnRenamed("node", "v")).groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.u).select("node", F.least("label", "near").alias("label"))
        # A label's own label: what its node has hooked to. Roots hook as well, through `pulled`.
        pulled = hooked.select("node", "label").join(labels.select(F.col("node").alias("n"), F.col("label").alias("old")), F.col("node") == F.col("n")).groupBy("old").agg(F.min("label").alias("least"))
        hooked = durable(hooked.join(pulled, hooked.node == pulled.old, "left").select("node", F.least("label", F.coalesce("least", "label")).alias("label")))
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = durable(look_up(hooked, "label", up).select("node", F.least("label", "next").alias("label")))
        if new.join(labels.select(F.col("node").alias("n"), F.col("label").alias("old")), F.col("node") == F.col("n")).filter("label <> old").isEmpty():
            return new
        labels = new


def classes(each: DataFrame, largest: int, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of rows with fp: durable (fp, rep, n) with the least doc_id and the number of rows, and (fp, label) with the component's least fingerprint. `more`: further links (a, b)."""
    found = durable(each.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    edges = links(found.select("fp"), largest)
    labels = components(durable(edges.union(more).distinct()) if more is not None else edges)
    return found, durable(found.join(labels, found.fp == labels.node, "left").select("fp", F.coalesce("label", "fp").alias("label")))


def near_duplicates(docs: DataFrame, largest: int = LARGEST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and component_size (rows) of each row of `docs`."""
    each = durable(fingerprints(docs))
    found, labels = classes(each, largest)
    named = durable(found.join(labels, "fp"))
    groups = durable(named.groupBy("label").agg(F.min("rep").alias("component_id"), F.sum("n").alias("component_size")))
    by_fp = durable(look_up(named, "label", groups).select("fp", "component_id", "component_size"))
    return look_up(each, "fp", by_fp).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


#: Rows to drop that are broadcast (8 bytes each); beyond these, the table is joined with them.
FEW = 2_000_000


def keep_one(docs: DataFrame, largest: int = LARGEST) -> DataFrame:
    """`docs` with one row left of each component. `docs` must give its rows in the same order each time, as files do.

    Components are of fingerprints within DISTANCE bits and of texts whose five-word shingles have a
    similarity of 0.8 or more (see `near`): fingerprints alone leave most near copies.
    """
    # The columns travel as one, so none of theirs can clash with those made here.
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.struct("*").alias("row"))
    each = durable(fingerprints(rows.select("row.doc_id", "row.text", "place"), "place"))
    pairs = near.links(rows.select("row.text", "place"))
    by_place = lambda c: each.select(F.col("place").alias(c), F.col("fp").alias(f"f{c}"))
    more = pairs.join(by_place("a"), "a").join(by_place("b"), "b").filter("fa <> fb").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"))
    named = durable(look_up(each, "fp", classes(each, largest, more)[1]).select("doc_id", "place", "label"))
    first = durable(named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place"))["place"].alias("kept")))
    drop = durable(look_up(named, "label", first).filter("place <> kept").select("place"))
    few = F.broadcast(drop) if drop.count() <= FEW else drop
    return rows.join(few, "place", "left_anti").select("row.*")
