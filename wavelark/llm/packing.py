"""Best-fit packing of token sequences, in bulk-synchronous supersteps.

Documents are tokenised, cut where longer than a sequence, and range-sorted by length, so every
piece has a rank among the pieces of its length. Lengths are whole numbers of at most `capacity`, so
both sorted sides, pieces and gaps, are kept as tables of runs of equal size. In a superstep the
runs are dealt by ranges of sizes; in each range a sweep matches pieces with their successors, the
smallest gaps that hold them, and where pieces meet at the same gaps, rank decides; what a range
has left is carried to one more sweep. Then the gaps are updated, and the superstep is repeated until
no gap takes a piece; what is left of the class of lengths opens sequences, and the next class
follows. That fills about as many sequences as best-fit decreasing, piece by piece, would.

Defined cases: a null or empty text has the closing id alone. Repeated rows are packed as often as
they occur. A piece as long as a sequence has one to itself. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, durable, map_arrow

CAPACITY, TOKENIZER = 2048, "word_bpe_49k.json"
CACHE_WORDS, CACHE_MARKS, CACHE_IDS, LONG, PORTION = 600_000, 20_000, 4_000_000, 64, 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Bpe:
    """Byte-pair merges of many words at once, as the tokenizer's model has them: in each word the pair of least rank, the leftmost of equals, again and again."""

    EMPTY, NONE = np.uint32(0xFFFFFFFF), np.int64(1 << 30)

    def __init__(self, path: str):
        model = json.load(open(path))["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        # Bytes stand for themselves where printable, the others for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.inner, self.final = (np.array([vocab.get(char[b] + end, 0) for b in range(256)], np.uint32) for end in ("", suffix))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.key, self.rank, self.new = np.full(1 << 18, self.EMPTY), np.full(1 << 18, self.NONE), np.zeros(1 << 18, np.uint32)
        made = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):  # those that find their slot taken go to the next one
            free = self.key[slot[left]] == self.EMPTY
            won = left[free][np.unique(slot[left[free]], return_index=True)[1]]
            self.key[slot[won]], self.rank[slot[won]], self.new[slot[won]] = keys[won], won, made[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + (self.key[slot[left]] != self.EMPTY)) & ((1 << 18) - 1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1) >> np.uint32(14)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the pairs, each with its own key or an empty one."""
        slot = self._slot(keys)
        odd = np.flatnonzero((self.key[slot] != keys) & (self.key[slot] != self.EMPTY))
        while len(odd):
            slot[odd] = (slot[odd] + 1) & ((1 << 18) - 1)
            odd = odd[(self.key[slot[odd]] != keys[odd]) & (self.key[slot[odd]] != self.EMPTY)]
        return slot

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as bytes; no word is empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(size) - 1
        symbols[ends] = self.final[data[ends]]
        word, done = np.arange(len(words)), []
        while len(word):
            starts = np.cumsum(size) - size
            slot = self._find(symbols[:-1] << np.uint32(16) | symbols[1:])
            best = np.append(self.rank[slot], self.NONE)
            best[starts[1:] - 1] = self.NONE
            best = best << np.int64(32) | np.arange(len(best))
            least = np.minimum.reduceat(best, starts)
            at, go = least & 0xFFFFFFFF, least >> 32 < self.NONE
            if not go.all():
                stay = np.repeat(~go, size)
                done.append((word[~go], size[~go], symbols[stay]))
            at = at[go]
            symbols[at] = self.new[slot[at]]
            keep = np.repeat(go, size)
            keep[at + 1] = False
            symbols, size, word = symbols[keep], size[go] - 1, word[go]
        out: list[bytes] = [b""] * len(words)
        for w, n, s in done:
            raw, end = s.tobytes(), (np.cumsum(n) * 4).tolist()
            for i, a, b in zip(w.tolist(), [0, *end], end):
                out[i] = raw[a:b]
        return out


class Encoder:
    """Token ids by the named public tokenizer, encoding each different word once.

    This tokenizer drops white space and never joins characters across it, so a text's ids are its
    words' ids in a row; only the four commonest white-space characters are cut at here, the
    tokenizer sees to the others. Words are found and hashed (64 bits: a polynomial of their bytes,
    or XXH64 where longer than LONG) for a portion of text at once; what each different word stands
    for lies in one array of ids. A word met first is encoded: a plain one as its lower-cased
    letters (by Bpe, if these aren't too long) and then the marks that end it, since the tokenizer
    lower-cases and parts these; any other by the tokenizer itself.
    """

    PLAIN = re.compile("([^\\W\\d_]+)([.,;:!?%&#*$|\"()]*)")
    STEP = 0xD6E8FEB86659FD93

    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer, self.bpe = Tokenizer.from_file(public_tokenizers.path(name)), Bpe(public_tokenizers.path(name))
        self.is_space = np.zeros(256, bool)
        self.is_space[[32, 10, 9, 13]] = True
        self.of_byte = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
        self._powers(PORTION)
        self.marks: dict[str, bytes] = {}
        self._forget()

    def _powers(self, n: int) -> None:
        back = pow(self.STEP, -1, 1 << 64)
        self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, m, np.uint64)])) for m in (self.STEP, back))

    def _forget(self) -> None:
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and the word each is
        self.ids, self.first, self.size = np.zeros(1 << 20, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _cut(self, word: str) -> tuple[str, str]:
        """A plain word's letters, lower-cased, and its marks; any other word whole."""
        if word.isascii() and word.isalpha():
            return word.lower(), ""
        m = self.PLAIN.fullmatch(word)
        # Below U+0250 lower case is the same character by character; U+0130 apart, all of it is composed.
        return (m[1].lower(), m[2]) if m and max(word) < "\u0250" and "\u0130" not in word else (word, "")

    def _encode(self, words: list[str]) -> list[bytes]:
        cut, marks = [self._cut(w) for w in words], self.marks
        if len(marks) > CACHE_MARKS:
            marks.clear()
        marks[""] = b""
        # A word that isn't plain comes whole, and is mostly not met again: it goes with the marks for this once.
        plain = [i for i, (core, _) in enumerate(cut) if core.isalpha() and len(core) <= LONG and max(core) < "\u0250"]
        letters = dict(zip(plain, self.bpe([cut[i][0].encode() for i in plain]) if plain else ()))
        unknown = list({m for _, m in cut} | {c for i, (c, _) in enumerate(cut) if i not in letters} - marks.keys())
        found = dict(zip(unknown, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(unknown, add_special_tokens=False))))
        marks.update((m, found[m]) for _, m in cut if m in found and len(m) <= LONG)
        return [(letters[i] if i in letters else found[c] if c in found else marks[c]) + (found[m] if m in found else marks[m]) for i, (c, m) in enumerate(cut)]

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Adds words by their sorted hashes."""
        new = self._encode([w.decode("utf-8", "surrogatepass") for w in words])
        n, sizes = len(self.row), np.array([len(x) // 4 for x in new], np.int64)
        total = self.used + int(sizes.sum())
        while len(self.ids) < total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.first) < n + len(new):
            self.first, self.size = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.used : total] = np.frombuffer(b"".join(new), "<u4")
        self.size[n : n + len(new)] = sizes
        self.first[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
        at = np.searchsorted(self.known, hashes)
        self.known, self.row = np.insert(self.known, at, hashes), np.insert(self.row, at, np.arange(n, n + len(new)))
        self.used = total

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = b" ".join([b"", *raws, b""])  # a space before and after each
        at = np.cumsum([1, *(len(r) + 1 for r in raws)])
        data = np.frombuffer(raw, np.uint8)
        if len(data) >= len(self.up):
            self._powers(len(data))
        gap = self.is_space[data]
        lo, hi = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.of_byte[data] * self.up[: len(data)])])
        h = (sums[hi] - sums[lo]) * self.down[lo]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        for k in np.flatnonzero(hi - lo > LONG).tolist():
            h[k] = xxhash.xxh64_intdigest(raw[lo[k] : hi[k]])
        if len(self.row) > CACHE_WORDS or self.used > CACHE_IDS:
            self._forget()
        different, first, where = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, different)
        there = place < len(self.known)
        there[there] = self.known[place[there]] == different[there]
        if not there.all():
            self._learn(different[~there], [raw[lo[k] : hi[k]] for k in first[~there].tolist()])
            place = np.searchsorted(self.known, different)
        rows = self.row[place][where]
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[rows] - (ends - sizes), sizes)]
        ends = np.concatenate([np.zeros(1, np.int64), ends])
        cuts = ends[np.searchsorted(lo, at)]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def __call__(self, text: str) -> np.ndarray:
        """The ids of one text; a very long one in portions that end at a space."""
        out, at = [], 0
        while len(text) - at > PORTION and (end := text.find(" ", at + PORTION)) > 0:
            out += self.many([text[at:end]])
            at = end
        return np.concatenate([*out, *self.many([text[at:]])])


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One to a process: what it has encoded serves its next tasks too."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts that have about PORTION characters together."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size + len(t) > PORTION and i > lo:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Each document's pieces: doc_id, piece, start, length, ids_crc32."""

    def make():
        encode = encoder(tokenizer)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, ids in ((docs[lo + i], x) for lo, hi in portions(texts) for i, x in enumerate(encode.many(texts[lo:hi]) if hi - lo > 1 else [encode(texts[lo])])):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                for k, lo in enumerate(range(0, len(ids), capacity)):
                    part = ids[lo : lo + capacity]
                    for col, v in zip(out, (doc, k, lo, len(part), zlib.crc32(part.tobytes()))):
                        col.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

        return run

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_text()), make, PIECES)


GAP, PIECES_LEFT, PLACED, USED = range(4)
RUN = "kind int, size long, at long, n long, seq long, each long, offset long"
#: Ranges of sizes that a superstep's sweeps are dealt over.
RANGES = 8
Run = tuple[int, int, int, int, int, int, int]


def classes(capacity: int) -> list[tuple[int, int]]:
    """Bounds (above, up to) of the lengths that are matched together, the longest first: by how many fill a sequence, later by a factor."""
    out, hi = [], capacity
    while hi:
        many = capacity // hi
        lo = capacity // (many + 1) if many < 4 else hi * 5 // 8
        out.append((min(lo, hi - 1), hi))
        hi = out[-1][0]
    return out


def sweep(runs: list[Run], lo: int, hi: int) -> list[Run]:
    """One sweep from the largest size down: each piece of the class meets its successor, the smallest gap that holds it and is not taken.

    Where pieces meet at the same gaps, rank decides: longer ones come first, then lower ranks. A gap
    takes as many pieces of one length as it holds. What it has left then comes back as USED, for the
    next superstep; gaps and pieces that met nothing come back as they are. So sweeps over ranges of
    sizes, and then one over what these have left, are one sweep over all.
    """
    out, stack = [], []
    for kind, size, at, n, seq, each, offset in sorted(runs, key=lambda r: (-r[1], r[0] == PIECES_LEFT, r[2])):
        if kind == GAP:
            stack.append((size, seq, n, offset))
        elif kind != PIECES_LEFT or not lo < size <= hi:
            out.append((kind, size, at, n, seq, each, offset))
        else:
            while n and stack:
                free, seq, m, offset = stack.pop()
                each = min(free // size, n)
                full = min(m, n // each)
                out.append((PLACED, size, at, full * each, seq, each, offset))
                if free > each * size:
                    out.append((USED, free - each * size, 0, full, seq, 0, offset + each * size))
                if m > full:
                    stack.append((free, seq + full, m - full, offset))
                at, n = at + full * each, n - full * each
            if n:
                out.append((PIECES_LEFT, size, at, n, 0, 0, 0))
    return out + [(GAP, free, 0, n, seq, 0, offset) for free, seq, n, offset in stack]


def open_sequences(runs: list[Run], lo: int, hi: int, first: int, capacity: int) -> list[Run]:
    """The class's pieces in new sequences from number `first` on, one after another, the longest first; other runs as they are."""
    out, free, seq = [r for r in runs if r[0] != PIECES_LEFT or not lo < r[1] <= hi], 0, first - 1
    for _, size, at, n, *_ in sorted((r for r in runs if r[0] == PIECES_LEFT and lo < r[1] <= hi), key=lambda r: -r[1]):
        while n:
            if free < size:
                if free:
                    out.append((GAP, free, 0, 1, seq, 0, capacity - free))
                per = capacity // size
                if full := n // per:
                    out.append((PLACED, size, at, full * per, seq + 1, per, 0))
                    if capacity > per * size:
                        out.append((GAP, capacity - per * size, 0, full, seq + 1, 0, per * size))
                    at, n, seq, free = at + full * per, n - full * per, seq + full, 0
                if n:
                    seq, free = seq + 1, capacity
                continue
            some = min(free // size, n)
            out.append((PLACED, size, at, some, seq, some, capacity - free))
            at, n, free = at + some, n - some, free - some * size
    return out + ([(GAP, free, 0, 1, seq, 0, capacity - free)] if free else [])


def superstep(state: DataFrame, lo: int, hi: int, opened: int, capacity: int) -> DataFrame:
    """Durable runs after one superstep over gaps and pieces: sweeps within ranges of sizes, then one over what they have left.

    Where nothing met, the class's pieces open sequences from number `opened` on.
    """

    def rows(batches):
        return [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]

    def batch(runs: list[Run]):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(zip(*runs))], names=[x.split()[0] for x in RUN.split(", ")])

    def within(batches):
        if got := rows(batches):
            yield from batch(sweep(got, lo, hi))

    def carry(batches):
        got = sweep(rows(batches), lo, hi)
        if all(r[0] != PLACED for r in got):
            got = open_sequences(got, lo, hi, opened, capacity)
        if got:
            yield from batch([(GAP, *r[1:]) if r[0] == USED else r for r in got])

    by_range = F.floor(F.col("size") * RANGES / (capacity + 1)).cast("int")
    swept = state.repartitionById(RANGES, by_range).mapInArrow(within, RUN)
    return durable(swept.repartitionById(1, F.lit(0)).mapInArrow(carry, RUN))


def match(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: rows (length, first rank, pieces, first sequence, pieces of this run in each sequence, offset).

    The piece of rank `first rank + i` goes to sequence `first sequence + i // each`, at
    `offset + (i % each) * length`. Class after class, supersteps repeat until no gap takes a piece;
    what is left then opens sequences.
    """
    plan, opened = [], 0
    runs: list[Run] = [(PIECES_LEFT, length, 0, n, 0, 0, 0) for length, n in counts.items()]
    state = spark.createDataFrame(runs, RUN)
    left = set(counts)
    for lo, hi in classes(capacity):
        while any(lo < size <= hi for size in left):
            after = superstep(state, lo, hi, opened, capacity)
            placed = [tuple(r)[1:] for r in after.filter(F.col("kind") == PLACED).collect()]  # runs, a few for each length
            plan += placed
            opened = max([opened, *(seq + -(-n // each) for _, _, n, seq, each, _ in placed)])
            state = after.filter(F.col("kind") != PLACED)
            left = {r[0] for r in state.filter(F.col("kind") == PIECES_LEFT).select("size").collect()}
    return plan


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`items` (as of `pieces`) plus sequence_id and offset."""
    spark = items.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64("doc_id", "piece", "start")
    items = durable(items)  # sampling for the ranges and the sort read it, not the tokenizer
    ranged = durable(items.repartitionByRange(n, F.desc("length"), spread).sortWithinPartitions(F.desc("length"), "doc_id", "piece")).withColumn("_part", F.spark_partition_id())
    # At most one row for each length and each cut between partitions.
    runs = sorted((r[0], r[1], r[2]) for r in ranged.groupBy("_part", "length").count().collect())
    totals, first = {}, {}
    for part, length, count in runs:
        first[part, length] = totals.get(length, 0)
        totals[length] = totals.get(length, 0) + count
    plan = np.array(sorted(match(spark, totals, capacity)), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast((first, plan))

    def make():
        ranks, plan = shared.value
        keys, seen = plan[:, 0] << 44 | plan[:, 1], {}

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            *cols, part = batch.columns
            part, length = part[0].as_py(), cols[3].to_numpy()
            rank = np.empty(len(length), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                lo = seen.setdefault(size, ranks[part, int(size)])
                rank[at] = lo + np.arange(len(at))
                seen[size] = lo + len(at)
            row = plan[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            i = rank - row[:, 1]
            seq, offset = row[:, 3] + i // row[:, 4], row[:, 5] + i % row[:, 4] * length
            return pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(offset)], names=[x.split()[0] for x in OUT.split(", ")])

        return run

    OUT = PIECES + ", sequence_id long, offset long"
    return map_arrow(ranged.select("doc_id", "piece", "start", "length", "ids_crc32", "_part"), make, OUT)


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs))
