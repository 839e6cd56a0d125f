"""Benchmark decontamination by template canonicalisation.

Words become canonical tokens: numbers, names (capitalised words inside a sentence, and runs of
them) and units after a number turn into typed placeholders, whose values are kept as slots; other
words are lower-cased, without the marks around them. Windows of WINDOW tokens are hashed and
hash-joined with the benchmark's. A document holds an item if its windows cover at least COVER of
the item's different windows, and if the slots agree: an item's value must meet one value in the
document (its own, or another's in a re-parameterised copy), so that pairs of values number no more
than 1 / CONSISTENT of the values. They may agree over the whole document or over one occurrence
that covers as much: the windows that lie as far apart as in the item, exactly or but for some words
(within half an item). So other copies beside one don't matter. Windows of placeholders alone count
for nothing, but where an item has no others, they are hashed with their values, so that verbatim
copies are found.

Items shorter than a window are held to more: they are hashed whole, with their values, and must begin
a sentence in the document; those of less than SHORT tokens must be lines of their own, as an answer
"Paris" is in no text that merely names the town.

Common windows: an item can't be covered without one of its rarest windows (as many as it may miss,
and one more), so only these look for candidates; an item's other windows, however common, are
compared for its candidates alone. Index of the benchmark: if its different hashes number at most
FILTER_MOST, they are broadcast as a sorted array that drops other windows before the join (8 bytes
each); beyond that all windows are joined.

Defined cases: null or empty texts hold nothing; an item without a token is never found; each row is
judged on its own, whatever its doc_id, and of rows that share one the best match is told; repeated
items are found each under its own id, items without one never; an empty table gives no rows; long
texts are read whole, in one pass. Extra columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_text, durable, map_arrow

WINDOW, SHORT, COVER, CONSISTENT = 5, 3, 0.5, 0.5
#: Tokens of a window that aren't placeholders, at least.
LITERALS = 1
FILTER_MOST = 4_000_000
FEW_IDS = 1_000_000
NUM, NAME, UNIT = 1, 2, 3
CACHE = 300_000
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—§·"
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|[kmb%])?$", re.I)
#: Number words and units of measure and money.
NUMBER_WORDS = set("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
UNITS = set(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "mph kph km/h m/s hz khz mhz ghz w kw v a j kj n pa k c f percent dollar dollars cent cents euro euros usd eur".split()
)
ENDS = (".", "!", "?", ":")


class Canon:
    """Canonical tokens of texts: hash, kind and slot value. What a word is by itself is looked up once."""

    def __init__(self):
        self.words: dict[str, tuple[str, int, int, bool, bool]] = {}

    def word(self, w: str) -> tuple[str, int, int, bool, bool]:
        """Core, kind (number or none), hash of the lower-cased core, whether capitalised, whether a sentence ends."""
        core = w.strip(MARKS)
        low = core.lower()
        number = bool(NUMBER.match(core)) or low in NUMBER_WORDS
        cased = bool(core) and core[0].isupper()
        out = (core, NUM if number else 0, zlib.crc32(low.encode("utf-8", "surrogatepass")) << 2 | 4, cased, w.endswith(ENDS))
        if len(w) < 64:
            self.words[w] = out
        return out

    def __call__(self, text: str) -> tuple[np.ndarray, list[tuple[int, str]], np.ndarray, np.ndarray]:
        """Token hashes, with kinds in the low two bits, the slots as (token, value), and the tokens that sentences, and that lines begin with (there the end, too)."""
        if len(self.words) > CACHE:
            self.words.clear()
        tokens: list[int] = []
        slots: list[tuple[int, str]] = []
        lines: list[int] = []
        sentences: list[int] = []
        get, make, start, last = self.words.get, self.word, True, 0
        for line in text.split("\n"):
            start, last = True, 0
            lines.append(len(tokens))
            for w in line.split():
                core, kind, h, cased, ends = get(w) or make(w)
                if not core:
                    start = start or ends
                    continue
                if start:
                    sentences.append(len(tokens))
                if kind:
                    kind = NUM
                elif last == NUM and core.lower() in UNITS:
                    kind = UNIT
                elif cased and not start and len(core) > 1:
                    kind = NAME
                if kind == NAME and last == NAME:
                    slots[-1] = (slots[-1][0], slots[-1][1] + " " + core)
                elif kind:
                    slots.append((len(tokens), core.lower() if kind != NAME else core))
                    tokens.append(kind)
                else:
                    tokens.append(h)
                start, last = ends, 0 if ends and kind == NAME else kind
        return np.array(tokens, np.uint64), slots, np.array(sentences, np.int64), np.array([*lines, len(tokens)])


def window_hashes(tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of `size` tokens, and whether literal tokens enough are in it."""
    n = len(tokens) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    h = np.full(n, 0x9E3779B97F4A7C15 + size, np.uint64)
    literal = np.zeros(n, np.int64)
    for k in range(size):
        t = tokens[k : k + n]
        h = (h ^ (t * np.uint64(0xBF58476D1CE4E5B9))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        literal += t > 3
    return h.view(np.int64), literal >= min(LITERALS, size)


def with_values(tokens: np.ndarray, slots: list[tuple[int, str]]) -> np.ndarray:
    """The tokens with slots' values in place of placeholders."""
    out = tokens.copy()
    for at, value in slots:
        out[at] = 1 << 40 | zlib.crc32(value.lower().encode("utf-8", "surrogatepass")) << 2 | 4
    return out


SCHEMA = "id long, row long, at int, hash long, keys array<string>, vals array<string>"


def windows(rows: DataFrame, sizes: tuple[int, ...], known: np.ndarray | None, whole: bool = False) -> DataFrame:
    """Windows of (id, text) as SCHEMA: `row` numbers the rows, `vals` are its slot values in order, `keys` the slot kinds.

    `sizes`: lengths of windows. `known`: sorted hashes to keep, or all. `whole`: texts shorter than
    WINDOW are one window of their length instead. Windows of placeholders alone have their values
    hashed too; with `whole` only where a text has no others, else they are left out. Windows shorter
    than WINDOW have their values hashed, and begin sentences or are whole lines.
    """
    shared = rows.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def found(canon: Canon, text: str) -> Iterator[tuple]:
        tokens, slots, sentences, lines = canon(text)
        where = [s[0] for s in slots]
        for size in sizes if not (whole and 0 < len(tokens) < WINDOW) else (len(tokens),):
            if size < WINDOW:
                h = window_hashes(with_values(tokens, slots), size)[0]
                ok = np.zeros(len(h), bool)
                first = sentences if size >= SHORT else np.intersect1d(lines, lines - size)  # where a line begins, and one `size` tokens later
                ok[first[first < len(h)]] = True
            else:
                h, ok = window_hashes(tokens, size)
                if not ok.all() and not (whole and ok.any()):
                    h = np.where(ok, h, window_hashes(with_values(tokens, slots), size)[0])
                    ok[:] = True
            at = np.flatnonzero(ok)
            if shared is not None and len(at):
                keep = np.searchsorted(shared.value, h[at])
                at = at[shared.value[np.minimum(keep, len(shared.value) - 1)] == h[at]] if len(shared.value) else at[:0]
            if len(at):
                first, last = np.searchsorted(where, at), np.searchsorted(where, at + size)
                for a, i, j in zip(at.tolist(), first.tolist(), last.tolist()):
                    yield a, int(h[a]), size, [s[1] for s in slots[i:j]]

    def make():
        canon = Canon()
        row = TaskContext.get().partitionId() << 33

        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            nonlocal row
            cols: list[list] = [[], [], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at, h, size, vals in found(canon, text or ""):
                    for c, v in zip(cols, (key, row, at, h, [str(size)], vals)):
                        c.append(v)
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "row", "at", "hash", "keys", "vals"])

        return run

    return map_arrow(rows, make, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, consistency, literal): the items that documents hold.

    `literal`: every slot met its own value, so the passage is verbatim but for case and marks.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), doc_text()).filter("id is not null")
    index = durable(windows(items, (WINDOW,), None, whole=True))
    sizes = tuple(sorted(int(r[0]) for r in index.select(F.col("keys")[0]).distinct().collect()))  # at most WINDOW values
    hashes = index.select("hash").distinct()
    known = None
    if hashes.count() <= FILTER_MOST:
        known = np.sort(hashes.toPandas()["hash"].to_numpy(np.int64))
    found = durable(windows(docs.select(F.col("doc_id").cast("long").alias("id"), doc_text()), sizes or (WINDOW,), known))
    there = found.select("row", "hash").distinct()
    parts = durable(index.select(F.col("id").alias("item_id"), "hash").distinct())
    ranked = parts.join(parts.groupBy("hash").agg(F.count(F.lit(1)).alias("items")), "hash")
    own = Window.partitionBy("item_id")
    ranked = ranked.select("item_id", "hash", F.row_number().over(own.orderBy("items", "hash")).alias("k"), F.count(F.lit(1)).over(own).alias("of"))
    rare = durable(ranked.filter(F.col("k") <= F.col("of") - F.ceil(F.lit(COVER) * F.col("of")) + 1).select("item_id", "hash", "of"))
    small = lambda df: F.broadcast(df) if known is not None and df.count() <= FILTER_MOST else df
    pairs = durable(there.join(small(rare), "hash").select("row", "item_id", "of").distinct())
    hits = pairs.join(small(parts), "item_id").join(there, ["row", "hash"])
    cover = hits.groupBy("row", "item_id", "of").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= COVER * F.col("of"))
    cover = durable(cover.select("row", "item_id", "of", (F.col("hits") / F.col("of")).alias("coverage")))
    met = cover.join(index.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "hash", F.col("vals").alias("item_vals")), "item_id")
    met = met.join(found.select("row", F.col("at").alias("doc_at"), "hash", F.col("vals").alias("doc_vals")), ["row", "hash"])
    # Occurrences: all of the row, windows of one shift, and those of shifts close together, in two grids.
    shift, wide = F.col("doc_at") - F.col("item_at"), F.greatest(F.col("of") / 2, F.lit(2.0))
    group = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("long").alias("shift"))
    groups = F.array(group(0, F.lit(0)), group(1, shift), group(2, F.floor(shift / wide)), group(3, F.floor(shift / wide + 0.5)))
    met = durable(met.select("row", "item_id", "of", "hash", "item_vals", "doc_vals", F.explode(groups).alias("where")))
    by = ["row", "item_id", "where"]
    whole = met.groupBy(*by, "of").agg(F.countDistinct("hash").alias("hits")).filter(F.col("hits") >= COVER * F.col("of"))
    slots = met.select(*by, F.explode(F.arrays_zip("item_vals", "doc_vals")).alias("s")).select(*by, F.col("s.item_vals").alias("i"), F.col("s.doc_vals").alias("d")).distinct()
    slots = slots.groupBy(*by).agg((F.countDistinct("i") / F.count(F.lit(1))).alias("consistency"), (F.count_if(F.col("i") == F.col("d")) >= F.countDistinct("i")).alias("literal"))
    both = whole.join(slots, by, "left").select(*by, F.coalesce("consistency", F.lit(1.0)).alias("consistency"), F.coalesce("literal", F.lit(True)).alias("literal"))
    held = both.filter((F.col("consistency") >= CONSISTENT) | F.col("literal") & (F.col("where.kind") > 0)).groupBy("row", "item_id").agg(F.max("consistency").alias("consistency"), F.max("literal").alias("literal"))
    of_row = found.select("row", F.col("id").alias("doc_id")).distinct()
    out = cover.join(held, ["row", "item_id"]).join(of_row, "row")
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("coverage", "consistency", "literal")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows that hold an item of the benchmark. `docs` must give its rows in the same order each time, as files do."""
    # The columns travel as one, so none of theirs can clash with those made here.
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.struct("*").alias("row"))
    bad = durable(contaminated(rows.select(F.col("place").alias("doc_id"), "row.text"), benchmark).select(F.col("doc_id").alias("place")).distinct())
    few = F.broadcast(bad) if bad.count() <= FEW_IDS else bad
    return rows.join(few, "place", "left_anti").select("row.*")
