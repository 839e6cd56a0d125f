"""Phrase collocation mining by hierarchical pair naming.

Level 1 names words: each frequent word of a language gets an id. Level k names k-grams: where two
(k-1)-grams stand at neighbouring places (they overlap in all but one word) and both have names, the
pair of names is counted, and pairs that are frequent enough get ids of their own. A phrase can't be
more frequent than its parts, so nothing is lost by naming frequent ones alone. A named k-gram is a
pair (left, right) of names, and these are its parent pointers: all but its last word, and all but its
first. Cuts of a phrase and the shorter phrases inside it are found by following them, without texts:
of a phrase x = (p, q), p is what stands before its last word and q what stands after its first, and
exactly p and q are the phrases of one word less that lie inside it.

How it runs: texts are cut into chunks of some 4 MB, and a chunk keeps, for each language, its
different words and its text as places in that list, in a Parquet table in the shared folder, of row
groups of a few chunks, so that a task holds these and not its whole file. Each level then exchanges a chunk's different words (or pairs) with their counts, not their occurrences:
they are summed up by key, the frequent ones are named in a durable table, and the chunks get the names
of theirs back by a join on the key. Both are plain shuffles, so a word that every chunk has is no
more than a row a chunk, and is split where it is hot. The last level needs no names and is counted alone.

Exactness: names are row ids, not hashes; scores are whole numbers of up to 38 digits.

Defined cases: null text is empty, null lang is `und` (and joins those called so). A-Z alone is put
into lower case. Words are bytes, not letters: any other character, control characters too, is part of
a word. Repeated rows count as often as they stand. Ties in score and count go to the phrase whose
bytes come first. Empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, shared_folder

LEAST, LONGEST, COVERED, TOP = 10, 3, 50, 2000
#: Bytes of text in a chunk; a longer text is a chunk alone.
CHUNK = 4 << 20
#: Chunks in a row group of a table: readers and writers hold a row group at once, with each of a file's columns.
#: Words and names differ from one to the next, so dictionaries would only be tried and given up.
ROWS = 4
STORED = {"compression": "zstd", "parquet.block.row.count.limit": str(ROWS), "parquet.page.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}

_FROM = bytes(range(65, 91)) + b"\t" + b".,;:!?\n\v\f\r"
_TO = bytes(range(97, 123)) + b" " + b"\n" * 10
#: A-Z to lower case, a tab to a space, and what ends a piece to a line feed.
TABLE = bytes.maketrans(_FROM, _TO)


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The different words of texts, and the texts as places in that list, -1 where a piece ends."""
    whole = b" \n ".join(x.translate(TABLE).replace(b"\n", b" \n ") for x in texts)
    words = pc.split_pattern(pa.array([whole], pa.large_binary()), b" ").flatten()
    coded = words.filter(pc.not_equal(words, pa.scalar(b"", words.type))).dictionary_encode()
    places, different = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary
    end = pc.index(different, pa.scalar(b"\n", different.type)).as_py()
    if end >= 0:
        different = pa.concat_arrays([different[:end], different[end + 1 :]])
        places = np.where(places == end, -1, places - (places > end)).astype(np.int32)
    return different, places


CHUNKS = "chunk long, lang string, words array<binary>, counts array<int>, places binary"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    size, n = 0, TaskContext.get().partitionId() << 33

    def told() -> Iterator[pa.RecordBatch]:
        nonlocal size, n
        for lang in list(held):
            words, places = words_of(held.pop(lang))
            counts = np.bincount(places[places >= 0], minlength=len(words)).astype(np.int32)
            rows = [pa.array([n], pa.int64()), pa.array([lang]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary())), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(counts))]
            yield pa.RecordBatch.from_arrays([*rows, pa.array([places.tobytes()], pa.binary())], ["chunk", "lang", "words", "counts", "places"])
        size, n = 0, n + 1

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= CHUNK:
                yield from told()
    yield from told()


class Folder:
    """Intermediate tables in the shared folder, each dropped when it isn't read any more."""

    def __init__(self, spark):
        self.spark, self.path = spark, f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.options(**STORED).parquet(f"{self.path}/{name}")
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def named(counts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(id, *keys, f) of the keys that occur often enough; counts: (*keys, n). Durable, so that an id is given once."""
    f = counts.groupBy(*keys).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    return durable(f.select(F.monotonically_increasing_id().alias("id"), *keys, "f"))


NAMED = "chunk long, lang string, names array<long>, places binary"


def _name_words(key: tuple, chunk: pa.Table, names: pa.Table) -> pa.Table:
    """A chunk with the names of its words instead of the words; places of words without one are -1, and so is what can't be next to another."""
    places = np.frombuffer(chunk["places"][0].as_py(), np.int32)
    at, ids = names["place"].to_numpy(), names["id"].to_numpy()
    new = np.full(chunk["n"][0].as_py() + 1, -1, np.int32)  # the last is for -1
    new[at] = np.arange(len(at))
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()]), pa.array([ids], pa.list_(pa.int64())), pa.array([squeezed(new[places]).tobytes()], pa.binary())], ["chunk", "lang", "names", "places"])


def squeezed(places: np.ndarray) -> np.ndarray:
    """Places without what has no neighbour: runs of -1 become one."""
    return places[(places >= 0) | (np.append(places[1:], -1) >= 0)] if len(places) else places


def pairs(places: np.ndarray) -> np.ndarray:
    """left << 32 | right at each place but the last; -1 where either is missing."""
    left, right = places[:-1].astype(np.int64), places[1:]
    return np.where((left >= 0) & (right >= 0), left << 32 | right, -1)


def different_pairs(names: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The names of the different pairs, and how often each is there."""
    there = (places[:-1] >= 0) & (places[1:] >= 0)
    codes = places[:-1][there].astype(np.int64)
    codes <<= 32
    codes |= places[1:][there]
    codes, counts = np.unique(codes, return_counts=True)
    return names[codes >> 32], names[codes & 0xFFFFFFFF], counts


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            left, right, counts = different_pairs(batch["names"][i].values.to_numpy(), np.frombuffer(batch["places"][i].as_py(), np.int32))
            n = len(left)
            for at in range(0, n, 1 << 18):
                s = slice(at, at + (1 << 18))
                m = len(left[s])
                yield pa.RecordBatch.from_arrays([pa.array(left[s]), pa.array(right[s]), pa.array(counts[s]), pa.array(np.full(m, batch["chunk"][i].as_py())), pa.array([batch["lang"][i].as_py()] * m, pa.string())], ["l", "r", "n", "chunk", "lang"])


COUNTED = "l long, r long, n long, chunk long, lang string"


def _name_pairs(key: tuple, chunk: pa.Table, found: pa.Table) -> pa.Table:
    """A chunk with the names of its pairs instead of those of its words."""
    words, places = chunk["names"].combine_chunks().flatten().to_numpy(), np.frombuffer(chunk["places"][0].as_py(), np.int32)
    order = np.argsort(words)
    place_of = lambda ids: order[np.searchsorted(words, ids, sorter=order)].astype(np.int64)
    ids, left, right = (found[c].to_numpy() for c in ("id", "l", "r"))
    if not len(ids):
        ids, new = np.array([], np.int64), np.array([], np.int32)
    else:
        codes = place_of(left) << 32 | place_of(right)
        by_code = np.argsort(codes)
        codes, ids, at = codes[by_code], ids[by_code], pairs(places)
        i = np.minimum(np.searchsorted(codes, at), len(codes) - 1)
        new = np.where(codes[i] == at, i, -1).astype(np.int32)
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()]), pa.array([ids], pa.list_(pa.int64())), pa.array([squeezed(new).tobytes()], pa.binary())], ["chunk", "lang", "names", "places"])


def levels(docs: DataFrame, least: int, folder: Folder) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(lang, n) word counts; named words (id, lang, word, f); and for 2, 3, ... words named pairs (id, l, r, f)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    chunks = folder.put(texts.mapInArrow(_encode, CHUNKS), "words")
    of = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select("chunk", "lang", "place", F.col("x.words").alias("word"), F.col("x.counts").cast("long").alias("n"))
    totals = durable(of.groupBy("lang").agg(F.sum("n").alias("n")))
    words = named(of.select("lang", "word", "n"), ["lang", "word"], least)
    back = of.select("chunk", "lang", "word", "place").join(words.select("lang", "word", "id"), ["lang", "word"]).select("chunk", "lang", "place", "id")
    rows = folder.get("words").select("chunk", "lang", F.size("words").alias("n"), "places")
    table, out = folder.put(rows.groupBy("chunk", "lang").cogroup(back.groupBy("chunk", "lang")).applyInArrow(_name_words, NAMED), "names1"), []
    folder.drop("words")
    for k in range(2, LONGEST + 1):
        counted = table.mapInArrow(_count_pairs, COUNTED)
        # a chunk has a pair once: there is next to nothing to combine before the shuffle, and trying to would fill memory
        out.append(named(counted.select("l", "r", "n").repartition("l", "r"), ["l", "r"], least))
        if k < LONGEST:
            back = counted.select("l", "r", "chunk", "lang").join(out[-1].select("l", "r", "id"), ["l", "r"]).select("chunk", "lang", "l", "r", "id")
            rows = folder.get(f"names{k - 1}")
            table = folder.put(rows.groupBy("chunk", "lang").cogroup(back.groupBy("chunk", "lang")).applyInArrow(_name_pairs, NAMED), f"names{k}")
        folder.drop(f"names{k - 1}")
    return totals, words, out


def named_phrases(words: DataFrame, named_pairs: list[DataFrame]) -> list[DataFrame]:
    """For 2, 3, ... words: (id, l, r, f, lang, phrase, heads, tails), durable.

    heads has the counts of a phrase's first 1, 2, ... words, tails those of its last 1, 2, ...; both come
    from its parents, the left one's heads and the right one's tails, and end with its own.
    """
    at, out = words.select("id", "lang", F.col("word").cast("string").alias("phrase"), F.array("f").alias("heads"), F.array("f").alias("tails")), []
    for table in named_pairs:
        left = at.select(F.col("id").alias("l"), "lang", F.col("phrase").alias("first"), "heads")
        right = at.select(F.col("id").alias("r"), F.substring_index("phrase", " ", -1).alias("last"), "tails")
        own = F.array("f")
        both = table.join(left, "l").join(right, "r").select("id", "l", "r", "f", "lang", F.concat_ws(" ", "first", "last").alias("phrase"), F.concat("heads", own).alias("heads"), F.concat("tails", own).alias("tails"))
        out.append(at := durable(both))
    return out


#: The cut of the lowest score, and of those the first. Counts up to 10^16 stay within 38 digits.
_WIDE = "cast({} AS DECIMAL(38, 0))".format
LOWEST_CUT = f"""array_min(transform(sequence(1, size(heads) - 1), k -> named_struct(
  'score', ({_WIDE("f")} * {_WIDE("f")} * {_WIDE("1000000")}) div ({_WIDE("heads[k - 1]")} * {_WIDE("tails[size(heads) - k - 1]")}), 'k', k, 'l', heads[k - 1], 'r', tails[size(heads) - k - 1])))"""


def candidates(phrases: list[DataFrame], covered: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that no longer one covers.

    If a phrase of several words more covers one, a part of that with one word more does too, being no
    rarer; so it is enough to ask the children: what has the phrase as its left or right parent.
    """
    out = []
    for table, longer in zip(phrases, [*phrases[1:], None], strict=True):
        if longer is not None:
            most = longer.select(F.col("l").alias("id"), "f").unionByName(longer.select(F.col("r").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("most"))
            table = table.join(most, "id", "left").filter(f"most IS NULL OR {_WIDE('most')} * 100 < {_WIDE('f')} * {covered}")
        out.append(table.withColumn("cut", F.expr(LOWEST_CUT)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score", "id"))
    return reduce(DataFrame.unionByName, out)


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    folder = Folder(docs.sparkSession)
    totals, words, named_pairs = levels(docs, least, folder)
    folder.drop()
    phrases = named_phrases(words, named_pairs)
    found = candidates(phrases, covered)
    # A language's best are chosen among the best of its shares, of about as many rows as there are shares' winners.
    shares = max(1, int((sum(p.count() for p in phrases) / top) ** 0.5))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    found = found.withColumn("share", F.pmod(F.xxhash64("id", "phrase"), F.lit(shares)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT rid, lang, unnest(string_split_regex(x, '[.,;:!?
-
]')) AS y, generate_subscripts(string_split_regex(x, '[.,;:!?
-
]'), 1) AS i FROM d),
v AS (SELECT lang, list_filter(string_split_regex(y, '[ 	]+'), lambda z: z <> '') AS ws FROM p),
w AS (SELECT lang, unnest([[ws[i]] for i in range(1, len(ws) + 1)]) AS g FROM v UNION ALL SELECT lang, unnest([[ws[i], ws[i + 1]] for i in range(1, len(ws))]) FROM v UNION ALL SELECT lang, unnest([[ws[i], ws[i + 1], ws[i + 2]] for i in range(1, len(ws) - 1)]) FROM v),
f AS MATERIALIZED (SELECT lang, g, count(*) AS a FROM w GROUP BY lang, g HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM v GROUP BY lang),
c AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) >= 2),
s AS (SELECT c.lang, c.g, c.a, c.k, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
o AS (SELECT lang, g[1:2] AS g, a FROM f WHERE len(g) = 3 UNION ALL SELECT lang, g[2:3], a FROM f WHERE len(g) = 3),
m AS (SELECT lang, g, max(a) AS most FROM o GROUP BY lang, g),
z AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.score FROM b LEFT JOIN m USING (lang, g) WHERE most IS NULL OR 100 * most < 50 * b.a)
SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang QUALIFY rank <= 2000"""
