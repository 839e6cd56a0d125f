"""Quality classifier by co-training of two views.

The text view sees which words a document has, the marks stuck to them, how much of it is marks and
how often words repeat; the metadata view sees its source, language, length and the layout of its
characters and lines, never a word or a mark. Both are logistic models; the text view of a head has the
words that labelled rows with and without the fault hold unlike often, whatever their number. Starting from
labelled rows, in each round either view looks at all documents without a label and names those that it is surest of, and the
other view learns from those. Then each view is calibrated on labelled rows that neither learned
from, and a last logistic model over both calibrated views scores all documents. The same is done
twice: for low quality and for toxic text. `keep` is false where either is the likelier.

How it runs: at most LABELLED labelled documents, chosen by a hash of doc_id (of rows that share one, the one
whose text has the least hash), are what the first models learn from. Their words are counted on the
executors, and only those that tell come to the driver, at most WORDS for a head, which is the size of the model. What
the two views see of every document is written once, some hundred bytes a row; each round
reads that table, not the texts. A task keeps the TEACH surest rows for each head, view and label, and the
surest of all tasks come to the driver: different ones, so copies teach once.

Defined cases: null text counts as empty, null metadata as a value of its
own. Labels with nulls are left out; several labels of a document count as their greatest. Without
labels of both values a head can't be fitted: quality is then 1 and toxicity 0. Of equally sure documents those of the least
hash teach. Repeated rows give
repeated scores; an empty table gives none; long texts are read whole. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_arrow

LABELLED = 4000
#: Words of a head: those that labelled rows of both kinds hold unlike often, by so many standard errors.
WORDS, LEAST_DOCS, UNLIKE, CACHE = 3000, 3, 4.0, 200_000
#: Rounds; how sure a view must be; documents that it names at most in a round, for each label.
ROUNDS, SURE, TEACH = 4, 0.95, 200
MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
META = 10 + 64
#: Levels that the shares of marks, bars, repeated words and doubled words are told apart by in the text view.
LEVELS = 80
#: A document goes where either fault is at least so likely: clean ones in doubt stay.
REJECT = 0.6
_KIND = np.zeros(256, np.int64)  # 0 other letters, then upper, digit, white space, mark, new line, not ASCII
for _lo, _hi, _k in ((65, 91, 1), (48, 58, 2), (9, 14, 3), (32, 33, 3), (33, 48, 4), (58, 65, 4), (91, 97, 4), (123, 127, 4), (10, 11, 5), (128, 256, 6)):
    _KIND[_lo:_hi] = _k


def marks_of(word: bytes) -> tuple[int, ...]:
    """Hashes of a word without the marks around it, and of those marks."""
    core = word.strip(MARKS)
    out = (zlib.crc32(core),) if core else ()
    tail = word[len(word.rstrip(MARKS)) :] if core else word[:8]
    return (*out, zlib.crc32(b"\x00" + tail[:8])) if tail else out


def levels(raw: bytes, words: list[bytes]) -> list[int]:
    """Hashes of how much of a text is marks, and how much its words repeat: one for each level that is reached."""
    n, many = max(len(raw), 1), len(words) or 1
    marks = len(raw) - len(raw.translate(None, MARKS))
    shares = (marks / n * 4, raw.count(b"|") / n * 10, 1 - len(set(words)) / many, sum(map(eq, words, words[1:])) / many * 2)
    return [zlib.crc32(b"\x01%d:%d" % (k, level)) for k, x in enumerate(shares) for level in range(1, min(int(x * LEVELS), LEVELS) + 1)]


def word_hashes(raw: bytes) -> np.ndarray:
    words = raw.lower().split()
    return np.unique(np.fromiter((h for w in set(words) for h in marks_of(w)), np.int64).tolist() + levels(raw, words)).astype(np.int64)


def layout(raw: bytes, lang: str | None, source: str | None) -> np.ndarray:
    """The metadata view of a document."""
    n = len(raw)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    kinds = np.bincount(_KIND, weights=byte, minlength=7)
    share = kinds / max(n, 1)
    gaps, lines = kinds[3] + kinds[5], kinds[5] + 1
    x = np.zeros(META, np.float32)
    x[:10] = (1, math.log1p(n) / 10, share[1] * 4, share[2] * 10, share[3] * 4, share[6] * 4, math.log1p(n / lines) / 6, math.log1p(n / (gaps + 1)) / 2, math.log1p(lines) / 5, float(n == 0))
    x[10 + zlib.crc32(("l" + (lang or "\x00")).encode()) % 32] = 0.3
    x[42 + zlib.crc32(("s" + (source or "\x00")).encode()) % 32] = 0.3
    return x


def logistic(x: np.ndarray, y: np.ndarray, epochs: int, rate: float, decay: float, seed: int = 0) -> np.ndarray:
    """Weights by stochastic gradient descent with per-weight steps; classes weigh alike. x has a constant column."""
    rng = np.random.default_rng(seed)
    w, seen = np.zeros(x.shape[1], np.float32), np.full(x.shape[1], 1e-3, np.float32)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 64):
            at = order[lo : lo + 64]
            xb = x[at].astype(np.float32)
            g = xb.T @ ((sigmoid(xb @ w) - y[at]) * weight[at]) / len(at) + decay * w
            seen += g * g
            w -= rate * g / np.sqrt(seen)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Slopes for the columns of z and an offset, by damped Newton steps under a slight pull to zero."""
    a = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ w)
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.eye(len(w)) * 0.5
        d = np.linalg.solve(hess, a.T @ (p - y) + 0.5 * w)
        w -= d / max(1.0, np.abs(d).max())
        if np.abs(d).max() < 1e-6:
            break
    return w


def telling(words: DataFrame, target: str, rows: int, ones: int) -> list[int]:
    """Hashes of the words that tell rows with the target from those without, the most telling first; words: (hash, n, and for the target in how many of its rows)."""
    n1, n0 = max(ones, 1), max(rows - ones, 1)
    p = F.col("n") / (n1 + n0)
    z = F.abs(F.col(target) / n1 - (F.col("n") - F.col(target)) / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    best = words.filter(F.col("n") >= LEAST_DOCS).withColumn("z", z).filter(F.col("z") >= UNLIKE).orderBy(F.desc("z"), "hash").limit(WORDS)
    return [r.hash for r in best.select("hash").collect()]


class Head:
    """One fault's two views: their labelled rows, what they have been taught, and their models."""

    HOW = ((12, 0.15, 1e-4), (12, 0.2, 1e-4))

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, own: np.ndarray):
        self.held = np.arange(len(y)) % 4 == 3
        self.rows, self.y, self.own = (text[:, own], meta), y, own
        self.taught: list[dict[int, tuple[np.ndarray, float]]] = [{}, {}]
        self.fits = min(y[self.held].sum(), (1 - y[self.held]).sum(), y[~self.held].sum(), (1 - y[~self.held]).sum()) >= 1

    def train(self) -> None:
        self.models = []
        for x, extra, how in zip(self.rows, self.taught, self.HOW):
            more = [extra[k] for k in sorted(extra)]
            x = np.concatenate([x[~self.held], *[v[None] for v, _ in more]])
            self.models.append(logistic(x, np.concatenate([self.y[~self.held], [label for _, label in more]]).astype(np.float32), *how))

    def wide(self) -> np.ndarray:
        """The text view's weights over the words of both heads."""
        out = np.zeros(len(self.own), np.float32)
        out[self.own] = self.models[0]
        return out

    def sure(self) -> list[np.ndarray]:
        """Slope and offset of each view, on the rows that it learned from."""
        return [platt((x[~self.held].astype(np.float32) @ w)[:, None], self.y[~self.held]) for x, w in zip(self.rows, self.models)]

    def result(self) -> dict:
        z = np.column_stack([x[self.held].astype(np.float32) @ w for x, w in zip(self.rows, self.models)])
        cals = [platt(z[:, [v]], self.y[self.held]) for v in (0, 1)]
        both = np.column_stack([z[:, v] * c[0] + c[1] for v, c in enumerate(cals)])
        return {"text": self.wide(), "meta": self.models[1], "cals": cals, "both": platt(both, self.y[self.held])}


def dense(ids: list[np.ndarray], size: int) -> np.ndarray:
    """Rows of ones at the ids, and in a last column."""
    x = np.zeros((len(ids), size + 1), np.int8)
    x[:, -1] = 1
    for row, at in enumerate(ids):
        x[row, at] = 1
    return x


NAMED = "head string, view int, label double, p double, key long, ids array<int>, meta array<float>"


def surest(pool: DataFrame, heads: dict[str, Head], size: int) -> list:
    """For each head, view and label the TEACH documents of the pool (key, ids, meta) that the view is surest of, as rows of NAMED."""
    models = {name: (h.wide(), h.models[1], h.sure()) for name, h in heads.items()}
    names = [x.split()[0] for x in NAMED.split(", ")]

    def run(batches):
        held: dict[tuple, dict[int, tuple]] = {}  # by key: how sure, ids, meta
        least: dict[tuple, float] = {}  # how sure one must be to get in
        for batch in batches:
            keys, meta = batch["key"].to_numpy(), batch["meta"].values.to_numpy()[batch["meta"].offset * META :].reshape(-1, META)
            ends = batch["ids"].offsets.to_numpy()
            ids, row = batch["ids"].values.to_numpy()[ends[0] : ends[-1]], np.repeat(np.arange(len(keys)), np.diff(ends))
            ends = ends - ends[0]
            for name, (text, other, cals) in models.items():
                for v, z in enumerate((np.bincount(row, text[ids], len(keys)) + text[-1], meta @ other)):
                    p = sigmoid(z * cals[v][0] + cals[v][1])
                    for label, close in ((1.0, p), (0.0, 1 - p)):
                        group = (name, v, label)
                        best, at = held.setdefault(group, {}), np.flatnonzero(close >= least.get(group, SURE))
                        for i in at[np.lexsort((keys[at], -close[at]))][:TEACH].tolist():
                            if int(keys[i]) not in best:
                                best[int(keys[i])] = (float(close[i]), ids[ends[i] : ends[i + 1]].copy(), meta[i].copy())
                        if len(best) > TEACH:
                            held[group] = best = dict(sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:TEACH])
                            least[group] = min(x[0] for x in best.values())
        out = [(*group, p, key, ids, meta) for group, best in held.items() for key, (p, ids, meta) in best.items()]
        if out:
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    group = ("head", "view", "label")
    named = pool.mapInArrow(run, NAMED).dropDuplicates([*group, "key"])
    order = Window.partitionBy(*group).orderBy(F.desc("p"), "key")
    return named.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= TEACH).drop("n").collect()


def seen_by_views(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """doc_id, key (a hash of what follows), ids (places in vocab of the words that a document has) and meta, of every document."""
    at = {int(h): i for i, h in enumerate(vocab)}
    shared = docs.sparkSession.sparkContext.broadcast(at)  # at most 2 * WORDS

    def make():
        look = Lookup(shared.value)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            meta = [layout(r, a, b) for r, a, b in zip(raws, batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            ids = [look(r).astype(np.int32) for r in raws]
            keys = [int.from_bytes(hashlib.blake2b(a.tobytes() + b.tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(ids, meta)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(meta, pa.list_(pa.float32()))], names=["doc_id", "key", "ids", "meta"])

        return run

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string"), F.col("source").cast("string")), make, "doc_id long, key long, ids array<int>, meta array<float>")


def word_table(docs: DataFrame) -> DataFrame:
    """doc_id and the hashes of its different words, made on the executors."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [word_hashes((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], names=["doc_id", "words"])

        return run

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, words array<long>")


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Heads `bad` (low quality) and `toxic`, either None, and the words that the text view knows."""
    return fitted(docs, labels)[0]


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[dict, DataFrame | None]:
    """The model of `fit`, and what its views have seen of every document (None if no head could be fitted)."""
    spark = docs.sparkSession
    order = F.xxhash64("doc_id", F.lit("quality"))
    truth = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    answers = {r.doc_id: (r.quality, r.toxic) for r in truth.orderBy(order, "doc_id").limit(LABELLED).collect()}
    wanted = spark.createDataFrame([(d,) for d in answers], "doc_id long")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).alias("row")).join(F.broadcast(wanted), "doc_id", "left_semi")
    once = durable(chosen.groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("doc_id", "row.*"))  # a row each, of at most LABELLED
    labelled = sorted(r.doc_id for r in once.select("doc_id").collect())
    y = np.array([answers[d] for d in labelled], np.float32).reshape(-1, 2)
    targets = {"bad": 1 - np.minimum(y[:, 0], 1), "toxic": np.minimum(y[:, 1], 1)}
    learn = [i for i in range(len(labelled)) if i % 4 != 3]
    said = spark.createDataFrame([(labelled[i], *(int(t[i]) for t in targets.values())) for i in learn], "doc_id long, bad int, toxic int")
    each = word_table(once).join(F.broadcast(said), "doc_id").select(F.explode("words").alias("hash"), "bad", "toxic")
    words = durable(each.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"), F.sum("toxic").alias("toxic")))
    known = {name: np.array(telling(words, name, len(learn), int(t[learn].sum())), np.int64) for name, t in targets.items()}
    vocab = np.unique(np.concatenate(list(known.values())))

    mine = {r.doc_id: (np.array(r.ids, np.int64), np.array(r.meta, np.float32)) for r in seen_by_views(once, vocab).select("doc_id", "ids", "meta").collect()}
    text = dense([mine[d][0] for d in labelled], len(vocab))
    meta = np.stack([mine[d][1] for d in labelled]) if labelled else np.zeros((0, META), np.float32)
    heads = {name: Head(text, meta, t, np.append(np.isin(vocab, known[name]), True)) for name, t in targets.items()}
    some = {name: h for name, h in heads.items() if h.fits}
    every = None
    if some:
        every = durable(seen_by_views(docs, vocab))
        # documents with labels don't teach; a row without an id has none
        pool = durable(every.filter("doc_id is not null").join(truth.select("doc_id"), "doc_id", "left_anti").unionByName(every.filter("doc_id is null")).select("key", "ids", "meta"))
        for turn in range(ROUNDS):
            for h in some.values():
                h.train()
            if turn == ROUNDS - 1:
                break
            for r in surest(pool, some, len(vocab)):
                h = some[r["head"]]
                row = dense([np.array(r.ids, np.int64)], len(vocab))[0][h.own] if r["view"] == 1 else np.array(r.meta, np.float32)
                h.taught[1 - r["view"]].setdefault(r.key, (row, r.label))
    return {"vocab": vocab, "heads": {name: h.result() if h.fits else None for name, h in heads.items()}}, every


class Lookup:
    """Places of a text's words in a vocabulary; what a word means is looked up once."""

    def __init__(self, at: dict[int, int]):
        self.at, self.words = at, {}

    def __call__(self, raw: bytes) -> np.ndarray:
        if len(self.words) > CACHE:
            self.words.clear()
        ids = set()
        words = raw.lower().split()
        for w in set(words):
            k = self.words.get(w)
            if k is None:
                k = tuple(self.at[h] for h in marks_of(w) if h in self.at)
                if len(w) < 64:
                    self.words[w] = k
            if k:
                ids.update(k)
        ids.update(self.at[h] for h in levels(raw, words) if h in self.at)
        return np.fromiter(sorted(ids), np.int64, len(ids))


class Scorer:
    """Scores of one document after another."""

    def __init__(self, model: dict):
        self.heads, self.look = model["heads"], Lookup({int(h): i for i, h in enumerate(model["vocab"])})

    def __call__(self, text: str | None, lang: str | None, source: str | None) -> tuple[float, ...]:
        """P(low quality), P(toxic), and both views of either."""
        raw, out = (text or "").encode("utf-8", "surrogatepass"), []
        at, meta = self.look(raw), layout(raw, lang, source)
        for name in ("bad", "toxic"):
            h = self.heads[name]
            if h is None:
                out.append((0.0, 0.0, 0.0))
                continue
            z = [float(h["text"][at].sum() + h["text"][-1]), float(meta @ h["meta"])]
            cal = [z[v] * c[0] + c[1] for v, c in enumerate(h["cals"])]
            out.append((float(sigmoid(cal[0] * h["both"][0] + cal[1] * h["both"][1] + h["both"][2])), float(sigmoid(cal[0])), float(sigmoid(cal[1]))))
        return out[0][0], out[1][0], out[0][1], out[0][2]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, keep, quality_score, toxic_score, and the quality that either view sees."""

    def make():
        f = Scorer(model)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = np.array([f(*r) for r in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))])
            cols = [batch.column(0), pa.array((got[:, :2] < REJECT).all(axis=1)), *map(pa.array, (1 - got[:, 0], got[:, 1], 1 - got[:, 2], 1 - got[:, 3]))]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "keep", "quality_score", "toxic_score", "text_view", "metadata_view"])

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string"), F.col("source").cast("string"))
    return map_arrow(rows, make, "doc_id long, keep boolean, quality_score double, toxic_score double, text_view double, metadata_view double")


SCORES = "doc_id long, keep boolean, quality_score double, toxic_score double, text_view double, metadata_view double"


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """As `score` with the model of `fit`, in one reading less of the texts: from what the views have seen while it was fitted."""
    model, every = fitted(docs, labels)
    if every is None:
        return score(docs, model)

    def run(batches):
        for batch in batches:
            n, ends = batch.num_rows, batch["ids"].offsets.to_numpy()
            ids, row = batch["ids"].values.to_numpy()[ends[0] : ends[-1]], np.repeat(np.arange(n), np.diff(ends))
            meta, got = batch["meta"].values.to_numpy()[batch["meta"].offset * META :][: n * META].reshape(-1, META), []
            for name in ("bad", "toxic"):
                if (h := model["heads"][name]) is None:
                    got.append([np.zeros(n)] * 3)
                    continue
                z = np.bincount(row, h["text"][ids], n) + h["text"][-1], (meta @ h["meta"]).astype(np.float64)
                a, b = (z[v] * c[0] + c[1] for v, c in enumerate(h["cals"]))
                got.append([sigmoid(a * h["both"][0] + b * h["both"][1] + h["both"][2]), sigmoid(a), sigmoid(b)])
            (bad, text, other), (toxic, *_) = got
            cols = [batch["doc_id"], (bad < REJECT) & (toxic < REJECT), 1 - bad, toxic, 1 - text, 1 - other]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=[x.split()[0] for x in SCORES.split(", ")])

    return every.select("doc_id", "ids", "meta").mapInArrow(run, SCORES)


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of `docs` that the classifier keeps, with all their columns; nothing is shuffled."""
    k = [docs.columns.index(c) for c in ("text", "lang", "source")]

    def make():
        f = Scorer(model)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [f(*r)[:2] for r in zip(*(batch.column(i).to_pylist() for i in k))]
            return batch.filter(pa.array([max(g) < REJECT for g in got]))

        return run

    return map_arrow(docs, make, docs.schema)
