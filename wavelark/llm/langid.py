"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Subwords are the 1- to 4-grams of a text's letters (other characters count as a gap), hashed into
BUCKETS; a text is the average of its subwords' embeddings, over the whole text. Embeddings and
softmax are trained together by stochastic gradient descent in numpy on the driver, on a sample of
about SAMPLE rows at most, PER_LANG of each language or an equal share where there are many (at least
one expected row of each), chosen by a hash. Only mini-batches are dense. A
fifth of the sample fits the softmax's temperature and the bound under which a prediction counts
as rejected: REJECT of the sample's right predictions fall below it.

Defined cases: text that is null or has no letter is `und` with score 0 and rejected. With nothing
to learn from, every row is. Repeated rows give repeated results; an empty table gives none; long
texts are read in blocks, whole. A null doc_id counts as an empty one when held-out rows are chosen,
and as the hash of the text when the sample is. Of languages that are equally likely the first by
name is predicted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, map_arrow

BUCKETS, DIM, ORDERS = 1 << 13, 16, (1, 2, 3, 4)
PER_LANG, SAMPLE = 600, 8000
EPOCHS, RATE, BATCH = 12, 4.0, 32
REJECT = 0.005
UNKNOWN = "und"
BLOCK = 1 << 17
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def subwords(text: str) -> np.ndarray:
    """How often each bucket occurs among the text's subwords; a gap comes before the text and after it."""
    out = np.zeros(BUCKETS, np.int64)
    is_letter, text, most = letters(), f" {text.lower()} ", max(ORDERS) - 1
    for lo in range(0, len(text), BLOCK):
        at = max(lo - most, 0)  # subwords that end in this block
        c = np.frombuffer(text[at : lo + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = is_letter[c]
        c = np.where(ok, c, np.uint32(32))
        for n in ORDERS:
            first = max(lo - n + 1, 0) - at
            m = len(c) - n + 1 - first
            if m < 1:
                continue
            h = np.full(m, n * 0x165667B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ c[first + k : first + k + m]) * _MULT[k]
                h ^= h >> np.uint32(15)
            starts = ok[first + (n > 1) : first + (n > 1) + m]  # a gap may come first, then a letter must follow
            out += np.bincount(h[starts] >> np.uint32(32 - 13), minlength=BUCKETS)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


Counts = tuple[np.ndarray, np.ndarray]


def averages(rows: list[Counts]) -> np.ndarray:
    """Dense averages of a few texts' (buckets, counts)."""
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (at, n) in enumerate(rows):
        x[i, at] = np.asarray(n, np.float32) / max(np.sum(n), 1)
    return x


def train(rows: list[Counts], y: np.ndarray, n_langs: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x languages: embeddings times softmax) and bias."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / np.sqrt(DIM), (BUCKETS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (DIM, n_langs)).astype(np.float32), np.zeros(n_langs, np.float32)
    total, done = EPOCHS * -(-len(rows) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), BATCH):
            some = order[lo : lo + BATCH]
            xb = averages([rows[i] for i in some])
            hidden = xb @ emb
            g = softmax(hidden @ soft + bias)
            g[np.arange(len(some)), y[some]] -= 1
            g /= len(some)
            rate = RATE * (1 - done / total)
            back = g @ soft.T
            soft -= rate * (hidden.T @ g)
            bias -= rate * 0.1 * g.sum(axis=0)
            emb -= rate * 20 * (xb.T @ back)  # averages are small numbers: their gradients need a longer step
            done += 1
    return emb @ soft, bias


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 0) -> dict | None:
    """A model from (lang, buckets, counts) of the sample; None without rows."""
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    counts, place = [r[1:] for r in rows], {x: i for i, x in enumerate(langs)}
    y = np.array([place[r[0]] for r in rows])
    check = np.arange(len(rows)) % 5 == 0 if len(rows) >= 50 else np.ones(len(rows), bool)
    learn = np.flatnonzero(check if check.all() else ~check)
    weights, bias = train([counts[i] for i in learn], y[learn], len(langs), seed)
    held = np.flatnonzero(check)
    z, want = np.concatenate([averages([counts[i] for i in held[lo : lo + BATCH]]) @ weights for lo in range(0, len(held), BATCH)]) + bias, y[held]
    heat = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0), key=lambda t: -np.log(softmax(z / t)[np.arange(len(want)), want] + 1e-12).mean())
    p = softmax(z / heat)
    right = p.max(axis=1)[p.argmax(axis=1) == want]
    bound = float(np.quantile(right, REJECT)) if len(right) else 1.0
    return {"langs": langs, "weights": weights.astype(np.float32), "bias": bias, "heat": heat, "bound": min(bound, 0.9)}


def _is_held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def sample(docs: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Subword counts of the training sample, read on the executors."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", doc_text()).filter(~_is_held_out() & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return []
    each = min(PER_LANG, max(1.0, SAMPLE / len(counts)))
    rates = docs.sparkSession.createDataFrame([(r[0], min(1.0, each / r[1])) for r in counts], "lang string, rate double")
    chance = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), F.lit("lang")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = rows.join(F.broadcast(rates), "lang").filter(chance < F.col("rate")).select("doc_id", "lang", "text")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, n = [], []
            for t in batch.column(2).to_pylist():
                c = subwords(t)
                at.append(np.flatnonzero(c).astype(np.int16))
                n.append(c[at[-1]].astype(np.int32))
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(at, pa.list_(pa.int16())), pa.array(n, pa.list_(pa.int32()))], names=["lang", "at", "n"])

        return run

    # Chance may give more than was meant, by a little; repeated rows of one doc_id by a lot: the limit bounds these.
    found = map_arrow(chosen, make, "lang string, at array<short>, n array<int>").filter("size(at) > 0").orderBy(F.xxhash64("at", "n"), "lang").limit(2 * SAMPLE + len(counts)).toArrow()
    return [(lang, a.values.to_numpy(), n.values.to_numpy()) for lang, a, n in zip(found["lang"].to_pylist(), found["at"], found["n"])]


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row of `docs`, from its text alone."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores, out = [], [], []
            for t in batch.column(2).to_pylist():
                c = subwords(t) if model and t else None
                total = c.sum() if c is not None else 0
                if total:
                    p = softmax((c.astype(np.float32) @ model["weights"] / total + model["bias"]) / model["heat"])
                    best = int(p.argmax())
                    langs.append(model["langs"][best])
                    scores.append(float(p[best]))
                    out.append(scores[-1] < model["bound"])
                else:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    out.append(True)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _is_held_out().alias("held_out"), doc_text())
    return map_arrow(rows, make, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(sample(docs)))
