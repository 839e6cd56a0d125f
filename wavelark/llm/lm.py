"""Language-model scores from a weighted backoff automaton that lies in shards.

Model: the root state gives any word its add-one unigram probability. Every word, and every n-gram
seen at least LEAST times in training documents, is a state. A state's arcs are the words that
followed it at least LEAST times; their weights are interpolated by absolute discounting: with c
the state's count, n the arc's, S and T the sum and number of its arcs, an arc weighs
(n - DISCOUNT) / c + rest * lower, where rest = 1 - (S - DISCOUNT * T) / c is the weight of the
failure arc, to the state of the longest proper suffix, and lower what that state gives the word.
Each state sums to one over words, and an arc needs nothing from other states but `lower`. All words
and all such n-grams are kept, at every size of corpus, in shards dealt by the state's hash.

Counting goes with scoring, in chunks of about BUFFER tokens: a chunk asks the shards
about its different words and the words that follow them (their counts come with the question), gets
the counts over the corpus back in its own order, and asks once more, about n-grams whose parts were all kept, since no
other can be seen LEAST times. From the answers it builds the part of the automaton that its texts can
reach, states, arcs and failure arcs, and walks them through it once from left to right: a token is the
arc that leaves the state it is in, or the failure arc's weight and then that of a shorter state; what
the walk carries along is the state. Many stretches of text are walked side by side, each of at most
LANE tokens; one that begins within a text first reads the two words before it, which is all that a state knows.
So one exchange carries different n-grams of a chunk, no
occurrences, and one pass over the texts is enough. The first 48 bits of its hash tell a word from the others that follow
one context; two of 10 million such words would be taken for one with a probability of a fifth.

Skew: contexts that hold a share of 1/HOT of a sample of the tokens are dealt by the following word,
and their sums put together from the shards; that changes where things are counted, nothing else.

Defined cases: null or empty text is the end token alone. A null doc_id counts as an empty one when
held-out texts are chosen. Rows that repeat are scored each. With nothing to learn from, N and V are
0 and every token has probability one. An empty table gives no rows. Extra columns are ignored; long
texts are read whole, and no list but one chunk's words is held.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, durable

ORDER, DISCOUNT, LEAST = 3, 0.5, 2
#: Tokens of a stretch that is walked in one go.
LANE = 512
BUFFER, CACHE = 1_000_000, 200_000
#: Contexts with such a share of a sample of SAMPLE rows are dealt by the next word too; at most 2 * HOT of them.
HOT, SAMPLE = 1 << 10, 5000
END = xxhash.xxh64_intdigest(b"\n")  # no word has a new line
MESSAGE = "shard int, chunk long, tag int, data binary"
ASK, ANSWER, SUMS, HOME, MORE = range(5)


def word_hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


class Lookup(dict):
    """word: its hash; forgets all when it has grown too large."""

    def __missing__(self, w: bytes) -> int:
        v = word_hash(w)
        if len(w) < 64:
            self[w] = v
        return v

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        w = words_of(text)
        return np.append(np.fromiter(map(self.__getitem__, w), np.uint64, len(w)), np.uint64(END))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def packed(*cols: np.ndarray) -> bytes:
    """Arrays in as few bytes as their greatest values allow; whole numbers byte by byte, all lowest bytes first, so that the many zeros of the highest lie together."""
    parts = []
    for c in cols:
        if c.dtype.kind in "iu":
            top = int(c.max()) if len(c) else 0
            c = c.astype(next(t for t, most in (("<u1", 1 << 8), ("<u2", 1 << 16), ("<u4", 1 << 32), ("<u8", 1 << 64)) if top < most))
        raw = np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T) if c.dtype.kind == "u" and c.itemsize > 1 else c
        parts += [c.dtype.str[1:].encode(), len(c).to_bytes(8, "little"), raw.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = np.dtype(raw[at : at + 2].decode()), int.from_bytes(raw[at + 2 : at + 10], "little")
        at += 10
        if kind.kind == "u" and kind.itemsize > 1:
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T).reshape(-1).view(kind))
        else:
            out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def steps(h: np.ndarray) -> np.ndarray:
    """Sorted hashes by their differences."""
    return np.diff(h, prepend=np.zeros(1, np.uint64))


def hashes(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d.astype(np.uint64), dtype=np.uint64)


def short(h: np.ndarray) -> np.ndarray:
    """The first 48 bits of hashes, as bytes: what tells the words after one context apart."""
    return np.ascontiguousarray(h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)


def long(six: np.ndarray) -> np.ndarray:
    out = np.zeros((len(six) // 6, 8), np.uint8)
    out[:, :6] = six.reshape(-1, 6)
    return out.reshape(-1).view(">u8").astype(np.uint64)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """By ranges of hashes, so that what is sorted by hash lies in order of shards."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Automaton:
    """The part of the automaton that a chunk's texts reach. Words are 0 to words - 1; states: -1 the root, a word's own number, and words + i for the i-th pair."""

    def __init__(self, words: int, root: np.ndarray):
        """root: log10 weight of each word's arc from the root, which leads to its own state."""
        self.words, self.root = words, root
        none = np.zeros(0, np.int64)
        self.arcs = [(none, np.zeros(0), none), (none, np.zeros(0), none)]  # of states of one word and of two: key, log10 weight, target
        self.fails = [(np.zeros(words), np.full(words, -1)), (np.zeros(0), none)]  # log10 weight, target

    def add(self, order: int, keys: np.ndarray, weights: np.ndarray, targets: np.ndarray, fail: np.ndarray, to: np.ndarray) -> None:
        """Arcs of the states of `order` words; key: the state's number of its order * words + the word, sorted."""
        self.arcs[order - 1], self.fails[order - 1] = (keys, weights, targets), (fail, to)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state of each walk, and what its token weighs."""
        weight, new, left = np.zeros(len(state)), np.full(len(state), -2), state.copy()
        for order in (2, 1):
            keys, weights, targets = self.arcs[order - 1]
            fail, to = self.fails[order - 1]
            here = np.flatnonzero((new == -2) & (left >= (self.words if order == 2 else 0)))
            if not len(here):
                continue
            own = left[here] - (self.words if order == 2 else 0)
            if len(keys):
                key = own * self.words + word[here]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                weight[here[hit]] += weights[at[hit]]
                new[here[hit]] = targets[at[hit]]
                here, own = here[~hit], own[~hit]
            weight[here] += fail[own]
            left[here] = to[own]
        end = np.flatnonzero(new == -2)
        weight[end] += self.root[word[end]]
        new[end] = word[end]
        return new, weight

    def walk(self, place: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each text; place: the texts' words, one text after another."""
        starts = np.cumsum(lengths) - lengths
        many = -(-lengths // LANE)
        text = np.repeat(np.arange(len(lengths)), many)
        first = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * LANE  # of a lane in its text
        begin = starts[text] + first
        size = np.minimum(lengths[text] - first, LANE)
        by = np.argsort(-size, kind="stable")
        text, begin, size, before = text[by], begin[by], size[by], np.minimum(first, ORDER - 1)[by]
        state, total = np.full(len(text), -1), np.zeros(len(text))
        for k in range(ORDER - 1, 0, -1):  # the words before a lane, for the state alone
            on = np.flatnonzero(before >= k)
            state[on] = self.step(state[on], place[begin[on] - k])[0]
        going = len(text)
        for k in range(int(size.max(initial=0))):
            while size[going - 1] <= k:
                going -= 1
            state[:going], weight = self.step(state[:going], place[begin[:going] + k])
            total[:going] += weight
        return np.bincount(text, total, len(lengths))


class Asked:
    """Questions about contexts and what follows them, and the order in which answers come back.

    ctx: the contexts' hashes, sorted and distinct; count: how often they occur here in training;
    follow_ctx, follow: context (its place) and the next word's hash of each different pair, sorted
    by these; n: how often the pair occurs here in training.
    """

    def __init__(self, ctx: np.ndarray, count: np.ndarray, follow_ctx: np.ndarray, follow: np.ndarray, n: np.ndarray, hot: np.ndarray):
        self.ctx, self.count, self.follow_ctx, self.follow, self.n = ctx, count, follow_ctx, follow, n
        at = np.minimum(np.searchsorted(hot, ctx), max(len(hot) - 1, 0))
        self.hot = np.where(hot[at] == ctx, at, -1) if len(hot) else np.full(len(ctx), -1)
        is_hot = self.hot[follow_ctx] >= 0
        self.cold, spread = np.flatnonzero(~is_hot), np.flatnonzero(is_hot)
        self.spread = spread[np.lexsort((follow_ctx[spread], follow[spread]))]

    def messages(self, chunk: int, shards: int) -> list[tuple[int, int, int, bytes]]:
        edge = np.arange(shards + 1)
        a = np.searchsorted(shard_of(self.ctx, shards), edge)
        c = np.searchsorted(self.follow_ctx[self.cold], a)
        s = np.searchsorted(shard_of(self.follow[self.spread], shards), edge)
        many, out = np.bincount(self.follow_ctx[self.cold], minlength=len(self.ctx)), []
        for k in np.flatnonzero((np.diff(a) > 0) | (np.diff(s) > 0)).tolist():
            own, cold, spread = slice(a[k], a[k + 1]), self.cold[c[k] : c[k + 1]], self.spread[s[k] : s[k + 1]]
            data = packed(steps(self.ctx[own]), self.count[own], many[own], short(self.follow[cold]), self.n[cold], self.hot[self.follow_ctx[spread]], short(self.follow[spread]), self.n[spread])
            out.append((k, chunk, ASK, data))
        return out

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        return self.cold, self.spread


def answers(held: dict[int, list[tuple[int, bytes]]], shard: int) -> tuple[list[tuple[int, int, int, bytes]], tuple]:
    """What a shard says to all questions, and its totals: tokens, words, and sums of hot contexts."""
    asked = [(chunk, [hashes(x[0]), *x[1:]]) for chunk, x in ((chunk, unpacked(data)) for chunk, data in held.get(ASK, ()))]
    if not asked:
        return [], (0, 0, *[np.zeros(0, np.int64)] * 3)
    col = lambda k: np.concatenate([x[k] for _, x in asked])
    names, word = np.unique(col(0), return_inverse=True)
    count = np.bincount(word, col(1), len(names)).astype(np.int64)
    ctx = np.repeat(word, col(2))
    # Followers of cold contexts by their context, those of hot ones by its number.
    keys = np.concatenate([mix(names[ctx], long(col(3))), mix(~col(5).astype(np.uint64), long(col(6)))])
    kinds, first, pair = np.unique(keys, return_index=True, return_inverse=True)
    n = np.bincount(pair, np.concatenate([col(4), col(7)]), len(kinds)).astype(np.int64)
    n[n < LEAST] = 0
    kept, is_cold = n > 0, first < len(ctx)
    own = ctx[first[kept & is_cold]]
    total, kept_of = (np.bincount(own, w, len(names)).astype(np.int64) for w in (n[kept & is_cold], None))
    number = col(5).astype(np.int64)[first[kept & ~is_cold] - len(ctx)]
    some, where = np.unique(number, return_inverse=True)
    hot = some, np.bincount(where, n[kept & ~is_cold], len(some)).astype(np.int64), np.bincount(where, minlength=len(some))
    out, w, p, q = [], 0, 0, len(ctx)
    for chunk, x in asked:
        a, b, c = len(x[0]), len(x[4]), len(x[7])
        own = word[w : w + a]
        out.append((shard, chunk, ANSWER, packed(count[own], total[own], kept_of[own], n[pair[p : p + b]], n[pair[q : q + c]])))
        w, p, q = w + a, p + b, q + c
    return out, (int(count.sum()), int((count > 0).sum()), *hot)


def joined(found: list[tuple[int, bytes]], places: tuple[np.ndarray, np.ndarray], pairs: int) -> tuple[np.ndarray, ...]:
    """A chunk's answers, shard after shard: counts, sums and numbers of arcs by context, and n by pair."""
    cols = [np.concatenate(c).astype(np.int64) for c in zip(*(unpacked(data) for _, data in sorted(found)))]
    n = np.zeros(pairs, np.int64)
    n[places[0]], n[places[1]] = cols[3], cols[4]
    return cols[0], cols[1], cols[2], n


def with_hot(total: np.ndarray, arcs: np.ndarray, hot: np.ndarray, sums: dict[int, tuple[int, int]]) -> None:
    for at in np.flatnonzero(hot >= 0).tolist():
        total[at], arcs[at] = sums.get(int(hot[at]), (0, 0))


def in_parts(rows: list[tuple[int, int, int, bytes]], most: int = 8 << 20):
    """Batches of messages, of some megabytes each."""
    here, size = [], 0
    for i, r in enumerate(rows):
        here.append(r)
        size += len(r[3])
        if size > most or i == len(rows) - 1:
            cols = [pa.array(c, k) for c, k in zip(zip(*here), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "chunk", "tag", "data"])
            here, size = [], 0


def grouped(batches, by: int):
    """(key, {tag: [(the other of shard and chunk, data)]}) of dealt messages, key after key."""
    now, held = None, {}
    for batch in batches:
        shard, chunk, tag, data = batch.columns
        for key, other, t, d in zip((shard, chunk)[by].to_pylist(), (chunk, shard)[by].to_pylist(), tag.to_pylist(), data.to_pylist()):
            if key != now:
                if held:
                    yield now, held
                now, held = key, {}
            held.setdefault(t, []).append((other, d))
    if held:
        yield now, held


def hot_contexts(docs: DataFrame) -> np.ndarray:
    """Hashes of words and pairs with 1/HOT of a sample's tokens, sorted: how to deal them out, no more."""
    rows = docs.count()

    def run(batches):
        of, seen = Lookup(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                h = of.of(text)
                for x in (h, mix(h[:-1], h[1:])):
                    seen.update(dict(zip(*(c.tolist() for c in np.unique(x, return_counts=True)))))
                seen[END] += 0
        tokens = sum(seen.values()) / 2
        some = [(h, n) for h, n in seen.items() if n > tokens / (2 * HOT) and h != END] + [(0, int(tokens))]
        yield pa.RecordBatch.from_arrays([pa.array(np.array([h for h, _ in some], np.uint64).view(np.int64)), pa.array([n for _, n in some], pa.int64())], names=["h", "n"])

    some = docs.sample(min(1.0, SAMPLE / max(rows, 1)), seed=7).select(doc_text())
    by = {r.h: r.n for r in some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(2 * HOT + 1).collect()}
    tokens = by.pop(0, 0)
    return np.sort(np.array([h for h, n in by.items() if n >= tokens / HOT], np.int64).view(np.uint64))


def exchange(messages: DataFrame, shards: int) -> tuple[DataFrame, int, int, dict]:
    """The shards' answers, and the chunks' own messages if these come along, durable; tokens, words, and the sums of hot contexts by number."""

    def run(batches):
        for shard, held in grouped(batches, 0):
            yield from in_parts([(shard, chunk, HOME, data) for chunk, data in held.get(HOME, ())])
            said, (tokens, words, *of_hot) = answers(held, shard)
            yield from in_parts([*said, (shard, -1, SUMS, packed(np.array([tokens, words]), *of_hot))])
            held.clear()
            said.clear()

    dealt = messages.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "tag", "chunk")
    met = durable(dealt.mapInArrow(run, MESSAGE))

    def sums(batches):
        for batch in batches:
            cols: list[list] = [[], [], []]
            for data in batch.column(0).to_pylist():
                total, *of_hot = unpacked(data)
                for c, x, y in zip(cols, ([-1], total[:1], total[1:]), of_hot):
                    c.append(np.concatenate([x, y]).astype(np.int64))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["at", "s", "t"])

    found = met.filter(F.col("tag") == SUMS).select("data").mapInArrow(sums, "at long, s long, t long").groupBy("at").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # at most 2 * HOT + 1 rows
    by = {r.at: (r.s, r.t) for r in found}
    return met.filter(F.col("tag") != SUMS), *by.pop(-1, (0, 0)), by


def at_home(met: DataFrame, run, schema: str) -> DataFrame:
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, "chunk").sortWithinPartitions("chunk", "tag", "shard").mapInArrow(run, schema)


def rest_of(count: np.ndarray, total: np.ndarray, arcs: np.ndarray) -> np.ndarray:
    """Weights of failure arcs."""
    return 1 - (total - DISCOUNT * arcs) / np.maximum(count, 1)


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; order: 2 or 3 words to an n-gram at most."""
    spark = docs.sparkSession
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_text())
    hot = hot_contexts(rows)

    def pairs_in(place: np.ndarray, lengths: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pairs begin, the different pairs (context and next word in one number), and which each is."""
        last = np.zeros(len(place), bool)
        last[np.cumsum(lengths) - 1] = True
        at = np.flatnonzero(~last)
        return at, *np.unique(place[at] * words + place[at + 1], return_inverse=True)

    def ask(batches):
        of, part, chunk = Lookup(), TaskContext.get().partitionId() << 24, 0
        ids: list[np.ndarray] = []
        docs_: list = []
        size = 0

        def out():
            lengths = np.array([len(i) for i in ids])
            words, place = np.unique(np.concatenate(ids), return_inverse=True)
            held = np.array([is_held_out(d) for d in docs_])
            train = np.repeat(~held, lengths)
            at, pairs, pair = pairs_in(place, lengths, len(words))
            ctx, last = np.divmod(pairs, len(words))
            asked = Asked(words, np.bincount(place[train], minlength=len(words)), ctx, words[last], np.bincount(pair[train[at]], minlength=len(pairs)), hot)
            here = part + chunk
            often = np.bincount(place, minlength=len(words))
            by = np.argsort(-often, kind="stable")  # the commonest words first: small numbers; those that occur once come last, by hash
            more = int((often > 1).sum())
            code = np.empty_like(by)
            code[by] = np.arange(len(by))
            home = packed(words[by[:more]], steps(words[by[more:]]), code[place], lengths, np.array([d or 0 for d in docs_], np.int64).view(np.uint64), np.array([d is not None for d in docs_]), held)
            return in_parts([*asked.messages(here, shards), (here % shards, here, HOME, home)])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(of.of(text))
                docs_.append(doc)
                size += len(ids[-1])
                if size > BUFFER:
                    yield from out()
                    ids, docs_, size, chunk = [], [], 0, chunk + 1
        if size:
            yield from out()

    met, n, v, sums = exchange(rows.mapInArrow(ask, MESSAGE), shards)
    denominator = n + v + 1.0

    def result(doc, has_id, held, lengths, known, base, score):
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        cols = [pa.array(doc.view(np.int64), mask=~has_id), held, lengths.astype(np.int64), known.astype(np.int64), np.full(len(doc), n, np.int64), base, score]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    def walk_chunk(chunk: int, held: dict, last_round: bool):
        """Every text through the states of one word; then questions about longer ones, or their answers and the result."""
        often, once, code, lengths, doc, has_id, away = unpacked(held[HOME][0][1])
        names = np.concatenate([often.astype(np.uint64), hashes(once)])
        by = np.argsort(names)
        words, rank = names[by].astype(np.uint64), np.empty_like(by)
        rank[by] = np.arange(len(by))
        place, lengths, doc = rank[code], lengths.astype(np.int64), doc.astype(np.uint64)
        at, pairs, pair = pairs_in(place, lengths, len(words))
        ctx, last = np.divmod(pairs, len(words))
        asked = Asked(words, place[:0], ctx, words[last], pairs[:0], hot)
        count, total, arcs, seen = joined(held[ANSWER], asked.places(), len(pairs))
        with_hot(total, arcs, asked.hot, sums)
        # The token at `at + 1` ends a pair. It ends a triple too where the pair before ends where this one begins.
        third = np.r_[False, at[1:] == at[:-1] + 1][: len(at)]
        deep = np.flatnonzero(third & np.r_[False, seen[pair[:-1]] > 0][: len(at)]) if order > 2 else at[:0]
        of_row = np.repeat(np.arange(len(lengths)), lengths)
        used, state = np.unique(pair[deep - 1], return_inverse=True)
        named = mix(words[ctx[used]], words[last[used]])
        by = np.argsort(named)
        rank = np.empty_like(by)
        rank[by] = np.arange(len(by))
        triples, first, triple = np.unique(rank[state] * len(words) + place[at[deep] + 1], return_index=True, return_inverse=True)
        state, then = np.divmod(triples, len(words))
        second = pair[deep[first]]
        maybe = np.flatnonzero(seen[second] > 0)
        train = np.bincount(triple[~away[of_row[at[deep]]]], minlength=len(triples))
        more = Asked(named[by], np.zeros(len(by), np.int64), state[maybe], words[then[maybe]], train[maybe], hot)
        if not last_round:
            yield from in_parts(more.messages(chunk, shards))
            return
        p1 = (count + 1) / denominator
        p2 = rest_of(count, total, arcs)[ctx] * p1[last] + np.where(seen > 0, (seen - DISCOUNT) / np.maximum(count[ctx], 1), 0)
        starts = np.cumsum(lengths) - lengths
        base = np.add.reduceat(np.log10(p1)[place], starts)
        known = np.add.reduceat((count > 0)[place].astype(np.int64), starts)
        machine, number = Automaton(len(words), np.log10(p1)), np.full(len(pairs), -1)
        number[used[by]] = np.arange(len(used))  # of pairs that are states
        kept = np.flatnonzero(seen > 0)
        after = lambda p: np.where(number[p] >= 0, len(words) + number[p], last[p])
        machine.add(1, pairs[kept], np.log10(p2[kept]), after(kept), np.log10(rest_of(count, total, arcs)), np.full(len(words), -1))
        if len(deep):
            _, total, arcs, n3 = joined(held[MORE], tuple(maybe[x] for x in more.places()), len(triples))
            with_hot(total, arcs, more.hot, more_sums)
            own = seen[used][by]
            p3 = rest_of(own, total, arcs)[state] * p2[second] + np.where(n3 > 0, (n3 - DISCOUNT) / own[state], 0)
            kept = np.flatnonzero(n3 > 0)
            machine.add(2, triples[kept], np.log10(p3[kept]), after(second[kept]), np.log10(rest_of(own, total, arcs)), last[used[by]])
        score = machine.walk(place, lengths)
        yield result(doc, has_id, away, lengths, known, base, score)

    def walk(batches, last_round: bool):
        for chunk, held in grouped(batches, 1):
            yield from walk_chunk(chunk, held, last_round)
            held.clear()

    scores = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if order < 3:
        return at_home(met, lambda batches: walk(batches, True), scores)
    more, _, _, more_sums = exchange(at_home(met, lambda batches: walk(batches, False), MESSAGE), shards)
    return at_home(met.union(more.withColumn("tag", F.lit(MORE))), lambda batches: walk(batches, True), scores)
