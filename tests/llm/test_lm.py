import math
import zlib
from collections import Counter

import numpy as np
import pytest
from llmfixtures import ODD

from wavelark.llm import lm


def tokens(t):
    return [*"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split(), "END"]


def held_out(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2


class Automaton:
    """The model by its definition, as states, arcs and failure arcs in dictionaries."""

    def __init__(self, rows, order=lm.ORDER):
        train = [tokens(t) for d, t in rows if not held_out(d)]
        self.count = Counter(tuple(t[j : j + k]) for t in train for k in range(1, order + 1) for j in range(len(t) - k + 1))
        self.n, self.v = sum(c for g, c in self.count.items() if len(g) == 1), sum(len(g) == 1 for g in self.count)
        self.arcs = {}
        for g, c in self.count.items():
            if len(g) > 1 and c >= lm.LEAST:
                self.arcs.setdefault(g[:-1], {})[g[-1]] = c
        self.order = order

    def root(self, w):
        return (self.count[w,] + 1) / (self.n + self.v + 1)

    def failure(self, state):
        return 1 - sum(n - lm.DISCOUNT for n in self.arcs[state].values()) / self.count[state]

    def weight(self, state, w):
        if not state:
            return self.root(w)
        lower = self.weight(state[1:], w)
        if state not in self.arcs:
            return lower
        n = self.arcs[state].get(w, 0)
        return (n - lm.DISCOUNT if n else 0) / self.count[state] + self.failure(state) * lower

    def score(self, text):
        state, total = (), 0.0
        for w in tokens(text):
            total += math.log10(self.weight(state, w))
            state = (*state, w)[1 - self.order :]
            while len(state) > 1 and self.count[state] < lm.LEAST:
                state = state[1:]
        return total

    def base(self, text):
        return sum(math.log10(self.root(w)) for w in tokens(text))

    def known(self, text):
        return sum(self.count[w,] > 0 for w in tokens(text))


def check(got, rows, order=lm.ORDER):
    auto = Automaton(rows, order)
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[4])
    a = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
    b = sorted(((d, held_out(d), len(tokens(t)), auto.known(t), auto.base(t), auto.score(t)) for d, t in rows), key=key)
    assert [x[:4] for x in a] == [x[:4] for x in b] and all(r.train_tokens == auto.n for r in got)
    assert [x[4] for x in a] == pytest.approx([x[4] for x in b], rel=1e-9)
    assert [x[5] for x in a] == pytest.approx([x[5] for x in b], rel=1e-9)


@pytest.mark.parametrize("hot,buffer", [(1 << 10, 1_500_000), (8, 20_000)])
def test_whole_table(spark, monkeypatch, hot, buffer):
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "BUFFER", buffer)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm.score_documents(docs).collect()
    check(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order,lane", [(2, 512), (3, 512), (2, 1), (3, 7)])
def test_odd_rows(make_docs, monkeypatch, order, lane):
    monkeypatch.setattr(lm, "LANE", lane)
    monkeypatch.setattr(lm, "HOT", 20)
    monkeypatch.setattr(lm, "BUFFER", 100)
    texts = [*ODD, *(f"the word{i} of the {'x' * (i % 7)} Word{i // 2}" for i in range(60))]
    rows = [*enumerate(texts), (5, "a b"), (5, "a b"), (None, "the end"), (None, None)]
    check(lm.score_documents(make_docs(rows), order).collect(), rows, order)
    assert lm.score_documents(make_docs(rows).limit(0)).count() == 0


def test_a_walk_follows_arcs_and_failure_arcs(monkeypatch):
    """Three words; states of one word, and the pair (0, 1). By hand."""
    m = lm.Automaton(3, np.array([-1.0, -2.0, -3.0]))
    m.add(1, np.array([0 * 3 + 1, 1 * 3 + 2]), np.array([-0.5, -0.25]), np.array([3, 2]), np.array([-0.1, -0.2, 0.0]), np.array([-1, -1, -1]))
    m.add(2, np.array([0 * 3 + 0]), np.array([-0.01]), np.array([0]), np.array([-0.03]), np.array([1]))
    texts = [[0], [0, 1, 0], [0, 1, 2], [0, 1, 1], [2, 2, 0, 1, 2, 1]]
    want = [-1.0, -1.0 - 0.5 - 0.01, -1.0 - 0.5 + (-0.03 - 0.25), -1.0 - 0.5 + (-0.03 - 0.2 - 2.0), -3.0 - 3.0 - 1.0 - 0.5 - 0.28 - 2.0]
    place, lengths = np.concatenate([np.array(t) for t in texts]), np.array([len(t) for t in texts])
    for lane in (512, 1, 2, 3):
        monkeypatch.setattr(lm, "LANE", lane)
        assert m.walk(place, lengths) == pytest.approx(want)


def test_nothing_to_learn_from(make_docs):
    rows = [(d, "a b") for d in range(200) if lm.is_held_out(d)]
    assert all((r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0, 0) for r in lm.score_documents(make_docs(rows)).collect())


def test_states_sum_to_one():
    rows = [(i, " ".join("abcde"[(i * j + j // 3) % 5] for j in range(3 + i % 11))) for i in range(120)]
    auto = Automaton(rows)
    assert any(len(s) == 2 for s in auto.arcs)
    words = [g[0] for g in auto.count if len(g) == 1]
    for state in [(), *auto.arcs]:
        assert sum(auto.weight(state, w) for w in [*words, b"never"]) == pytest.approx(1)


@pytest.mark.parametrize("hot", [1 << 20, 4])
def test_all_repeated_ngrams_count_whatever_their_share(make_docs, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    rows = [(i, f"w{i % 50} x{i % 50} y{i % 50} and w{(i * 7) % 50} x{i % 9}") for i in range(300)]
    check(lm.score_documents(make_docs(rows)).collect(), rows)


def test_arrays_come_back():
    cols = [np.arange(5), np.array([1 << 40], np.int64), np.zeros(0, np.int64), np.array([True, False]), np.array([0.5])]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(cols, lm.unpacked(lm.packed(*cols))))
    h = np.random.default_rng(0).integers(0, 1 << 63, 100, np.uint64)
    assert (lm.long(lm.short(h)) == h >> np.uint64(16) << np.uint64(16)).all()
