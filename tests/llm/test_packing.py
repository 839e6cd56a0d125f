import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

DATA = "/root/testdata"
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wavelark.llm import packing

from llmfixtures import ODD

TOK = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
encode = packing.Encoder()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("İßΣÀàĲ!?# \n\t\r\x0b\x1c\x85 'sS!.́ABé<|endoftext|>")), max_size=60))
def test_word_cache_gives_the_tokenizers_ids(text):
    for t in (text, text + "<|endoftext|>" + text, "x" * 70 + text):
        assert encode(t).tolist() == TOK.encode(t, add_special_tokens=False).ids


def test_portions_change_nothing(monkeypatch):
    text = "Ein Satz, der öfter kommt; and İt's new. " * 40 + "x" * 300
    want = TOK.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "PORTION", 50)
    small = packing.Encoder()
    assert small(text).tolist() == want
    assert [x.tolist() for x in small.many(["", text, " ", "a"])] == [[], want, [], TOK.encode("a", add_special_tokens=False).ids]
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    assert small(text).tolist() == want


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


def filled(plan, n_pieces, capacity):
    """How many sequences a plan fills, each of them without gaps before its end."""
    fill, placed = defaultdict(list), 0
    for length, _, n, seq, each, offset in plan:
        for i in range(n):
            fill[seq + i // each].append((offset + i % each * length, length))
        placed += n
    assert placed == n_pieces
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(fill)


def in_memory(counts, capacity, ranges):
    """`match` with lists for tables."""
    runs, plan, opened = [(packing.PIECES_LEFT, length, 0, n, 0, 0, 0) for length, n in counts.items()], [], 0
    for lo, hi in packing.classes(capacity):
        while any(r[0] == packing.PIECES_LEFT and lo < r[1] <= hi for r in runs):
            parts = [[r for r in runs if r[1] * ranges // (capacity + 1) == k] for k in range(ranges)]
            got = packing.sweep([r for part in parts for r in packing.sweep(part, lo, hi)], lo, hi)
            one = packing.sweep(runs, lo, hi)
            assert sum(r[3] for r in got if r[0] == packing.PLACED) == sum(r[3] for r in one if r[0] == packing.PLACED)
            if all(r[0] != packing.PLACED for r in got):
                got = packing.open_sequences(got, lo, hi, opened, capacity)
            new = [r[1:] for r in got if r[0] == packing.PLACED]
            plan, runs = plan + new, [(packing.GAP, *r[1:]) if r[0] == packing.USED else r for r in got if r[0] != packing.PLACED]
            opened = max([opened, *(seq + -(-n // each) for _, _, n, seq, each, _ in new)])
    return plan


def test_supersteps_fill_about_as_few_as_best_fit_decreasing():
    rng, ours, best = random.Random(5), 0, 0
    for capacity in (1, 2, 7, 50, 100, 2048):
        assert sum(hi - lo for lo, hi in packing.classes(capacity)) == capacity
        for _ in range(40):
            lengths = [rng.choice([rng.randint(1, capacity), max(1, capacity // 3)]) for _ in range(rng.randint(0, 200))]
            n, least = filled(in_memory(Counter(lengths), capacity, rng.randint(1, 9)), len(lengths), capacity), best_fit_decreasing(lengths, capacity)
            assert n <= least * 1.05 + 1
            ours, best = ours + n, best + least
    assert ours <= best * 1.005


@pytest.mark.parametrize("capacity,most", [(60, 60), (100, 20)])
def test_supersteps_on_tables(spark, capacity, most):
    rng = random.Random(capacity)
    lengths = [rng.randint(1, most) for _ in range(3000)]
    n = filled(packing.match(spark, dict(Counter(lengths)), capacity), len(lengths), capacity)
    assert n == filled(in_memory(Counter(lengths), capacity, packing.RANGES), len(lengths), capacity) and n <= best_fit_decreasing(lengths, capacity) + 3


def test_letters_merge_as_the_tokenizer_has_it():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["a" * k for k in range(1, 60)] + ["ab" * k for k in range(1, 30)]
    got = encode.bpe([w.encode() for w in words])
    assert got == [np.array(e.ids, "<u4").tobytes() for e in TOK.encode_batch(words, add_special_tokens=False)]


def check(docs, texts):
    rows = packing.pack_documents(docs).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*TOK.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // 2048)))
        assert sum(r.length for r in parts) == len(ids)
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and (r.length == 2048 or r is parts[-1])
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(by_seq), best_fit_decreasing([r.length for r in rows], 2048)


def test_odd_documents(make_docs):
    n, best = check(make_docs(ODD), dict(enumerate(ODD)))
    assert n == best


def test_repeated_rows_and_empty_table(make_docs):
    docs = make_docs(["a b c", "d"])
    assert packing.pack_documents(docs.union(docs)).count() == 4
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    n, best = check(docs, {r.doc_id: r.text for r in docs.collect()})
    assert n == best
