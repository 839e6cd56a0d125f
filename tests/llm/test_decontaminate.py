import random

import pytest
from llmfixtures import ODD

from wavelark.llm import decontaminate as dc

ITEMS = [
    (1, "When Alice Baker walks 5 km in 40 minutes and Tom walks twice as far at the same pace, how many minutes does Tom need in all?"),
    (2, "The quick brown fox jumps over the lazy dog while the small cat sleeps under the old wooden table near the door"),
    (3, "short item of four"),
    (4, None),
    (5, "The quick brown fox jumps over the lazy dog while the small cat sleeps under the old wooden table near the door"),
]


def bench(spark, items=ITEMS):
    return spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")


def found(docs, benchmark):
    return {(r.doc_id, r.item_id): r for r in dc.contaminated(docs, benchmark).collect()}


def test_verbatim_reparameterised_and_clean(spark, make_docs):
    again = "When Carla Dean walks 9 mi in 75 minutes and Max walks twice as far at the same pace, how many minutes does Max need in all?"
    torn = "When Carla Dean walks 9 mi in 75 minutes and Max walks home."
    docs = make_docs([ITEMS[0][1], "Before. " + again + " After.", torn, "nothing here", "x " + ITEMS[1][1].upper().lower() + " y", "a short item of four words", *ODD])
    got = found(docs, bench(spark))
    assert set(got) == {(0, 1), (1, 1), (4, 2), (4, 5)}
    assert got[0, 1].literal and not got[1, 1].literal and got[0, 1].coverage == 1 and got[1, 1].consistency > 0.7


def test_short_items_begin_sentences_or_are_lines(spark, make_docs):
    items = [(1, "Paris"), (2, "short item of four"), (3, "7 May")]
    docs = make_docs(["Paris is a town. I like Paris", "The answer:\nParis.\n", "a short item of four words", "So it is. Short item of four words.", "on 7 May", "Paris", "Short item\nof four", "7 May\n8 May", "8 May"])
    assert set(found(docs, bench(spark, items))) == {(1, 1), (3, 2), (5, 1), (6, 2), (7, 3)}


def plain(docs, items):
    """The result by its definition, for each row and item."""
    canon, out = dc.Canon(), {}

    def windows_of(text, sizes, whole):
        tokens, slots, sentences, lines = canon(text or "")
        size_of = [len(tokens)] if whole and 0 < len(tokens) < dc.WINDOW else sizes
        got = []
        for size in size_of:
            for at in range(len(tokens) - size + 1):
                own = tokens[at : at + size].tolist()
                vals = [v for k, v in slots if at <= k < at + size]
                literal = any(t > 3 for t in own)
                named = tuple(dc.with_values(tokens, slots)[at : at + size].tolist())
                if size < dc.WINDOW:
                    fits = at in sentences if size >= dc.SHORT else at in lines and at + size in lines
                    got += [(at, (size, named), vals)] * (whole or fits)
                else:
                    got.append((at, (size, tuple(own) if literal else named), vals, literal))
        if whole and any(len(g) > 3 and g[3] for g in got):
            got = [g for g in got if g[3]]
        return [g[:3] for g in got]

    index = {i: windows_of(t, [dc.WINDOW], True) for i, t in items if i is not None}
    sizes = sorted({w[1][0] for ws in index.values() for w in ws})
    for doc, text in docs:
        mine = {}
        for at, h, vals in windows_of(text, sizes, False):
            mine.setdefault(h, []).append((at, vals))
        for item, ws in index.items():
            of, groups = len({w[1] for w in ws}), {}
            for at, h, vals in ws:
                for there, others in mine.get(h, ()):
                    shift, wide = there - at, max(of / 2, 2.0)
                    for g in ((0, 0), (1, shift), (2, shift // wide), (3, (shift / wide + 0.5) // 1)):
                        hits, pairs = groups.setdefault(g, (set(), set()))
                        hits.add(h)
                        pairs |= set(zip(vals, others))
            good = []
            for (kind, _), (hits, pairs) in groups.items():
                values = len({a for a, _ in pairs})
                same, literal = (values / len(pairs), sum(a == b for a, b in pairs) >= values) if pairs else (1.0, True)
                if len(hits) >= dc.COVER * of and (same >= dc.CONSISTENT or literal and kind):
                    good.append((same, literal))
            if good:
                new = (len(groups[0, 0][0]) / of, max(g[0] for g in good), max(g[1] for g in good))
                out[doc, item] = tuple(map(max, zip(new, out.get((doc, item), new))))
    return out


def test_against_the_definition(spark, make_docs):
    """Verbatim and re-parameterised copies, templates that many items share, torn copies and repeated windows."""
    rng = random.Random(2)
    nouns, names = "apples pears plums figs nuts".split(), ["Ann Lee", "Bo Chan", "Cy Dow", "Di Eve"]
    shape = ["If {n} has {a} {x} and buys {b} more {x} then how many {x} has {n} in all on that day?", "so {a} {x} and {b} {y} and {a} {x} make a lot of {y}", "Solve {a} + {b} = {c}", "the {x} of the {y} of the {x} of the {y} and no more of it"]
    fill = lambda: rng.choice(shape).format(n=rng.choice(names), a=rng.randint(1, 30), b=rng.randint(1, 30), c=rng.randint(1, 60), x=rng.choice(nouns), y=rng.choice(nouns))
    items = [(i, fill()) for i in range(60)] + [(60, None), (61, ""), (62, "apples")]
    texts = []
    for k in range(80):
        parts = [rng.choice([fill(), rng.choice(items[:60])[1], "some words between these"]) for _ in range(rng.randint(0, 5))]
        text = rng.choice([" ", "\n", ". "]).join(parts)
        texts.append(text if k % 3 else text[: rng.randint(0, len(text))])
    docs = [*enumerate(texts), (None, texts[5]), (7, texts[8])]
    want = plain(docs, items)
    got = {k: (r.coverage, r.consistency, r.literal) for k, r in found(make_docs(docs), bench(spark, items)).items()}
    assert set(got) == set(want) and len(want) > 100
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_slots_that_disagree_are_no_copy(spark, make_docs):
    item = "so 7 apples and 7 pears and 7 plums and 7 figs"
    docs = make_docs(["so 7 apples and 7 pears and 7 plums and 7 figs", "so 1 apples and 2 pears and 3 plums and 4 figs", "so 8 apples and 8 pears and 8 plums and 8 figs"])
    assert {k[0] for k in found(docs, bench(spark, [(1, item)]))} == {0, 2}


def test_join_without_the_filter_finds_the_same(spark, make_docs, monkeypatch):
    docs = make_docs([ITEMS[0][1], ITEMS[1][1], "clean text of its own"])
    want = set(found(docs, bench(spark)))
    monkeypatch.setattr(dc, "FILTER_MOST", 0)
    monkeypatch.setattr(dc, "FEW_IDS", 0)
    assert set(found(docs, bench(spark))) == want
    assert [r.doc_id for r in dc.drop_contaminated(docs, bench(spark)).collect()] == [2]


def test_repeats_missing_ids_and_empty_tables(spark, make_docs):
    docs = make_docs([(1, ITEMS[1][1]), (1, "other"), (None, ITEMS[1][1]), (None, "fine"), (2, "fine")])
    assert set(found(docs, bench(spark))) == {(1, 2), (1, 5), (None, 2), (None, 5)}
    kept = dc.drop_contaminated(docs, bench(spark))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "fine"), (1, "other"), (2, "fine")] and kept.columns == docs.columns
    assert dc.drop_contaminated(docs, bench(spark).limit(0)).count() == 5
    assert dc.contaminated(docs.limit(0), bench(spark)).count() == 0


def test_whole_table_against_brute_force(spark):
    import re

    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = set(found(docs, items))
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    texts = {r.doc_id: " " + words(r.text) + " " for r in docs.collect()}
    want = {(i, r.item_id) for r in items.collect() for i, t in texts.items() if " " + words(r.text) + " " in t}
    assert want and got == want


def test_a_copy_counts_beside_others_of_other_values(spark, make_docs):
    item = "If Alice Baker walks 5 km in 40 minutes then how far does she walk in 70 minutes at the same pace?"
    other = "If {} walks {} km in {} minutes then how far does she walk in {} minutes at the same pace?"
    others = [other.format(n, 2 * i + 3, 10 * i + 11, 20 * i + 13) for i, n in enumerate(["Carla Dean", "Emma Frost", "Gina Hall", "Ida Jones"])]
    torn = item.replace("then how", "and then, so they say, how")
    docs = make_docs([(1, "\n".join([*others, item])), (2, "\n".join([others[0], torn, *others[1:]])), (3, item), (3, others[0]), (3, others[1]), (3, others[2]), (None, item), *((None, o) for o in others)])
    got = found(docs, bench(spark, [(1, item)]))
    assert set(got) == {(1, 1), (2, 1), (3, 1), (None, 1)} and all(r.literal for r in got.values())


def test_an_item_that_repeats_a_window_is_found(spark, make_docs):
    item = "the tank holds 10 litres of the water and the tank holds 20 litres of the water and the tank holds 30 litres of the water"
    got = found(make_docs([item, "the tank holds 1 litres of the oil"]), bench(spark, [(1, item)]))
    assert set(got) == {(0, 1)} and got[0, 1].literal


def test_items_dense_in_numbers_and_names_are_found(spark, make_docs):
    items = [(1, "Solve 3x + 5 = 20"), (2, "What is 12 + 45 * 3?"), (3, "12 + 45 * 3 - 7 / 9 = 80"), (4, "7 km 8")]
    docs = make_docs([*(f"Before that. {t} And so on." for _, t in items), "Before that. 13 + 46 * 4 - 8 / 10 = 81 And so on.", "9 km 8"])
    got = found(docs, bench(spark, items))
    assert set(got) == {(0, 1), (1, 2), (2, 3), (3, 4)} and all(r.literal for r in got.values())
