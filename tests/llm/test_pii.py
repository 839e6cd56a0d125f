import re

from llmfixtures import ODD

from wavelark.llm import pii

TEXT = "Mrs Anna Weber wrote to o'neil.42@Mail3.example.com from 192.168.7.12; call +1 (509) 555-6973 or 4111 1111 1111 1111, SSN 123-45-6789, DE89 3704 0044 0532 0130 00. Mrs Weber and Mr Иван Петров agreed; Dr. Müller too. 9.5 % of 1,234,567 in 2024-01-02."


def rows(docs):
    return {r.doc_id: r for r in pii.pseudonymise(docs).collect()}


def test_types_formats_and_coreference(make_docs):
    r = rows(make_docs([TEXT, TEXT.replace("Mrs Anna Weber wrote", "WEBER? Then"), *ODD]))
    new = r[0].text
    old = [TEXT[int(a) : int(b)] for _, a, b in (e.split(":") for e in r[0].entities.split(","))]
    assert {"Anna", "Weber", "neil.42@Mail3.example.com", "192.168.7.12", "+1 (509) 555-6973", "4111 1111 1111 1111", "123-45-6789", "DE89 3704 0044 0532 0130 00", "Иван", "Петров", "Müller"} <= set(old)
    assert not any(x in new for x in old)
    m = re.fullmatch(r"Mrs (\w+) (\w+) wrote to o'([a-z]{4}\.\d\d@[A-Z][a-z]{3}\d\.[a-z]+\.com) from (192\.168\.\d+\.\d+); call \+1 \(\d{3}\) \d{3}-\d{4} or (4\d{3} \d{4} \d{4} \d{4}), SSN \d{3}-\d\d-\d{4}, (DE\d\d(?: \d{4}){4} \d\d)\. Mrs (\w+) and Mr ([А-Яа-я]+) ([А-Яа-я]+) agreed; Dr\. (\w+) too\. 9\.5 % of 1,234,567 in 2024-01-02\.", new)
    assert m and m[2] == m[7] and m[1].endswith(tuple(pii.ENDINGS["latin"]["f"])) and m[8].endswith(tuple(pii.ENDINGS["cyrillic"]["m"])) and m[9].endswith(("ов", "ев", "ин"))
    assert pii.luhn(m[5].replace(" ", "")) == 0
    iban = m[6].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert m[3] in r[1].text and m[5] in r[1].text
    for i, t in enumerate(ODD, 2):
        assert (r[i].text, r[i].n_entities, r[i].entities) == (t, 0, "")


def test_distinct_values_stay_distinct_and_miss_real_ones(make_docs, monkeypatch):
    texts = [f"at 10.0.{i // 200}.{i % 200 + 1} Mr {chr(65 + i % 26)}{chr(97 + i // 26)}x{'y' * (i % 3)} Smith" for i in range(300)] + [f"Ms {n} Dahl" for n in pii.GIVEN["latin"]["f"]]
    texts += [f"127.5.{i}.9 a" for i in range(40)]

    def pairs(got):
        out = {}
        for i, t in enumerate(texts):
            a, b = t.split(" "), got[i].text.split(" ")
            out |= {x: y for x, y in zip(a, b) if x != y}
        return out

    docs = make_docs(texts)
    got = rows(docs)
    swapped = pairs(got)
    assert len(swapped) > 300 and len(set(swapped.values())) == len(swapped) and not set(swapped) & set(swapped.values())
    monkeypatch.setattr(pii, "FEW", 0)
    again = rows(docs)
    assert all(again[i].text == got[i].text for i in got)


def test_what_stands_next_to_a_value_does_not_hide_it():
    values = ["a.b@c.example.com", "+1 (509) 555-6973", "152.143.123.131", "4785380592391139"]
    for before, after in (("x ", " y"), ("", ""), (",", ","), ("...", "."), ("(", ")"), ("***", "###"), ('"', '",')):
        for v in values:
            found = pii.find(before + v + after)
            assert [f[3].lstrip(".") for f in found] == [v], (before, v, after)
    for clean in ("1.2.3.4.5", "v1.2.3.4", "3.14159265358979323", "1,234,567", "2024-01-02 10:11", "0.1234567890123456"):
        assert pii.find(clean) == [], clean


def test_repeats_missing_ids_and_empty_table(make_docs):
    docs = make_docs([(1, TEXT), (1, TEXT), (None, TEXT), (2, "")])
    got = pii.pseudonymise(docs).collect()
    assert len(got) == 4 and len({r.text for r in got}) == 2
    assert pii.pseudonymise(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    old, got = {r.doc_id: r.text for r in docs.collect()}, rows(docs)
    assert set(got) == set(old)
    planted = 0
    for i, t in old.items():
        values = re.findall(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) 555-\d{4}|(?<!\d)\d{16}(?!\d)|(?<![\d.])\d+\.\d+\.\d+\.\d+", t)
        planted += len(values)
        assert got[i].n_entities >= len(values) and not any(v in got[i].text for v in values)
        if not values:
            assert got[i].text == t
    assert planted > 50


def test_permutations_take_every_number_of_a_format_once():
    key = b"k"
    for n in (1, 2, 5, 100, 1000):
        assert sorted(pii.permuted(key, "x", x, n) for x in range(n)) == list(range(n))
        odd = lambda y: y % 3 == 1
        assert sorted(pii.permuted(key, "x", x, n, odd) for x in range(1, n, 3)) == list(range(1, n, 3))
    addresses = [f"192.168.{a}.{b}" for a in range(256) for b in range(256)][::7] + ["10.1.2.3", "127.0.0.1", "172.20.1.1", "8.8.8.8", "240.1.1.1"]
    new = [pii.surrogate(key, "ip", a, 0) for a in addresses]
    ip = lambda a: pii.ip_range(int.from_bytes(bytes(map(int, a.split("."))), "big"))
    assert len(set(new)) == len(new) and [ip(a) for a in new] == [ip(a) for a in addresses]
    cards = [f"4{k:014d}{c}" for k in range(60) for c in range(10)]
    new = [pii.surrogate(key, "card", c, 0) for c in cards]
    assert len(set(new)) == len(new) and [pii.luhn(c) == 0 for c in new] == [pii.luhn(c) == 0 for c in cards] and all(c[0] == "4" for c in new)
    for kind, values in (("ssn", [f"{k:09d}" for k in (*range(10_100_010, 10_100_400), 999_999_999, 0)]), ("phone", [f"+1509555{k:04d}" for k in range(500)]), ("iban", [f"DE{c:02d}{k:018d}" for c in (10, 20) for k in range(200)])):
        new = [pii.surrogate(key, kind, v, 0) for v in values]
        assert len(set(new)) == len(new) and [len(x) for x in new] == [len(v) for v in values]


def test_mail_of_few_letters_or_none_ends(make_docs):
    texts = ["write to -@-.com or to _@b.com", "a@b.com e@b.com i@b.com o@b.com u@b.com y@b.com", " ".join(f"{c}@b.com" for c in "bcdfghjklmnpqrstvwxz"), "李@例子.com and 王@例子.com"]
    got = rows(make_docs(texts))
    old, new = " ".join(texts).split(), " ".join(got[i].text for i in range(4)).split()
    swapped = {a: b for a, b in zip(old, new) if "@" in a}
    assert len(old) == len(new) and len(set(swapped.values())) == len(swapped) and not set(swapped) & set(swapped.values())
    assert all("\u4e00" <= swapped[x][0] <= "\u9fa5" for x in ("李@例子.com", "王@例子.com"))


def test_names_by_context_and_bare_mentions(make_docs):
    texts = [
        "Barack Obama met Wei Zhang and Fatima Hassan. Then Obama left, and Zhang too.",
        "Mrs Anna Weber came. Weber said so, and Anna agreed with Weber-Klein.",
        "My name is Nadia Petrova",
        "Госпожа Анна Петрова и Господин Пётр Петров",
        "The United Nations and New York are no names here, Monday neither.",
    ]
    got = rows(make_docs(texts))
    for i, hidden in ((0, "Barack Obama Wei Zhang Fatima Hassan"), (1, "Anna Weber"), (2, "Nadia Petrova"), (3, "Анна Петрова Пётр Петров")):
        words = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", got[i].text)
        assert not set(hidden.split()) & set(words), got[i].text
    a = got[0].text.split()
    assert a[1] == a[9] and got[1].text.split()[1] == re.findall(r"\w+", got[1].text)[8] and "Weber-Klein" in got[1].text
    she, he = got[3].text.split()[2], got[3].text.split()[6]
    assert she.endswith(("ова", "ева", "ина")) and he.endswith(("ов", "ев", "ин"))
    assert got[4].text == texts[4]


def swapped(text):
    return pii.replace(text, b"k", {}, {})[0]


def test_ordinary_text_stays():
    for text in (
        "The Court said no. The man left. The end of The story, The Court.",
        "White House said, New York said, they met Monday Morning. Prime Minister said so, Apple Inc said, Los Angeles works, United Nations asked, Supreme Court asked; Apple pie, Los Lobos and The Prime of life.",
        "Dear Customer Service, Dear Sir, met привет мир, met Central Park",
        "The Big Apple said no, a big one. In Baden Hessen told nobody; Baden Hessen said so.",
        "at 10:11:12, std::vector a::b, 1:2:3",
    ):
        assert swapped(text) == text


def test_a_part_has_one_surrogate_in_a_document():
    got = re.findall(r"\w+", swapped("Mr Kim Novak met them. Kim Novak said no. Then Kim left."))
    assert got[1:3] == got[5:7] and got[1] == got[10] and "Kim" not in got and "Novak" not in got
    a, b = (re.findall(r"\w+", swapped(t)) for t in ("Mr Kim met us", "Mrs Kim Weber met us"))
    assert a[1][:6] == b[1][:6]  # drawn by the part, ended by its type


def test_mentions_in_other_forms():
    got = swapped("Mrs Anna Weber. Weber's car, WEBER and Webers Haus. Anna Müller's and a later MÜLLER. Weber’s")
    m = re.fullmatch(r"Mrs (\w+) (\w+)\. (\w+)'s car, ([A-Z]+) and (\w+)s Haus\. (\w+) (\w+)'s and a later ([A-Z]+)\. (\w+)’s", got)
    assert m and m[2] == m[3] == m[5] == m[9] and m[4] == m[2].upper() and m[6] == m[1] and m[8] == m[7].upper() and "Weber" not in got
    words = re.findall(r"\w+", swapped("Госпожа Анна Петрова; с Петровой, Петровым, к Петрову. Ирина"))
    base = words[2].removesuffix("а")
    assert [w.removeprefix(base) for w in (words[2], words[4], words[5], words[7])] == ["а", "ой", "ым", "у"] and base.endswith(("ов", "ев", "ин"))
    got = swapped("Baden Hessen said no. In Hessen all is well, Hessen said.")
    assert "In Hessen" in got and not got.startswith("Baden Hessen") and not got.endswith("Hessen said.")
    assert swapped("President Obama flew home. O'Neil, Mr O'Neil said; O'Neil's").count("O'Neil") == 0


def test_countries_and_addresses_of_128_bits():
    for number, code in (("+353 1 555 1234", "+353 "), ("+358 40 555 1234", "+358 "), ("+44 20 7946 0958", "+44 "), ("+1 (509) 555-6973", "+1 ("), ("+7 495 123-45-67", "+7 ")):
        new = swapped(f"call {number} now")
        assert new.startswith(f"call {code}") and number not in new and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", f"call {number} now")
    kinds = ["2001:db8::1", "fe80::a1b2:3c4d", "fc00::1:2", "2a00:1450:4001:81b:0:0:0:200e", "2A00:1450:4001:081B:0000:0000:0000:200E"]
    new = [swapped(f"at {a}, then").removeprefix("at ").removesuffix(", then") for a in kinds]
    assert [pii.ip6_kind(pii.ip6(a)) for a in kinds] == [pii.ip6_kind(pii.ip6(a)) for a in new] and len(set(map(pii.ip6, new))) == 4 and pii.ip6(new[3]) == pii.ip6(new[4]) and new[4] == new[4].upper() and len(new[4]) == 39
    many = [pii.surrogate(b"k", "ip6", f"{(0x20010DB8 << 96) + k:032x}", 0) for k in range(300)]
    assert len(set(many)) == 300 and all(x.startswith("20010db8") for x in many)


def test_against_a_plain_version(make_docs):
    """Whole tables: what isn't in a span stays, spans' values and surrogates are one to one by kind, and no surrogate of a name or mail is an entity."""
    texts = [TEXT, "Mr Bo Li, Ms Bo Ek, Dr Ek-Li said hello to bo@li.example", "Wei Zhang said it. Zhang too", "nothing at all", None, ""] + [f"Ms {a} {b} wrote to {a.lower()}{k}@mail{k % 3}.example.org from 10.{k}.2.3" for k, (a, b) in enumerate([("Ada", "Byron"), ("Bea", "Byron"), ("Ada", "Clark")] * 9)]
    got, forth, back = rows(make_docs(texts)), {}, {}
    for i, t in enumerate(texts):
        spans = [(int(a), int(b), k) for k, a, b in (e.split(":") for e in got[i].entities.split(",") if e)]
        assert got[i].n_entities == len(spans) and spans == sorted(spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        outside = [x for x in re.split("|".join(re.escape((t or "")[a:b]) for a, b, _ in spans) or "$^", t or "")]
        at, pieces = 0, []
        for a, b, _ in spans:
            pieces.append((t or "")[at:a])
            at = b
        pieces.append((t or "")[at:])
        new = re.fullmatch("(.+?)".join(map(re.escape, pieces)), got[i].text or "", re.S)
        assert new and len(outside) >= 1
        for (a, b, k), y in zip(spans, new.groups()):
            x = t[a:b]
            n = pii.norm(k, x)
            kind = "name" if k.startswith("given") or k == "family" else k
            y = pii.norm(k, y)
            assert x != y and forth.setdefault((k, n), y) == y and back.setdefault((kind, y), (k, n)) == (k, n)
    reals = {("name" if k.startswith("given") or k == "family" else k, n) for k, n in forth}
    assert not reals & {b for b in back if b[0] in ("name", "email")} and len(forth) > 60
