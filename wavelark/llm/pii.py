"""Surrogate generation for personal data.

Detected entities (e-mail addresses, phone numbers, IP addresses, card-like numbers, IBANs, social
security numbers, and names; IP addresses of both kinds) are replaced by surrogates of the same type and format (lengths,
separators, case, script, country, private or public range, whether a check digit holds).

Names are found after a form of address, by a common given name, or by words around them. "My name is",
"Dear", "signed by" and the like are strong cues; "met", "said" and the like are weak ones, and a name
that follows a found one by "and" or a comma is as certain as a weak one. Two capitalised words are no
name if one of them is a determiner, a weekday, a word of places or institutions and so on (NO_NAME), and by
a weak cue they are none either if the document has one of them in lower case, or has both after "the" or "in".
Then bare mentions of a name's parts in the same document are found, so that a plain "Weber" beside "Mrs
Anna Weber" doesn't stay in clear: in capitals, with a possessive ('s) or genitive s, and in the cases
of Slavic family names too. What a weak cue alone has found spreads less: its last part, where that
stands by itself and after no article or preposition. A part has one type in a document, the most certain one that a
mention gives it, so a person stays one person. Names without any of these stay.

Numbers: within each format (the valid card numbers of sixteen digits that begin with a 4, the
addresses of 192.168, and so on) a keyed permutation, a Feistel network with cycle walking, gives
each number its surrogate. So different ones never share a surrogate, however many there are and even
if the corpus holds the whole space; a surrogate may be another's number, which is replaced in turn.

Names and mail addresses: surrogates are keyed by HMAC, names part by part with the gender (of given
names, and of surnames where their ending tells it) and script kept, hosts apart from local parts.
Collision checks: the different ones are gathered as a table; where two share a surrogate, all but
the least, and where a surrogate is an entity of the corpus, its owner, draw again. Each draw is from
a space that is larger than the last by a letter or syllable, so the checks end. The table of those
that drew again is broadcast if it has at most FEW rows, else joined by text, salted.

Defined cases: null text stays null; empty text stays empty; text without entities is unchanged.
Ties: of entities that overlap the first one counts, of those that begin together mail, IBAN, social
security, card, phone, IP, name, in this order. Repeated rows get equal results, whatever their ids
(null ids too). An empty table gives no rows. Long texts are scanned whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_arrow

KEY = b"set spark.wavelark.pii.key to a secret of your own"
FEW, SALTS = 500_000, 16
ROUNDS = 8

HOST = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
IBAN = r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
SSN = r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
CARD = r"(?P<card>(?<!\d)(?<!\d[.,])(?:\d{4}(?P<sep>[\x20-]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}|\d{4}\x20\d{6}\x20\d{5}|\d{13,19})(?![\d]))"
PHONE = r"(?P<phone>(?<![\w+])(?<!\d\.)(?:\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d{1,4}(?:[\x20.-]?\d{2,4}){1,4}|\(\d{3}\)\x20?\d{3}[-.\x20]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\d))"
IP = r"(?P<ip>(?<![\dvV])(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d))"
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
CAP = r"(?:[OD]['’])?[^\W\d_a-zß-öø-ÿ][^\W\d_]+(?:-[^\W\d_]+)?"
#: Forms of address that tell a gender, or none, and common given names by script and gender.
ADDRESS = {
    "m": "Mr Mister Herr Herrn Monsieur Señor Signor Sir Господин Κύριος".split(),
    "f": "Mrs Ms Miss Frau Madame Mademoiselle Señora Señorita Signora Lady Госпожа Κυρία".split(),
    "u": "Dr Prof Professor Doctor President Chancellor Senator Governor".split(),
}
GIVEN = {
    "latin": {
        "m": "James John Robert Michael William David Thomas Daniel Peter Paul Hans Karl Stefan Andreas Pierre Jean Louis Antoine Carlos José Luis Miguel".split(),
        "f": "Mary Anna Linda Susan Sarah Laura Julia Emma Maria Sophie Claire Marie Camille Ursula Monika Petra Sabine Carmen Lucía Elena Isabel Teresa".split(),
    },
    "cyrillic": {"m": "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил".split(), "f": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split()},
    "greek": {"m": "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος".split(), "f": "Μαρία Ελένη Κατερίνα Σοφία Άννα Δήμητρα".split()},
}
GENDER = {name: (script, g) for script, by in GIVEN.items() for g, names in by.items() for name in names}
#: Syllables that made-up names are built from, and how they end by gender.
SYLLABLES = {"latin": "ba da fe ga ha jo ka le ma ne or pa ra sa ti va we".split(), "cyrillic": "ба ва га да же за ка ле ма но па ра са та фе".split(), "greek": "βα γα δε ζα θη κα λε μα νο πα ρα σα τα φι".split()}
ENDINGS = {"latin": {"m": "n rt k s".split(), "f": "a na ra ia".split(), "s": "mann son ez eau er".split()}, "cyrillic": {"m": "н р й".split(), "f": "а на я".split(), "s": "ов ев ин".split()}, "greek": {"m": "ος ης ας".split(), "f": "α η ία".split(), "s": "ίδης άκης όπουλος".split()}}
#: Letters that stand for each other, and ranges of code points of other scripts' letters.
ALPHABETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αειουωη", "βγδζθκλμνξπρστφχψ", "0123456789"]
RANGES = ((0x5D0, 0x5EA), (0x561, 0x586), (0x628, 0x63A), (0x641, 0x64A), (0x915, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3042, 0x3093), (0x30A2, 0x30F3), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
ALPHABET = {c: a for a in ALPHABETS for c in a}
#: Words before and after a name, those that tell more first.
BEFORE = "name\x20is|Name:|Dear|Sincerely,|Regards,|[Ss]igned\x20by|named"
WEAK, AFTER = "met|told|asked|emailed", "said|says|met|told|asked|wrote|lives|works"
#: Fixed values, in lower case: capitalised words that are no part of a person's name: function words, days and months, words of places, institutions and offices.
NO_NAME = frozenset(
    """a all an and any as at both but by each every for from he her here his i if in it its many most my no none of on or our she so some that the their then there these they this those to we what when where which who why with yes you your
    monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december today tomorrow yesterday morning evening night spring summer autumn winter
    der die das ein eine und le la les un une des et el los las una y il lo gli
    new old north south east west northern southern eastern western central upper lower san santa saint st fort port mount lake united great grand white black red green blue royal national international federal american british french german european english
    city county state states street road avenue square park river island bay hill house home court union nations kingdom republic parliament congress senate government ministry minister prime supreme high department office agency council committee commission board party
    university college school institute academy museum library hospital church bank company corporation corp inc ltd llc gmbh ag co group holdings industries airlines times post news press journal team club association society foundation center centre police army navy force
    customer service support sales sir madam friends colleagues everyone president chancellor senator governor chairman director manager editor""".split()
)
FEMALE, MALE = re.compile("(?:[оеё]ва|ина|[сц]кая)$"), re.compile("(?:[оеё]в|ин|[сц]кий)$")
#: Country codes of one and two digits; all others have three.
COUNTRY = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}|\d{1,2}$)|")
#: How family names in -ов, -ев, -ин are declined.
DECLINED = re.compile("(.+(?:[оеё]в|[иы]н))(а|у|ым|е|ой|ою|ы|ых|ым|ыми)?")
_titles = "|".join(t + r"\.?" for ts in ADDRESS.values() for t in ts)
NUMBERS = re.compile("|".join((IBAN, SSN, CARD, PHONE, IP)))
NAME = re.compile(
    rf"(?P<title>(?<!\w)(?:{_titles})\x20)(?P<named>{CAP}(?:\x20{CAP}){{0,2}})|(?<!\w)(?P<full>(?:{'|'.join(GENDER)})\x20{CAP})(?!\w)"
    rf"|(?<!\w)(?:{BEFORE})[\x20\n](?!(?:{_titles})\x20)(?P<cued>{CAP}\x20{CAP})(?!\w)|(?<!\w)(?:{WEAK})\x20(?!(?:{_titles})\x20)(?P<hinted>{CAP}\x20{CAP})(?!\w)|(?<!\w)(?!(?:{_titles})\x20)(?P<said>{CAP}\x20{CAP})(?=\x20(?:{AFTER})\b)"
)
NEXT = re.compile(rf"(?:,|,?\x20and)\x20(?!(?:{_titles})\x20)(?P<next>{CAP}\x20{CAP})(?!\w)")
#: A text has a number only where DIGITS is, and a name only with one of these words.
DIGITS = re.compile(r"\d[\d .()-]{5}|[A-Z]{2}\d\d")
WORD = re.compile(r"\w+")
KNOWN = frozenset(w for ts in ADDRESS.values() for w in ts) | GENDER.keys() | frozenset("name Name Dear Sincerely Regards signed Signed met told asked emailed named said says wrote lives works".split())
ORDER = ("email", "iban", "ssn", "card", "phone", "ip", "ip6")
#: How certain a name is by what found it.
CERTAIN = {"named": 3, "full": 3, "cued": 2, "hinted": 1, "said": 1, "next": 1}
TOKEN = re.compile(r"(?:[ODod]['’])?[^\W\d_]+(?:[-][^\W\d_]+)?")
LOWER = re.compile(r"(?<!\w)[a-zß-öø-ÿа-яёα-ω][^\W\d_]*")

#: What stands before places and things, not before persons' names alone.
PLACED = frozenset("the a an in at near of der die das im le la les el los".split())

Entity = tuple[int, int, str, str]


def script_of(word: str) -> str:
    for ch in word:
        if ch.isalpha():
            name = unicodedata.name(ch, "").split(" ")[0].lower()
            return name if name in SYLLABLES else "other"
    return "latin"


def mails(text: str) -> list[Entity]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        if start < at and (m := HOST.match(text, at + 1)):
            end = m.end()
            out.append((start, end, "email", text[start:end]))
        at = text.find("@", at + 1)
    return out


def capital(word: str) -> bool:
    """Whether a word begins like a name: with a capital, or with a letter of a script that has none."""
    return word[0].isupper() or word[0].lower() == word[0].upper()


def base_of(word: str) -> str:
    """A word in the form that all its mentions share: lower case, and family names in -ов, -ев, -ин undeclined."""
    word = unicodedata.normalize("NFC", word).casefold()
    return m[1] if (m := DECLINED.fullmatch(word)) else word


def names(text: str) -> list[list[Entity]]:
    """Names as rows of parts, typed given_m, given_f, given_u or family; bare mentions of their parts are rows of one."""
    rows: list[tuple[int, list[Entity]]] = []
    lower: list[frozenset[str]] = []

    def add(kind: str, whole: str, at: int, title: str) -> int:
        """Where the name ends; 0 if it is none."""
        parts, row = whole.split(" "), []
        if kind == "named":  # what follows a form of address is a name as far as it can be
            n = next((i for i, p in enumerate(parts) if p.casefold() in NO_NAME), len(parts))
            parts = parts[:n]
        if not parts or any(p.casefold() in NO_NAME for p in parts) or not all(map(capital, parts)):
            return 0
        if CERTAIN[kind] == 1:
            lower[:] = lower or [frozenset(LOWER.findall(text))]
            if any(p.casefold() in lower[0] for p in parts) or re.search(rf"(?i:\b(?:the|in|at|near)) {re.escape(whole)}(?!\w)", text):
                return 0
        known = GENDER.get(parts[0])
        gender = known[1] if known else next((g for g, ts in ADDRESS.items() if title in ts), "u")
        for i, part in enumerate(parts):
            given = i < len(parts) - 1 if len(parts) > 1 else bool(known)
            row.append((at, at + len(part), "given_" + gender if given else "family", part))
            at += len(part) + 1
        rows.append((CERTAIN[kind], row))
        return row[-1][1]

    at = 0
    while m := NAME.search(text, at):
        kind = m.lastgroup
        end = add(kind, m[kind], m.start(kind), (m["title"] or "").rstrip(". "))
        at = end or m.start(kind) + len(m[kind].split(" ")[0])
        while end and (m := NEXT.match(text, at)):
            at = end = add("next", m["next"], m.start("next"), "") or at
            if at != m.end("next"):
                break
    # a part's type is the most certain one, a known gender before an unknown one, the first of equals
    kinds: dict[str, tuple[int, bool, int, str]] = {}
    for n, (sure, row) in enumerate(rows):
        for _, _, kind, part in row:
            mine = (-sure, kind == "given_u", n, kind)
            kinds[base_of(part)] = min(kinds.get(base_of(part), mine), mine)
    out = [[(a, b, kinds[base_of(part)][-1], part) for a, b, _, part in row] for _, row in rows]
    if not kinds:
        return out
    last = {base_of(row[-1][3]) for sure, row in rows if sure == 1}
    taken = {e[0] for row in out for e in row}
    for m in TOKEN.finditer(text):
        word = m[0]
        if m.start() in taken or not capital(word):
            continue
        base = base_of(word)
        if base not in kinds and word.endswith(("s", "S")) and base_of(word[:-1]) in kinds:
            word, base = word[:-1], base_of(word[:-1])
        if base not in kinds:
            continue
        if kinds[base][0] == -1:
            before, after = text[max(0, m.start() - 24) : m.start()], text[m.end() : m.end() + 2]
            prior = re.search(r"(\w+)\W*$", before)
            if base not in last or after[:1] == " " and after[1:].isupper() or prior and (prior[1].casefold() in PLACED or before.endswith(" ") and prior[0].endswith(prior[1] + " ") and prior[1][0].isupper() and prior[1].casefold() not in NO_NAME):
                continue
        out.append([(m.start(), m.start() + len(word), kinds[base][-1], word)])
    return out


def find(text: str | None) -> list[Entity]:
    """(start, end, type, value): leftmost entities without overlap."""
    if not text:
        return []
    rows: list[list[Entity]] = [[e] for e in mails(text)] if "@" in text else []
    if DIGITS.search(text):
        for m in NUMBERS.finditer(text):
            kind = next(k for k in ORDER[1:] if m[k])
            if kind != "phone" or sum(c.isdigit() for c in m[0]) >= 7:
                rows.append([(m.start(kind), m.end(kind), kind, m[kind])])
    if "::" in text or text.count(":") > 6:
        for m in IP6.finditer(text):
            x = ip6(m[0])
            if x is not None and x > 0xFFFF and sum(c.isdigit() for c in m[0]):
                rows.append([(m.start(), m.end(), "ip6", m[0])])
    if not KNOWN.isdisjoint(WORD.findall(text)):
        rows += names(text)
    out: list[Entity] = []
    for row in sorted(rows, key=lambda r: (r[0][0], ORDER.index(r[0][2]) if r[0][2] in ORDER else len(ORDER))):
        if not out or row[0][0] >= out[-1][1]:
            out += row
    return out


def norm(kind: str, value: str) -> str:
    """What makes two mentions the same entity."""
    if kind in ("card", "phone", "ssn", "iban"):
        return re.sub(r"[^0-9A-Za-z+]", "", value).upper()
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    if kind == "ip6":
        return f"{ip6(value):032x}"
    return unicodedata.normalize("NFC", value).lower() if kind == "email" else base_of(value)


class Draw:
    """An endless row of small numbers that a key and a value determine."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.n, self.bytes = key, "\x00".join(what).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.bytes) < 4:
            self.bytes += hmac.new(self.key, self.what + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.bytes = int.from_bytes(self.bytes[:4], "big"), self.bytes[4:]
        return x % n


def permuted(key: bytes, what: str, x: int, n: int, same=lambda y: True) -> int:
    """Where a keyed permutation of the numbers below n takes x; with `same`, one of those that it holds for (x among them)."""
    bits = max(2, (n - 1).bit_length())
    low = bits // 2
    high = bits - low
    while True:
        a, b, wa, wb = x >> low, x & (1 << low) - 1, high, low
        for k in range(ROUNDS):  # the halves change places, each as wide as it is
            f = hashlib.blake2b(b.to_bytes(-(-wb // 8), "big"), key=key[:64], person=k.to_bytes(16, "big"), salt=hashlib.blake2b(what.encode("utf-8", "surrogatepass"), digest_size=16).digest(), digest_size=64).digest()
            a, b, wa, wb = b, a ^ int.from_bytes(f, "big") & (1 << wa) - 1, wb, wa
        x = a << wb | b
        if x < n and same(x):
            return x


def letters_of(ch: str) -> tuple[int, int | str]:
    """A letter's or digit's number in its alphabet, and the alphabet (or the first code point of its range); else (-1, 0)."""
    if (a := ALPHABET.get(ch)) is not None:
        return a.index(ch), a
    lo = next((lo for lo, hi in RANGES if lo <= ord(ch) <= hi), 0)
    return (ord(ch) - lo, lo) if lo else (-1, 0)


def like(key: bytes, what: str, value: str, more: int = 0) -> str:
    """Same length, each letter or digit for one of its alphabet by a keyed permutation of all such values, the rest as it is; `more` letters are added."""
    out = []
    for at in range(0, max(len(value), 1), 64):
        part = value[at : at + 64]
        where = [(i, *letters_of(ch)) for i, ch in enumerate(part.lower()) if len(part.lower()) == len(part)]
        where = [w for w in where if w[1] >= 0]
        extra = more if at + 64 >= len(value) else 0
        sizes = [len(a) if isinstance(a, str) else next(hi - lo + 1 for lo, hi in RANGES if lo == a) for _, _, a in where] + [21, 5] * (extra // 2) + [21] * (extra % 2)
        n = x = 0
        for (_, k, _), size in zip([*where, *[(0, 0, 0)] * extra], sizes):
            n, x = (n or 1) * size, x * size + k
        if not n:
            out.append(part)
            continue
        y, chars, tail = permuted(key, f"{what}\x00{at}\x00{extra}\x00{part if not where else ''.join(str(a) for _, _, a in where)}", x, n), list(part), []
        for j in range(len(sizes) - 1, -1, -1):
            y, k = divmod(y, sizes[j])
            if j >= len(where):
                tail.append(ALPHABETS[(j - len(where)) % 2 == 0][k])
                continue
            i, _, a = where[j]
            new = a[k] if isinstance(a, str) else chr(a + k)
            chars[i] = new.upper() if part[i].isupper() else new
        out.append("".join([*chars, *reversed(tail)]))
    return "".join(out)


def luhn(digits: str) -> int:
    return sum((2 * d - 9 * (d > 4) if k % 2 else d) for k, d in enumerate(map(int, reversed(digits)))) % 10


def digits(key: bytes, what: str, value: str, same=lambda y: True) -> str:
    return f"{permuted(key, f'{what}:{len(value)}', int(value), 10 ** len(value), lambda y: same(f'{y:0{len(value)}d}')):0{len(value)}d}"


def ip_range(x: int) -> str:
    a, b = x >> 24, x >> 16 & 255
    return "10" if a == 10 else "127" if a == 127 else "172" if a == 172 and 16 <= b < 32 else "192" if (a, b) == (192, 168) else "other" if not 0 < a < 224 else "public"


#: First address and number of addresses of the small ranges.
SMALL_RANGES = {"10": (10 << 24, 1 << 24), "127": (127 << 24, 1 << 24), "172": (172 << 24 | 16 << 16, 1 << 20), "192": (192 << 24 | 168 << 16, 1 << 16)}


def ip6(value: str) -> int | None:
    """The number of an address of 128 bits, or None."""
    try:
        return int(ipaddress.IPv6Address(value))
    except ValueError:
        return None


#: Prefixes (bits, value) of the kinds of addresses that stay among themselves: unique local, link local, multicast, documentation; others are alike.
KINDS6 = ((7, 0xFC >> 1), (10, 0xFE80 >> 6), (8, 0xFF), (32, 0x20010DB8), (3, 1))


def ip6_kind(x: int) -> int:
    return next((i for i, (bits, v) in enumerate(KINDS6) if x >> 128 - bits == v), len(KINDS6))


def iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def mail_host(key: bytes, host: str) -> str:
    *labels, top = host.split(".")
    some = ["".join(c for c in x if letters_of(c)[0] >= 0) for x in labels]
    return ".".join([*(like(key, f"host:{'.'.join(labels[i + 1 :])}.{top}", x, max(0, 4 - len(some[i]))) for i, x in enumerate(labels)), top])


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The surrogate of a normalised value; attempts matter for names and mail."""
    if kind == "email":
        local, _, host = value.rpartition("@")
        known = sum(letters_of(c)[0] >= 0 for c in local)
        return like(key, f"mail:{host}", local, max(0, 4 - known) + attempt) + "@" + mail_host(key, host)
    if kind == "ip":
        x = int.from_bytes(bytes(map(int, value.split("."))), "big")
        lo, n = SMALL_RANGES.get(ip_range(x), (0, 1 << 32))
        y = lo + permuted(key, f"ip:{lo}", x - lo, n, lambda y: ip_range(y + lo) == ip_range(x))
        return ".".join(map(str, y.to_bytes(4, "big")))
    if kind == "ip6":
        x = int(value, 16)
        bits, prefix = KINDS6[ip6_kind(x)] if ip6_kind(x) < len(KINDS6) else (0, 0)
        rest = 128 - bits
        y = prefix << rest | permuted(key, f"ip6:{bits}:{prefix}", x & (1 << rest) - 1, 1 << rest, lambda y: ip6_kind(prefix << rest | y) == ip6_kind(x))
        return f"{y:032x}"
    if kind == "card":
        last = next(d for d in "0123456789" if luhn(value[:-1] + d) == 0)
        off = (int(value[-1]) - int(last)) % 10  # 0 where the check digit holds
        body = value[0] + digits(key, f"card:{value[0]}:{off}", value[1:-1])
        last = next(d for d in "0123456789" if luhn(body + d) == 0)
        return body + str((int(last) + off) % 10)
    if kind == "iban":
        country, body = value[:2], value[4:]
        off = (int(value[2:4]) - int(iban_check(country, body))) % 100
        new = like(key, f"iban:{country}:{off}", body.lower()).upper()
        return f"{country}{(int(iban_check(country, new)) + off) % 100:02d}{new}"
    if kind == "phone":
        keep = COUNTRY.match(value)[0]
        rest = value[len(keep) :]
        return keep + (digits(key, f"phone:{keep}", rest, lambda y: (y[0] == "0") == (rest[0] == "0")) if rest else "")
    if kind == "ssn":
        valid = lambda y: 0 < int(y[:3]) < 666 and int(y[3:5]) > 0 and int(y[5:]) > 0
        return digits(key, "ssn", value, lambda y: valid(y) == valid(value))
    script = script_of(value)
    if script == "other":
        return like(key, f"name:{kind}", value) + like(key, f"more:{kind}:{attempt}", (value * (attempt + 1))[:attempt])
    draw = Draw(key, "name", value, str(attempt))  # of the part alone: its type has a say in the ending only
    gender = "s" if kind == "family" else kind[-1]
    if gender == "u":
        gender = "mf"[draw.below(2)]
    some, ends = SYLLABLES[script], ENDINGS[script][gender]
    if gender == "s" and script == "cyrillic":
        stems = ("ов", "ев", "ин")
        ends = tuple(e + "а" for e in stems) if FEMALE.search(value) else stems if MALE.search(value) else ("ко", "ук", "дзе")
    stem = "".join(some[draw.below(len(some))] for _ in range(3 + attempt))
    return (stem + ends[draw.below(len(ends))]).capitalize()


def fit_format(kind: str, value: str, new: str) -> str:
    """The surrogate as this mention writes it: its separators, its case."""
    if kind in ("card", "phone", "ssn", "iban"):
        chars = iter(new)
        return "".join(next(chars, "") if c.isalnum() or c == "+" else c for c in value)
    if kind == "ip6":
        groups = str(ipaddress.IPv6Address(int(new, 16))) if "::" in value else ":".join(f"{int(new[i : i + 4], 16):x}" if len(value) < 39 else new[i : i + 4] for i in range(0, 32, 4))
        return groups.upper() if any(c.isupper() for c in value) else groups
    if kind != "email" and (m := DECLINED.fullmatch(unicodedata.normalize("NFC", value).casefold())):
        new += (m[2] or "") if (d := DECLINED.fullmatch(new.casefold())) and not d[2] else ""
    if value.isupper() and len(value) > 1:
        return new.upper()
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(value, new)) if len(new) == len(value) else new
    return new.lower() if value.islower() else new


def replace(text: str | None, key: bytes, attempts: dict[tuple[str, str], int], cache: dict) -> tuple[str | None, list[Entity]]:
    found = find(text)
    if not found:
        return text, found
    out, at = [], 0
    for start, end, kind, value in found:
        n = norm(kind, value)
        if (kind, n) not in cache:
            if len(cache) > 100_000:
                cache.clear()
            cache[kind, n] = surrogate(key, kind, n, attempts.get((kind, n), 0))
        out += [text[at:start], fit_format(kind, value, cache[kind, n])]
        at = end
    return "".join([*out, text[at:]]), found


def key_of(spark) -> bytes:
    return (spark.conf.get("spark.wavelark.pii.key", None) or KEY.decode()).encode()


def entities(docs: DataFrame) -> DataFrame:
    """The different names and mail addresses (kind, norm) of each batch of texts, with the hash of a text that has them."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = {(k, kind, norm(kind, value)) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for _, _, kind, value in find(text) if kind not in ORDER[1:]}
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sorted(rows))], names=["text_key", "kind", "norm"]) if rows else None

        return run

    return map_arrow(docs.select(F.md5("text").alias("text_key"), "text").filter("text is not null"), make, "text_key string, kind string, norm string")


def with_surrogates(rows: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, attempt) plus the surrogate of that attempt."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            new = [norm(k.split("_")[0] if k.startswith("given") else k, surrogate(key, k, n, a)) for k, n, a in zip(*(c.to_pylist() for c in batch.columns))]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "norm", "attempt", "surrogate"])

        return run

    return map_arrow(rows.select("kind", "norm", "attempt"), make, "kind string, norm string, attempt int, surrogate string")


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """Durable (kind, norm, attempt) such that surrogates are distinct by kind and none is an entity of the corpus."""
    # Genders and family names share one space of names, so that no two people's parts can meet.
    space = lambda c: F.when(F.col(c).startswith("given") | (F.col(c) == "family"), F.lit("name")).otherwise(F.col(c))
    real = found.select(space("kind").alias("space"), F.col("norm").alias("surrogate")).distinct()
    now = durable(with_surrogates(found.withColumn("attempt", F.lit(0)), key))
    while True:
        here = now.withColumn("space", space("kind"))
        owner = here.groupBy("space", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("norm", "kind")).alias("first")).filter("n > 1")
        shared = here.join(owner, ["space", "surrogate"]).filter((F.col("norm") != F.col("first.norm")) | (F.col("kind") != F.col("first.kind")))
        clash = durable(shared.select("kind", "norm").union(here.join(real, ["space", "surrogate"], "left_semi").select("kind", "norm")).distinct())
        if clash.isEmpty():
            return now
        again = with_surrogates(now.join(clash, ["kind", "norm"], "left_semi").withColumn("attempt", F.col("attempt") + 1), key)
        now = durable(now.join(clash, ["kind", "norm"], "left_anti").select("kind", "norm", "attempt", "surrogate").union(again))


def pseudonymise(docs: DataFrame) -> DataFrame:
    """doc_id, text with surrogates, n_entities and entities (type:start:end in the old text) of each row."""
    key = key_of(docs.sparkSession)
    found = durable(entities(docs).select("kind", "norm").distinct())
    odd = durable(assign(found, key).filter("attempt > 0").select("kind", "norm", "attempt"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, text string, n_entities long, entities string"

    def result(batch, attempts_of, cache):
        texts, spans = [], []
        for i, t in enumerate(batch.column(1).to_pylist()):
            new, ents = replace(t, key, attempts_of(i), cache)
            texts.append(new)
            spans.append(ents)
        said = [",".join(f"{k}:{a}:{b}" for a, b, k, _ in e) for e in spans]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, spans), pa.int64()), pa.array(said, pa.string())], names=["doc_id", "text", "n_entities", "entities"])

    if odd.count() <= FEW:
        shared = docs.sparkSession.sparkContext.broadcast({(r.kind, r.norm): r.attempt for r in odd.collect()})

        def make_small():
            cache: dict = {}
            return lambda batch: result(batch, lambda _: shared.value, cache)

        return map_arrow(rows, make_small, schema)
    # A text that a third of the rows have would fill a task: each goes to one of SALTS.
    of_text = entities(docs).distinct().join(odd, ["kind", "norm"]).groupBy("text_key").agg(F.collect_set(F.struct("kind", "norm", "attempt")).alias("odd"))
    of_text = of_text.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def make_joined():
        def run(batch):
            each = [{(o["kind"], o["norm"]): o["attempt"] for o in os or ()} for os in batch.column(2).to_pylist()]
            out = [result(batch.slice(i, 1), lambda _, i=i: each[i], {}) for i in range(batch.num_rows)]
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

        return run

    return map_arrow(rows.withColumn("text_key", F.md5("text")).withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(of_text, ["text_key", "salt"], "left").select("doc_id", "text", "odd"), make_joined, schema)
