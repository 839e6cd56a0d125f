"""HTML extraction by inferring union-free wrappers from pages of the same host.

A page becomes a tree of blocks, and each level of it a stream of tokens (tags and texts). Pages of
a host are aligned one after another: tokens of one tag whose contents are alike are matched, texts that differ
become slots, tokens that only one side has become optional, and neighbours of the same shape
fold into a repeated group. The result, a regular expression without unions, is the host's
wrapper. Its invariant texts are the site's own (labels, notices); its slots are the pages'
content, and each knows how much text it has held over all pages, links apart.

A page is read by matching its stream against its host's wrapper again. From the top, the block is
entered that holds most of its level's slot text over the host's pages, as long as it is one block and no
repeated record, and paragraphs beside it hold little; where that ends is the main block. All of its text is the article's, text that other pages have too
included, and what stands outside goes: menus hold links, notices are invariant, adverts and footers
hold little. Headings that stand before the main block, and differ from page to page, belong to it.

Tags and names choose where the wrapper leaves room: an `article` isn't looked into for a smaller
main block; of two large blocks the one that is called the article is meant; what is called a menu, a form
or comments goes from within the main block, unless it holds most of it; blocks called an article stay even outside. Where no block
stands out (the whole body is the main block) invariants go, and names choose among the slots as far as the slots' own text
bears them out. Reader comments that no name gives away, within the main block, are read as text.

Every page takes part: each task folds its pages into wrappers by host (a page whose form it has met
on INVARIANT_PAGES others would change nothing), and these (one a host and task) are
aligned with each other in the order of their text. Alignment isn't associative: how pages are dealt
to tasks can make a rare item optional at another place. A level of a wrapper has WIDTH items at most, far
more than folded levels have; what is beyond, or deeper than DEPTH, has no item, and its text counts by
the page's own. If all wrappers together are small they
are broadcast, else joined by host. Defined cases: null or empty html gives an empty text; a null
or odd url belongs to the host ''; repeated rows give repeated results; markup that breaks off or
nests wrongly is closed where it must be; a host of one page (or of copies of one) has a wrapper
without invariants, so the page's own text decides. Of blocks with equal text the first is entered.
Empty tables give no rows; extra columns don't matter; long pages are read whole.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_arrow

#: Bounds of a wrapper: items of one level, depth.
WIDTH, DEPTH = 200, 64
INVARIANT_PAGES = 3
#: Shares of slot text: a block with more than the first is entered, and no name makes it boilerplate; with less than the second no name makes it the whole article.
MOST, LITTLE = 0.5, 0.1
#: Bytes of wrappers that are broadcast; parts that a host's pages are dealt into beyond that; forms of pages that a task remembers.
SMALL, SALTS, FORMS = 32 << 20, 16, 100_000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S | re.I)
ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Tags of running text, tags without an end, and tags that a following one closes.
INLINE = set("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Tags of running text, which no main block is looked for in; tags that hold anything; headings.
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 hgroup li ul ol dl dt dd pre blockquote figure figcaption address details summary".split())
CONTAINERS = set("div section td article main aside header footer nav form center table tr tbody".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
#: How alike the contents of two containers of one label are at least, as a share of their kids' labels.
ALIKE = 0.25
BOILERPLATE_TAGS = set("head title nav footer aside form button menu dialog fieldset input select".split())
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|breadcrumbs?|byline|comments?|commentlist|consent|cookies?|copyright|disqus|feedback|footer|gdpr|header|login|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notice|notices|overlay|pager|pagination|popup|promo\w*|recommend\w*|related|replies|reply|respond|search|share|sharing|sidebar|sidenav|signup|site-?info|skip|social|sponsor\w*|subscribe|tags?|toolbar|topbar|widgets?)(?=$|[\s_-])",
    re.I,
)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articlebody|entry|main|post|story)(?=$|[\s_-])", re.I)
#: Names that tell how a page is laid out ("with-sidebar"), and those of an article's heading.
LAYOUT_NAMES = re.compile(r"(?<![\w-])(?:with|without|has|no)[-_][\w-]+", re.I)
HEADING_NAMES = re.compile(r"(?<![\w-])(?:\w+[-_]+)*header(?![\w-])", re.I)
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "label", "role", "inside", "inner", "kids", "items", "places", "plus", "chars")

    def __init__(self, tag: str, label: str, role: str, inside: str, inner: str):
        """role: what the block itself is called; inside: what it would be called in an article; inner: what its kids are told, '' or '+'."""
        self.tag, self.label, self.role, self.inside, self.inner, self.kids = tag, label, role, inside, inner, []
        self.items: list[list] = []  # its level as items, and the item (and the part of a group) of each kid
        self.places: list[tuple[int, int]] = []
        self.chars = -1  # its own text's length, once asked for
        self.plus = False  # whether it is, or holds, what is called an article


def _role(tag: str, attrs: dict[str, str], within: str) -> str:
    """What tag and names say: '-' boilerplate, '+' in the main article, '' elsewhere. `within`: what the blocks around say, boilerplate aside."""
    names = LAYOUT_NAMES.sub("", attrs.get("class", "") + " " + attrs.get("id", ""))
    if tag in BOILERPLATE_TAGS or attrs.get("role", "").lower() in BOILERPLATE_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return "-"
    if tag == "header" and within != "+":
        return "-"
    if tag in ("html", "body"):
        return within
    if tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article"):
        return "-" if re.search(r"comment|reply|respond|teaser|related", names, re.I) else "+"
    if within == "+":
        names = HEADING_NAMES.sub("", names)  # an article's own heading is part of it
    if names.strip() and BOILERPLATE_NAMES.search(names):
        return "-"
    return "+" if names.strip() and MAIN_NAMES.search(names) else within


@lru_cache(maxsize=50_000)
def called(tag: str, attributes: str, within: str) -> tuple[str, str, str]:
    """A block's label and role, and what its role would be in an article."""
    attrs = {a.group(1).lower(): a.group(2) or a.group(3) or a.group(4) or "" for a in ATTR.finditer(attributes)} if attributes else {}
    names = DIGITS.sub("#", " ".join(sorted(attrs.get("class", "").lower().split()))[:40])
    role = _role(tag, attrs, within)
    return tag + ("." + names if names else ""), role, _role(tag, attrs, "+") if role == "-" else role


def parse(page: str | None) -> Node:
    """The tree of blocks. Texts are kids too, as strings, with white space made single and trimmed; a link's text is marked by a leading \\x00."""
    root = Node("", "", "", "", "")
    stack, text, links = [root], [], [0, 0]

    def flush() -> None:
        if not text:
            links[1] = 0
            return
        joined = "".join(text)
        text.clear()
        clean = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
        if clean:
            stack[-1].kids.append(("\x00" if links[1] * 2 > len(joined.strip()) else "") + clean)
        links[1] = 0

    def close(to: int) -> None:
        flush()
        del stack[to:]

    at = 0
    page = page or ""
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            if links[0]:
                links[1] += m.start() - at
        at = m.end()
        if m.group(2) is not None:
            text.append(entities.escape(m.group(2)))
            continue
        tag = (m.group(4) or "").lower()
        if not tag or tag in INLINE:
            if tag == "a":
                links[0] = 0 if m.group(3) else 1
            continue
        if m.group(3):  # an end tag
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            else:
                flush()
            links[0] = 0
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        flush()
        if tag in BLOCKS and tag not in ("html", "body"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "li", "div", "section", "article", "body"):
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SCOPE.get(tag, ()):
                    break
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                    break
        if tag in ("body", "main", "article", "nav", "footer") and len(stack) > 1 and stack[-1].tag in ("head", "title"):
            while len(stack) > 1 and stack[-1].tag in ("head", "title"):
                stack.pop()
        label, role, inside = called(tag, m.group(5), stack[-1].inner)
        node = Node(tag, label, role, inside, stack[-1].inner if role == "-" else role)
        stack[-1].kids.append(node)
        if len(stack) < 400:
            stack.append(node)
    if at < len(page):
        text.append(page[at:])
    flush()
    return root


# A wrapper item is [label, role, optional, repeated, text, kids, chars]. Label '#' stands for a text: `text`
# is [mark of the invariant one, marks of up to INVARIANT_PAGES different pages that have it], or
# None for a slot; chars is how long its texts were, on all pages together, links apart. A group's label begins
# with '*', and its kids are its parts. A whole wrapper is its list of top items.


def mark(text: str) -> str:
    """What a wrapper keeps of an invariant text, so that its size doesn't follow the pages'."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=9).hexdigest()


def length(text: str) -> int:
    return 0 if text[:1] == "\x00" else len(text)


def items_of(node: Node, page: str, depth: int = 0) -> list[list]:
    """A page's own wrapper at this level: its kids as items, neighbours of one shape folded. The node remembers it."""
    out: list[list] = []
    for kid in node.kids:
        if isinstance(kid, str):
            item = ["#", node.role, False, False, [mark(kid), [page]], [], length(kid)]
        else:
            item = [kid.label, kid.role, False, False, None, items_of(kid, page, depth + 1) if depth < DEPTH else [], 0]
        if out and alike(out[-1], item):
            if item[0] == "#" and out[-1][4] is None:
                out[-1][6] += item[6]
            else:
                out[-1] = merge(out[-1], item)
            out[-1][3] = True
        elif len(out) < WIDTH:
            out.append(item)
        else:
            node.places.append((-1, 0))
            continue
        node.places.append((len(out) - 1, 0))
    node.items, moved = fold(out)
    node.places = [moved[i] if i >= 0 else (-1, 0) for i, _ in node.places]
    return node.items


def fold(items: list[list]) -> tuple[list[list], list[tuple[int, int]]]:
    """Tandem repeats of two or three items (dt dd dt dd) become one repeated group, label '*'; and where each item has gone."""
    where, at = [(i, 0) for i in range(len(items))], list(range(len(items)))
    if len(items) < 4:
        return items, where
    for period in (2, 3):
        k = 0
        while k + 2 * period <= len(items):
            a, end = items[k : k + period], k + period
            group = a
            while all(alike(x, y) for x, y in zip(a, items[end : end + period])) and end + period <= len(items) and a[0][0][0] != "*" and len({x[0] for x in a}) == period:
                group = [merge(x, y) for x, y in zip(group, items[end : end + period])]
                end += period
            if end > k + period:
                for j, now in enumerate(at):
                    if k <= now < end:
                        where[j], at[j] = (k, (now - k) % period), k
                    elif now >= end:
                        at[j] = now - (end - k) + 1
                        where[j] = (at[j], where[j][1])
                items[k:end] = [["*" + " ".join(x[0] for x in a), a[0][1], False, True, None, group, 0]]
            k += 1
    return items, where


@lru_cache(maxsize=50_000)
def container(label: str) -> bool:
    return label.split(".", 1)[0] in CONTAINERS


def alike(a: list, b: list) -> float:
    """How well two items match: 0 not at all, 1 the same label and contents of the same labels."""
    if a[0] != b[0]:
        return 0.0
    if not container(a[0]):
        return 1.0
    x, y = {k[0] for k in a[5]}, {k[0] for k in b[5]}
    share = len(x & y) / len(x | y) if x or y else 1.0
    return share if share >= ALIKE else 0.0


def merge(a: list, b: list) -> list:
    """The least general item for two of one label."""
    text = [a[4][0], sorted({*a[4][1], *b[4][1]})[:INVARIANT_PAGES]] if a[4] and b[4] and a[4][0] == b[4][0] else None
    return [a[0], a[1] if a[1] == b[1] else min(a[1], b[1]), a[2] or b[2], a[3] or b[3], text, align(a[5], b[5]) if a[5] or b[5] else [], a[6] + b[6]]


def pairing(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """The heaviest common subsequence of two streams of items, by how alike they are."""
    if len(a) == len(b) and all(alike(x, y) == 1.0 for x, y in zip(a, b)):
        return [(i, i) for i in range(len(a))]
    near = [[alike(x, y) for y in b] for x in a]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + near[i][j] if near[i][j] else 0.0)
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if near[i][j] and best[i][j] == best[i + 1][j + 1] + near[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[list], b: list[list]) -> list[list]:
    """Both streams in one: matched items merged, the others optional."""
    if len(a) == len(b) == 1 and alike(a[0], b[0]):
        return [merge(a[0], b[0])]
    out, i, j = [], 0, 0
    for x, y in [*pairing(a, b), (len(a), len(b))]:
        out += [[k[0], k[1], True, *k[3:]] for k in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return out[:WIDTH]


def shape(items: list[list]) -> tuple:
    return tuple((k[0], k[4] and k[4][0], shape(k[5])) for k in items)


def wrapper_of(page: str | None) -> list[list]:
    """The wrapper of a single page."""
    return items_of(parse(page), mark(page or ""))


def add(wrapper: list[list] | None, other: list[list]) -> list[list]:
    """One wrapper that both fit."""
    return other if wrapper is None else align(wrapper, other)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", url or "")
    return m.group(1).lower() if m else ""


def invariant(item: list) -> bool:
    return bool(item[4]) and len(item[4][1]) >= INVARIANT_PAGES


def slot_chars(item: list, known: dict[int, int]) -> int:
    """How much slot text an item has held, over all pages."""
    if (n := known.get(id(item))) is None:
        n = known[id(item)] = (0 if invariant(item) else item[6]) + sum(slot_chars(k, known) for k in item[5])
    return n


def own_chars(node: Node | str) -> int:
    if isinstance(node, str):
        return length(node)
    if node.chars < 0:
        node.chars = sum(map(own_chars, node.kids))
    return node.chars


def matched(node: Node, items: list[list]) -> list[list | None]:
    """The wrapper's item of each kid."""
    node.places = node.places or [(-1, 0)] * len(node.kids)  # deeper than DEPTH
    pairs = dict(pairing(node.items, items)) if items else {}
    out: list[list | None] = []
    for i, part in node.places:
        item = items[pairs[i]] if i in pairs else None
        out.append(item[5][part] if item and item[0][:1] == "*" and part < len(item[5]) else item)
    return out


def find_plus(node: Node) -> bool:
    node.plus = node.role != "-" and (any([find_plus(k) for k in node.kids if not isinstance(k, str)]) or node.tag in ("article", "main") or (node.role == "+" and bool(node.label)))
    return node.plus


class Page:
    """A page beside its host's wrapper: for each block the items of its kids."""

    def __init__(self, page: str | None, wrapper: list[list] | None, known: dict[int, int] | None = None):
        self.root, self.known = parse(page), {} if known is None else known
        items_of(self.root, mark(page or ""))
        find_plus(self.root)
        self.of: dict[int, list[list | None]] = {}
        todo = [(self.root, wrapper or [])]
        while todo:
            node, items = todo.pop()
            self.of[id(node)] = mine = matched(node, items)
            todo += [(k, i[5] if i else []) for k, i in zip(node.kids, mine, strict=True) if not isinstance(k, str)]

    def heart(self) -> list[tuple[Node, int]]:
        """The way to the main block: blocks, each with the place of the kid that is entered; the main block is the last such kid."""
        node, way = self.root, []
        while node.tag != "article":
            groups: dict[tuple, list[int]] = {}
            for k, (i, part) in enumerate(node.places):
                groups.setdefault((i, part) if i >= 0 else ("", k), []).append(k)
            weights = []
            for ks in groups.values():
                kid, item = node.kids[ks[0]], self.of[id(node)][ks[0]]
                if isinstance(kid, Node) and kid.tag in ("head", "title"):
                    continue
                w = sum(own_chars(node.kids[k]) for k in ks) if item is None or isinstance(kid, Node) and kid.plus else slot_chars(item, self.known)
                if item is not None and isinstance(kid, Node) and kid.plus:  # whatever is called the article counts with all that it holds, on an average page
                    w = max(w, slot_chars(item, self.known))
                weights.append((w, ks, item))
            total = sum(w for w, _, _ in weights)
            named = any(isinstance(node.kids[ks[0]], Node) and node.kids[ks[0]].plus and w >= LITTLE * total for w, ks, _ in weights)
            if named:
                weights = [(0 if isinstance(node.kids[ks[0]], Node) and node.kids[ks[0]].role == "-" else w, ks, i) for w, ks, i in weights]
                total = sum(w for w, _, _ in weights)
            if not weights:
                break
            w, ks, item = max(weights, key=lambda x: x[0])
            kid = node.kids[ks[0]]
            if isinstance(kid, str) or kid.tag in TEXTUAL or len(ks) > 1 or item is not None and item[3] or w <= MOST * total:
                break
            beside = sum(x for x, js, _ in weights if isinstance(node.kids[js[0]], Node) and node.kids[js[0]].tag in TEXTUAL - HEADINGS)
            if beside >= LITTLE * total and not kid.plus:  # running text on this level too: it is one of several parts
                break
            way.append((node, ks[0]))
            node = kid
        return way

    def main_text(self, way: list[tuple[Node, int]]) -> list[str]:
        """The texts of the main block, headings before it, and what is called an article elsewhere."""
        main = way[-1][0].kids[way[-1][1]]
        entered, limit, out = {id(n): k for n, k in way}, MOST * own_chars(main), []

        def inside(node: Node) -> None:
            for kid in node.kids:
                if isinstance(kid, str):
                    out.append(kid)
                elif kid.inside != "-" or own_chars(kid) > limit:
                    inside(kid)

        def outside(node: Node, over: bool) -> None:
            to, of = entered.get(id(node)), self.of[id(node)]
            for k, kid in enumerate(node.kids):
                if kid is main:
                    inside(kid)
                elif isinstance(kid, str):
                    if node.inner == "+" and not over and not (of[k] and invariant(of[k])):
                        out.append(kid)
                elif k == to:
                    outside(kid, over)
                elif to is not None and k < to and kid.tag in HEADINGS and node.role != "-":
                    inner = self.of[id(kid)]
                    out.extend(t for t, i in zip(kid.kids, inner, strict=True) if isinstance(t, str) and not (i and invariant(i)))
                elif kid.plus:
                    outside(kid, over or kid.role == "-")

        outside(self.root, False)
        return out

    def leaves(self) -> list[tuple[str, tuple[int, ...], bool, str]]:
        """(role, numbers of the boilerplate blocks around it, invariant, text) of the page's texts in order."""
        out, count = [], [0]

        def read(node: Node, over: tuple[int, ...]) -> None:
            if node.role == "-":
                count[0] += 1
                over = (*over, count[0])
            for kid, item in zip(node.kids, self.of[id(node)], strict=True):
                if isinstance(kid, str):
                    out.append((node.inner, over, bool(item) and invariant(item) and item[4][0] == mark(kid), kid))
                else:
                    read(kid, over)

        read(self.root, ())
        return out


def extract(page: str | None, wrapper: list[list] | None, known: dict[int, int] | None = None) -> str:
    """The main text: that of the main block, or, where none stands out, the page's slots, of which names choose as far as the slots' own text bears them out."""
    seen = Page(page, wrapper, known)
    way = seen.heart()
    if way and way[-1][0].kids[way[-1][1]].tag not in ("html", "body"):
        return "\n".join(t.lstrip("\x00") for t in seen.main_text(way))
    leaves = seen.leaves()
    slots = [(role, over, t) for role, over, same, t in leaves if not same]
    size = lambda some: sum(length(t) for *_, t in some)
    if not any(role == "+" and not over for role, over, _ in slots):
        inside: dict[int, int] = {}
        for _, over, t in slots:
            for k in over:
                inside[k] = inside.get(k, 0) + length(t)
        wrong = {k for k, n in inside.items() if n > MOST * size(slots)}
        slots = [(role, tuple(k for k in over if k not in wrong), t) for role, over, t in slots]
    free = [(role, t) for role, over, t in slots if not over]
    main = [x for x in free if x[0] == "+"]
    if not main or size(main) < LITTLE * size(free):
        main = [x for x in free if x[0] == "+" or x[1][0] != "\x00"]
    if not main:  # pages that differ outside the article alone
        main = [(role, t) for role, over, _, t in leaves if role == "+" and not over]
    return "\n".join(t.lstrip("\x00") for _, t in main)


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON), durable: of all pages, first by task and then by host."""

    def by_task(batches):
        known: dict[str, list] = {}
        seen: dict[int, tuple[str, ...]] = {}

        def out():
            return pa.RecordBatch.from_pydict({"host": list(known), "wrapper": [json.dumps(w) for w in known.values()]})

        for batch in batches:
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host = host_of(url)
                w = wrapper_of(page)
                form, name = hash((host, str(shape(w)))), mark(page or "")
                pages_of = seen.get(form, ())
                if name in pages_of or len(pages_of) >= INVARIANT_PAGES:
                    continue  # nothing new in it: the wrapper has all its items, and pages enough that have its texts
                if len(seen) > FORMS:
                    seen.clear()
                seen[form] = (*pages_of, name)
                known[host] = add(known.get(host), w)
            if len(known) > 2000:  # so many hosts in a task: hand over what there is
                yield out()
                known, seen = {}, {}
        if known:
            yield out()

    def by_host(batches):
        host, w, out = None, None, []
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h != host:
                    if host is not None:
                        out.append((host, json.dumps(w)))
                    host, w = h, None
                w = add(w, json.loads(text))
            if len(out) > 500:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["host", "wrapper"])
                out = []
        if host is not None:
            out.append((host, json.dumps(w)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["host", "wrapper"])

    schema = "host string, wrapper string"
    partial = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(by_task, schema)
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(partial.repartition(n, "host").sortWithinPartitions("host", "wrapper").mapInArrow(by_host, schema))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages`."""
    wrappers = infer(pages)
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def result(batch: pa.RecordBatch, known) -> pa.RecordBatch:
        texts = [extract(page, *known(i, url)) for i, (url, page) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = "page_id long, url string, text string, n_chars long"
    if size <= SMALL:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()})

        def make_small():
            parsed: dict[str, tuple[list | None, dict]] = {}

            def known(_, url):
                host = host_of(url)
                if host not in parsed:
                    parsed[host] = (json.loads(shared.value[host]) if host in shared.value else None, {})
                return parsed[host]

            return lambda batch: result(batch, known)

        return map_arrow(rows, make_small, schema)
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    # A host that has a third of the pages would fill a task: its pages go to one of SALTS.
    salted = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    joined = joined.join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "wrapper")

    def make_joined():
        last: list = ["", (None, {})]

        def known(text):
            if text != last[0]:
                last[:] = text, (json.loads(text) if text else None, {})
            return last[1]

        def run(batch):
            texts = batch.column(3).to_pylist()
            return result(batch, lambda i, _: known(texts[i]))

        return run

    return map_arrow(joined, make_joined, schema)
