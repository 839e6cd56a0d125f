from wavelark.llm import wrappers as W

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav>
<aside class="sidebar"><p>Latest</p></aside><div class="ad">Buy</div>{body}
<section id="comments"><article class="comment"><p>First!</p></article></section><form><input name=q><button>Go</button></form>
<footer>&copy; x &middot; y</footer></body></html>"""
ARTICLE = "<article><h1>One &amp;   two</h1><p>a <b>bold</b>\n line<br>next &lt;b&gt; line<p>caf&eacute; &#8364;5<script>x()</script></p><ul><li>i<li>ii</ul></article>"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, 0, "x") for i, u, h in rows], "page_id long, url string, html string, n_chars int, host string").repartition(3)


def texts(spark, rows):
    got = W.extract_pages(table(spark, rows)).collect()
    assert all(len(r.text) == r.n_chars for r in got)
    return {r.page_id: r.text for r in got}


def test_article_alone_is_left(spark, monkeypatch):
    want = "One & two\na bold line\nnext <b> line\ncafé €5\ni\nii"
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(body=ARTICLE)) for i in range(4)]
    assert texts(spark, rows) == dict.fromkeys(range(4), want)
    monkeypatch.setattr(W, "SMALL", -1)
    assert texts(spark, rows) == dict.fromkeys(range(4), want)


def test_without_an_article_invariants_of_the_host_go(spark):
    body = "<div class=box>Read in one minute</div><div class=text><p>Text {0} of its own, {0} words.</p><p>And more {0}.</p>{1}</div><div><a href=x>all</a> <a href=y>tags</a></div>"
    rows = [(i, "https://w.example.org/p", PAGE.format(body=body.format(i, "<p>Only here</p>" if i == 2 else ""))) for i in range(6)]
    got = texts(spark, rows)
    assert got[1] == "Text 1 of its own, 1 words.\nAnd more 1."
    assert got[2] == "Text 2 of its own, 2 words.\nAnd more 2.\nOnly here"


def test_names_of_layout_and_headings_keep_the_article(spark):
    page = '<body><div class="page with-sidebar"><div class="sidebar">side</div><article><div class="article-header"><h1>Title</h1></div><p data-hidden="x">Text</p><div class="share">Tell</div><div hidden>no</div></article></div></body>'
    assert texts(spark, [(0, "http://x.example/", page)]) == {0: "Title\nText"}


def test_odd_pages(spark):
    rows = [(0, None, None), (1, "", ""), (2, "nonsense", "just text"), (3, "http://a/", "<p>un<div>closed<p>b"), (4, "http://a/", "<article><p>broken <b"), (4, "http://a/", "<article><p>broken <b"), (5, "http://a/", "</div></p><article>" + "<p>x y</p>" * 50000), (6, "http://a/", "<div>" * 3000 + "deep")]
    got = texts(spark, rows)
    assert got[0] == got[1] == "" and got[2] == "just text" and got[3] == "un\nclosed\nb" and got[4].startswith("broken")
    assert got[5] == "\n".join(["x y"] * 50000) and got[6] == "deep"
    assert W.extract_pages(table(spark, rows).limit(0)).count() == 0


def test_alignment_makes_optionals_repeats_and_slots():
    a = W.wrapper_of("<body><h2>A</h2><p>x</p><p>y</p><dl><dt>k<dd>v<dt>k2<dd>v2</dl></body>")
    b = W.wrapper_of("<body><h2>A</h2><h3>sub</h3><p>x</p></body>")
    body = W.align(a, b)[0]
    kids = {k[0]: k for k in body[5]}
    assert kids["h2"][5][0][4] is not None and not kids["h2"][2]  # invariant text
    assert kids["h3"][2] and kids["dl"][2]  # optional
    assert kids["p"][3] and kids["p"][5][0][4] is None  # repeated, with a slot
    assert kids["dl"][5][0][0] == "*dt dd" and kids["dl"][5][0][3]


def test_whole_table_has_the_articles_lines(spark):
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in W.extract_pages(rows).collect()}
    for r in rows.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*(>|$)", "", b))).strip() for b in re.split(r"<br>|</?p>|</?h1>", article)]
        assert got[r.page_id] == "\n".join(filter(None, blocks))


def test_what_recurs_within_the_article_stays(spark):
    rows = [(i, "http://n.example/", f"<body><article><div class=intro>Read this in one minute</div><p>Text {i} of its own</p></article></body>") for i in range(5)]
    assert texts(spark, rows) == {i: f"Read this in one minute\nText {i} of its own" for i in range(5)}
    body = "<article><h1>T{0}</h1><p>One {0} two.</p><h2>Method</h2><p>Three {0} four.</p></article><footer>All rights</footer>"
    rows = [(i, "http://m.example/", PAGE.format(body=body.format(i))) for i in range(6)]
    assert texts(spark, rows) == {i: f"T{i}\nOne {i} two.\nMethod\nThree {i} four." for i in range(6)}


def test_the_same_article_beside_something_that_differs(spark):
    rows = [(i, "http://s.example/", f"<body><article><h1>Same</h1><p>{'the same words ' * 20}</p></article><div>Buy number {i} today</div></body>") for i in range(6)]
    assert set(texts(spark, rows).values()) == {"Same\n" + " ".join(["the same words"] * 20)}


def test_many_items_of_a_level(spark):
    items = "".join(f"<h2>Shared {k}</h2><p>Own {k} {{0}}</p><ul><li>{k}</ul>" if k % 3 else f"<h3>Shared {k}</h3><pre>Own {k} {{0}}</pre>" for k in range(100))
    rows = [(i, "http://l.example/", f"<body><div>Menu</div><div>{items.format(i)}</div></body>") for i in range(4)]
    for i, t in texts(spark, rows).items():
        assert t == "\n".join(f"Shared {k}\nOwn {k} {i}" + (f"\n{k}" if k % 3 else "") for k in range(100))


def blinded(page):
    """The page with names taken away: no class, id or role, and nothing but div for what tells its use."""
    import re

    page = re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page or "")
    return re.sub(r"<(/?)(article|main|nav|header|footer|aside)\b", r"<\1div", page)


def test_pages_without_names_give_the_same_text(spark):
    """The wrapper finds the main block: pages of hosts with at least three, whole table, with and without names."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    a, b = texts(spark, rows), texts(spark, [(i, u, blinded(h)) for i, u, h in rows])
    assert sum(a[i] == b[i] for i in a) >= 0.95 * len(a)
    body = "<div><h2>More</h2><div><a href=x>one {0}</a><a href=y>two</a></div></div><div><h1>Title {0}</h1><p>{1}</p><p>More of {0}</p></div><div>Buy {0} at once</div><div>Page {0} of many</div>"
    plain = [(i, "http://d.example/", f"<body>{body.format(i, 'some words ' * (3 + 5 * i))}</body>") for i in range(6)]
    assert texts(spark, plain) == {i: f"Title {i}\n{' '.join(['some words'] * (3 + 5 * i))}\nMore of {i}" for i in range(6)}


def test_names_only_choose_among_slots(spark):
    text = " ".join(["word"] * 40)
    article = f"<article><h1>Title {{0}}</h1><p>{text} {{0}}</p></article>"
    around = ["<form>{}</form>", '<div class="header-fixed">{}</div>', '<div class="sidebar-left">{}</div>']
    rows = [(3 * k + i, f"http://h{k}.example/", "<body>" + a.format(article.format(i)) + "<aside>Short</aside></body>") for k, a in enumerate(around) for i in range(3)]
    assert texts(spark, rows) == {3 * k + i: f"Title {i}\n{text} {i}" for k in range(3) for i in range(3)}
    small = [(i, "http://m.example/", f"<body><div class=entry>Go {i}</div><div><p>{text} {i}</p></div></body>") for i in range(3)]
    assert texts(spark, small) == {i: f"Go {i}\n{text} {i}" for i in range(3)}
    other = f"<section id=comments><article><p>{text} {text} {{0}}</p></article></section>"
    both = [(i, "http://b.example/", "<body>" + (article + other).format(i) + "</body>") for i in range(3)]
    assert texts(spark, both) == {i: f"Title {i}\n{text} {i}" for i in range(3)}


def test_a_hot_host_in_the_joined_path(spark, monkeypatch):
    body = "<div class=box>Read in one minute</div><div class=text><p>Text {0} of its own, {0} words.</p></div>"
    rows = [(i, f"https://{'hot' if i % 4 else f'h{i}'}.example.org/{i}", PAGE.format(body=body.format(i))) for i in range(60)] + [(None, "https://hot.example.org/x", PAGE.format(body=body.format("none")))]
    want = texts(spark, rows)
    monkeypatch.setattr(W, "SMALL", -1)
    assert texts(spark, rows) == want and want[5] == "Text 5 of its own, 5 words."
    assert W.extract(rows[5][2], None) != want[5]
