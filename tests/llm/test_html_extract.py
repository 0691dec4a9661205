import hashlib
import html
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import html_extract as hx

SITE = [f"Site line {k}" for k in range(8)]


def lcs(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        q = [0]
        for j, y in enumerate(b):
            q.append(p[j] + 1 if x == y else max(q[j], p[j + 1]))
        p = q
    return p[-1]


def test_alignment(monkeypatch):
    rng = random.Random(1)
    for bits in (1 << 28, 8):
        monkeypatch.setattr(hx, "ALIGN_BITS", bits)
        for _ in range(1500):
            a, b = ([rng.randrange(rng.randrange(1, 6)) for _ in range(rng.randrange(12))] for _ in "ab")
            s = [x for x, k in zip(a, hx.shared_lines(a, b), strict=True) if k]
            it = iter(b)
            assert len(s) == lcs(a, b) and all(x in it for x in s)


def plain(page):
    """The text of a fixture page by its known form."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body).replace("<br>", " "))
    return "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_fixture(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = hx.extract(spark, pages).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


PAGE = """<!doctype html><html><head><title>T</title><script>if (a</b) "<p>x</p>"</script><style>p{}</style></head><body class="page comments-open">
<header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<main><article><header><h1>Title &amp; more</h1></header><p>One<br>two&nbsp;<b>three</b> <span title="a>b">four</span><div>five <form><p>Name<input></form></div>
<ul><li>x<li>y</ul><table><tr><td>a</td><td>b</td></tr></table><aside>Aside</aside><div class="ad">Buy</div><div id=share-bar>Share</div><p hidden>hid</p><p>&#x41;&eacute &lt;tag&gt;
<section class="comments"><article class="comment"><p>Reader says</p></article></section></article></main><div class="sidebar">S</div><footer>F</footer></body></html>"""


def test_structure():
    text = "\n\n".join(t for t, content, main in hx.blocks(PAGE) if content and main)
    assert text == "Title & more\n\nOne two three four\n\nfive\n\nx\n\ny\n\na b\n\nAé <tag>"


def test_differencing_and_edges(spark):
    top, end = "<p>Home of things</p><p>Shared line</p>", "<p>Imprint</p>"
    rows = [
        (1, "http://a.x/n/1", f"<body>{top}<p>First story</p>{end}"),
        (2, "http://a.x/n/2", f"<body>{top}<p>Second story</p><p>more</p>{end}"),
        (3, "http://a.x/m/9", f"<body>{top}<p>Third</p>{end}"),
        (4, "http://b.x/", f"<body>{top}<p>Alone on its host</p>{end}"),
        (5, "http://c.x/1", "<article><p>Copy</p></article>"),
        (6, "http://c.x/2", "<article><p>Copy</p></article>"),
        (7, None, None), (8, "u", ""), (9, "http://[bad", "plain < text > & more"), (None, "http://d.x/1", "<p>" + "long word " * 50000),
    ]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in hx.extract(spark, pages).collect()}
    assert got[1] == "First story" and got[2] == "Second story\n\nmore" and got[3] == "Third"
    assert got[4] == "Home of things\n\nShared line\n\nAlone on its host\n\nImprint" and got[5] == got[6] == "Copy"
    assert got[7] == got[8] == "" and got[9] == "plain < text > & more" and len(got[None]) == 499999
    assert hx.extract(spark, pages.where("false")).collect() == []


def texts(*pages):
    """The text of each page as if alone on its host."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages)), pa.int64()), pa.array(["u"] * len(pages)), pa.array(pages)], ["page_id", "url", "html"])
    return ["\n\n".join(x) for x in next(hx._parse([batch])).column("lines").to_pylist()]


def test_articles_in_dropped_parts_name_no_page():
    real, teaser = "<div><p>Real text</p></div>", "<article><p>Teaser</p></article>"
    pages = [real + x for x in (f"<aside>{teaser}</aside>", f'<div class="related">{teaser}</div>', f'<section class="comments">{teaser}</section>')]
    assert texts(*pages) == ["Real text"] * 3


def test_whole_attributes_only():
    attributes = ('style="overflow:hidden"', 'title="The hidden valley"', "href=/hidden-gems", 'href="/p?id=search"', 'data-id="menu"', "data-role='search'", 'aria-hidden="false"')
    for x in attributes:
        assert texts(f"<article {x}><p>One</p></article>", f"<article><p>T <a {x}>link</a></p></article>") == ["One", "T link"], x
    for x in ("hidden", "HIDDEN", 'hidden=""', "aria-hidden = 'true'", 'title="a" Role=navigation', "id='menu'", 'data-x="a>b" class=ad'):
        assert texts(f"<article><p>One</p><div {x}>Two</div></article>") == ["One"], x


def test_class_words():
    for x in ("entry-header", "article-header", "post-header", "header", "post-related-work", "search-results", "social-history"):
        assert texts(f'<article><header class="{x}"><h1>T</h1></header><p>One</p></article>', f'<article><div class="{x}"><h1>T</h1></div><p>One</p></article>') == ["T\n\nOne"] * 2, x
    assert texts('<article><h1 class="page-header">T</h1><h2 id="comments">U</h2></article>') == ["T\n\nU"]
    for tag in ("article", "main"):
        for x in ("has-sidebar", "no-sidebar", "sidebar", "comments-open", "post promo"):
            assert texts(f'<{tag} class="{x}"><p>One</p></{tag}>') == ["One"], x
    for x in ("content-with-sidebar", "header", "page search", "site-header"):
        assert texts(f'<div class="{x}"><p>Bar</p><article><p>One</p></article></div>') == ["One"], x
    assert texts('<div class="sidebar"><p>Bar</p><main><p>One</p></main></div>') == ["One"]
    for x in ("ad", "ad-300x250", "share-bar", "wide social-links", "comments-area", "related-posts", "main-nav", "cookie-banner"):
        assert texts(f'<article><p>One</p><div class="{x}"><h2>No</h2><p>no</p></div></article>') == ["One"], x
    assert texts('<p>One</p><div class="site-header">no</div>', '<article><p>One</p><article class="comment">no</article></article>') == ["One"] * 2


def test_text_in_formulas_and_objects():
    assert texts("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p><object><p>Fallback</p></object><svg><title>no</title></svg></article>") == ["Let x=1 be\n\nFallback"]


def random_pages(rng):
    """(page_id, url, [(line, in the article)]): site lines always in one order, so that shared lines are a plain intersection."""
    rows = []
    for n in range(160):
        host, folder = rng.choice(["a.x", "a.x", "b.x"]), rng.choice(["", "n/", "n/2024/", "m/"])
        mine = [f"Own {n} {k} " + "word " * rng.randrange(30) for k in range(rng.randrange(4))]
        lines = [(x, False) for x in SITE if rng.random() < 0.6]
        named = rng.random() < 0.4
        body = [(x.strip(), named) for x in mine]
        if named and rng.random() < 0.5 and lines:
            body.append((lines.pop()[0], True))
        cut = rng.randrange(len(lines) + 1)
        if named and body and body[-1][0] in SITE:
            cut = len(lines)
        rows.append((n, f"http://{host}/{folder}p{n}", lines[:cut] + body + lines[cut:]))
        if n % 9 == 0:
            rows.append((n + 1000, f"http://{host}/{folder}copy{n}", rows[-1][2]))
    return rows


def page(lines):
    out, inside = "", False
    for x, named in lines:
        out += ("<article>" if named and not inside else "</article>" if inside and not named else "") + f"<p>{x}</p>"
        inside = named
    return out


def expected(rows):
    """By page: its text and how many lines differencing deletes, from the definition: sets for alignment, lists for pairing."""
    digest = {n: hashlib.blake2b(np.array([hx.line_hash(x) for x, _ in lines], np.int64).tobytes(), digest_size=16).digest() for n, _, lines in rows}
    content = {n: [x for x, _ in lines] for n, _, lines in rows}
    folders = {n: ["/".join(url.split("/")[:k]) for k in range(3, url.count("/") + 1)] for n, url, _ in rows}
    groups = {}
    for n in digest:
        for f in folders[n]:
            part = int.from_bytes(digest[n][:2], "big") % hx.CANDIDATES
            groups[f, part] = min(groups.get((f, part), n), n, key=lambda k: digest[k])
    out = {}
    for n, _, lines in rows:
        named = any(a for _, a in lines)
        partner = set()
        for f in reversed(folders[n]):
            for m in sorted({groups[f, p] for p in range(hx.CANDIDATES) if (f, p) in groups}, key=lambda k: digest[k]):
                common = set(content[m]) & set(content[n])
                if digest[m] != digest[n] and not partner:
                    share = sum(len(x) for x in content[n] if x in common) / max(1, sum(map(len, content[n])))
                    if named or not common or share < hx.NEARLY:
                        partner = common or {None}
        stays = [x for x, a in lines if a or (not named and x not in partner)]
        out[n] = "\n\n".join(stays), sum(x in partner and not a for x, a in lines)
    return out


@pytest.mark.parametrize("numbers", [hx.NUMBERS, 0])
def test_pairing_against_brute_force(spark, numbers):
    rows = random_pages(random.Random(5))
    pages = spark.createDataFrame([(n, url, page(lines)) for n, url, lines in rows], "page_id long, url string, html string").repartition(7)
    want = expected(rows)
    got = hx.extract(spark, pages, numbers).collect()
    assert len(got) == len(rows) and sum(r.n_shared > 0 for r in got) > 100
    for r in got:
        assert (r.text, r.n_shared) == want[r.page_id], r
    plan = hx.extract(spark, pages, 0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_copies_under_near_urls_stay(spark):
    article = "<p>" + "A long article of its own. " * 20 + "</p><p>Second part.</p>"
    rows = [(k, f"http://h.x/d/{k}", f"<p>Menu</p>{article}<p>Copy {k}</p>") for k in range(5)] + [(9, "http://h.x/d/9", "<p>Menu</p><p>" + "Another one. " * 30 + "</p>")]
    got = {r.page_id: r.text for r in hx.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("A long article" in got[k] and f"Copy {k}" in got[k] for k in range(5)) and got[9].startswith("Another one.")


def test_long_pages_are_aligned(spark):
    lines = "".join(f"<p>line {k}</p>" for k in range(20000))
    rows = [(1, "http://h.x/1", f"<p>{'own text one ' * 40000}</p>{lines}"), (2, "http://h.x/2", f"{lines}<p>{'own text two ' * 40000}</p>")]
    got = {r.page_id: r for r in hx.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), 1 << 30).collect()}
    assert got[1].n_shared == got[2].n_shared == 20000 and got[1].text.startswith("own text one") and "line" not in got[2].text


def test_heads_without_end():
    page = "<html><head><title>x</title><meta charset=utf-8>{}<p>Hello world</p></html>"
    assert texts(page.format("<body>"), page.format(""), page.format("</head>")) == ["Hello world"] * 3
    assert texts("<head><title>x</title><script>a</script>bare words", "<head><noscript>no</noscript><link href=x><h1>T</h1>") == ["bare words", "T"]


def test_unclosed_markup_is_no_text():
    assert texts("<p>One</p><a href='x", "<p>One</p><a <a <a", "<p>One</p></div", "<p>One</p><!-- two", "<p>One > two <p>three <b", "1 < 2 and <3", "<p>One</p><!-- > two") == ["One", "One", "One", "One", "One > two\n\nthree", "1 < 2 and <3", "One"]


def test_nested_elements_without_text():
    assert texts("<p>a</p><svg><svg><text>x</text></svg>leak<svg/></svg><p>b</p>", "<template><p>x</p><template>y</template>leak</template>b", "<svg/>b<script>1<script>2</script>c") == ["a\n\nb", "b", "b c".replace(" ", "")]


def test_forms_around_articles():
    assert texts("<form id=f><nav>menu</nav><article><p>One</p><form>no</form></article><input></form>", "<p>One</p><form>no <b>no</b></form>", "<form><main><p>One</p></main></form>") == ["One"] * 3


def test_time_is_linear():
    """Pages that once took quadratic time, each of about a megabyte."""
    began = time.monotonic()
    for x in ("<a ", "<a b='\"", "</b ", "<svg ", "<script></script "):
        assert texts(x * (1_000_000 // len(x))) == [""]
    assert texts("<span>" * 80_000 + "</b>" * 80_000 + "x") == ["x"]
    assert texts("<b><p>" + "<span>" * 80_000 + "</b>" * 80_000 + "x") == ["x"]
    assert texts("<span>" * 80_000 + "<hr>" * 80_000 + "x") == ["x"]
    assert time.monotonic() - began < 60
