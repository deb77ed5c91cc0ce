import random
import time

import pytest

from gristmill.llm import dom
from gristmill.llm import html_extract as H
from gristmill.llm.dom import Shape, parse, simple_tree_match

RICH = """<!doctype html><html><head><title>No</title><script>if (a < b) document.write("<p>no</p>")</script></head><body class="page sidebar-left">
<header><h1>Site</h1><form><input name=q><label>Search</label></form></header><nav>Menu <a href=x>one</a></nav>
<div class="cookie-notice">We use cookies</div><div class=ad-slot>Buy</div>
<main><article class="post"><header class="entry-header"><h1>Title &amp; more</h1></header>
<p>First <b>bold</b>,<br>then   <i>more</i>&nbsp;text.<p>Second &lt;tag&gt;<script>x="</article>"</script>
<ul><li>one<li>two</ul><div class="share-buttons">Share</div><blockquote>Said</blockquote><aside>Not this</aside>
<table><tr><td>a<td>b</table><div style="display: none">hidden</div></article>
<section id="comments"><article class="comment"><p>A reader says a lot of things here that are long enough to be taken for text.</p></article></section></main>
<aside>Side</aside><footer>Foot</footer></body></html>"""


def test_rich_page():
    assert H.Page(RICH).main().split("\n\n") == ["Title & more", "First bold, then more text.", "Second <tag>", "one", "two", "Said", "a", "b"]


def test_broken_and_empty_pages():
    assert H.Page(None).main() == "" == H.Page("").main() == H.Page("<!-- only").main() == H.Page("<script>x").main()
    assert H.Page("plain text").main() == "plain text"
    assert H.Page("<article><p>a<b>b<p>c</article").main() == "ab\n\nc"
    assert H.Page("a < b <p title='x>y'>c</p> 1 > 0").main() == "a < b\n\nc\n\n1 > 0"
    assert H.Page("<article>" + "<div>" * 5000 + "deep").main() == "deep"
    assert H.Page("<body><form><article><p>in a form</p></article></form></body>").main() == "in a form"


def test_what_elements_say_of_themselves():
    kept = ['<div class="has-sidebar">t</div>', '<div class="entry-header">t</div>', '<div class="post-content">t</div>', "<header><main>t</main></header>", '<div class="headline">t</div>', '<p id="admiral">t</p>']
    gone = [
        '<div class="comment-list">t</div>', '<div id="disqus_thread">t</div>', '<div class="adsbygoogle">t</div>', '<div class="siteHeader">t</div>', '<div role="banner">t</div>', '<div class="relatedPosts">t</div>',
        '<span class="ad">t</span>', '<ul class="breadcrumb"><li>t</ul>', "<div aria-hidden=true>t</div>", "<p hidden>t</p>", "<select><option>t</select>", "<textarea>t</textarea>", '<div class="newsletter-signup"><p>t</p></div>', "<dialog>t</dialog>",
    ]
    assert [H.Page(x).main() for x in kept] == ["t"] * len(kept)
    assert [H.Page(x).main() for x in gone] == [""] * len(gone)


def site(n, copies=0):
    rng = random.Random(n)
    rows = []
    for k in range(n):
        body = "".join(f"<p>{' '.join(rng.choices('abcdefgh', k=12))} {k}</p>" for _ in range(rng.randint(1, 4)))
        rows.append((k, f"https://Shop.example.com:80/p/{k}", f"<body><div><span>All our texts are free</span></div><div><h2>T{k}</h2>{body}</div><div>Write to us</div></body>", "x"))
    rows += [(1000 + k, "http://copy.example.com/", "<body><div><p>the same article</p></div></body>", "x") for k in range(copies)]
    return rows


def expected(html):
    inner = html.split("<h2>")[1].rsplit("</div><div>", 1)[0]
    return inner.replace("</h2>", "").replace("<p>", "\n\n").replace("</p>", "").strip()


def test_constant_nodes_of_a_host_are_template_but_copies_are_not(spark, monkeypatch):
    rows = site(30, copies=8) + [(2000, None, None, "x"), (2001, "http://one.example.com", "<p>Write to us</p>", "x")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    want = {k: expected(h) for k, _, h, _ in rows[:30]} | {1000 + k: "the same article" for k in range(8)} | {2000: "", 2001: "Write to us"}
    assert {r["page_id"]: r["text"] for r in H.extract(frame).collect()} == want
    monkeypatch.setattr(H, "BROADCAST_BYTES", -1)
    assert {r["page_id"]: r["text"] for r in H.extract(frame).collect()} == want
    assert H.extract(frame.where("false")).count() == 0


def test_an_empty_first_page_and_two_layouts(spark, monkeypatch):
    """What one reference page cannot show: it may hold nothing, lack a template node, or be of the other layout."""
    rng = random.Random(8)

    def body(k):
        return "".join(f"<p>{' '.join(rng.choices('abcdefgh', k=12))} {k}</p>" for _ in range(rng.randint(1, 4)))

    rows, want = [], {}
    for k, html in enumerate((None, " ", "<p>", "<body><h1>502 Bad gateway</h1></body>")):
        rows += [(k, "http://first.example.com/", html), (50 + k, "http://two.example.com/", html)]
        want |= {k: "", 50 + k: ""} if k < 3 else {k: "502 Bad gateway", 50 + k: "502 Bad gateway"}
    for k in range(100, 140):
        text = body(k)
        rows.append((k, "http://first.example.com/", f"<body><div><span>All our texts are free</span></div><div><h2>T{k}</h2>{text}</div><div>Write to us</div></body>"))
        want[k] = f"T{k}{text}".replace("<p>", "\n\n").replace("</p>", "")
    for k in range(200, 260):
        text = body(k)
        one = f"<body><div>Shop of things</div><div>{text}</div><div>Pay as you like</div><div>Back to the shop</div></body>"
        two = f"<body><table><tr><td>Our magazine</td><td>Every month</td></tr></table><section>{text}</section><div>All issues</div></body>"
        rows.append((k, "http://two.example.com/", two if k % 2 else one))
        want[k] = text.replace("</p><p>", "\n\n").replace("<p>", "").replace("</p>", "")
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in H.extract(frame).collect()} == want
    monkeypatch.setattr(H, "BROADCAST_BYTES", -1)
    assert {r["page_id"]: r["text"] for r in H.extract(frame).collect()} == want


def brute_match(a, b):
    """Size of a largest matching, by plain recursion."""
    if a.tag != b.tag:
        return 0
    rows = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            rows[i][j] = max(rows[i - 1][j], rows[i][j - 1], rows[i - 1][j - 1] + brute_match(x, y))
    return 1 + rows[-1][-1]


def test_simple_tree_matching():
    rng = random.Random(3)

    def tree(depth=0):
        return Shape(rng.choice("ab") if depth else "r", rng.randint(0, 999), 0, tuple(tree(depth + 1) for _ in range(rng.randint(0, 3 if depth < 3 else 0))))

    for _ in range(200):
        a, b = tree(), tree()
        pairs = simple_tree_match(a, b)
        assert len(pairs) == brute_match(a, b) and all(x.tag == y.tag for x, y in pairs)


def test_shapes_round_trip():
    shape = H.Page(RICH).shape
    assert H.unpack_shape(H.pack_shape(shape)) == shape
    assert parse("<p>a").children[0].tag == "p"


def test_deep_pages_meet_a_deep_reference(spark):
    deep = lambda k: "<body>" + "<div>" * 3000 + f"<p>text {k}</p>"
    rows = [(k, "http://deep.example.com/", deep(k)) for k in range(8)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: f"text {k}" for k in range(8)}


def test_all_articles_of_a_page_are_kept():
    page = H.Page("<body><div>x</div><article><p>" + "long " * 50 + "</p></article><article><p>short</p></article></body>")
    assert page.main().endswith("\n\nshort") and "x" not in page.main().split("\n\n")


def test_repeated_rows_and_long_pages(spark):
    long = "<body>" + "".join(f"<p>{'word ' * 200}{k}</p>" for k in range(2000)) + "</body>"
    rows = [(1, "http://l.example.com/", long)] * 3 + [(2, "http://l.example.com/", "<p>one</p>")]
    got = sorted((r["page_id"], len(r["text"])) for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    assert len(got) == 4 and got[0] == got[1] == got[2] and got[0][1] > 2_000_000


LONG = "Real words of the article, of which there are many more than of anything else on this page. " * 4


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><form action='x'><div>{LONG}</div><p>more</p></form></body>", [LONG.strip(), "more"]),  # one form around the page
        (f"<div class='content comments-open'><p>{LONG}</p></div>", [LONG.strip()]),
        (f"<div class='body-text skip-lines'><p>{LONG}</p></div>", [LONG.strip()]),
        ("<p>a</p><div class='social-history'>of the town</div>", ["a", "of the town"]),
        ("<p>a</p><div id='related-work'>of others</div>", ["a", "of others"]),
        ("<p>a</p><div class='promotion-rules'>of the league</div>", ["a", "of the league"]),
        ("<div class='post'><p>before</p><article><p>the text</p></article><p>after</p></div><div>else</div>", ["before", "the text", "after"]),
        ("<article><p>a</p><label>named</label></article>", ["a", "named"]),
        (f"<aside class='sidebar'>{LONG}</aside>", [LONG.strip()]),  # a frame that is called something else
        (f"<p>a</p><div class='comment-list'>{LONG}</div>", ["a"]),  # readers say more than the article does
        ("<p>a</p><div class='site-footer'>f</div><div id='cookieBanner'>c</div><div class='related-links'>r</div><div class='ad-slot-3'>x</div><div class='nav-bar'>n</div>", ["a"]),
        ("<p>a</p><form><label>Search</label></form>", ["a"]),
    ],
)
def test_names_of_elements(page, want):
    assert H.Page(page).main().split("\n\n") == want


def test_open_elements_of_any_depth_cost_no_more(spark):
    began = time.perf_counter()
    deep = "<div>" * 40_000 + "deep" + "<p>x" * 1000
    assert H.Page(deep).main().startswith("deep\n\nx")
    assert time.perf_counter() - began < 20
    assert [c.tag for c in dom.parse("<p>a<div>b</div>").children] == ["p", "div"]
    assert [c.tag for c in dom.parse("<ul><li><p>a<li>b</ul>").children[0].children] == ["li", "li"]


def test_empty_tables_nulls_and_clashing_columns(spark):
    schema = "page_id bigint, url string, html string, host string, text string, deal int"
    assert H.extract(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, "h", "t", 1), (2, "https://a/x", "<p>b</p>", "h", "t", 1), (None, None, "<p>c</p>", None, None, None), (2, "https://a/x", "<p>b</p>", "h", "t", 1)]
    got = [(r["page_id"], r["url"], r["text"]) for r in H.extract(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == sorted([(1, None, ""), (2, "https://a/x", "b"), (2, "https://a/x", "b"), (None, None, "c")], key=str)
