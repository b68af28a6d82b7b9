"""Operator 5: blocks, boilerplate, host consensus, edge rows."""

from __future__ import annotations

import html
import re
import time

import pytest

from roadlens.llm.html_extract import blocks_of, extract, main_text
from roadlens.llm.queries import QUERIES, table
from tests.conftest import SF001

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{a:b}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div id="cookie-notice"><p>We use cookies</p></div>
<div class="wrap 12"><div class="post"><h2>Title &amp; more</h2><p>First <b>para</b>graph
  text, long enough &lt;ok&gt; to&nbsp;count.<p>Second, <a href="x">with a link</a> inside.<br>After a break
<ul><li>one<li>two</ul><!-- <p>not this</p> --><table><tr><td>cell<td>next</table><form><p>Subscribe now</p></form>
<script>var t = "</p><p>no</p>";</script><div class="ad">Buy!</div></div>
<div class="sidebar"><p>Related stuff</p></div><aside>More</aside>
<section class="comments"><p>Nice post! I enjoyed it so very much that I write a very long comment about it here.</p></section></div>
<footer>&copy; me</footer></body></html>"""
TEXT = ("Title & more First paragraph text, long enough <ok> to count. Second, with a link inside. After a break one two cell next")


def test_article_without_the_rest():
    assert main_text(PAGE, None) == TEXT


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("no markup", "no markup"), ("<p>a<p>b", "a b"), ("a &am", "a &am"), ("<p>1 < 2 &#65;&#x42;&eacute;", "1 < 2 ABé"),
    ("<p>cut <a hre", "cut"), ("<p>x</p><script>alert(1)", "x"), ("<p>x<!-- never closed", "x"), ("<article><p>in</article><p>out", "in"),
    ("<div><div><div>" * 300 + "deep", "deep"), ("</p></div>stray", "stray"), ("<p hidden>no</p><p>yes", "yes"),
    ("<article><header><h1>T</h1></header><p>b</p></article>", "T b"), ("<div class=header>Site</div><p>text", "text"),
    ("<main><h1>T</h1><div class=entry><p>" + "b " * 900 + "</div></main>", "T " + "b " * 899 + "b"),
    ("<div id=page><div class=post><h1>T</h1><div class=body><p>long text of it</p></div></div><div class=box>x</div></div>", "T long text of it"),
    ("<div class='content with-sidebar'><p>kept</p></div>", "kept"), ("<div class='reader-comments'>no</div><p>yes", "yes"), ("<P CLASS='Menu'>no</P><P>yes</P>", "yes"),
])
def test_odd_pages(page, text):
    assert main_text(page, None) == text


def test_host_consensus_overrules_a_page(spark):
    usual = "<html><body><div class='story 1'><p>{}</p></div><div class='box'><p>short</p></div></body></html>"
    odd = usual.format("brief") + "<div class='box'><p>" + "a far longer text in the box " * 20 + "</p></div>"
    rows = [(k, f"http://h.com/{k}", usual.format(f"the story number {k} is long enough"), "r", 1, "p") for k in range(5)]
    rows += [(10, "http://h.com/odd", odd, "r", 1, "p"), (11, "http://other.com/", odd, "r", 1, "p"), (12, None, None, "r", 1, "p"),
             (13, "http://h.com/n", "", "r", 1, "p"), (13, "http://h.com/n", "", "r", 1, "p"), (14, "x", "<p>" + "z" * 500_000, "r", 1, "p")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, host string, n int, path string")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert got[10].text == "brief" and got[10].path == ">html>body>div.0.story"
    assert got[11].text.startswith("a far longer")
    assert got[12].text == "" and got[12].n_chars == 0 and got[13].text == "" and got[14].n_chars == 500_000
    assert extract(pages).count() == len(rows) and extract(pages.limit(0)).count() == 0


def test_given_pages_by_a_plain_expression(spark):
    want = {}
    for r in table(spark, SF001, "pages").collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S).group(1)
        parts = re.split(r"</?(?:p|h1|br)>", re.sub(r"<[^>]*$", "", body))
        clean = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?[bi]>", "", x))).strip() for x in parts]
        want[r.page_id] = (r.url, " ".join(x for x in clean if x))
    got = QUERIES["op5_html_extraction"](spark, SF001).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_links_count_against_a_container():
    page = "<div class=x>" + "<p><a href=1>link text here</a></p>" * 20 + "</div><div class=y><p>plain text of the page, not long</p></div>"
    assert main_text(page, None) == "plain text of the page, not long"
    assert len(blocks_of(page)) == 21


STORY = "<h2>Title</h2><p>" + "the story goes on " * 20 + "</p>"
SIDE = "<div class=sidebar><p>more to read</p></div>"
WHOLE = "Title " + ("the story goes on " * 20).strip()


@pytest.mark.parametrize("page, text", [
    (f"<div class='site-content right-sidebar'><article>{STORY}</article>{SIDE}</div><p>made by us</p>", WHOLE),
    (f"<div class='layout sidebar-left'><main>{STORY}</main>{SIDE}</div>", WHOLE),
    (f"<div class='layout sidebar-left'><div class=post>{STORY}</div>{SIDE}</div>", WHOLE),
    (f"<div class=cookie-notice>We use cookies</div><div class=widget-page><div class=modal-page><article>{STORY}</article></div></div>", WHOLE),
    (f"<article>{STORY}<section id=related-work><h2>Related work</h2><p>plain text of it</p></section></article>", WHOLE + " Related work plain text of it"),
    (f"<article>{STORY}<h2 id=privacy>Privacy</h2><h2 id='search-and-login'>Search and login</h2><p>x</p></article>", WHOLE + " Privacy Search and login x"),
    (f"<article>{STORY}<div id=related-posts><h2>Related posts</h2><a href=1>one post</a> <a href=2>two posts are here</a></div></article>", WHOLE),
    (f"<article>{STORY}<section id=comments><h2>Comments</h2><p>so nice</p></section></article>", WHOLE),
    (f"<div class=post>{STORY}</div><ol class=comments><li><article class=comment><p>" + "so nice " * 200 + "</p></article></ol>", WHOLE),
    ("<div><article>" + "<div>" * 450 + "in" + "</div>" * 450 + "<p>still in</p></article><p>out</p></div>", "in still in"),
    ("<div><article>" + "<div>" * 450 + "<p>a<p>b<ul><li>c<li>d</ul>" + "</div>" * 450 + "<p>still in</p></article><p>out</p></div>", "a b c d still in"),
])
def test_marks_do_not_swallow_the_article(page, text):
    assert main_text(page, None) == text


def test_very_deep_and_unclosed_pages():
    deep = "<div class=d>" * 50_000 + "deep" + "</div>" * 50_000 + "<p>after"
    assert main_text(deep, None).startswith("deep")
    assert main_text("<b><p>x " * 20_000, None) == " ".join(["x"] * 20_000)
    assert main_text("<nav>" + "<div>" * 20_000 + "no", None) == ""


LONG = ("plain words here " * 9).strip()


@pytest.mark.parametrize("page, text", [
    (f"<body><form id=aspnetForm><nav>x</nav><div class=post>{STORY}</div></form>", WHOLE),
    (f"<form><div><p>{LONG}</div></form>", LONG), ("<p>a</p><form><label>Name</label><input></form>", "a"),
    (f"<div class=post>{STORY}</div><form class=login><p>{LONG}</p></form>", WHOLE),
    ("<p title=it's>one</p><p>two's</p>", "one two's"), ("<p title='a>b'>x</p><p data-x=a\"b>y", "x y"), ("<p title=\"a>first</p><p>second", "first second"),
    ("<a title='class=ad x'>kept</a>", "kept"), ("<div/class=ad>no</div><p>yes", "yes"), ("<p a = 'x' b= c>yes", "yes"),
    ("<p>a <!--> b <!-- no --!> c <!-- no --> d", "a b c d"), ("<p>a</p><p>b <div class='x", "a b"), ("a </ b", "a"), ("1 < 2 <3", "1 < 2 <3"),
    (f"<article>{STORY}<section class='alert-systems'><h2>Alert systems</h2><p>they ring</p></section></article>", WHOLE + " Alert systems they ring"),
    (f"<article>{STORY}<div class='login-guide'><p>{LONG}</p></div></article>", WHOLE + " " + LONG),
    (f"<article>{STORY}<div class='alert-box'><p>{LONG}</p></div><div class='cookie-notice'><p>{LONG}</p></div></article>", WHOLE),
    (f"<article>{STORY}<div class='sponsor-acme'><p>{LONG}</p></div><div class='reader-comments'><p>{LONG}</p></div></article>", WHOLE),
    ("<article><p>The <span class='alert'>red</span> fox</p><p><span class=alert>Beware</span></p><p>It <span class=ad>buy</span> ran</p></article>", "The red fox It ran"),
    (f"<div class='alert-systems'><p>{LONG}</p></div><p>yes", "yes"),
])
def test_ordinary_faults_and_topics(page, text):
    assert main_text(page, None) == text


@pytest.mark.parametrize("page", ["<div " * 60_000, "<p a=\"" * 40_000, "<p title=it's>" * 20_000, "<!--" * 60_000, "<a 'b" * 50_000 + ">",
                                  "<span id=a>" * 9_000 + "<hr>" * 20_000, "<script>" * 40_000, "</div " * 50_000, "<div class=x" + "y" * 3000 + ">"] +
                         ["".join(f"<div class=c{k}x{'y' * 3000}>" for k in range(300)) + "deep"])
def test_time_is_linear(page):
    start = time.monotonic()
    main_text(page, None)
    assert time.monotonic() - start < 5


def test_a_long_path_still_votes(spark):
    """A host whose article lies under a path of over 2,000 characters is extracted by it."""
    deep = "".join(f"<div class='level{chr(97 + k)} {'z' * 300}'>" for k in range(12))
    page = "<body>" + deep + "<div class=box><p>{}</p></div><div class=story><p>{}</p></div>"
    rows = [(k, f"http://h.com/{k}", page.format("short", f"the story number {k} is long enough")) for k in range(4)]
    rows.append((9, "http://h.com/9", page.format("a far longer text in the box " * 20, "brief")))
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[9].text == "brief" and got[9].path.startswith("#") and len(got[9].path) <= 2_000
