import time
import html
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from cardwatch.llm.html_text import extract_text, main_text, smoothed, upper_cluster

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li><li>About us</li></ul></nav>
<div class="cookie-notice"><p>We use cookies for a very long and boring list of reasons, all of them good.</p></div>
<div id="main-ad" class="ad">Buy now, buy a lot, buy things that nobody ever needs, they are cheap today.</div>
<article><header><h1>A &amp; B</h1></header><p>First   paragraph with enough&nbsp;words<br>to be <b>content</b>, as it goes on.</p>
<p>Short.</p><form><input name="q"><button>Send</button></form><aside>Read this as well</aside>
<div class="share">Share on</div><p>Last &lt;one&gt; &#233;<p>unclosed paragraph that is long enough to count as well, surely</p>
<section class="comments"><p>First! A reader's long comment that says a lot about nothing at all, really.</p></section></article>
<aside class="sidebar"><p>Other articles with a long teaser text that could be mistaken for content easily.</p></aside>
<footer>&copy; 2020 Somebody</footer></body></html>"""


def test_article_without_what_surrounds_it():
    assert main_text(PAGE).split("\n") == [
        "A & B", "First paragraph with enough words to be content, as it goes on.", "Short.", "Last <one> é",
        "unclosed paragraph that is long enough to count as well, surely",
    ]


def test_content_without_an_article_element():
    body = "".join(f"<p>{'word ' * 30}{k}</p>" for k in range(5))
    links = "".join(f"<li><a href='/{k}'>x</a></li>" for k in range(30))
    page = f"<body><div><ul>{links}</ul></div><div class='story'><h2>Title</h2>{body}</div><div><ul>{links}</ul></div>"
    assert main_text(page).split("\n") == ["Title", *(f"{'word ' * 30}{k}" for k in range(5))]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>x", "<nav>only</nav>", "</div></p>"])
def test_pages_without_content(page):
    assert main_text(page) == ("<" if page == "<" else "")


def test_pages_of_the_table_match_a_plain_reading(spark):
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    got = {r.page_id: r for r in extract_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for row in rows:
        inner = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[row["page_id"]].text == "\n".join(b for b in blocks if b)
        assert got[row["page_id"]].n_chars == len(got[row["page_id"]].text)


def test_edge_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted([tuple(r) for r in extract_text(pages).collect()], key=str) == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "x", 1)], key=str)
    assert extract_text(pages.limit(0)).count() == 0


def test_smoothing_and_clusters():
    assert np.allclose(smoothed(np.full(3, 2.0)), 2.0)
    assert upper_cluster(np.array([1.0, 1.2, 9.0, 8.5])).tolist() == [False, False, True, True]
    assert upper_cluster(np.array([3.0, 3.0])).all()


LONG = "A long line of prose that says one thing after another and does not come to an end before it has to, "


def test_article_keeps_all_its_parts():
    own = [f"{LONG * 6}{k}" for k in range(6)]
    parts = ["Title", "Intro.", *(f"Short {k}." for k in range(8)), *own, "cell a", "cell b", "End."]
    shorts = "".join(f"<p>Short <b>{k}</b>.</p>" for k in range(8))
    table = "<table><tr><td>cell a<td>cell b</table>"
    for wide in ("section", "blockquote", "div", "figure", "details"):
        inner = "".join(f"<p>{x}</p>" for x in own)
        body = f"<h1>Title</h1><p>Intro.</p><section>{shorts}</section><{wide}>{inner}</{wide}><section>{table}</section><p>End.</p>"
        for page in (f"<body><article>{body}</article></body>", f"<body><main>{body}</main></body>", f"<body><div>{body}</div></body>"):
            assert main_text(page).split("\n") == parts, (wide, page[:20])


@pytest.mark.parametrize("mark", ["class='layout has-sidebar'", "class='page no-sidebar'", "id='header-main-wrap'"])
def test_marked_element_around_the_content_is_shown(mark):
    body = f"<h1>Title</h1><p>{LONG}1</p><p>{LONG}2</p>"
    want = ["Title", f"{LONG}1", f"{LONG}2"]
    for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>"):
        side = f"<div class='sidebar'><p>{LONG}</p></div>"
        assert main_text(f"<body><div {mark}>{inner}{side}</div></body>").split("\n") == want
    comment = f"<section class='comments'><article><p>{LONG}</p></article></section>"
    assert main_text(f"<body><div {mark}><article>{body}{comment}</article></div></body>").split("\n") == want
    assert main_text(f"<body><article><div {mark}>{body}</div></article></body>").split("\n") == want


@pytest.mark.parametrize("start,after", [
    ("<head><title>T</title><body>", ""), ("<head><title>T</title>", ""), ("<p class='notice'>Mind", ""), ("<p class='notice'>Mind<ul><li>one</ul>", "one"),
    ("<ul><li class='share'>Share<li>one</ul>", "one"), ("<ul><li class='share'>Share</ul>", ""), ("<dl><dt class='ad'>Buy<dd>one</dl>", "one"),
    ("<table><tr><td class='ad'>Buy<td>one</table>", "one"), ("<table><tr class='ad'><td>Buy<tr><td>one</table>", "one"),
    ("<p><span class='share'>", ""), ("<table><tr><td><p class='notice'>Mind<td>one</table>", "one"),
])
def test_implied_end_tags(start, after):
    own = [f"{LONG}{k}" for k in range(3)]
    tail = "".join(f"<p>{x}" for x in own)
    for page in (f"<html>{start}{tail}", f"<html><body><article>{start}{tail}</article></body></html>"):
        assert main_text(page).split("\n") == [*after.split(), *own]


def _p(n, word="Some words of a sentence, long enough to count as one"):
    return "".join(f"<p>{word} {k}.</p>" for k in range(n))


ARTICLE = "<h1>Title of it</h1>" + _p(2, "Article text here")
WANT = "Title of it\nArticle text here 0.\nArticle text here 1."


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{ARTICLE}</article><div class='comments'>{_p(12)}</div>",
        f"<article>{ARTICLE}<section id='comments'>{_p(12)}</section></article>",
        f"<div id='content'>{ARTICLE}</div><div id='comments'>{_p(12)}</div>",
        f"<div class='sidebar'>{_p(8)}</div><article>{ARTICLE}</article>",
        f"<main>{ARTICLE}<div class='advert'>{_p(9)}</div></main>",
        f"<article>{ARTICLE}</article><article class='comment'>{_p(6)}</article>",
        f"<article class='related'>{_p(6)}</article><article>{ARTICLE}</article>",
        f"<div class='comment-list'>{_p(6)}</div><div class='site-header'>{_p(5)}</div><main>{ARTICLE}</main>",
        f"<div class='layout has-sidebar'><article>{ARTICLE}</article></div>",
        f"<div class='page no-sidebar'>{ARTICLE}</div>",
        f"<div id='header-main-wrap'><article>{ARTICLE}</article><div class='promo'>{_p(7)}</div></div>",
        f"<div class='widget'>{ARTICLE}</div>",
        f"<body class='comments'><ol class='comments'><li>{_p(9)}</li></ol><div>{ARTICLE}</div>",
    ],
)
def test_what_surrounds_a_short_article_is_left_out_however_long_it_is(page):
    assert main_text(page) == WANT


def test_a_marker_within_a_longer_name_marks_nothing():
    page = f"<article>{ARTICLE}<p class='ad-free'>Free of them.</p><p class='comment-line'>A line.</p></article>"
    assert main_text(page) == f"{WANT}\nFree of them.\nA line."


def test_only_comments_are_no_content():
    assert main_text(f"<div id='comments'>{_p(5)}</div>") == ""


def test_many_unclosed_and_nested_elements_take_little_time():
    start = time.process_time()
    assert main_text("<section>" * 4000 + f"<article>{ARTICLE}</article>") == WANT
    assert main_text("<span class='x'>a</span>" * 30_000 + f"<article>{ARTICLE}</article>") == WANT
    assert time.process_time() - start < 5
