import html as entities
import random
import re
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from oscilla.llm import htmltext
from oscilla.llm.htmltext import Page, align, choose, expression, main_text


def sentence(r, n=12):
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(n)).capitalize() + "."


def paragraphs(r):
    return [sentence(r, r.randint(15, 40)) for _ in range(r.randint(2, 6))]


def article(r, i):
    title, ps = sentence(r, 5), paragraphs(r)
    related = "".join(f'<li><a href="/{k}">{sentence(r, 4)}</a></li>' for k in range(5))
    comments = "".join(f'<article class="comment"><p>{sentence(r, 30)}</p></article>' for _ in range(r.randint(0, 8)))
    body = "".join(f"<p>{p}" for p in ps)
    text = f"""<!doctype html><html><head><title>{title} | Site</title><script>if (a < b) document.write("<p>no</p>")</script></head>
    <body class="has-sidebar"><header><h1>The Site</h1><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></header><div class="cookie-notice">We use cookies, all of them.</div>
    <div id="wrapper"><article id="post-{i}" class="post comments-open"><header><h1>{title}</h1></header>{body}
    <figure><img src=x><figcaption>A picture of {i}</figcaption></figure><div class="share-buttons"><a href=#>Share this</a></div><aside>{sentence(r)}</aside>
    <div class="related"><ul>{related}</ul></div></article><section id="comments"><h2>Comments</h2>{comments}<form><textarea>say</textarea><button>Send</button></form></section></div>
    <div class="sidebar"><p>{sentence(r, 20)}</p></div><footer><p>&copy; 2020 The Site</p></footer></body></html>"""
    return text, " ".join([title, *ps, f"A picture of {i}"])


def soup(r, i):
    """Nothing is named: only places, repetition and template strings tell."""
    title, ps = sentence(r, 6), paragraphs(r)
    menu = "".join(f"<a href='/{k}'>{k} is a section</a> " for k in ("one", "two", "three", "four"))
    extra = f"<div>{'<p>Our offer of the week is great. Buy now, it is cheap and good.</p>'}</div>" if i % 2 else ""
    text = f"""<html><body><div><div>{menu}</div><div><div>Welcome to our site, read every day by many people.</div>{extra}<div><h1>{title}</h1>{"".join(f"<p>{p}</p>" for p in ps)}</div></div>
    <div>All rights reserved. Do not copy anything from this site, ever.</div></div></body></html>"""
    return text, " ".join([title, *ps])


def table(r, i):
    title, ps = sentence(r, 6), paragraphs(r)
    text = f"""<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD CLASS=menu><A HREF=/a>Start</A><BR><A HREF=/b>Ende</A><TD CLASS="mainContent"><H1>{title}</H1>
    {"<BR><BR>".join(f"<FONT SIZE=2>{p} caf&eacute; &amp; <B>b</B>old</FONT>" for p in ps)}<TD ID=adBanner>Kauf das</TABLE></BODY>"""
    return text, " ".join([title, *(f"{p} café & bold" for p in ps)])


def main_element(r, i):
    title, ps = sentence(r, 6), paragraphs(r)
    text = f"""<body><nav>menu</nav><form action=/all><main role="main"><h1>{title}</h1><!-- <p>gone</p> --><p hidden>unseen</p>{"".join(f"<div>{p}</div>" for p in ps)}
    <div class="newsletter-box">Subscribe to all of our letters now.</div><ul><li>one<li>two</ul></main><input name=q></form><div style="display: none">{"hidden words " * 200}</div>"""
    return text, " ".join([title, *ps, "one", "two"])


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    rows = []
    for host, make in (("news", article), ("soup", soup), ("old", table), ("main", main_element)):
        rows += [(len(rows) + i, f"https://{host}.example/{i}?q=1", *make(r, i)) for i in range(12)]
    return rows


def test_templates(spark, corpus):
    pages = spark.createDataFrame([r[:3] for r in corpus], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r for r in htmltext.extract(pages, htmltext.infer_wrappers(pages)).collect()}
    for i, url, _, want in corpus:
        assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), url)


def test_named_elements_of_single_pages(corpus):
    for _, url, text, want in corpus:
        if "soup" not in url:  # one page alone has no template strings
            assert main_text(Page(text), set(), set()) == want


def test_wrappers_do_not_depend_on_the_order_of_alignment(spark, corpus):
    pages = spark.createDataFrame([r[:3] for r in corpus], "page_id long, url string, html string")
    one = {r.host: r for r in htmltext.infer_wrappers(pages.repartition(1)).collect()}
    many = {r.host: r for r in htmltext.infer_wrappers(pages.orderBy(F.desc("page_id")).repartition(9)).collect()}
    assert one == many and {h: r.n_pages for h, r in one.items()} == {f"{h}.example": 12 for h in ("news", "soup", "old", "main")}


def wrapper(*texts):
    w = {}
    for t in texts:
        align(w, Page(t))
    follows = {}
    for k, n in w:
        if n:
            follows.setdefault(k, set()).add(n)
    places = {k: p for (k, n), p in w.items() if not n}
    choose(places)
    return expression(places, follows)


def test_expressions():
    assert wrapper("<div><p>a</p></div>") == "div:blocks(p(#text))"
    assert wrapper("<div><h2>x</h2><p>a</p></div>", "<div><h2>x</h2><p>b</p><p>c</p></div>") == "div:title:blocks(h2('…') p(#text)+)"
    assert wrapper("<div class=x1><p>a</p></div>", "<div class=x2><h2>t</h2><p>b</p></div>") == "div.x(h2(#text)? p(#text))"
    assert wrapper("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p></div>") == "div:title:blocks((h2(#text)* p(#text)*)+)"
    assert wrapper("<ul><li>a<li>b</ul>", "<ul></ul>", "<p>x") == "p(#text)? ul(li(#text)*)?"


def test_markup():
    page = lambda t: main_text(Page(t), set(), set())
    assert page("<p>a<b>b</b>c <i>d</i></p>\n<p> e&nbsp;\t f&lt;g&#x21; &amp;lt; </p>") == "abc d e f<g! &lt;"
    assert page("<p>1 < 2 & 3 <</p>x <a title='>' href=\"a>b\">y</a><br>z words here") == "1 < 2 & 3 < x y z words here"
    assert page("<p>a<script>'</p>'<p>b") == "a" and page("<p>a<!-- b") == "a" and page("<p>a<svg><text>t</text></svg>b") == "ab"
    assert page("") == page("<html></html>") == page("<nav>only a menu</nav>") == ""
    assert page("plain text") == "plain text"
    assert page("<div>" * 500 + "deep" + "</div>" * 500 + " end") == "deep end"
    assert page("<ul><li>a<ul><li>b</ul><li>c</ul><dl><dt>d<dd>e<dt>f</dl>") == "a b c d e f"
    assert page("<head><title>t</title><meta name=x><p>a</p>") == "a"


def test_hints():
    assert htmltext.hints(["ad-slot"])[1] == htmltext.hints(["postComments"])[1] == htmltext.hints(["cookie_notice"])[1] == htmltext.HARD
    assert htmltext.hints(["sidebar-left"])[1] == htmltext.SOFT
    assert htmltext.hints(["has-sidebar", "comments-open", "header-image", "loaded", "shade"]) == (0, 0)
    assert htmltext.hints(["post-content"]) == htmltext.hints(["entryContent"]) == (1, 0)


def test_rows(spark):
    rows = [
        (1, "http://a.example/1", None), (2, "http://a.example/2", ""), (3, None, "<p>x y</p>"), (None, "no host", "<article>z</article>"),
        (4, "HTTP://u:p@A.example:80/", "<article>same</article>"), (4, "HTTP://u:p@A.example:80/", "<article>same</article>"), (5, "http://a.example", "<p>" + "long text " * 200_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit(1))
    wrappers = htmltext.infer_wrappers(pages)
    assert {(r.host, r.n_pages) for r in wrappers.collect()} == {("a.example", 5), ("", 2)}
    got = htmltext.extract(pages, wrappers)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = ["", "", "x y", "z", "same", "same", ("long text " * 200_000).strip()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, u, t, len(t)) for (i, u, _), t in zip(rows, want)], key=str)
    none = pages.limit(0)
    assert htmltext.extract(none, htmltext.infer_wrappers(none)).count() == 0


def test_large_wrappers_are_shuffled(spark, corpus, monkeypatch):
    pages = spark.createDataFrame([r[:3] for r in corpus], "page_id long, url string, html string")
    wrappers = htmltext.infer_wrappers(pages)
    want = sorted(map(tuple, htmltext.extract(pages, wrappers).collect()))
    monkeypatch.setattr(htmltext, "BROADCAST", 0)
    monkeypatch.setattr(htmltext, "PLACES", 10)
    assert sorted(map(tuple, htmltext.extract(pages, htmltext.infer_wrappers(pages)).collect())) == want


def test_rare_places_are_left_to_their_pages(spark, corpus, monkeypatch):
    monkeypatch.setattr(htmltext, "RARE", 1)  # only what every page has
    odd = (999, "https://news.example/odd", "<div class=entry-content><h1>Odd one</h1><p>Only here, and nowhere else.</p></div>", "Odd one Only here, and nowhere else.")
    rows = [r for r in corpus if "news" in r[1]] + [odd]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(pages, htmltext.infer_wrappers(pages)).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_given_pages(spark):
    """The given pages have one article each, with titles, paragraphs and line breaks only."""
    rows = htmltext.op13_html(spark, "/root/testdata/sf0.01").collect()
    given = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(given)
    for r in rows:
        source = given[r.page_id].html
        inner = source[source.index("<article>") + 9 : source.index("</article>")]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inner))
        assert r.text == " ".join(filter(None, blocks)) and r.n_chars == len(r.text) and urlsplit(r.url).hostname
