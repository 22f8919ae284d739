"""Attributes, forms and names of pages, the tree's say over them, and pages that are slow to read badly."""

import time

import pytest

from mnemospark.llm import html_text

CASES = {
    "<article><p>See <a href='/hidden/valley'>the valley</a> now</p></article>": "See the valley now",
    "<p title='a hidden gem'>x</p>": "x",
    "<p><abbr title='hidden Markov model'>HMM</abbr> y</p>": "HMM y",
    "<p data-hidden='no'>x</p>": "x",
    "<div data-id='menu'>x</div>": "x",
    "<div data-role='search'>x</div>": "x",
    """<div title="class='ad'">x</div>""": "x",
    "<p><a href='/x?role=search'>See</a> it</p>": "See it",
    '<p title="open hidden>text</p>': "text",
    "<p hidden>x</p><p>y": "y",
    "<p>a<!-- never closed > b": "a",
    "<p>a</p><script>var x='<p>'": "a",
    "<p>a <b": "a <b",
    "<body><form id='aspnetForm'><div class='menu'>m</div><article><h1>T</h1><p>body text</p></article></form></body>": "T\nbody text",
    "<body><fieldset><article><p>text of it</p></article></fieldset></body>": "text of it",
    "<body><div class='promotion'><article><p>whole article</p></article></div></body>": "whole article",
    "<article><h1>T</h1><section id='navigation'><h2>Navigation</h2><p>how to</p></section><section id='comments'><h2>Comments</h2><p>in code</p></section><div class='notice'>Note</div><table class='menu'><tr><td>soup</td></tr></table></article>": "T\nNavigation\nhow to\nComments\nin code\nNote\nsoup",
    "<article><p>long enough text of the article</p><section id='comments'><h2>Comments</h2><div class='comment'>nice</div></section></article>": "long enough text of the article",
    "<body><p>text of this page</p><form>Name <input><label>Mail</label></form></body>": "text of this page",
    "<body><div class='ad-wrapper'>j</div><div class='adsbygoogle'>j</div><div class='cookie-notice-bar'>j</div><div class='user-comment'>j</div><div class='responses'>j</div><p>the text of this page</p></body>": "the text of this page",
    "<body><article><p>the main article is here</p></article><div class='related-posts'><article>card</article></div></body>": "the main article is here",
}


@pytest.mark.parametrize("html", sorted(CASES))
def test_a_page_by_itself(html):
    assert html_text.main_text(html_text.parse(html)) == CASES[html]


def test_pages_of_one_host_each_like_a_page_by_itself(spark):
    table = spark.createDataFrame([(i, f"http://h{i}.example/", h) for i, h in enumerate(CASES)], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_text.main_texts(table).collect()}
    assert got == dict(enumerate(CASES.values()))


def test_the_tree_decides_what_stands_beside_articles(spark):
    """Without decisions the text beside the article stays: names and marks act through the tree alone."""
    page = "<body><div class=q>Read {0}</div><article><p>text {0} of this page</p></article><div class='ad'>buy {0}</div></body>"
    pages = [page.format(f"w{i}") for i in range(30)]
    table = spark.createDataFrame([(i, "http://h.example/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    assert {r.text for r in html_text.main_texts(table).collect()} == {f"text w{i} of this page" for i in range(30)}
    assert html_text.decided_text(html_text.parse(pages[0]), set()) == "Read w0\ntext w0 of this page\nbuy w0"


def test_a_name_yields_to_its_hosts_pages(spark):
    """On one host ``promo-page`` wraps the text of nearly all pages, and so stays on a page with a long foot, too."""
    text = "words of page {0} that are here and nowhere else, and more of them {0}"
    wrap = "<body><div class='promo-page'><p>" + text + "</p></div>{1}</body>"
    foot = "<div class='z'>" + "the usual long foot of this site, with words of its own and more " * 3 + "</div>"
    pages = [wrap.format(i, "") for i in range(40)] + [wrap.format(99, foot)]
    table = spark.createDataFrame([(i, "http://h.example/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    assert html_text.main_text(html_text.parse(pages[-1])).startswith("the usual long foot")
    got = {r.page_id: r.text for r in html_text.main_texts(table).collect()}
    assert got[40].startswith(text.format(99)) and got[3] == text.format(3)


@pytest.mark.parametrize("make", [lambda n: "<div>" * n + "x" + "</span></b>" * n, lambda n: "<a " * n, lambda n: "<p>" * n + "</i>" * n, lambda n: "<ul><li>" * n + "x", lambda n: "<b>" * n + "</p></table>" * n, lambda n: '<p ">' * n, lambda n: "<script>" * n, lambda n: "<!--" * n, lambda n: "<div class='ad' id='menu'>" * n + "x"])
def test_time_is_linear_in_tags(make):
    start = time.perf_counter()
    html_text.main_text(html_text.parse(make(100_000)))
    assert time.perf_counter() - start < 40
