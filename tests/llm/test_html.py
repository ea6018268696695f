import html as stdlib
import re
import time

import numpy as np

from wavelens.llm import html
from wavelens.llm.common import table


def plain(page):
    """The article by regular expressions, right for the simple pages of the test tables."""
    m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    inner = re.sub(r"<[^>]*$", "", m[1]) if m else ""
    blocks = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", re.sub(r"<br>", " ", inner))
    return "\n".join(t for b in blocks if (t := " ".join(stdlib.unescape(re.sub(r"<[^>]+>", "", b)).split())))


def test_pages_match(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in html.main_text(pages).collect()}
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_boilerplate_of_other_kinds():
    body = "".join(f"<p>Paragraph {i} has a <a href='/x'>link</a> and enough words to be content of a page.</p>" for i in range(6))
    page = f"""<html><body><header><h1>Site</h1></header><div id="main-menu"><ul><li><a>Home</a></li></ul></div><div class="cookie-notice">We use cookies.</div>
    <div class="content"><h2>Title</h2>{body}<p>Short.</p><form><label>Mail</label></form><div class="ad-slot">Buy!</div><table><tr><td>Cell</td></tr></table></div>
    <aside>Related</aside><section id="comments"><p>{'A reader says a lot about this. ' * 30}</p></section><footer>&copy; us</footer></body></html>"""
    text = html.extract(page)
    assert text.split("\n") == ["Title", *(f"Paragraph {i} has a link and enough words to be content of a page." for i in range(6)), "Short.", "Cell"]


def test_edges(spark):
    df = spark.createDataFrame([(1, "u", None, 3), (2, "u", "", 3), (3, "u", "just text &amp; more", 3), (4, "u", "<p>a<p>b<scr", 3), (5, "u", "<nav>only menu</nav>", 3), (6, "u", "<div>" * 3000 + "deep", 3)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert got == {1: "", 2: "", 3: "just text & more", 4: "a\nb", 5: "", 6: "deep"}
    assert html.main_text(df.limit(0)).count() == 0


BODY = "".join(f"<p>Paragraph {i} tells a reader something that takes more than a few words to say.</p>" for i in range(8))
TEXT = [f"Paragraph {i} tells a reader something that takes more than a few words to say." for i in range(8)]


def test_names_are_evidence_and_no_veto():
    for open_, close in (('<div class="layout has-sidebar">', "</div>"), ('<div id="page" class="no-sidebar">', "</div>"), ('<div class="market-share report">', "</div>"), ('<div class="widget">', "</div>"), ("<div>", "</div>")):
        page = f"<html><body>{open_}<div class='menu'><a href='/'>Home</a></div><div>{BODY}<p class='related-work'>{TEXT[0]}</p></div>{close}</body></html>"
        assert html.extract(page).split("\n") == [*TEXT, TEXT[0]], open_


def test_comments_in_a_neutral_block():
    reader = "<p>I, a reader, think that this is not so and say so at some length here.</p>" * 3
    page = f"<html><body><div class='a'><h1>Title</h1>{BODY}</div><div class='b'><h3>3 Comments</h3>{reader}</div></body></html>"
    assert html.extract(page).split("\n") == ["Title", *TEXT]


def pages_without_article():
    links = "".join(f"<li><a href='/{i}'>Link {i}</a> <b>x</b></li>" for i in range(30))
    for k in range(1, 6):
        extra = f"<p>{'One more sentence of some length that a reader reads. ' * k}</p>"
        yield f"<html><body><div><ul>{links}</ul></div><div><div>{BODY}{extra}</div></div><div><ul>{links}</ul></div></body></html>"


def test_the_smoothed_ratio_decides(monkeypatch):
    got = [html.extract(p) for p in pages_without_article()]
    assert all(t.split("\n")[:8] == TEXT and "Link" not in t for t in got)
    monkeypatch.setattr(html, "smooth", lambda x, sigma=1.0: np.arange(len(x), dtype=float))
    assert all(a != html.extract(p) for a, p in zip(got, pages_without_article()))


def test_time_is_in_proportion_to_nesting():
    def seconds(n):
        page = "<div class='x'>" * n + "<p>some words</p></b></i>" * n
        start = time.perf_counter()
        html.extract(page)
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16000) < 12 * max(seconds(4000), 0.02)
