import re
import time
from html import unescape

import pytest

from terrazzo.llm import html_text as h

CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<html><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>T</h1><p>One <b>two</b>\n  three<p>Four &eacute;&#33;</article><footer>c</footer>", "T\nOne two three\nFour é!"),
    ('<article><p>a<br>b</p><div class="ad">buy</div><script>x()</script><p>c<!-- no --></p><section class="comments"><p>me too</p></section></article>', "a b\nc"),
    ('<div class="with-sidebar"><article><p>in</p><article class="comment">hey</article></article></div><aside>out</aside>', "in"),
    ("<article><p><b>x.<br><p>y</p><form><p>mail</p><input></form><ul><li>i<li>j</ul>", "x.\ny\ni\nj"),
    ("<article><p>5 < 6 && a<b>c</b></p></article>", "5 < 6 && ac"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_main_text(html, text):
    assert h.main_text(html) == text


def test_ratio_fallback():
    long = "Words of a long paragraph that goes on and on, with much to say and little markup. " * 4
    page = "<div><a href=a>one</a></div><div><a href=b>two</a></div>" + f"<div>{long}</div><div>{long}</div>" + "<div><a href=c>three</a></div>"
    assert h.main_text(page) == "\n".join([long.strip()] * 2)


def by_elements(html):
    """A second reading of the test pages by patterns alone: the article's blocks in order."""
    if not html or "<article>" not in html:
        return ""
    body = html.split("<article>", 1)[1].split("</article>", 1)[0]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<!--.*?-->", "", body, flags=re.S))
    return "\n".join(t for b in blocks if (t := re.sub(r"\s+", " ", unescape(re.sub(r"</?b>", "", b.replace("<br>", " ")))).strip()))


def test_all_pages_go_through_the_threshold(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    calls, real = [], h.threshold
    monkeypatch.setattr(h, "threshold", lambda v: calls.append(len(v)) or real(v))
    for r in pages:
        assert h.main_text(r.html) == by_elements(r.html)
    assert len(calls) == sum(bool(r.html) for r in pages)


def test_adjusted_densities_decide():
    page = "<div>left out, though it is a rather long line of text that has no tags in it at all</div><article><p>a</p><p>bb</p></article>"
    assert h.main_text(page) == "a\nbb"
    assert h.main_text(page.replace("article", "section")).startswith("left out")
    assert h.main_text('<article><p>x</p><div class="related">y</div><div class="sidebar">z</div><math>n</math></article>') == "x\ny\nn"


def test_hostile_pages_take_linear_time():
    for page in ("<b>" * 20_000 + "</i>" * 20_000, "<b>" * 20_000 + "<p>" * 20_000, "<b>" * 20_000 + "<div></div>" * 20_000, "<li>" * 20_000 + "</ul>" * 20_000):
        start = time.process_time()
        h.main_text(page + "x")
        assert time.process_time() - start < 3


def test_extract(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<p>a</p>", "y"), (None, "v", "<p>b", "z")], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), str(r.url), r.text) for r in h.extract(df).collect())
    assert got == [("1", "None", ""), ("1", "u", "a"), ("None", "v", "b")]
