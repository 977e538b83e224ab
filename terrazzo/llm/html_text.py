"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's event parser turns a page into lines, one a block of text. Each line knows its text, how
many tags fell on it, how much of its text is link text, and the elements around it. A line's density is the
logarithm of its characters over its tags, link text left out; densities are smoothed with a Gaussian over
neighbouring lines. Two means of the smoothed densities (a threshold in one dimension) set content apart from the
rest, on every page.

Markup adjusts what is clustered: lines inside nav, header, footer, aside, form, dialog and the like, or inside
elements whose class, id or role names menus, adverts, notices, comments and so on, take no part; lines inside an
article or main element have MARKUP added, more than any density, and are smoothed among themselves. So where a
page has such an element the two means fall on its two sides, and elsewhere on dense and sparse text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.llm.common import pick

SKIPPED = {"script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "select", "textarea", "button", "title", "option", "datalist", "audio", "video", "map"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "fieldset", "head"}
MAIN = {"article", "main"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side|aside|footer|header|masthead|toolbar|cookies?|consent|notice|alert|popup|modal|overlay|subscribe|newsletter|signup|login|share|sharing|social|related|recommend\w*|comments?|disqus|replies|reply|pagination|pager|copyright|widget|skip)(?:$|[\s_-]|\d)", re.I)
#: The same within an article, where blocks that are no menu, header, footer, sidebar, notice, advert, form or comment belong to the text.
NAMED_INSIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|menu|nav|navbar|navigation|breadcrumbs?|sidebar|footer|header|masthead|toolbar|cookies?|consent|notice|popup|subscribe|newsletter|signup|login|comments?|disqus|replies|reply)(?:$|[\s_-]|\d)", re.I)
#: Names of wrappers that say what their page has, as in has-sidebar.
ABOUT = re.compile(r"(?:^|(?<=\s))(?:with|without|has|no)[-_]\S+", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: What an article adds to the densities of its lines: more than any density, a logarithm of a length, can be.
MARKUP = 64.0
SPACE = re.compile(r"\s+")


class Line:
    __slots__ = ("text", "tags", "link", "outside", "main")

    def __init__(self, text: str, tags: int, link: int, outside: bool, main: bool):
        self.text, self.tags, self.link, self.outside, self.main = text, tags, link, outside, main


class Events(HTMLParser):
    """Collects lines. Unclosed elements end with the element around them; a stray end tag is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool, bool, bool]] = []  # tag, skipped, outside, main, link
        self.blocks: list[int] = []  # where block elements stand in `open`
        self.count: Counter[str] = Counter()  # how many elements of a name are open
        self.parts: list[str] = []
        self.tags = self.link = 0

    def state(self) -> tuple[bool, bool, bool, bool]:
        return self.open[-1][1:] if self.open else (False, False, False, False)

    def end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            _, outside, main, _ = self.state()
            self.lines.append(Line(text, self.tags, self.link, outside, main))
            self.tags = self.link = 0
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.end_line()
            self.close_implied(tag)
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        skipped, outside, main, link = self.state()
        a = dict(attrs)
        skipped |= tag in SKIPPED or "hidden" in a or (a.get("aria-hidden") or "") == "true" or "display:none" in (a.get("style") or "").replace(" ", "").lower()
        main |= tag in MAIN
        if tag not in ("html", "body"):
            names = NAMED_INSIDE if main else NAMED
            named = any(names.search(ABOUT.sub("", a.get(k) or "")) for k in ("class", "id"))
            outside |= named or tag in OUTSIDE or (a.get("role") or "").lower() in ROLES
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.count[tag] += 1
        self.open.append((tag, skipped, outside, main, link or tag == "a"))

    def drop(self, at: int) -> None:
        """Close the open elements from place `at` on."""
        for name, *_ in self.open[at:]:
            self.count[name] -= 1
        del self.open[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def close_implied(self, tag: str) -> None:
        """A block ends an open paragraph, and an item, row or cell its sibling, with what is open inside."""
        siblings = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}.get(tag, set()) | {"p"}
        while siblings and self.blocks and (name := self.open[self.blocks[-1]][0]) in siblings:
            self.drop(self.blocks[-1])
            siblings -= {name}

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if self.count[tag]:  # each step down closes an element, so all end tags together take linear time
            at = len(self.open) - 1
            while self.open[at][0] != tag:
                at -= 1
            self.drop(at)

    def handle_data(self, data: str) -> None:
        skipped, _, _, link = self.state()
        if not skipped:
            self.parts.append(data)
            self.link += len(data) * link


def lines_of(html: str | None) -> list[Line]:
    if not html:
        return []
    events = Events()
    events.feed(html)
    events.close()
    events.end_line()
    return events.lines


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian-weighted means over neighbours within three sigma; weights beyond the ends are left out."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        w = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(a * b for a, b in zip(w, values[lo:hi], strict=True)) / sum(w))
    return out


def threshold(values: list[float]) -> float:
    """The middle between two means, started from the extremes; equal values are all above it."""
    low, high = min(values), max(values)
    if low == high:
        return low
    for _ in range(50):
        cut = (low + high) / 2
        below, above = [v for v in values if v < cut], [v for v in values if v >= cut]
        new = sum(below) / len(below) if below else low, sum(above) / len(above) if above else high
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def densities(lines: list[Line], sigma: float) -> list[float]:
    """The smoothed densities of lines; those inside and outside of articles are smoothed apart."""
    out = [0.0] * len(lines)
    for main in (False, True):
        at = [i for i, x in enumerate(lines) if x.main == main]
        of = smoothed([math.log1p(max(0, len(lines[i].text) - lines[i].link) / max(1, lines[i].tags)) for i in at], sigma)
        for i, d in zip(at, of, strict=True):
            out[i] = d + MARKUP * main
    return out


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The page's article: its blocks in order, joined by line feeds; empty if the page is null or has none."""
    lines = [x for x in lines_of(html) if not x.outside]
    if not lines:
        return ""
    density = densities(lines, sigma)
    # the threshold never falls inside an article, nor above text of 20 characters a tag where there is none
    cut = min(threshold(density), MARKUP if any(x.main for x in lines) else math.log1p(20))
    kept = [d >= cut and (x.main or 2 * x.link <= len(x.text)) for d, x in zip(density, lines, strict=True)]
    if not any(kept):
        kept = [2 * x.link <= len(x.text) for x in lines]
    return "\n".join(x.text for k, x in zip(kept, lines, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text), one for each page; null html gives an empty text, null ids and urls stay."""
    d = pick(pages, page_id=id_col, url=url_col, html=html_col)
    kind = d.schema["page_id"].dataType.simpleString()
    d = d.withColumn("url", F.col("url").cast("string")).withColumn("html", F.col("html").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrazzo.llm.html_text import main_text as of

        for b in batches:
            text = pa.array([of(h.as_py()) for h in b.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), text], ["page_id", "url", "text"])

    return d.mapInArrow(run, f"page_id {kind}, url string, text string")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its length; null html has an empty text."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLE: dict[str, str] = {}
