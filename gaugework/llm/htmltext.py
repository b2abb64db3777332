"""Main text of HTML pages by text-to-tag ratios.

The events of the standard library's streaming parser cut a page into lines at the borders of block elements, so a page
without line breaks has them too. Each line has a text-to-tag ratio; lines of menus, headers, footers, sidebars and forms,
which elements tell, have none, nor have adverts, notices and comment sections, which only class names tell. The ratios
are smoothed with a Gaussian along the page, and lines above a threshold of the page's own spread form clusters. The
clusters select regions: an article or main element that holds selected lines is taken as a whole, and without one all
that lies between the first and the last selected line; short lines between long ones thus stay.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import map_rows

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math canvas iframe object audio video select option textarea button".split())
BOILER = frozenset("nav footer aside form dialog menu".split())
ARTICLE = frozenset(["article", "main"])
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Words of a class, id or role that mark boilerplate wherever they stand.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr popup modal menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead comment comments "
    "disqus subscribe newsletter signup pagination pager complementary contentinfo".split()
)
#: Words that do so only beside words that say no more about a block than its place.
WEAK = frozenset("banner notice notices alert overlay aside header topbar respond reply replies teaser sharing share social related recommended login search widget toolbar".split())
PLACES = frozenset(
    "area bar block bottom box bottom button buttons container content field form global head icon icons inline inner item items left line link links list main message messages outer page panel post posts right row "
    "section site sticky title top unit widget wrap wrapper".split()
)
#: Of these, the ones that mark even an article: one reader's comment, or another page's teaser.
OTHERS = frozenset("ad advert advertisement comment comments promo related recommended replies reply sponsored teaser".split())
#: An element that implies the end of these, if they stand open innermost.
IMPLIED = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SIGMA = 1.0
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Markup that never ends, as a whole: what stands before the next tag or the end.
_UNFINISHED = re.compile(r"<[A-Za-z/!?][^<>]*>?")


@dataclass
class Line:
    text: str
    tags: int
    boiler: bool
    article: int
    linked: int

    @property
    def ratio(self) -> float:
        """Characters outside of links to tags."""
        return 0.0 if self.boiler else max(0, len(self.text) - self.linked) / max(1, self.tags)


@dataclass
class Element:
    """An open element: its name, and whether text in it is hidden, left out of its line, boilerplate, in which article, and whether in a link."""

    name: str
    hidden: bool
    skipped: bool
    boiler: bool
    article: int
    link: bool


ROOT = Element("", False, False, False, 0, False)


class Lines(HTMLParser):
    """Cuts a page into lines at the borders of block elements.

    Every element that has an end stands on a stack, inline ones too, so that the end of one within a marked element ends
    only itself. Text in hidden and in marked inline elements is left out of the line that they stand in.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Element] = []
        self.blocks: list[int] = []  # places of the block elements among the open ones
        self.counts: dict[tuple[int, str], int] = {}  # of open elements: inline ones by innermost block and name, blocks by name
        self.parts: list[str] = []
        self.tags = self.linked = self.articles = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            at = self.open[self.blocks[-1]] if self.blocks else ROOT
            self.lines.append(Line(text, self.tags, at.boiler, at.article, self.linked))
        self.parts, self.tags, self.linked = [], 0, 0

    def close_from(self, k: int) -> None:
        while len(self.open) > k:
            element = self.open.pop()
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()
                place = -1
            else:
                place = self.blocks[-1] if self.blocks else -2
            self.counts[place, element.name] -= 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in BLOCKS
        if block:
            self.flush()
            while self.blocks and self.open[self.blocks[-1]].name in IMPLIED.get(tag, ("p",)):
                self.close_from(self.blocks[-1])
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        top = self.open[-1] if self.open else ROOT
        article = top.article
        if tag in ARTICLE and not article:
            self.articles += 1
            article = self.articles
        hidden = top.hidden or tag in HIDDEN or any(k == "hidden" for k, _ in attrs)
        marked = tag in BOILER or (tag == "header" and not article) or (tag not in ("html", "body") and self.marked(attrs, tag in ARTICLE))
        if block:
            self.blocks.append(len(self.open))
            place = -1
        else:
            place = self.blocks[-1] if self.blocks else -2
        self.counts[place, tag] = self.counts.get((place, tag), 0) + 1
        self.open.append(Element(tag, hidden, not block and (top.skipped or marked), top.boiler or (block and (marked or top.skipped)), article, top.link or tag == "a"))

    @staticmethod
    def marked(attrs: list, article: bool) -> bool:
        """Whether a class, id or role marks boilerplate; of an article, whether it is another's, as a reader's comment is."""
        for name, value in attrs:
            if name not in ("class", "id", "role", "aria-label") or not value:
                continue
            for token in value.split():
                words = {w.lower() for w in _WORDS.findall(token)}
                if article:
                    if words & OTHERS:
                        return True
                elif words & STRONG or (words & WEAK and words <= WEAK | PLACES):
                    return True
        return False

    def handle_endtag(self, tag: str) -> None:
        block = tag in BLOCKS
        if block:
            self.flush()
        self.tags += 1
        floor = self.blocks[-1] if self.blocks else -2
        if not self.counts.get((-1 if block else floor, tag)):
            return  # nothing that it could end; an inline end doesn't reach beyond its block
        for k in reversed(self.blocks) if block else range(len(self.open) - 1, floor, -1):
            if k >= 0 and self.open[k].name == tag:
                self.close_from(k)
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        top = self.open[-1] if self.open else ROOT
        if not top.hidden and not top.skipped:
            self.parts.append(data)
            self.linked += len(data.strip()) if top.link else 0

    def finish(self) -> None:
        """Take what the parser holds back at the end of a page, once, however many tags in it never end.

        A tag that never ends is markup, and an unclosed comment, script or style hides the rest, as in browsers.
        """
        rest, self.rawdata = self.rawdata, ""
        if not self.cdata_elem and not rest.startswith("<!--"):
            self.handle_data(unescape(_UNFINISHED.sub(" ", rest)))
        self.flush()


def lines(html: str) -> list[Line]:
    parser = Lines()
    parser.feed(html)
    parser.finish()
    return parser.lines


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the lines; at the ends the kernel is cut and weighs what it still covers."""
    radius = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[radius : radius + len(values)]
    return np.convolve(values, kernel)[radius : radius + len(values)] / weight


def clusters(found: list[Line]) -> list[int]:
    """The lines with text outside of links whose smoothed ratio reaches the threshold and that aren't boilerplate."""
    ratios = np.array([x.ratio for x in found])
    smoothed = smooth(ratios)
    threshold = min(float(smoothed.std()), float(smoothed.max(initial=0.0)))
    return [i for i, x in enumerate(found) if smoothed[i] >= threshold and x.ratio > 0]


def extract(html: str) -> str:
    """The main text: blocks joined by a line break, white space within a block one space; empty if there is none."""
    found = lines(html)
    chosen = clusters(found) if found else []
    if not chosen:
        return ""
    articles = {found[i].article for i in chosen} - {0}
    if articles:
        # Sections of one page stand side by side; those that hold a cluster are content.
        return "\n".join(x.text for x in found if x.article in articles and not x.boiler)
    return "\n".join(x.text for x in found[chosen[0] : chosen[-1] + 1] if not x.boiler)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, text, n_chars.

    A null or empty page has an empty text; a key or url may be null; repeated rows repeat; no rows give none. Further
    columns are left out before anything is added. Time grows in proportion to the length of a page, broken ones included.
    """

    def row(page: str) -> tuple:
        text = extract(page)
        return text, len(text)

    return map_rows(pages.select(F.col(key), F.col(url), F.col(html).alias("__html")), [key, url], "__html", "text string, n_chars bigint", row, ["text", "n_chars"])
