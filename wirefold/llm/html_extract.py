"""Main text of web pages: streaming parser events, smoothed text-to-tag ratios, threshold clustering.

The standard library's parser is fed piece by piece.  Its events cut a page
into lines (one per block element); a line has its text, the number of tags
in it and the container it stands in.  Then:

1. *Ratios.*  The ratio of text to tags per line is smoothed with a Gaussian
   kernel, and lines above a threshold (a share of the standard deviation) are
   content.
2. *Clusters.*  Content lines in a row are a cluster; a line of low ratio in a
   container of its own ends it.  The cluster with most text is the core.
   Another one belongs to it if a container below the page's body holds both,
   or if it has at least ``LARGE`` of the core's text.
3. *Region.*  The smallest container that holds these clusters, so that
   sibling articles and sections stay together; an article or main element
   around it is taken whole.  The result is all lines of the region, short ones
   too, without those that are left out.

Left out are scripts, menus, headers, footers, sidebars, forms and the like by
their element.  A class, id or role that names such a part only counts as a
hint: it doesn't reach into an article or main element, and is ignored where the container
holds most of the text of such an element around it (of the page, if it has no
such element), so that ``<div class="layout has-sidebar">`` doesn't drop a whole
article.  Names of reader comments count whatever their share, as long as other
text is left.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element names and name parts of classes, ids and roles.
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody tfoot thead title tr ul").split())
CONTAINERS = frozenset("article main section div td th table body html blockquote details".split())
LEFT_OUT = frozenset((
    "script style noscript template head title nav footer aside form button select textarea input iframe svg object menu "
    "dialog fieldset").split())
COMMENT_NAMES = frozenset("comment comments commentlist discussion disqus replies".split())
LEFT_OUT_NAMES = COMMENT_NAMES | frozenset((
    "ad ads advert advertisement advertising adbox banner sponsor sponsored promo promotion sidebar aside nav navbar navigation menu "
    "breadcrumb breadcrumbs footer cookie cookies consent gdpr notice "
    "notices alert popup modal overlay share sharing social related recommended newsletter subscribe signup login search "
    "toolbar skip pagination pager contentinfo complementary dialog").split())
HEADER_NAMES = frozenset("header masthead banner topbar".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PIECE = 1 << 16
SMOOTHING = 1.0  # standard deviation of the kernel, in lines
THRESHOLD = 0.5  # of the smoothed ratios' standard deviation
LARGE = 0.5  # of the core's text: a cluster that belongs to the content wherever it stands
MOST = 0.5  # of the text around: a container that no name can drop

_NAME = re.compile(r"[a-z]+")
_TOP = ("article", "main")


class Page(HTMLParser):
    """The lines and the container tree of a page, in linear memory.

    Containers are numbered as they open, so those inside a container ``c`` are
    ``c + 1 .. last[c]``; number 0 is the whole page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.tags: list[int] = []
        self.home: list[int] = []  # innermost container of a line
        self.dropped: list[bool] = []  # left out by its element
        self.kind, self.parent, self.last, self.named = ["page"], [0], [0], [0]  # named: 0 no, 1 by its name, 2 as reader comments
        self._open: list[tuple[str, int, bool]] = []  # name, container, left out by an element
        self._count: Counter[str] = Counter()  # open elements by name
        self._parts: list[str] = []
        self._n_tags = 0

    def updatepos(self, i, j):
        """Line numbers aren't needed."""
        return j

    def _flush(self):
        text = " ".join("".join(self._parts).split())
        if text:
            self.text.append(text)
            self.tags.append(self._n_tags)
            self.home.append(self._open[-1][1] if self._open else 0)
            self.dropped.append(bool(self._open) and self._open[-1][2])
        self._parts.clear()
        self._n_tags = 0

    def _inside(self) -> bool:
        return any(self._count[n] for n in _TOP)

    def _hidden(self, tag: str, attrs) -> bool:
        if tag in LEFT_OUT or tag == "header" and not self._inside():
            return True
        return tag not in ("html", "body", "main") and any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)

    def _named(self, tag: str, attrs) -> int:
        if tag in ("html", "body", "main"):
            return 0
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names = set(_NAME.findall(value.lower()))
                if tag == "article":
                    names &= {"comment", "comments", "ad", "advert", "promo", "related"}
                if names & COMMENT_NAMES:
                    return 2
                if names & LEFT_OUT_NAMES or not self._inside() and names & HEADER_NAMES:
                    return 1
        return 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in LEFT_OUT:
            self._flush()
            if tag in BLOCKS and self._count["p"]:
                self._close("p")
            if tag == "li" and self._count["li"] and self._nearest("li", ("ul", "ol", "menu")):
                self._close("li")
        elif tag in ("br", "td", "th", "img"):
            self._parts.append(" ")
        self._n_tags += 1
        if tag in VOID or not (tag in BLOCKS or tag in CONTAINERS or tag in LEFT_OUT):
            return
        out = bool(self._open) and self._open[-1][2]
        own, named = self._hidden(tag, attrs), self._named(tag, attrs)
        if tag in _TOP and not own and self._open and not (self._open[0][0] == "form" or self._open[0][2]):
            out = out and self._inside()  # a menu that was never closed doesn't swallow the article
        number = self._open[-1][1] if self._open else 0
        if tag in CONTAINERS or named:
            self.kind.append(tag)
            self.parent.append(number)
            number = len(self.parent) - 1
            self.last.append(number)
            self.named.append(named)
        self._open.append((tag, number, out or own))
        self._count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._open and self._open[-1][0] == tag:
            self.handle_endtag(tag)

    def _nearest(self, tag: str, stop: tuple[str, ...]) -> bool:
        for name, _, _ in reversed(self._open):
            if name in stop:
                return False
            if name == tag:
                return True
        return False

    def _close(self, tag: str):
        if not self._count[tag]:
            return
        self._flush()
        while True:
            name, number, _ = self._open.pop()
            self._count[name] -= 1
            self.last[number] = len(self.parent) - 1
            if name == tag:
                return

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in LEFT_OUT:
            self._flush()
        elif tag in ("td", "th"):
            self._parts.append(" ")
        self._n_tags += 1
        self._close(tag)

    def handle_data(self, data):
        self._parts.append(data)

    def close(self):
        super().close()
        self._flush()
        for _, number, _ in self._open:
            self.last[number] = len(self.parent) - 1
        self.last[0] = len(self.parent) - 1


def page_lines(html: str) -> Page:
    """Parse a page piece by piece."""
    page = Page()
    for i in range(0, len(html), PIECE):
        page.feed(html[i:i + PIECE])
    page.close()
    return page


# ---- what is left out --------------------------------------------------------

def _weights(page: Page, size: np.ndarray) -> np.ndarray:
    """Text below each container, given the text of each line."""
    own = np.bincount(page.home, weights=size, minlength=len(page.parent)) if len(size) else np.zeros(len(page.parent))
    total = np.concatenate([[0.0], np.cumsum(own)])
    return total[np.array(page.last) + 1] - total[:-1]  # containers inside follow their container


def left_out(page: Page) -> np.ndarray:
    """Which lines are left out, by their element or by the name of a container around them."""
    out = np.array(page.dropped, bool)
    size = np.array([0 if d else len(t) for t, d in zip(page.text, page.dropped)], float)
    weight, named = _weights(page, size), np.array(page.named)
    outer = [-1] * len(named)  # the outermost article or main element around a container
    for c in range(1, len(named)):
        outer[c] = outer[page.parent[c]]
        if outer[c] < 0 and page.kind[c] in _TOP and not page.named[c]:
            outer[c] = c
    tops = np.array([c for c in range(1, len(named)) if outer[c] == c], np.int64)
    holds = np.searchsorted(tops, np.arange(len(named)), "right") < np.searchsorted(tops, np.array(page.last), "right")
    whole = weight[0] if not weight[tops].any() else 0.0
    around = np.array([weight[c] if c >= 0 else whole for c in outer])
    drops = (named > 0) & ~holds & ((named == 2) | (weight <= MOST * around) | (around == 0))
    unclosed = _below(page, (named > 0) & holds) & (np.array(outer) < 0)  # around an article: all but the article
    for names in (drops, drops & (named == 1)):  # without the comments something must be left
        hidden = (_below(page, names) | unclosed)[page.home] if len(out) else out
        if (size * ~hidden).any():
            return out | hidden
    return out


def _below(page: Page, marked: np.ndarray) -> np.ndarray:
    """Containers that are marked or stand in a marked one."""
    change = np.zeros(len(marked) + 1, np.int64)
    at = np.flatnonzero(marked)
    np.add.at(change, at, 1)
    np.add.at(change, np.array(page.last)[at] + 1, -1)
    return np.cumsum(change)[:-1] > 0


# ---- content -----------------------------------------------------------------

def smoothed(ratio: np.ndarray) -> np.ndarray:
    """Ratios smoothed with a Gaussian kernel."""
    reach = max(1, int(round(3 * SMOOTHING)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SMOOTHING) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def content_clusters(page: Page, out: np.ndarray) -> list[list[int]]:
    """Content lines in a row; the threshold never exceeds the best line's value."""
    ratio = np.array([0.0 if o else len(t) / max(1, n) for t, n, o in zip(page.text, page.tags, out)])
    smooth = smoothed(ratio)
    floor = min(THRESHOLD * float(smooth.std()), float(smooth[~out].max()))
    clusters: list[list[int]] = []
    low: list[int] = []  # containers of low lines since the last content line
    for i in np.flatnonzero(~out).tolist():
        if smooth[i] >= floor and (ratio[i] >= floor or not clusters or page.home[i] == page.home[clusters[-1][-1]]):
            before = page.home[clusters[-1][-1]] if clusters else -1
            if clusters and all(c in (before, page.home[i]) for c in low):
                clusters[-1].append(i)
            else:
                clusters.append([i])
            low = []
        else:
            low.append(page.home[i])
    return clusters


def _around(page: Page, first: int, last: int) -> int:
    """The smallest container that holds the containers ``first`` to ``last``."""
    while page.last[first] < last:
        first = page.parent[first]
    return first


def content_region(page: Page, clusters: list[list[int]]) -> int:
    """The smallest container around the content; all of the outermost article or main element around that."""
    def text(cluster: list[int]) -> int:
        return sum(len(page.text[i]) for i in cluster)

    def span(cluster: list[int]) -> tuple[int, int]:
        homes = [page.home[i] for i in cluster]
        return min(homes), max(homes)

    core = max(clusters, key=text)
    low, high = span(core)
    for c in sorted(clusters, key=text, reverse=True):
        a, b = span(c)
        joined = _around(page, min(low, a), max(high, b))
        if page.kind[joined] not in ("page", "html", "body") or text(c) >= LARGE * text(core):
            low, high = min(low, a), max(high, b)
    region = at = _around(page, low, high)
    while at:
        if page.kind[at] in _TOP:
            region = at
        at = page.parent[at]
    return region


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks, joined by line feeds; empty where there is none."""
    if not html:
        return ""
    page = page_lines(html)
    out = left_out(page)
    if out.all():
        return ""
    region = content_region(page, content_clusters(page, out))
    return "\n".join(t for t, c, o in zip(page.text, page.home, out) if not o and region <= c <= page.last[region])


def extract_main_text(html: Column) -> Column:
    """Column of main texts; null and empty pages give an empty text."""

    def extract(pages):
        return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())

    extract.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    return F.arrow_udf(extract, "string")(html)


def extract_pages(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of the whole html in ``out`` (replaced if it exists); every row is kept, no shuffle.

    Malformed pages don't fail: open elements end with the page, however many there are.
    """
    return pages.withColumn(out, extract_main_text(F.col(html_col)))
