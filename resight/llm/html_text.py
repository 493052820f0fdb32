"""Main text of web pages: parser events, text-to-tag ratios by line, Gaussian smoothing, threshold clustering.

The standard library's parser sends a page's events one by one: tags open and close elements, by HTML's rules for those
that nobody closes, and text goes to the current line. A line is a block: what stands between two block-level tags. Its
ratio is its characters outside links to the tags since the line before; a line in what says of itself that it is a menu,
a header, a footer, a sidebar, a notice, an advert, a form or readers' comments has a ratio of nil. The ratios are smoothed
by a Gaussian, and lines that reach a share of their mean are content; neighbours among them are a cluster. Clusters select
regions: the articles that hold most of their characters, or the page's main element, or, where a page has neither, the
smallest element that still holds most of them, with the headings before it. A region's lines are the text, short ones
too, save those of menus and the like within it: an article's last line of one word is as much of it as any other.

A page is one row, read by a stream of events in the task that holds it: no shuffle.

Defined results: a null or empty page and one without content give an empty text and no characters; markup that is cut
off, nested wrongly or never closed is read as browsers do, more or less; character references that stand for nothing
stay as they are; repeated rows give repeated rows; very long pages are read whole; a null id or url stays null; an empty
table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm.common import map_text, table

#: Lines within which the Gaussian falls to 0.6, and beyond which it is cut off, in such widths.
SIGMA, REACH = 1.5, 3
#: Share of the mean smoothed ratio from which a line is content.
THRESHOLD = 0.5
#: Share of the content's characters that articles must hold to be the region, and that an element must hold to be looked into.
ARTICLE_SHARE, INNER_SHARE = 0.3, 0.75

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text no one reads.
SILENT = frozenset("head script style template noscript svg math object iframe canvas audio video select datalist title textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
#: Elements that are no part of an article, and roles that say the same.
ASIDE = frozenset("nav aside footer form menu dialog button search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist form".split())
#: Words of a class or an id that say the same: fixed values.
WORDS = frozenset(
    "ad ads adsense adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments commentlist disqus replies respond share sharing social related recommended recommendations trending widget".split()
)
#: A class that begins so tells of something else on the page.
ABOUT = ("has-", "no-", "with-", "without-", "is-", "not-", "js-")
#: Which open elements a tag ends, unless one of the second set lies between.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
#: What an end tag of another name, or a paragraph's end, doesn't reach past.
SCOPES = frozenset("html body article section aside main nav header footer div table td th button object blockquote form template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PART, _CUT = re.compile(r"[A-Za-z]+"), re.compile(r"<(?:[A-Za-z!?]|/[A-Za-z])")


@dataclass(slots=True)
class Element:
    """An open or closed element: its tag, the number of its parent, and whether it is no content by its own words."""

    tag: str
    parent: int
    named_aside: bool = False  # by its tag or role
    hinted_aside: bool = False  # by its class or id
    comment: bool = False


@dataclass(slots=True)
class Line:
    element: int
    text: str
    linked: int  # characters in links
    tags: int


@dataclass
class Page(HTMLParser):
    """Lines and elements of a page, from the parser's events."""

    elements: list[Element] = field(default_factory=lambda: [Element("", -1)])
    lines: list[Line] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self._open, self._silent, self._links = [0], 0, 0
        self._parts: list[str] = []
        self._linked = self._tags = 0
        self._at = 0

    def end_line(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.lines.append(Line(self._at, text, self._linked, self._tags))
                self._tags = 0
            self._parts, self._linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag == "br":
            if self._parts:
                self._parts.append(" ")
            return
        if tag in BLOCKS:
            self.end_line()
            self._imply(tag)
        if tag in VOID:
            return
        self.elements.append(_element(tag, attrs, self._open[-1]))
        self._open.append(len(self.elements) - 1)
        self._silent += tag in SILENT
        self._links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "path"):  # a slash ends foreign elements only
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self.end_line()
        elements, open_ = self.elements, self._open
        for i in range(len(open_) - 1, 0, -1):
            name = elements[open_[i]].tag
            if name == tag or tag in HEADINGS and name in HEADINGS:
                self._close(i)
                return
            if name in SCOPES and tag not in SCOPES:
                return  # closes nothing that is open here

    def handle_data(self, data: str) -> None:
        if self._silent:
            return
        if not self._parts:
            if data.isspace():
                return
            at = self._open[-1]
            while self.elements[at].tag not in BLOCKS and at:
                at = self.elements[at].parent
            self._at = at
        self._parts.append(data)
        if self._links:
            self._linked += len(data)

    def close(self) -> None:
        if _CUT.match(self.rawdata):  # a comment or a tag that the page's end cuts off
            self.rawdata = ""
        super().close()

    def _imply(self, tag: str) -> None:
        """Close what a tag of this name ends: a paragraph, or an item before it."""
        elements, open_ = self.elements, self._open
        ends, walls = ENDS.get(tag, (frozenset(), frozenset()))
        last = None
        for i in range(len(open_) - 1, 0, -1):
            name = elements[open_[i]].tag
            if name in walls or name == "template":
                break
            if name == "p" or name in ends or name == "head":
                last = i
            elif name in SCOPES and not ends:
                break
        if last is not None:
            self._close(last)

    def _close(self, i: int) -> None:
        for at in self._open[i:]:
            tag = self.elements[at].tag
            self._silent -= tag in SILENT
            self._links -= tag == "a"
        del self._open[i:]


def _element(tag: str, attrs: list[tuple[str, str | None]], parent: int) -> Element:
    out = Element(tag, parent, tag in ASIDE)
    for name, value in attrs:
        value = value or ""
        if name in ("class", "id") and tag not in ("html", "body"):
            for token in value.lower().split():
                parts = () if token.startswith(ABOUT) else _PART.findall(token)
                if not WORDS.isdisjoint(parts):
                    out.hinted_aside = True
                    out.comment |= not {"comment", "comments", "commentlist", "replies"}.isdisjoint(parts)
        elif name == "role":
            out.named_aside |= value.lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            out.named_aside = True
        elif name == "style":
            plain = value.lower().replace(" ", "")
            out.named_aside |= "display:none" in plain or "visibility:hidden" in plain
    return out


def read(html: str) -> Page:
    page = Page()
    page.feed(html)
    page.close()
    page.end_line()
    return page


def asides(elements: list[Element]) -> list[bool]:
    """Whether each element, or what it lies in, is no content. A class says so only of what holds no article or main
    element, unless that is a reader's; a header is the page's where it lies in neither."""
    holds = [False] * len(elements)
    for e in reversed(elements):
        if e.tag in ("article", "main") and not e.comment and e.parent >= 0:
            at = e.parent
            while at >= 0 and not holds[at]:
                holds[at] = True
                at = elements[at].parent
    out, within = [False] * len(elements), [False] * len(elements)
    for i, e in enumerate(elements):
        if e.parent < 0:
            continue
        own = e.tag in ("article", "main")
        within[i] = within[e.parent] or own
        hinted = e.hinted_aside and (e.comment or not (own or holds[i]))
        banner = e.tag == "header" and not within[i] and not holds[i]
        out[i] = out[e.parent] or e.named_aside and not holds[i] or hinted or banner
    return out


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """The ratios under a Gaussian, whose weights within the page sum to one."""
    half = int(SIGMA * REACH)
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / SIGMA) ** 2)
    full = lambda x: np.convolve(x, kernel)[half : half + len(ratios)]
    return full(ratios) / full(np.ones(len(ratios)))


def content(ratios: np.ndarray) -> np.ndarray:
    """Which lines are content: those with a ratio whose smoothed one reaches the threshold."""
    if not (ratios > 0).any():
        return np.zeros(len(ratios), bool)
    smooth = smoothed(ratios)
    return (ratios > 0) & (smooth >= THRESHOLD * smooth[ratios > 0].mean())


def main_lines(page: Page) -> list[str]:
    """The lines of the regions that the content's clusters select."""
    elements, lines = page.elements, page.lines
    aside = asides(elements)
    ratios = np.array([0.0 if aside[x.element] else max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    chosen = content(ratios)
    if not chosen.any():
        return []
    mass = np.zeros(len(elements))
    for x, c in zip(lines, chosen, strict=True):
        at = x.element if c else -1
        while at >= 0:
            mass[at] += len(x.text)
            at = elements[at].parent
    inside = _inside(elements, _regions(elements, aside, mass))
    picked = [inside[x.element] and not aside[x.element] for x in lines]
    first = picked.index(True)
    while first and not aside[lines[first - 1].element] and elements[lines[first - 1].element].tag in HEADINGS:
        first -= 1
        picked[first] = True
    return [x.text for x, p in zip(lines, picked, strict=True) if p]


def _regions(elements: list[Element], aside: list[bool], mass: np.ndarray) -> set[int]:
    """Numbers of the elements that are the main text."""
    for tag in ("article", "main"):
        found = {i for i, e in enumerate(elements) if e.tag == tag and not aside[i] and mass[i]}
        if found and sum(mass[i] for i in _outermost(elements, found)) >= ARTICLE_SHARE * mass[0]:
            return found
    at = 0
    while True:
        inner = [i for i in range(at + 1, len(elements)) if elements[i].parent == at and elements[i].tag in SCOPES | {"tr", "tbody", "center"} and mass[i] >= INNER_SHARE * mass[at]]
        if not inner:
            return {at}
        at = inner[0]


def _outermost(elements: list[Element], found: set[int]) -> list[int]:
    out = []
    for i in sorted(found):
        at = elements[i].parent
        while at >= 0 and at not in found:
            at = elements[at].parent
        if at < 0:
            out.append(i)
    return out


def _inside(elements: list[Element], regions: set[int]) -> list[bool]:
    out = [False] * len(elements)
    for i, e in enumerate(elements):
        out[i] = i in regions or e.parent >= 0 and out[e.parent]
    return out


def main_text(html: str) -> str:
    return "\n\n".join(main_lines(read(html))) if html else ""


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points): a row for each row of pages."""

    def kernel(rows: list[bytes]) -> dict[str, object]:
        texts = [main_text(r.decode("utf-8", "replace")) for r in rows]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return map_text(pages, html, {"page_id": F.col(page_id), "url": F.col(url)}, kernel, "text string, n_chars long")


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
