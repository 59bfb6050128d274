"""Operator 3, main-text extraction by line-block distribution.

A page becomes a sequence of lines, one per block of the page; lines of menus, headers, footers, sidebars, notices, adverts, forms and reader comments are left out by their marks. A line's weight is its text
length; lines that are mostly links weigh nothing, and those inside an article or main element weigh ``ZONE_WEIGHT`` times as much. Weights are summed over sliding windows of ``window`` lines.
A region begins where the sums surge from nothing and ends where they dive to nothing, or at the edge of an article, whose lines are one region. A region is text, from its first weighted line to
its last, if its highest sum exceeds the threshold: ``surge`` characters, or a share of the page's highest sum where that is less, so a page of any length has a region. Beside an article, a
region has to exceed the article's own sums and three times ``surge`` as well: so a page's article wins over what surrounds it, and a teaser marked as an article doesn't displace the
story. Lines of links between weighted lines belong to their region.

Markup goes by one linear scan: comments, declarations, scripts and styles vanish, character references are decoded once
after that, white space inside a block becomes one space. Unclosed and stray tags are harmless: a skipped container ends with its own end tag or that of
a block around it, where HTML implies its end (a paragraph at the next block, a list item at the next item), with an opening article, or with the page. An article in an aside, footer or dialog, or in an element that its
attributes mark as boilerplate, is part of that.

An element is boilerplate by its attributes if it is hidden or has such a role, or if a class or id names one. A name is split at marks and at changes of case, and plurals count as
singulars. A word that always names such a part (``comment``, ``newsletter``, ``advert``) decides alone (``readerComments``), unless the name says otherwise (``no-comments``) or reads like a phrase
(``comments-on-the-theory``); other words decide if the rest of the name is neutral (``site-footer``, but not ``with-sidebar``). Headings, and inline elements inside an article, aren't skipped by such names.

Defined results: null or empty html has an empty text (n_chars 0); repeated rows each get a row; further columns are ignored; nothing is cut off, whatever the length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import with_workers

WINDOW = 3
#: How much more a line counts inside an element that marks the article.
ZONE_WEIGHT = 3
#: Elements by their part in a page.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "title", "canvas", "audio", "video", "xmp"}
SKIPPED = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "datalist", "head"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
SPACERS = {"br", "td", "th", "img", "wbr", "option", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ARTICLE = {"article", "main"}
OWN_ARTICLES = {"aside", "footer", "dialog"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BOILERPLATE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "login", "masthead", "menu",
    "alert", "copyright", "disclaimer", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promotion", "recommendation", "recommended", "signup", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget",
}
#: Those that name such a part whatever else stands in the name.
DECISIVE_WORDS = {"advert", "advertisement", "breadcrumb", "comment", "cookie", "disqus", "newsletter", "sponsored"}
#: What says that a part isn't there, or is about it.
DENYING_WORDS = {"about", "after", "and", "before", "disable", "disabled", "enable", "enabled", "for", "has", "hide", "how", "in", "is", "no", "not", "of", "on", "open", "the", "to", "what", "why", "with", "without"}
#: Words that say where or in what form a part stands, or for whom, not what it is about.
NEUTRAL_WORDS = {
    "article", "more", "news", "reader", "reading", "slot", "stories", "story", "unit", "up", "sign", "user", "visitor", "your", "zone", "area", "bar", "block", "body", "bottom", "box", "buttons", "button", "container", "content", "custom", "desktop", "floating", "form", "global", "group", "icons", "inner", "item", "items", "layer", "left", "links", "list",
    "main", "mobile", "outer", "overlay", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "sticky", "thread", "toolbar", "top", "wrap", "wrapper",
}
#: A header of these holds the title of the text.
TITLED_WORDS = {"content", "item", "main", "page", "post", "section"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
KEPT_ELEMENTS = {"html", "body", "article", "main", "h1"}
#: Elements whose ends are followed, and which open element each of them ends by its start.
STACKED = (BLOCKS | {"td", "th"}) - VOID - {"html", "body"}
SECTIONS = ["thead", "tbody", "tfoot"]
IMPLIED = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "td": ["td", "th"], "th": ["td", "th"], "tr": ["td", "th", "tr"]} | {x: ["td", "th", "tr", *SECTIONS] for x in SECTIONS}
P_ENDERS = BLOCKS | STACKED
#: An end tag doesn't reach beyond these, other than their own.
BARRIERS = {"article", "main", "table", "td", "th", "caption"}
TABLE_PARTS = {"table", "caption", "tr", "td", "th", *SECTIONS}
LISTS = {"ul", "ol", "menu"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>\"'<]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+[^>]*)>", re.S)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _one(word: str) -> str:
    """The singular of a word of a name."""
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _names_boilerplate(value: str) -> bool:
    """Whether a class or id of ``value`` names boilerplate: by a decisive word that nothing denies, or by boilerplate words and neutral ones only."""
    for token in value.split():
        words = [w.lower() for w in _WORD.findall(token)]
        known = lambda w, names: w in names or _one(w) in names
        found = [w for w in words if known(w, BOILERPLATE_WORDS)]
        if not found or not DENYING_WORDS.isdisjoint(words):
            continue
        titled = set(found) == {"header"} and not TITLED_WORDS.isdisjoint(words)
        if any(known(w, DECISIVE_WORDS) for w in found) or not titled and all(known(w, BOILERPLATE_WORDS) or known(w, NEUTRAL_WORDS) for w in words):
            return True
    return False


def _boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    if name in KEPT_ELEMENTS or not attributes:
        return False
    named = name not in HEADINGS and (name in STACKED or not in_article)
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if named and key in ("class", "id") and _names_boilerplate(value):
            return True
        value = value.lower()
        if key == "role" and value in BOILERPLATE_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


class _Open:
    """The open block elements of a page, each followed to its end or its implied end; places by name keep every step short."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}

    def last(self, names: Iterable[str]) -> int:
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=-1)

    def pop(self) -> None:
        self.places[self.names.pop()].pop()

    def start(self, name: str) -> int:
        """Returns how many elements stay open around the new one."""
        if self.names and (self.names[-1] == "p" and name in P_ENDERS or self.names[-1] == "head"):
            self.pop()
        while self.names and self.names[-1] in IMPLIED.get(name, ()):
            self.pop()
        around = len(self.names)
        if name in STACKED:
            self.places.setdefault(name, []).append(around)
            self.names.append(name)
        return around

    def end(self, name: str) -> None:
        at = self.last([name])
        if at < 0 or name not in ARTICLE and at < self.last(ARTICLE if name in TABLE_PARTS else BARRIERS) or name == "li" and at < self.last(LISTS):
            return
        while len(self.names) > at:
            self.pop()


class _Lines:
    """The lines of a page with their weights, gathered in page order."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.zone: list[int] = []
        self.pieces: list[str] = []
        self.links = 0

    def end(self, zone: int) -> None:
        """``zone``: the number of the article that the line stands in, from 1; 0 outside of articles."""
        if self.pieces:
            text = " ".join(unescape("".join(self.pieces)).split())
            if text:
                self.texts.append(text)
                self.linked.append(self.links)
                self.zone.append(zone)
            self.pieces = []
        self.links = 0


def page_lines(html: str) -> _Lines:
    lines = _Lines()
    at, n = 0, len(html)
    opened = _Open()
    skip, skip_depth, skip_at, held = "", 0, 0, False  # what is skipped, how often the name of an inline one is open, how many blocks are around it, whether articles belong to it
    in_article, zone, in_link, heading = 0, 0, False, False
    while at < n:
        m = _TOKEN.search(html, at)
        text_end = m.start() if m else n
        if text_end > at and (not skip or skip == "header" and in_article and heading):
            piece = html[at:text_end]
            lines.pieces.append(piece)
            if in_link:
                lines.links += len(piece)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name, closing, attributes = name.lower(), m[1] == "/", m[3]
        if name in RAW and not closing and not attributes.endswith("/"):
            end = _ENDS[name].search(html, at)
            at = end.end() if end else n
            continue
        if name in BLOCKS:
            lines.end(zone if in_article else 0)
        elif name in SPACERS and lines.pieces:
            lines.pieces.append(" ")
        if name in HEADINGS:
            heading = not closing
        inline, empty = name not in STACKED, name in VOID or attributes.endswith("/")
        if closing:
            opened.end(name)
        around = opened.start(name) if not closing and (not empty or name == "hr") else len(opened.names)
        within, in_article = in_article, sum(len(opened.places.get(x, ())) for x in ARTICLE)
        zone += in_article > 0 and not within
        if skip and inline and name == skip:
            skip_depth += -1 if closing else 1
        if skip and (around < skip_at or skip_depth <= 0):
            skip = ""
        if name in ARTICLE and not closing and not held:
            skip = ""
        if not skip:
            held = not closing and not empty and (name in OWN_ARTICLES or _boilerplate(name, attributes, in_article > 0))
            if held or not closing and not empty and name in SKIPPED:
                skip, skip_depth, skip_at = name, 1, len(opened.names)
        if name == "a":
            in_link = not closing
    lines.end(zone if in_article else 0)
    return lines


def regions(lines: _Lines, window: int) -> list[tuple[int, int, bool, int]]:
    """(first line, end, whether in an article, highest sum) of each region of a page."""
    zone, length = np.array(lines.zone), np.array([len(x) for x in lines.texts])
    linked = np.minimum(np.array(lines.linked), length)
    weight = np.where(zone > 0, ZONE_WEIGHT * length, np.where(2 * linked > length, 0, length))
    found = []
    edges = np.flatnonzero(np.diff(zone)) + 1
    for start, stop in zip([0, *edges], [*edges, len(zone)], strict=True):
        sums = np.convolve(weight[start:stop], np.ones(window, dtype=np.int64))[window - 1 :]  # of each line and those after it
        held = np.flatnonzero(weight[start:stop])
        # sums dive to nothing where a window holds no weighted line
        cuts = [] if zone[start] else np.flatnonzero(np.diff(held) > window) + 1
        for part in np.split(held, cuts):
            if len(part):
                found.append((start + part[0], start + part[-1] + 1, zone[start] > 0, int(sums[part[0] : part[-1] + 1].max())))
    return found


def main_text(html: str | None, window: int = WINDOW, share: float = 0.15, surge: int = 100) -> str:
    """The main text of a page: its lines between surges and dives."""
    if not html:
        return ""
    lines = page_lines(html)
    if not lines.texts:
        return ""
    found = regions(lines, window)
    highest = max((peak for *_, peak in found), default=0)
    marked = max((peak for *_, inside, peak in found if inside), default=0)
    threshold = min(surge, share * highest)
    beside = max(threshold, marked, 3 * surge) if marked else threshold
    return "\n".join(x for first, end, inside, peak in found if peak > (threshold if inside else beside) for x in lines.texts[first:end])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = batch.slice(i, 500)
                texts = [main_text(x) for x in rows.column(rows.schema.get_field_index("html")).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("page_id")), rows.column(rows.schema.get_field_index("url")), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    with_workers(pages.sparkSession)
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
