"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser sends events; text gathers into lines, one for
each block element. Lines inside menus, headers, footers, sidebars, notices,
adverts, forms, comments and the like are marked by their elements: by tag,
role or state, or by a class or id: a whole one, unless that element holds nine
tenths of the content clusters' text, or one whose parts all name such things
or places (comment-list, post-comments, nav-links), unless it holds half of it.
An element inside a line whose class, or tag, marks it only takes the line with
it if nothing else is in the line, unless it is an advert. Of the others the text-to-tag ratio is
smoothed by a Gaussian, and lines at or above the ratios' standard deviation
form the content clusters. The clusters vote for the element that holds the
article: all articles, but for those outside of the clusters that are mostly
links, or a main element, where there is one, else the container with their text. All lines of it that aren't
marked are the result, those of links too.

Defined cases: null or empty html gives an empty text; repeated rows and null
keys are rows like any other; an empty table gives an empty result; further
columns are ignored. Markup may be broken: end tags close what is open inside
them, unknown ones are ignored, and odd declarations are comments.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Names of elements, roles and class words, from the HTML and ARIA standards and common usage.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HIDDEN = frozenset(
    "applet aside audio canvas datalist dialog embed fieldset footer form frame frameset head iframe input legend map menu "
    "meter nav noframes noscript object optgroup option output progress script search select style svg template textarea title video".split()
)
#: Outside of forms these are words of their line, but a line of nothing else goes.
CONTROLS = frozenset("button label".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split())
WORDS = frozenset(
    "ad ads adsbygoogle adsense adv advert advertisement advertising adverts banner breadcrumb breadcrumbs captcha comment comments commentlist consent "
    "cookie cookies discussion disqus feedback footer footnav gdpr login menu menus modal nav navbar navigation "
    "newsletter notice notices notification notifications outbrain overlay pager paginate pagination paywall popup promo promos promotion "
    "recommended register related replies reply respond responses search share sharing sidebar sidebars signup skip social sponsor sponsored "
    "sponsors subscribe subscription taboola toolbar topbar widget widgets".split()
)
#: Inside a line, too, these are no words of it.
ADVERTS = frozenset(w for w in WORDS if w.startswith(("ad", "promo", "sponsor")))
#: Parts that may stand beside such a word in a class or id: places, and the things that a page is made of.
PLACES = frozenset(
    "area article bar block body bottom box btn button buttons card cards col column container content cta desktop entry feed form global group holder icon icons inline inner "
    "item items left link links list main mobile module page panel post posts region right section site slot story stories thread title top unit wrap wrapper zone".split()
)
HEADERS = frozenset("header masthead".split())
#: A class with such a word names the page's header; other words beside it name the header of a part, as of a post.
PAGE_WORDS = HEADERS | frozenset("bar container fixed global inner main page site sticky top wrapper".split())
#: Elements that a start tag closes when they are open in the same container.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tbody", "thead", "tfoot"}, "tbody": {"tbody", "thead", "tfoot"}, "tfoot": {"tbody", "thead", "tfoot"}, "body": {"head"},
}
SCOPES = frozenset("ul ol dl table td th article section div main body html select".split())
#: These never hide their content by class: they hold the page or the article.
HOLDERS = frozenset("html body main".split())

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Element:
    tag: str
    parent: Element | None
    hidden: bool
    article: Element | None
    main: Element | None
    header: bool
    #: Elements around it, or itself, with a class or id that marks them.
    marks: tuple[Element, ...] = ()
    #: The tenths of the clusters' text with which it isn't marked after all.
    enough: int = 9
    #: Whether it is, or is in, an element of a line that is marked.
    aside: bool = False
    votes: float = 0.0
    depth: int = 0
    inside: bool = False

    @property
    def container(self) -> bool:
        return self.tag not in ("p", "li", "") and self.tag in BLOCKS and self.tag not in HEADINGS


@dataclass
class Line:
    """The text of one block: its pieces, the tags in it, and characters inside links."""

    element: Element
    pieces: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    heading: bool = False
    #: Whether there is text outside of marked elements of the line, and inside of them.
    plain: bool = False
    aside: bool = False


def _marked(attrs: dict, words: frozenset[str] = WORDS) -> bool:
    """Whether a whole class, or the id, is one of the words."""
    return not words.isdisjoint(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split())


def _parts_mark(attrs: dict) -> bool:
    """Whether all parts of a class, or of the id, are among the words and places, and one is a word."""
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = {w.lower() for w in _WORD.findall(name) if len(w) > 1}
        if not WORDS.isdisjoint(parts) and parts <= WORDS | PLACES:
            return True
    return False


def _named(attrs: dict) -> set[str]:
    names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
    return {w.lower() for w in _WORD.findall(names)}


class LineParser(HTMLParser):
    """Collects the lines of a page from the parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        root = Element("", None, False, None, None, False)
        self.stack, self.lines, self.links = [root], [Line(root)], 0
        self.elements, self.open = [root], Counter()

    def parse_html_declaration(self, i):
        # A marked section that isn't CDATA is a comment up to its >, and never an error.
        if self.rawdata.startswith("<![", i) and not self.rawdata.startswith("<![CDATA[", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def parse_marked_section(self, i, report=1):
        end = self.rawdata.find("]]>", i)
        return end + 3 if end >= 0 else self.parse_bogus_comment(i)

    def unknown_decl(self, data):
        pass

    def _line(self) -> None:
        self.lines.append(Line(self.stack[-1], heading=self.stack[-1].tag in HEADINGS))

    def _close_to(self, at: int) -> None:
        for e in self.stack[at:]:
            self.links -= e.tag == "a"
            self.open[e.tag] -= 1
        block = any(e.tag in BLOCKS for e in self.stack[at:])
        del self.stack[at:]
        if block:
            self._line()

    def _close_open(self, tags: set) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self._close_to(i)
                return
            if self.stack[i].tag in SCOPES:
                return

    def handle_starttag(self, tag, attrs):
        self.lines[-1].tags += 1
        if tag in VOID:
            if tag == "hr":
                self._line()
            elif tag == "br":
                self.lines[-1].pieces.append(" ")
            return
        if tag in CLOSES:
            self._close_open(CLOSES[tag])
        if tag in BLOCKS and self.open["p"]:
            self._close_open({"p"})
        up, given = self.stack[-1], dict(attrs)
        hidden = up.hidden or tag in HIDDEN or "hidden" in given or given.get("aria-hidden") == "true" or (given.get("role") or "").lower() in ROLES
        names = _named(given) if tag not in HOLDERS and ("class" in given or "id" in given) else set()
        hidden = hidden or "display:none" in (given.get("style") or "").replace(" ", "")
        holder = tag == "main" or given.get("role") == "main"
        e = Element(tag, up, hidden, up.article, up.main, up.header or tag == "header" or (names <= PAGE_WORDS and not HEADERS.isdisjoint(names)), up.marks)
        e.aside = up.aside and tag not in BLOCKS
        if tag not in HOLDERS and tag not in HEADINGS:
            whole = _marked(given)
            if whole or tag in CONTROLS or (names and _parts_mark(given)):
                if tag in BLOCKS:
                    e.marks, e.enough = (*up.marks, e), 9 if whole else 5
                elif _marked(given, ADVERTS):
                    e.hidden = True
                else:
                    e.aside = True
        e.depth = up.depth + e.container
        if tag == "article" and not hidden and up.article is None:
            e.article = e
        if holder and not hidden and up.main is None:
            e.main = e
        self.stack.append(e)
        self.elements.append(e)
        self.open[tag] += 1
        self.links += tag == "a"
        if tag in BLOCKS:
            self._line()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.lines[-1].tags += 1
        if tag == "br":
            self.lines[-1].pieces.append(" ")
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._close_to(i)
                return
            if tag not in BLOCKS and self.stack[i].tag in BLOCKS:
                return  # an inline end tag doesn't close blocks

    def handle_data(self, data):
        line = self.lines[-1]
        if self.stack[-1].hidden and not line.element.hidden:
            return  # a hidden element inside a line doesn't break it
        line.pieces.append(data)
        if not data.isspace():
            if self.stack[-1].aside:
                line.aside = True
            else:
                line.plain = True
        if self.links > 0:
            line.linked += len(data)


def smoothed(ratios: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """Ratios after a Gaussian of 2 * radius + 1 lines; the ends repeat."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


def _clusters(lines: list[tuple[str, Line]]) -> np.ndarray:
    """Whether each line is in a content cluster."""
    ratios = np.array([len(t) / max(1, line.tags) for t, line in lines])
    smooth = smoothed(ratios)
    return smooth >= min(float(ratios.std()), float(smooth.max()))


def _unmarked(lines: list[tuple[str, Line]]) -> list[tuple[str, Line]]:
    """Lines outside marked elements, those aside that hold nine tenths of the clusters' text."""
    if not any(line.element.marks for _, line in lines):
        return lines
    held, total = {}, 0
    for (text, line), good in zip(lines, _clusters(lines)):
        if good and 2 * line.linked <= len(text):
            total += len(text)
            for e in line.element.marks:
                held[id(e)] = held.get(id(e), 0) + len(text)
    return [(t, line) for t, line in lines if all(total and 10 * held.get(id(e), 0) >= e.enough * total for e in line.element.marks)]


def main_text(html: str) -> str:
    """The lines of a page's article, joined by newlines."""
    parser = LineParser()
    parser.feed(html)
    parser.close()
    lines = []
    for line in parser.lines:
        text = " ".join("".join(line.pieces).split())
        e = line.element
        # Of a header only an article's own headings belong to the text.
        if text and not e.hidden and (line.plain or not line.aside) and not (e.header and not (line.heading and e.article is not None)):
            lines.append((text, line))
    if lines:
        lines = _unmarked(lines)
    if not lines:
        return ""
    for (text, line), good in zip(lines, _clusters(lines)):
        if good and 2 * line.linked <= len(text):
            line.element.votes += len(text)
    for e in reversed(parser.elements[1:]):
        e.parent.votes += e.votes
    articles = {id(line.element.article): line.element.article for _, line in lines if line.element.article is not None}
    best = max((a.votes for a in articles.values()), default=0)
    if articles:
        own, linked = Counter(), Counter()
        for text, line in lines:
            own[id(line.element.article)] += len(text)
            linked[id(line.element.article)] += line.linked
        # A teaser is an article outside of the clusters that is mostly links.
        chosen = {i for i, a in articles.items() if a.votes > 0 or not best or 2 * linked[i] <= own[i]}
        return "\n".join(t for t, line in lines if id(line.element.article) in chosen)
    mains = [line for _, line in lines if line.element.main is not None]
    if mains:
        return "\n".join(t for t, line in lines if line.element.main is not None)
    containers = [e for e in parser.elements if e.container]
    total = max((c.votes for c in containers), default=0)
    if not total:
        return "\n".join(t for t, _ in lines)
    holder = max((c for c in containers if 10 * c.votes >= 9 * total), key=lambda c: c.depth)
    for e in parser.elements[1:]:
        e.inside = e is holder or e.parent.inside
    inside = [line.element.inside for _, line in lines]
    # The title may stand in a part of its own before the text's container.
    first = inside.index(True)
    titles = [i for i, (_, line) in enumerate(lines[:first]) if line.element.tag == "h1"]
    if titles and not any(line.element.tag == "h1" for (_, line), good in zip(lines, inside) if good):
        inside[titles[-1]] = True
    return "\n".join(t for (t, _), good in zip(lines, inside) if good)


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """A row for each page: page_id, url, text, n_chars."""

    def of(batches):
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    chosen = pages.selectExpr(f"cast(`{key}` as long) page_id", f"cast(`{url}` as string) url", f"cast(`{html}` as string) html")
    return chosen.mapInArrow(of, "page_id long, url string, text string, n_chars long")
