"""Main text of web pages: parser events to lines, text-to-tag ratios, smoothing, clustering.

The standard library's parser streams a page's events. Every block element ends a line; a line
knows its text, how many tags it took, how much of it is link text and where in the page it is.
What is inside menus, headers, footers, sidebars, notices, adverts, forms, buttons and comments is
dropped by the names of its containers, inside a paragraph too. The text-to-tag ratios of the other
lines are smoothed by a Gaussian; the two clusters of the smoothed values give the threshold, and
lines above it are the content. What a page calls its article is an input of that: its lines share
one ratio, the mean of theirs and the more the larger their share of the text is, so the clusters
take or leave it as a whole. A short teaser in an article beside a main text without a name is left.

Defined cases: null, empty and text-free pages give an empty text; unclosed and misnested tags
are closed as browsers do, roughly; an unclosed comment or script runs to the end of the page, any
other element without text of its own (svg, object, title, head) hides its content only if it has
its end tag; a menu or the like without an end, in which an article begins, hides nothing;
elements hidden by attributes give no text; character references are decoded, white space inside a block
becomes one space, blocks are joined by one space in page order; whole pages are read; repeated
rows are extracted each; other columns are carried along.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import prepare

SIGMA = 1.0
# Added to the ratio of the article, in logarithms, times the cube of its share of the text: an
# article with most of the text outweighs any other line, one with little of it weighs nothing.
ARTICLE_WEIGHT = 20.0
MIN_SPREAD = 0.7  # between the cluster centres, in logarithms; nearer ones are one cluster
MAX_LINKS = 0.5  # share of link text beyond which a line is a menu

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
) - {"br"}  # a line break is white space inside its block
HIDDEN = frozenset("script style noscript template head title iframe object svg math canvas audio video".split())
ASIDE = frozenset("nav footer aside form button select textarea input label fieldset menu dialog".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split()
)
# Whole class and id names that mark what is not the article: `sidebar`, `related-posts`, `site-footer`,
# but not `no-sidebar`, `category-legal` or `tag-social-media`, which say something of the content.
_PLACE = (
    "site|page|main|top|bottom|left|right|primary|secondary|global|mobile|desktop|sticky|google|post|entry|article|blog|"
    "wp|js|block"
)
_NAME = (
    r"ads?|advert[a-z]*|banners?|sponsor[a-z]*|promo[a-z]*|side|sidebars?|nav|navs|navbar|navigation|menus?|menubar|"
    r"breadcrumbs?|footers?|masthead|topbar|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|"
    r"newsletter|subscri[a-z]*|signup|login|share|sharing|social|related|recommend[a-z]*|comments?|commentlist|replies|"
    r"reply|discussion|disqus|respond|widgets?|toolbar|pager|pagination|search|searchform|skip|copyright|legal|disclaimer"
)
_PART = (
    "areas?|lists?|sections?|box|boxes|wrap|wrapper|container|inner|outer|holder|body|panel|posts?|articles?|stories|"
    "links?|items?|bars?|slots?|units?|forms?|thread|content|text|title|buttons?|icons?|media|trail|block|column|col|"
    "row|group|left|right|top|bottom|primary|secondary|main|header|[a-z]*[0-9][a-z0-9]*"
)
ASIDE_NAMES = re.compile(
    rf"(?:^|\s)(?:(?:(?:{_PLACE})[-_]+)*(?:{_NAME})(?:[-_]+(?:{_NAME}|{_PART}))*|(?:(?:site|global|top)[-_]+)?header)(?=$|\s)",
    re.IGNORECASE,
)
ARTICLE_NAMES = re.compile(
    r"(?:^|\s)(?:(?:article|post|entry|story|main|page)[-_]?(?:body|content|text)|articlebody|content|article|post|entry|story)(?:$|\s)",
    re.IGNORECASE,
)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
# Which open elements a start tag closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
ENDS_P = BLOCK - {"body", "html", "head", "title", "li", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "dt", "dd"}
CLOSED_BY = {tag: frozenset(CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())) for tag in BLOCK | set(CLOSES)}
# Tags without attributes, which need none of the parser's patterns, and elements that it reads otherwise.
PLAIN_START = re.compile("<([a-zA-Z][a-zA-Z0-9]*)>")
PLAIN_END = re.compile("</([a-zA-Z][a-zA-Z0-9]*)>")
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
# Elements that an end tag of something outside does not reach across.
WALLS = frozenset("table td th article main aside nav footer header form body".split())


@dataclass(slots=True)
class Line:
    text: str  # all that is visible
    own: str  # without what stands aside: buttons, adverts and the like inside a paragraph
    tags: int
    link_chars: int  # of all that is visible
    own_links: int
    aside: bool
    article: bool
    heading: bool

    @property
    def ratio(self) -> float:
        return len(self.own) / (1 + self.tags)

    @property
    def links(self) -> float:
        return self.own_links / max(1, len(self.own))


@dataclass(slots=True)
class Element:
    tag: str
    hidden: bool
    article: bool
    heading: bool
    cover: Element | None = None  # the innermost element whose name hides its content
    side: Element | None = None  # the innermost element that puts its content aside
    outer_cover: Element | None = None  # of a cover: the next cover outside
    outer_side: Element | None = None
    closed: bool = False  # by its own end tag
    ended: bool = False  # by its own end tag, or with an element around it
    holds_article: bool = False  # an article began inside
    covers: bool = False  # known at the end: it, or a cover outside, hides its content
    sides: bool = False  # known at the end: it, or one outside, puts its content aside


def _marks(given: dict[str, str | None], tag: str) -> tuple[bool, bool, bool]:
    """Whether an element's attributes hide it, put it aside or make it the article."""
    names = f"{given.get('class') or ''} {given.get('id') or ''}"
    roles = (given.get("role") or "").lower().split()
    hidden = (
        "hidden" in given
        or (given.get("aria-hidden") or "").lower() == "true"
        or INVISIBLE.search(given.get("style") or "") is not None
    )
    named = len(names) > 1
    article = (
        tag in ARTICLE
        or "main" in roles
        or "article" in roles
        or (given.get("itemprop") or "").lower() == "articlebody"
        or (named and tag in BLOCK and ARTICLE_NAMES.search(names) is not None)
    )
    # what else a container of the article is named says nothing against it
    aside = any(r in ASIDE_ROLES for r in roles) or (named and not article and ASIDE_NAMES.search(names) is not None)
    return hidden, aside, article


class LineReader(HTMLParser):
    """Collects the lines of a page from the parser's events, in time linear in the page.

    Which open element an end tag closes, and what keeps it from that, is looked up among the
    places of open elements by name, of open blocks and of open walls, never by walking.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[list[tuple[str, Element, bool]], int]] = []
        self.open: list[Element] = [Element("", False, False, False)]
        self.pieces: list[tuple[str, Element, bool]] = []  # text, where, whether in a link
        self.tags = self.links = 0
        self.looked = self.last_end = -1
        self.places: dict[str, list[int]] = {}  # of the open elements of each name
        self.blocks: list[int] = []
        self.walls: list[int] = []
        self.stops: list[int] = []  # of walls and of blocks but paragraphs
        self.covers: list[Element] = []
        self.sides: list[Element] = []

    def updatepos(self, i: int, j: int) -> int:
        """Line and column numbers are not needed."""
        return j

    def parse_comment(self, i: int, report: int = 1) -> int:
        """The page is fed at once, so a comment without an end has none."""
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 else end

    def _endless(self, i: int) -> bool:
        """Whether no tag can end from here on. Looked up once, as the rest of a page can be all openings."""
        if self.looked != len(self.rawdata):
            self.looked, self.last_end = len(self.rawdata), self.rawdata.rfind(">")
        return self.last_end < i

    def parse_starttag(self, i: int) -> int:
        plain = PLAIN_START.match(self.rawdata, i)
        if plain and (tag := plain[1].lower()) not in RAW_TEXT:
            self.lasttag = tag
            self.handle_starttag(tag, ())
            return plain.end()
        return -1 if self._endless(i) else super().parse_starttag(i)

    def parse_endtag(self, i: int) -> int:
        plain = PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def parse_html_declaration(self, i: int) -> int:
        """A marked section is no section in a page: it is skipped like a comment, to the next end."""
        if self._endless(i) and not self.rawdata.startswith("<!--", i):
            return -1
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def _flush(self) -> None:
        if self.pieces:
            self.found.append((self.pieces, self.tags))
        self.pieces, self.tags = [], 0

    def lines(self) -> list[Line]:
        """The lines of visible text; only at the end is known which elements were closed.

        Elements that put content aside do so unless they were never ended and an article began in
        them: then it is their end tag that is missing.
        """
        self._flush()
        for e in self.covers:  # outer ones first
            e.covers = e.closed or (e.outer_cover is not None and e.outer_cover.covers)
        for e in self.sides:
            own = e.ended or not e.holds_article
            e.sides = own or (e.outer_side is not None and e.outer_side.sides)
        out = []
        for pieces, tags in self.found:
            seen = [p for p in pieces if p[1].cover is None or not p[1].cover.covers]
            text = " ".join("".join([p[0] for p in seen]).split())
            if not text:
                continue
            kept = [p for p in seen if p[1].side is None or not p[1].side.sides]
            links = own_links = _link_chars(seen)
            own = text
            if len(kept) < len(seen):
                own, own_links = " ".join("".join([p[0] for p in kept]).split()), _link_chars(kept)
            article = any(p[1].article for p in kept)
            heading = any(p[1].heading for p in kept)
            out.append(Line(text, own, tags, links, own_links, not own, article and bool(own), heading))
        return out

    def _push(self, e: Element) -> None:
        at = len(self.open)
        self.open.append(e)
        self.places.setdefault(e.tag, []).append(at)
        wall = e.tag in WALLS
        if e.tag in BLOCK:
            self.blocks.append(at)
        if wall:
            self.walls.append(at)
        if wall or (e.tag in BLOCK and e.tag != "p"):
            self.stops.append(at)

    def _pop(self, upto: int, ended: bool) -> None:
        for e in self.open[upto:]:
            self.links -= e.tag == "a"
            self.places[e.tag].pop()
            e.ended = ended
        del self.open[upto:]
        for places in (self.blocks, self.walls, self.stops):
            while places and places[-1] >= upto:
                places.pop()

    def _last(self, tag: str) -> int:
        """Where the innermost open element of a name is; -1: nowhere."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def handle_starttag(self, tag, attrs) -> None:
        if tag in BLOCK:
            self._flush()
            self._close_implied(tag)
        elif tag == "br":
            self.pieces.append((" ", self.open[-1], False))
        self.tags += 1
        if tag in VOID:
            return
        parent, root = self.open[-1], tag in ("html", "body")
        hidden, aside, article = _marks(dict(attrs), "" if root else tag) if attrs else (False, False, False)
        aside = not root and (aside or tag in ASIDE or (tag == "header" and not parent.article))
        article = article or tag in ARTICLE
        here = Element(
            tag,
            parent.hidden or hidden,
            parent.article or article,
            parent.heading or tag in HEADINGS,
            parent.cover,
            parent.side,
        )
        if article and here.side is not None:
            here.side.holds_article = True
        if tag in HIDDEN:
            here.cover, here.outer_cover = here, parent.cover
            self.covers.append(here)
        if aside:
            here.side, here.outer_side = here, parent.side
            self.sides.append(here)
        self._push(here)
        self.links += tag == "a"

    def _close_implied(self, tag: str) -> None:
        at = max(map(self._last, CLOSED_BY[tag]), default=-1)
        if at > 0 and (not self.stops or self.stops[-1] <= at):
            self._pop(at, True)

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        if tag in BLOCK:
            self._flush()
        self.tags += 1
        at = self._last(tag)
        if at < 0:
            return
        if tag not in BLOCK and self.blocks and self.blocks[-1] > at:
            return  # an inline end tag does not close blocks
        if tag not in WALLS and tag not in ("html", "div", "section") and self.walls and self.walls[-1] > at:
            return
        self.open[at].closed = True
        self._pop(at, tag not in ("html", "body"))

    def handle_data(self, data) -> None:
        here = self.open[-1]
        if here.hidden or here.tag in ("script", "style"):
            return
        self.pieces.append((data, here, self.links > 0))


def _link_chars(pieces: list[tuple[str, Element, bool]]) -> int:
    return sum([len(p[0].strip()) for p in pieces if p[2]])


def lines_of(html: str | None) -> list[Line]:
    """The lines of a page that are text at all: no scripts, styles or hidden elements."""
    reader = LineReader()
    reader.feed(html or "")
    reader.close()
    return reader.lines()


# --- choosing content -----------------------------------------------------------------------


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian-weighted means of neighbouring values."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, kernel, "full")[reach : reach + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel, "full")[reach : reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """Midway between the centres of two clusters; minus infinity if there is one cluster."""
    low, high = values.min(), values.max()
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values < cut], values[values >= cut]
        if not len(below) or not len(above):
            return -np.inf
        low_, high_ = below.mean(), above.mean()
        if (low_, high_) == (low, high):
            break
        low, high = low_, high_
    return (low + high) / 2 if high - low >= MIN_SPREAD else -np.inf


def by_ratios(kept: list[Line]) -> list[bool]:
    """Which lines are above the threshold of the smoothed text-to-tag ratios.

    Lines of what the page calls its article are one region: they share the mean of their smoothed
    ratios, weighted by their text, so short lines of it stand or fall with the others.
    """
    ratios = smooth(np.log1p([line.ratio * (1 - line.links) for line in kept]))
    plain = np.array([line.links <= MAX_LINKS for line in kept])
    article = np.array([line.article for line in kept])
    if article.any():
        text = np.array([len(line.own) - line.own_links for line in kept], float) + 1e-9
        own = text[article]
        mean = (ratios[article] * own).sum() / own.sum()
        ratios[article] = mean + ARTICLE_WEIGHT * (own.sum() / text.sum()) ** 3
        plain |= article
    chosen = ((ratios >= threshold(ratios)) & plain).tolist()
    for i in range(len(kept) - 2, -1, -1):  # a heading belongs to the region below it
        chosen[i] = chosen[i] or (kept[i].heading and chosen[i + 1])
    return chosen


def content(lines: list[Line]) -> list[Line]:
    """The lines of the main text."""
    kept = [line for line in lines if not line.aside]
    if not kept:
        return []
    return [line for line, c in zip(kept, by_ratios(kept), strict=True) if c]


def main_text(html: str | None) -> str:
    return " ".join(line.own for line in content(lines_of(html)))


def visible_text(html: str | None) -> str:
    """All visible text of a page, a line a block."""
    return "\n".join(line.text for line in lines_of(html))


def extract(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return run(html)


def extract_pages(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """`pages` with the main text in column `into`."""
    prepare(pages.sparkSession)
    return pages.withColumn(into, extract(F.col(f"`{html_col}`")))
