"""Main text of web pages.

The standard library's streaming parser turns a page into blocks (lines) with
their text, tag count and enclosing elements.  The text-to-tag ratio of each
line, smoothed by a Gaussian, is split into two clusters by a threshold; lines of
the upper cluster are content.  Runs of them select the regions that make up the
text: the articles in which they lie, or on pages without articles the span from
the first to the last content line of their common container and whatever stands
in one container with a content line.  Lines of navigation, notices, adverts,
forms, comments and the like go before that, by tag or role; a telling class or
id removes a container too, but never one that holds all content lines.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrow_map import map_batches

# HTML element names and common names of page furniture.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup
    option p pre section select summary table tbody td tfoot th thead title tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP_TAGS = frozenset(
    """aside audio button canvas datalist dialog embed footer form frameset head header iframe input map menu nav
    noframes noscript object option script select style svg template textarea title video""".split()
)
SKIP_ROLES = frozenset(
    """alert alertdialog banner complementary contentinfo dialog directory form menu menubar navigation search
    status tablist toolbar tooltip""".split()
)
SKIP_NAMES = frozenset(
    """ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment commentlist
    comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr header login masthead menu
    modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion
    recommendations recommended related replies reply respond search share sharing sidebar signup skip social sponsor
    sponsored subscribe subscription teaser toolbar topbar widget widgets""".split()
)
# Names that say that a container has an article's text, whatever else they say.
TEXT_NAMES = frozenset("article body content copy entry main page post story text".split())
# Names that tell even of a paragraph that it isn't part of the text.
STRONG_NAMES = frozenset(
    """ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs consent cookie cookies
    copyright gdpr newsletter notice promo promoted sponsored subscribe""".split()
)
#: An open element of the key ends when one of the values starts.
IMPLIED_END = {
    "p": BLOCK_TAGS - {"body", "html", "head", "option", "optgroup"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "option": frozenset({"option", "optgroup"}),
    "tr": frozenset({"tr", "tbody", "tfoot", "thead"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "head": frozenset({"body"}),
}
ENDED_BY = {tag: [was for was, by in IMPLIED_END.items() if tag in by] for tag in frozenset().union(*IMPLIED_END.values())}
SCOPES = frozenset({"table", "ul", "ol", "dl", "select", "article", "section", "main", "aside", "nav", "form", "div"})
CONTAINERS = frozenset({"", "html", "body", "div", "section", "td", "center"})
#: Elements of text that a name removes only if it is one of STRONG_NAMES.
TEXT_TAGS = frozenset("a b blockquote cite code dd dt em figcaption figure font i li p pre q small span strong td th u".split())
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
UNFINISHED = re.compile(r"<(?:[A-Za-z/!?][^<>]*)?\Z")


class Element:
    """An open or closed element: its place in the tree and why it may not count."""

    __slots__ = ("article", "gone", "heading", "holds_article", "in_header", "inside", "main", "mass", "named", "parent", "skipped", "tag")

    def __init__(self, tag: str, parent: Element | None, skipped: bool, named: bool, kind: str):
        self.tag, self.parent, self.skipped, self.named = tag, parent, skipped, named
        self.mass, self.holds_article, self.gone, self.inside = 0, False, False, False
        self.heading = tag in HEADINGS or (parent is not None and parent.heading)
        self.in_header = tag == "header" or (parent is not None and parent.in_header)
        #: The outermost article, and main element, in which it stands.
        self.article = parent.article if parent is not None else None
        self.main = parent.main if parent is not None else None
        if kind == "article" and self.article is None:
            self.article = self
        if kind == "main" and self.main is None:
            self.main = self


class Line:
    __slots__ = ("element", "linked", "tags", "text")

    def __init__(self, text: str, tags: int, linked: int, element: Element):
        self.text, self.tags, self.linked, self.element = text, tags, linked, element


class PageLines(HTMLParser):
    """Lines of a page in order, from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Element("", None, False, False, "")
        self.counts: Counter = Counter()
        self.open, self.lines, self.elements = [self.top], [], [self.top]
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.muted = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.open[-1]))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
            self.imply_end(tag)
        else:
            self.tags += 1
        if tag in VOID_TAGS:
            self.parts.append(" " if tag in ("br", "hr") else "")
            return
        named = hidden = False
        role = ""
        if attrs:
            values = {k: v or "" for k, v in attrs}
            role = values.get("role", "").strip().lower()
            style = values.get("style", "").replace(" ", "")
            hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in style
            names = {p.lower() for k in ("class", "id") if k in values for p in NAME_PARTS.findall(values[k])}
            named = role in SKIP_ROLES or not names.isdisjoint(STRONG_NAMES if tag in TEXT_TAGS else SKIP_NAMES)
            named = named and tag not in HEADINGS and names.isdisjoint(TEXT_NAMES)
        if tag in ("html", "body", "main"):
            named = hidden = False
        kind = tag if tag in ("article", "main") else role
        element = Element(tag, self.open[-1], hidden or tag in SKIP_TAGS, named, kind)
        if kind in ("article", "main"):
            for above in reversed(self.open):
                if above.holds_article:
                    break
                above.holds_article = True
        self.counts[tag] += 1
        self.open.append(element)
        self.elements.append(element)
        self.links += tag == "a"
        self.muted += element.skipped and tag not in BLOCK_TAGS

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        else:
            self.tags += 1
        if not self.counts[tag]:
            return  # nothing of that name is open
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                self.close_from(depth)
                return
            if tag not in BLOCK_TAGS and self.open[depth].tag in BLOCK_TAGS:
                return  # a stray end tag of an inline element

    def handle_data(self, data: str) -> None:
        if self.muted:  # within a script, a style or another inline element that doesn't count
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def imply_end(self, tag: str) -> None:
        if not any(self.counts[was] for was in ENDED_BY.get(tag, ())):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            was = self.open[depth].tag
            if tag in IMPLIED_END.get(was, ()):
                self.close_from(depth)
                return
            if was in SCOPES:
                return

    def close_from(self, depth: int) -> None:
        self.links -= sum(e.tag == "a" for e in self.open[depth:])
        self.muted -= sum(e.skipped and e.tag not in BLOCK_TAGS for e in self.open[depth:])
        self.counts.subtract(e.tag for e in self.open[depth:])
        del self.open[depth:]


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing, with the kernel renormalised at both ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[low:high], strict=True)) / sum(weights))
    return out


def two_clusters(values: list[float]) -> float:
    """Threshold between the two clusters of ``values`` (two means in one dimension)."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not above:
            return cut
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_lines(lines: list[Line]) -> list[int]:
    """Numbers of the lines whose smoothed text-to-tag ratio is in the upper cluster; of all, if that leaves none.

    Clusters whose means differ by less than a factor of two are one.  A line that
    only smoothing lifts, in a container without any line of its own above the
    threshold, isn't content.
    """
    raw = [max(0, len(x.text) - x.linked) / (1 + x.tags) for x in lines]
    ratio = smoothed(raw)
    cut = two_clusters(ratio)
    below, above = [r for r in ratio if r < cut], [r for r in ratio if r >= cut]
    if below and 2 * sum(below) * len(above) > sum(above) * len(below):
        cut = 0.0
    dense = [i for i, r in enumerate(ratio) if r >= cut and len(lines[i].text) > lines[i].linked] or list(range(len(lines)))
    own = {id(container(lines[i].element)) for i in dense if raw[i] >= cut}
    return [i for i in dense if id(container(lines[i].element)) in own] if own else dense


class Page:
    """A parsed page, its elements in order, so that parents come before their children."""

    def __init__(self, html: str):
        parser = PageLines()
        parser.feed(UNFINISHED.sub("", html))
        parser.close()
        parser.flush()
        self.elements, self.lines, self.top = parser.elements, parser.lines, parser.top

    def live(self, by_name: Callable[[Element], bool]) -> list[Line]:
        """Lines that neither tags and roles nor names remove; of an article's own header, the headings."""
        for e in self.elements:
            skipped = e.skipped and not (e.tag == "header" and (e.article or e.main))
            e.gone = skipped or by_name(e) or (e.parent is not None and e.parent.gone)
        return [x for x in self.lines if not x.element.gone and (x.element.heading or not x.element.in_header)]

    def weigh(self, lines: list[Line]) -> None:
        """``mass`` of each element: how many of ``lines`` it holds."""
        for e in self.elements:
            e.mass = 0
        for x in lines:
            x.element.mass += 1
        for e in reversed(self.elements[1:]):
            e.parent.mass += e.mass

    def within(self, chosen: set[int], lines: list[Line]) -> list[Line]:
        for e in self.elements:
            e.inside = id(e) in chosen or (e.parent is not None and e.parent.inside)
        return [x for x in lines if x.element.inside]


def container(e: Element) -> Element:
    while e.tag not in CONTAINERS:
        e = e.parent
    return e


def mostly_links(line: Line) -> bool:
    return 2 * line.linked >= len(line.text)


def regions(page: Page, live: list[Line], dense: list[int]) -> list[Line]:
    """The lines that the content lines ``dense`` select."""
    content = [live[i] for i in dense]
    for kind in ("article", "main"):
        if not (found := {id(e): e for x in content if (e := getattr(x.element, kind)) is not None}):
            continue
        held, upper = Counter(), Counter()
        for counts, lines in ((held, live), (upper, content)):
            for x in lines:
                counts[id(getattr(x.element, kind))] += len(x.text)
        # Of several, those whose text is content for the larger part: not teasers beside an article.
        most = max(found, key=lambda e: (upper[e], -held[e]))
        return page.within({e for e in found if e == most or 2 * upper[e] >= held[e]}, live)
    page.weigh(content)
    whole = [e for e in page.elements if e.mass == len(content) and e.tag in CONTAINERS][-1]  # the innermost
    own = page.within({id(whole)}, live)
    with_content = {id(container(x.element)) for x in content}
    chosen, upper = set(map(id, content)), [i for i, x in enumerate(own) if id(x) in set(map(id, content))]
    keep = [
        id(x) in chosen or (not mostly_links(x) and (upper[0] < i < upper[-1] or id(container(x.element)) in with_content))
        for i, x in enumerate(own)
    ]
    for i in range(len(own) - 2, -1, -1):  # headings of what stays
        keep[i] = keep[i] or (own[i].element.heading and keep[i + 1] and not mostly_links(own[i]))
    return [x for x, k in zip(own, keep, strict=True) if k]


def main_text(html: str | None) -> str:
    """Text of the article in ``html``, its blocks joined by line feeds."""
    if not html:
        return ""
    page = Page(html)
    # An article under no telling name: then names remove elements whatever these hold.
    under_name = {}
    plain = False
    for e in page.elements:
        under_name[id(e)] = e.named or (e.parent is not None and under_name[id(e.parent)])
        plain = plain or (e in (e.article, e.main) and not under_name[id(e)])
    if not (lines := page.live(lambda e: False)):
        return ""
    content = [lines[i] for i in content_lines(lines)]
    page.weigh(content)
    everything = {id(e) for e in page.elements if e.mass == len(content)}
    live = page.live(lambda e: e.named and (plain or not (e.holds_article or id(e) in everything)))
    if not live:
        return ""
    return "\n".join(x.text for x in regions(page, live, content_lines(live)))


def extract_main_text(
    pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")
) -> DataFrame:
    """One row per page: the ``keep`` columns, ``text`` and ``n_chars`` (its code points).

    Null, empty and text-free pages give the empty string.  A page that ends
    within a tag or comment counts up to there.  Very long and very deep pages are
    read whole, one at a time.  Repeated pages and ids give repeated rows; an empty
    table gives none.  Other columns, whatever their names, are not read.
    """
    names = [f"_q_{i}" for i in range(len(keep))]
    picked = pages.select(*[F.col(k).alias(n) for k, n in zip(keep, names, strict=True)], F.col(html_col).cast("string").alias("_q_html"))
    kinds = ", ".join(f"{n} {picked.schema[n].dataType.simpleString()}" for n in names)

    def task():
        def work(batch: pa.RecordBatch) -> dict:
            text = [main_text(h) for h in batch.column("_q_html").to_pylist()]
            return {n: batch.column(n) for n in names} | {"text": text, "n_chars": [len(t) for t in text]}

        return work

    out = map_batches(picked, f"{kinds}, text string, n_chars long", task)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keep, names, strict=True)], "text", "n_chars")
