"""Main text of HTML pages: text-to-tag ratio of each line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser gives events; a *line* is the text between two block boundaries (pages come without line
breaks as often as with them). Three steps follow for each page:

1. Lines of elements that are no article by their kind, role or class name (menus, headers, footers, sidebars, notices, adverts,
   forms, scripts, styles, reader comments, hidden parts) get the ratio 0. A named element that holds the article keeps its lines.
2. The ratio of each line, characters outside links over tags, is smoothed along the page with a Gaussian kernel; lines at or above
   the standard deviation of the smoothed ratios form the content cluster.
3. The cluster selects regions: the ``article`` elements (else ``main``) that hold lines of the cluster, else the deepest element
   with most of the cluster's text. All other lines of a region belong to it, however short, but those of step 1.

Defined results: null, empty and blank html give an empty text and 0; markup that is never closed ends where its parent ends; long pages
are parsed whole, a page at a time; a page of repeated lines keeps each of them; equal pages and repeated rows each give a row; null ids
and urls come back null; an empty table gives no rows; other columns are ignored, whatever their names. A page without an article has
the text of its best region; a page whose text is all boilerplate has an empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import slices

#: Radius of the smoothing kernel in lines, and its standard deviation.
RADIUS, SIGMA = 2, 1.0
#: The content cluster begins at this many standard deviations of the smoothed ratios.
THRESHOLD = 1.0
#: A container without an ``article`` is entered as long as one child holds this share of the cluster's text.
MOST = 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead "
    "title tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements beside the cluster that belong to it where they lie in the page's body itself.
FLOW = HEADINGS | frozenset("p blockquote pre ul ol dl table figure".split())
#: Never text of an article, whatever they hold.
SILENT = frozenset("head script style template noscript title iframe object svg canvas audio video".split())
#: Boilerplate by kind unless the article is inside.
APART = frozenset("nav footer aside form dialog menu button select textarea label fieldset header".split())
#: Boilerplate by role.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Boilerplate by a word of a class name or id.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle adslot adunit sponsor sponsored sponsors promo promoted promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager topbar toolbar skiplink "
    "masthead footer colophon copyright sidebar aside widget widgets related recommended recommendations trending "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "share sharing social search login signup form".split()
)
COMMENTS = frozenset("comment comments commentlist commentary disqus respond replies reply discussion".split())
#: Class names that begin so speak of the page around them.
ABOUT = frozenset(("with", "has", "no", "without"))
#: What an opening tag closes, and how far up it looks for it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol menu dl table select html body article main div section".split())
#: Marks of elements whose text is not even looked at.
FIRM = ("silent", "comments")
TAG_OPENS = re.compile(r"<[A-Za-z/!?]")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def named(attrs: dict[str, str | None]) -> tuple[bool, bool, bool]:
    """``(boilerplate, reader comments, header)`` by class names and id."""
    boiler = comments = header = False
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = [w.lower() for w in WORD.findall(name)]
        if words and words[0] not in ABOUT:
            boiler |= not NAMES.isdisjoint(words)
            comments |= not COMMENTS.isdisjoint(words)
            header |= "header" in words
    return boiler, comments, header


def is_hidden(attrs: dict[str, str | None]) -> bool:
    style = (attrs.get("style") or "").replace(" ", "").lower()
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


@dataclass(slots=True)
class Line:
    text: str
    element: int
    tags: int
    linked: int  # characters of links


@dataclass
class Tree:
    """What is known of each element: its parent, kind and marks."""

    parent: list[int] = field(default_factory=lambda: [-1])
    kind: list[str] = field(default_factory=lambda: [""])
    mark: list[str] = field(default_factory=lambda: [""])  # "", "silent", "apart", "comments", "header"


class Events(HTMLParser):
    """Turns parser events into lines and an element tree."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tree, self.lines = Tree(), []
        self._open: list[int] = [0]
        self._count: dict[str, int] = {}
        self._parts: list[str] = []
        self._tags = self._linked = self._links = self._silent = 0

    def _flush(self) -> None:
        if self._parts:
            if text := " ".join("".join(self._parts).split()):
                self.lines.append(Line(text, self._open[-1], max(self._tags, 1), self._linked))
                self._tags = self._linked = 0
            self._parts = []

    def _pop(self) -> None:
        kind, mark = self.tree.kind[self._open[-1]], self.tree.mark[self._open[-1]]
        if mark in ("apart", "header"):
            self._flush()
        self._silent -= mark in FIRM
        self._open.pop()
        self._count[kind] -= 1
        if kind == "a":
            self._links -= 1

    def _close(self, kinds: tuple[str, ...], stops: frozenset[str]) -> None:
        """Closes the nearest open element of ``kinds``; looks no further than an element of ``stops``."""
        if any(self._count.get(k) for k in kinds):
            for depth in range(len(self._open) - 1, 0, -1):
                kind = self.tree.kind[self._open[depth]]
                if kind in kinds:
                    while len(self._open) > depth:
                        self._pop()
                    return
                if kind in stops:
                    return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._flush()
            if tag not in ("br", "option", "select", "legend", "summary"):
                self._close(("p",), SCOPES)
            if tag in CLOSES:
                self._close(CLOSES[tag], SCOPES)
            if tag == "body":
                self._close(("head",), frozenset())
        self._tags += 1
        if tag in VOID:
            return
        mark = self._mark(tag, dict(attrs))
        if mark in ("apart", "header"):
            self._flush()
        self._silent += mark in FIRM
        self.tree.parent.append(self._open[-1])
        self.tree.kind.append(tag)
        self.tree.mark.append(mark)
        self._open.append(len(self.tree.kind) - 1)
        self._count[tag] = self._count.get(tag, 0) + 1
        self._links += tag == "a"

    def _mark(self, tag: str, attrs: dict[str, str | None]) -> str:
        if tag in SILENT or is_hidden(attrs):
            return "silent"
        if tag in ("html", "body"):
            return ""
        boiler, comments, header = named(attrs)
        if comments:
            return "comments"
        if tag in ("article", "main"):
            return ""
        if (attrs.get("role") or "").lower() in ROLES or boiler or tag in APART - {"header"}:
            return "apart"
        return "header" if header or tag == "header" else ""

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        self._tags += 1
        if tag not in VOID:
            # an inline end tag closes nothing beyond its block, </p> nothing beyond its container
            self._close((tag,), SCOPES if tag == "p" else frozenset() if tag in BLOCK or tag in SILENT else BLOCK)

    def handle_data(self, data: str) -> None:
        if self._silent:
            return
        self._parts.append(data)
        if self._links:
            self._linked += len(data) - data.count(" ")

    def unknown_decl(self, data: str) -> None:
        """Marked sections are no text."""

    def finish(self) -> tuple[list[Line], Tree]:
        self.close()
        self._flush()
        return self.lines, self.tree


def parse(html: str) -> tuple[list[Line], Tree]:
    """Lines and elements of a page. A tag that the page ends in is none, so the parser gets no more than what a ``>`` ends."""
    events = Events()
    end = html.rfind(">") + 1
    opening = TAG_OPENS.search(html, end)
    try:
        events.feed(html[:end])
        events.feed(html[end : opening.start() if opening else len(html)])
        return events.finish()
    except AssertionError:  # a malformed declaration, which the parser refuses: its opening is no markup then
        return parse(html.replace("<![", "&lt;![")) if "<![" in html else (events.lines, events.tree)


def _inherit(tree: Tree, own: list[bool]) -> list[bool]:
    """True for elements that are, or lie in, one that has the property; parents come before their children."""
    out = list(own)
    for e in range(1, len(out)):
        out[e] = out[e] or out[tree.parent[e]]
    return out


def _holds(tree: Tree, kinds: frozenset[str], besides: list[bool]) -> list[bool]:
    """True for elements with a descendant of ``kinds`` that isn't one of ``besides``."""
    out = [False] * len(tree.kind)
    for e in range(len(out) - 1, 0, -1):
        if out[e] or (tree.kind[e] in kinds and not besides[e]):
            out[tree.parent[e]] = True
    return out


def boilerplate(tree: Tree) -> list[bool]:
    """True for elements whose lines are no article."""
    firm = _inherit(tree, [m in FIRM for m in tree.mark])
    roots = frozenset(("article", "main"))
    around, titled = _holds(tree, roots, firm), _holds(tree, HEADINGS, firm)
    within = _inherit(tree, [k in roots for k in tree.kind])
    first = _holds(tree, frozenset(("h1",)), firm)
    own = []
    for e, mark in enumerate(tree.mark):
        spared = around[e] or (mark == "header" and within[e] and titled[e]) or (tree.kind[e] == "form" and first[e])
        own.append(firm[e] or (mark in ("apart", "header") and not spared))
    return _inherit(tree, own)


def smooth(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; beyond the ends of the page there is nothing."""
    at = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(at**2) / (2 * SIGMA**2))
    return np.convolve(ratios, kernel / kernel.sum(), "full")[RADIUS : RADIUS + len(ratios)]


def clusters(lines: list[Line], dropped: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(ratio, smoothed ratio, in the content cluster)`` of each line."""
    ratios = np.array([0.0 if dropped[x.element] else max(len(x.text) - x.linked, 0) / x.tags for x in lines])
    smoothed = smooth(ratios)
    content = (smoothed >= THRESHOLD * smoothed.std()) & np.array([not dropped[x.element] for x in lines])
    return ratios, smoothed, content


def _region(lines: list[Line], tree: Tree, dropped: list[bool], content: np.ndarray) -> list[bool]:
    """Lines of the regions that the content cluster selects."""
    size = [len(x.text) for x in lines]
    for kind in ("article", "main"):
        owner = [-1] * len(tree.kind)  # the outermost element of the kind
        for e in range(1, len(owner)):
            up = owner[tree.parent[e]]
            owner[e] = up if up >= 0 else e if tree.kind[e] == kind and not dropped[e] else -1
        weight: dict[int, int] = {}
        chosen: dict[int, int] = {}
        for x, n, c in zip(lines, size, content):
            if (root := owner[x.element]) >= 0 and not dropped[x.element]:
                weight[root] = weight.get(root, 0) + n
                if c:
                    chosen[root] = chosen.get(root, 0) + n
        if weight:
            roots = set(chosen) or {max(weight, key=lambda k: (weight[k], -k))}
            return [owner[x.element] in roots and not dropped[x.element] for x in lines]
    total, held = 0, [0] * len(tree.kind)
    for x, n, c in zip(lines, size, content):
        if c:
            held[x.element] += n
            total += n
    for e in range(len(held) - 1, 0, -1):
        held[tree.parent[e]] += held[e]
    child: dict[int, int] = {}
    for e in range(1, len(held)):
        if tree.kind[e] not in ("p", *HEADINGS) and held[e] > held[child.get(tree.parent[e], 0)] * (tree.parent[e] in child):
            child[tree.parent[e]] = e
    root = 0
    while total and root in child and held[child[root]] >= MOST * total:
        root = child[root]
    inside = _inherit(tree, [e == root for e in range(len(tree.kind))])
    picked = [k for k, c in enumerate(content) if c and inside[lines[k].element]]
    if not picked:
        return [False] * len(lines)
    under = [root] * len(tree.kind)  # the child of the root that an element lies in
    for e in range(root + 1, len(under)):
        up = tree.parent[e]
        under[e] = e if up == root else under[up] if inside[up] else root
    whole = tree.kind[root] not in ("", "html", "body")
    keep = []
    for k, x in enumerate(lines):
        near = whole or picked[0] <= k <= picked[-1] or tree.kind[under[x.element]] in FLOW
        title = tree.kind[x.element] == "h1" and k < picked[0]
        keep.append(not dropped[x.element] and (bool(content[k]) or title or (inside[x.element] and near and 2 * x.linked <= len(x.text))))
    return keep


def main_text(html: str | None) -> str:
    """The article of one page."""
    lines, tree = parse(html or "")
    if not lines:
        return ""
    dropped = boilerplate(tree)
    _, _, content = clusters(lines, dropped)
    return " ".join(x.text for x, keep in zip(lines, _region(lines, tree, dropped, content)) if keep)


OUT = "page_id bigint, url string, text string, n_chars bigint"


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; each is parsed where it is read, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) as page_id", "cast(url as string) as url", "cast(html as string) as html").mapInArrow(run, OUT)


LINES = "page_id bigint, line int, text string, ratio double, smoothed double, content boolean, kept boolean"


def line_ratios(pages: DataFrame) -> DataFrame:
    """One row for each line of a page with its ratio, the smoothed ratio, its cluster, and whether it is kept: to look at a choice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                lines, tree = parse(html.as_py() or "")
                if lines:
                    dropped = boilerplate(tree)
                    ratios, smoothed, content = clusters(lines, dropped)
                    kept = _region(lines, tree, dropped, content)
                    columns = [[page] * len(lines), range(len(lines)), [x.text for x in lines], ratios, smoothed, content, kept]
                    types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in LINES.split(", ")])

    return pages.selectExpr("cast(page_id as bigint) as page_id", "cast(html as string) as html").mapInArrow(run, LINES)
