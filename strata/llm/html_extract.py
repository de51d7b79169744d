"""Main text of web pages by text-to-tag ratios (operator 1).

Parser events of the standard library stream over the page in pieces.  Each block of the
page becomes a line with its text, the tags met since the line before, and its place.  The
text-to-tag ratios of the lines, zero in menus, headers, footers, sidebars, adverts,
notices, forms and comments, are smoothed with a Gaussian; lines whose smoothed ratio is
at or above the threshold (a share of the ratios' standard deviation, or the middle of
the two clusters of ratios where that is lower) mark the content.  The content region
is the article that holds the marked lines (or ``main``, or, on pages without either,
the smallest container with most of the marked text).  Its lines are the text, short
paragraphs included; of those that are mostly links, lines of several links and runs
with a ratio below the threshold are left out, whatever their class is.

The pieces fed to the parser grow with the text that it holds back (an unclosed comment, script or
quoted attribute), so every page is read in time linear in its length.  Formulas and the
fallback text of embedded objects belong to the block around them.

Edge cases: a null, empty or tagless blank page has the empty text; text outside any tag is a
line of the body; unclosed tags are closed by what follows, a cut page is read to its end;
repeated rows are extracted alike; extra columns are carried; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.schema_safe import own_name

FEED_CHARS = 1 << 16
SIGMA = 1.0
DEVIATIONS = 0.5
REGION_SHARE = 0.7

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(
    "script style template noscript svg head title iframe select option datalist button textarea".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rt rp s samp small "
    "span strike strong sub sup time tt u var wbr object canvas map audio video "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mfenced mstyle "
    "semantics".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
CONTAINERS = frozenset("body div section td main article table tbody tr ul ol dl blockquote center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
#: Words of class and id names that mark what is not the article.
MARKERS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar "
    "nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "social share sharing related recommended recommendations widget toolbar pagination pager copyright skip "
    "header topbar teaser".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements that a start tag closes when they are open (the optional end tags of HTML).
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section div main body".split())


class _Line:
    __slots__ = ("anchors", "heading", "linked", "off", "path", "tags", "text")

    def __init__(self, text, tags, linked, path, off, heading, anchors):
        self.anchors = anchors
        self.text, self.tags, self.linked, self.path, self.off, self.heading = text, tags, linked, path, off, heading


class _Lines(HTMLParser):
    """Turns parser events into lines; keeps the open elements as ``(tag, id, silent, off)``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool]] = []
        self.lines: list[_Line] = []
        self.buffer: list[str] = []
        self.linked = self.anchors = 0
        self.tags = 0
        self.made = 0
        self.kinds: dict[int, str] = {}
        self.seen_main = False

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def flush(self) -> None:
        if not self.buffer:
            return
        text = " ".join("".join(self.buffer).split())
        if text:
            off = bool(self.stack) and self.stack[-1][3]
            heading = any(t in HEADINGS for t, *_ in self.stack)
            path = tuple(i for t, i, *_ in self.stack if t in CONTAINERS)
            self.lines.append(_Line(text, max(self.tags, 1), min(self.linked, len(text)), path, off, heading, self.anchors))
            self.tags = 0
        self.buffer, self.linked, self.anchors = [], 0, 0

    def _pop_to(self, at: int) -> None:
        self.flush()
        del self.stack[at:]

    def _is_off(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag in BOILERPLATE or attrs.get("role", "").lower() in ROLES:
            return True
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(
                " ", "").lower():
            return True
        if tag in ("body", "html", "main"):
            return False
        named = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        return bool(named.strip()) and any(w.lower() in MARKERS for w in _NAME.findall(named))

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.buffer.append(" ")
            return
        self.anchors += tag == "a"
        if tag in INLINE and tag in VOID:
            return
        block = tag not in INLINE
        if block:
            self.flush()
            closes = CLOSES.get(tag, ())
            for at in range(len(self.stack) - 1, -1, -1):
                open_tag = self.stack[at][0]
                if open_tag == "p" or open_tag in closes or (tag in HEADINGS and open_tag in HEADINGS):
                    self._pop_to(at)
                    break
                if open_tag in SCOPE:
                    break
        if tag in VOID:
            return
        named = {k: v or "" for k, v in attrs}
        above = self.stack[-1] if self.stack else ("", 0, False, False)
        off, silent = above[3], above[2] or tag in SILENT
        if tag in ("article", "main") and not self.seen_main and not self._is_off(tag, named):
            self.seen_main, off, silent = True, False, False  # an unclosed advert or script ends here
        elif tag == "header" and not off:
            off = True
        elif tag in HEADINGS and any(t == "header" for t, *_ in self.stack) and any(
                t == "article" and not o for t, _, _, o in self.stack):
            off = False  # the title in the article's own header
        else:
            off = off or self._is_off(tag, named)
        self.made += 1
        self.stack.append((tag, self.made, silent, off))
        if tag in CONTAINERS:
            self.kinds[self.made] = "main" if named.get("role") == "main" else tag

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        for at in range(len(self.stack) - 1, -1, -1):
            open_tag = self.stack[at][0]
            if open_tag == tag:
                if tag in INLINE:
                    del self.stack[at]
                else:
                    self._pop_to(at)
                return
            if tag in INLINE and open_tag not in INLINE or tag == "p" and open_tag in SCOPE:
                return

    def handle_data(self, data):
        if self.stack and self.stack[-1][2]:
            return
        self.buffer.append(data)
        if any(t == "a" for t, *_ in self.stack[-4:]):
            self.linked += len(data)


def page_lines(html: str) -> tuple[list[_Line], dict[int, str]]:
    """The lines of a page and the kind of every container on their paths."""
    parser = _Lines()
    at = 0
    while at < len(html):
        # what the parser holds back it reads again: feed as much anew
        size = max(FEED_CHARS, len(parser.rawdata))
        parser.feed(html[at : at + size])
        at += size
    parser.close()
    parser.flush()
    return parser.lines, parser.kinds


def smooth(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over neighbouring lines (weights renormalised at the ends)."""
    radius = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    out, n = [], len(ratios)
    for i in range(n):
        lo, hi = max(0, i - radius), min(n, i + radius + 1)
        w = kernel[lo - i + radius : hi - i + radius]
        out.append(sum(a * b for a, b in zip(w, ratios[lo:hi])) / sum(w))
    return out


def threshold(ratios: list[float], deviations: float = DEVIATIONS) -> float:
    """The lower of a share of the standard deviation and the middle of two clusters of the ratios."""
    n = len(ratios)
    mean = sum(ratios) / n
    spread = deviations * math.sqrt(sum((x - mean) ** 2 for x in ratios) / n)
    low, high = min(ratios), max(ratios)
    for _ in range(20):
        middle = (low + high) / 2
        a, b = [x for x in ratios if x <= middle], [x for x in ratios if x > middle]
        if not a or not b:
            break
        low, high = sum(a) / len(a), sum(b) / len(b)
    return min(spread, (low + high) / 2)


def link_blocks(lines: list[_Line], smoothed: list[float], least: float) -> set[int]:
    """Lines of links by ``id``: mostly link text, and the ratios speak against them.

    A line of several links goes by its own ratio; a run of such lines goes as one if the smoothed ratio
    falls below the threshold anywhere in it.  A single link between paragraphs, or in a heading, stays.
    """
    out: set[int] = set()
    run: list[tuple[_Line, float]] = []
    for x, r in [*zip(lines, smoothed), (None, 0.0)]:
        if x is not None and not x.heading and 2 * x.linked > len(x.text):
            run.append((x, r))
            continue
        low = any(r < least for _, r in run)
        out.update(id(y) for y, _ in run if low or y.anchors > 1 and (len(y.text) - y.linked) / y.tags < least)
        run = []
    return out


def main_text(html: str | None) -> str:
    """The main text of one page; empty where there is none."""
    if not html:
        return ""
    lines, kinds = page_lines(html)
    open_lines = [x for x in lines if not x.off]
    if not open_lines:
        return ""
    smoothed = smooth([0.0 if x.off else (len(x.text) - x.linked) / x.tags for x in lines])
    least = threshold(smoothed)
    marked = [x for x, r in zip(lines, smoothed) if not x.off and r >= least and 2 * x.linked <= len(x.text)]
    linked = link_blocks(lines, smoothed, least)
    marked = marked or [x for x in open_lines if 2 * x.linked <= len(x.text)] or open_lines
    mass: dict[int, int] = {}
    for x in marked:
        for i in x.path:
            mass[i] = mass.get(i, 0) + len(x.text)
    for kind in ("article", "main"):
        roots = {i for i in mass if kinds[i] == kind}
        if roots:
            return "\n".join(x.text for x in open_lines if id(x) not in linked and not roots.isdisjoint(x.path))
    total, root = sum(len(x.text) for x in marked), 0
    for i in sorted(mass):  # containers are numbered as they open: later ones lie deeper
        if mass[i] >= REGION_SHARE * total:
            root = i
    inside = [x for x in open_lines if not root or root in x.path]
    held = {id(x) for x in marked}
    return "\n".join(x.text for x in inside if id(x) in held or 2 * x.linked <= len(x.text))


def extract_main_text(
    pages: DataFrame, html: str = "html", carry: list[str] | None = None, text: str = "text", n_chars: str = "n_chars"
) -> DataFrame:
    """The columns ``carry`` of ``pages`` (default: all but the html), the main text and its code points.

    A carried column with the name of a result column is replaced.
    """
    keep = [c for c in pages.columns if c != html] if carry is None else list(carry)
    keep = [c for c in keep if c.lower() not in {text.lower(), n_chars.lower()}]
    (sent,) = own_name(pages, "whole_html")
    at = len(keep)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(at)]
                    + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*keep, text, n_chars])

    kept = pages.select(*[F.col(f"`{c}`") for c in keep])
    schema = kept.schema.add(text, "string").add(n_chars, "long")
    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").cast("string").alias(sent)).mapInArrow(
        extract, schema)
