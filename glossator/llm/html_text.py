"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

The standard library's parser streams a page's events. Block tags cut it into lines; each line has its text, the tags met
since the last one and the elements it lies in. A line's ratio is the logarithm of its text's length over its tags, so one huge
paragraph doesn't hide the others. Lines in elements that never hold the article (menus, page headers and footers, sidebars,
forms, scripts, hidden ones) have ratio 0. What names itself an advert, a notice, comments or the like has its ratio lowered
``LOWERED`` times, but for a name that an article may have too (``WEAK``) on the box of most of the page's text. The ratios
are smoothed along the page by a Gaussian, which doesn't lift the lines of a lowered element by their neighbours; lines above
the threshold form clusters. The content region is the innermost element that holds all of them, and the headings before it.
Its short lines between the long ones belong to it, save runs of link lines that are below the threshold alone.

Defined cases: null, empty and text-free pages give an empty text; broken markup is read as far as it goes (unclosed elements
end with the page); if names lower all text, they lower none more than another; very long pages are read whole; repeated rows
each get a row; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow, table
from .words import pieces

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that don't end a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("head title script style noscript template nav aside footer form button select option textarea input iframe svg canvas object embed audio video dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts of names: of what is hardly ever an article; the same for the first part of a name; of what may be one.
STRONG = re.compile(
    r"(?:ads?|advert\w*|adsense|adslot|adbox|sponsor\w*|promo\w*|sidebar|navbar|navigation|nav|menu|breadcrumbs?|cookies?|consent|gdpr|popup|modal|newsletter|subscri\w+|signup|"
    r"comments?|commentlist|disqus|respond|responses|replies|reply|pagination|pager|toolbar|footer|masthead|skiplink|login)"
)
STRONG_FIRST = re.compile(r"(?:header|banner|overlay|search|copyright)")
WEAK = re.compile(r"(?:legal|notice|share|sharing|social|related|recommend\w*|widget|links)")
PARTS = re.compile(r"[^\W_]+")
#: Elements that a region can be.
BOXES = frozenset("html body main article section div td center".split())
#: What a tag ends, unless one of the others is open within it.
_LIST, _CELL, _TERM = ({"ul", "ol", "div"}), ({"table"}), ({"dl", "div"})
ENDS = {"li": ({"li"}, _LIST), "td": ({"td", "th"}, _CELL), "th": ({"td", "th"}, _CELL), "tr": ({"td", "th", "tr"}, _CELL), "dt": ({"dt", "dd"}, _TERM), "dd": ({"dt", "dd"}, _TERM)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What names say isn't heeded on these.
FRAME = frozenset("html body main article".split())
SIGMA, RADIUS = 1.0, 2
#: Of the mean smoothed ratio; by what a name divides a ratio; share of a line's text in links, and lines together, of a menu.
THRESHOLD, LOWERED, LINKED, RUN = 0.5, 1000, 0.8, 3


class Line(NamedTuple):
    text: str
    tags: int
    path: tuple[int, ...]  # the boxes it lies in
    out: bool  # in an element that never holds the article
    strong: int  # the outermost element with such a name that it lies in, or -1
    weak: int
    links: int  # characters in links
    heading: bool


def named(value: str) -> tuple[bool, bool]:
    """Whether class and id values say strongly, or weakly, that an element is not the article."""
    strong = weak = False
    for name in value.replace("-bar", "bar").replace("-up", "up").replace("bread-", "bread").replace("skip-", "skip").split():
        parts = [x.lower() for x in PARTS.findall(name)]
        strong |= any(STRONG.fullmatch(x) for x in parts) or bool(parts and STRONG_FIRST.fullmatch(parts[0]))
        weak |= any(WEAK.fullmatch(x) for x in parts)
    return strong, weak


class Lines(HTMLParser):
    """Collects a page's lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kind: list[str] = []  # of each element, by number
        self.open: list[tuple[str, int, bool, int, int]] = []  # tag, number, out, strong, weak
        self.tags, self.text, self.links, self.linked = 0, [], 0, 0

    def end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text = []
            if text:
                _, _, out, strong, weak = self.open[-1] if self.open else ("", -1, False, -1, -1)
                path = tuple(n for t, n, *_ in self.open if t in BOXES)
                self.lines.append(Line(text, self.tags, path, out, strong, weak, self.links, any(t in HEADINGS for t, *_ in self.open)))
                self.tags = 0
            self.links = 0

    def excluded(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in NEVER or (tag == "header" and not any(t in ("article", "main") for t, *_ in self.open)):
            return True
        if not attrs or tag in FRAME:
            return False
        if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            return True
        return (attrs.get("role") or "").lower() in ROLES

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        self.linked += tag == "a"
        if tag not in INLINE:
            self.end_line()
            # a block ends an open paragraph, an item or a cell its forerunner
            if self.open and self.open[-1][0] == "p":
                self.open.pop()
            ends, within = ENDS.get(tag, ((), ()))
            for k in range(len(self.open) - 1, -1, -1) if ends else ():
                if self.open[k][0] in within:
                    break
                if self.open[k][0] in ends:
                    del self.open[k:]
                    if tag != "tr":
                        break
        if tag not in VOID:
            _, _, out, strong, weak = self.open[-1] if self.open else ("", -1, False, -1, -1)
            a = dict(attrs)
            out = out or self.excluded(tag, a)
            if a and not out and tag not in FRAME and (strong < 0 or weak < 0):
                by_name = named(f"{a.get('class') or ''} {a.get('id') or ''}")
                strong, weak = (len(self.kind) if yes and was < 0 else was for yes, was in zip(by_name, (strong, weak)))
            if tag not in INLINE or out:
                self.open.append((tag, len(self.kind), out, strong, weak))
                self.kind.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.linked = 0
        if tag not in INLINE:
            self.end_line()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if tag in INLINE:
                    self.end_line()
                del self.open[k:]
                return

    def handle_data(self, data):
        self.text.append(data)
        if self.linked:
            self.links += len(data)

    def unknown_decl(self, data):
        pass

    def read(self, html: str) -> "Lines":
        self.feed(html)
        if re.match("<[!/?a-zA-Z]", self.rawdata):
            self.rawdata = ""  # markup that the page's end cuts short is no text
        self.close()
        self.end_line()
        return self


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian weights over neighbours, normalised at the borders."""
    weights = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(ratios)):
        a, b = max(0, i - RADIUS), min(len(ratios), i + RADIUS + 1)
        w = weights[a - i + RADIUS : b - i + RADIUS]
        out.append(sum(x * y for x, y in zip(ratios[a:b], w)) / sum(w))
    return out


def lowered(page: Lines) -> list[int]:
    """Per line the element whose name lowers it, or -1.

    A weak name isn't heeded on the box of more than half of the text that isn't out or strongly named, unless an article or
    main element has other text of the page.
    """
    held: dict[int, int] = {}
    framed = total = 0
    inside: dict[int, int] = {}
    for line in page.lines:
        if not line.out and line.strong < 0:
            total += len(line.text)
            frame = any(page.kind[n] in ("article", "main") for n in line.path)
            framed += frame
            if line.weak >= 0:
                held[line.weak] = held.get(line.weak, 0) + len(line.text)
                inside[line.weak] = inside.get(line.weak, 0) + frame
    fine = {n for n, size in held.items() if 2 * size > total and inside[n] == framed}
    return [line.strong if line.strong >= 0 else -1 if line.weak in fine else line.weak for line in page.lines]


def scored(page: Lines) -> tuple[list[float], float, list[int]]:
    """Smoothed ratios, the threshold, and what lowers each line."""
    low = lowered(page)
    ratios = [0.0 if x.out else math.log1p(len(x.text) / max(1, x.tags) / (LOWERED if k >= 0 else 1)) for x, k in zip(page.lines, low)]
    smooth = smoothed(ratios)
    i = 0
    while i < len(low):  # a lowered element is smoothed by itself
        j = i + 1
        while j < len(low) and low[j] == low[i]:
            j += 1
        if low[i] >= 0:
            smooth[i:j] = smoothed(ratios[i:j])
        i = j
    counted = [s for s, x, k in zip(smooth, page.lines, low) if not x.out and k < 0] or [s for s, x in zip(smooth, page.lines) if not x.out]
    return smooth, THRESHOLD * sum(counted) / max(1, len(counted)), low


def region(page: Lines) -> list[str]:
    """The texts of the content region's lines."""
    lines = page.lines
    smooth, least, low = scored(page)
    chosen = [i for i, s in enumerate(smooth) if not lines[i].out and s >= least]
    if not chosen:
        return []
    path = list(lines[chosen[0]].path)
    for i in chosen:
        path = path[: next((k for k, (a, b) in enumerate(zip(path, lines[i].path)) if a != b), min(len(path), len(lines[i].path)))]
    picked = set(chosen)
    plain = [not x.out and (low[i] < 0 or i in picked) for i, x in enumerate(lines)]
    at = len(path)
    while at > 1:  # a box with a single line is but a paragraph of its parent; headings belong to what they stand before
        here = [i for i, x in enumerate(lines) if plain[i] and path[at - 1] in x.path]
        more = [i for i, x in enumerate(lines) if plain[i] and path[at - 2] in x.path and path[at - 1] not in x.path]
        if len(here) > 1 and not (more and all(lines[i].heading and i < here[0] for i in more)) and page.kind[path[at - 1]] != "body":
            if not any(page.kind[n] in ("article", "main") for n in path[: at - 1]):
                break
        at -= 1
    inside = [i for i, x in enumerate(lines) if plain[i] and (not path or path[max(0, at - 1)] in x.path)]
    menu: set[int] = set()
    run: list[int] = []
    for i in [*inside, -1]:
        if i >= 0 and lines[i].links >= LINKED * len(lines[i].text) and math.log1p(len(lines[i].text) / max(1, lines[i].tags)) < least:
            run.append(i)
            continue
        if len(run) >= RUN:
            menu.update(run)
        run = []
    return [lines[i].text for i in inside if i not in menu]


def main_text(html: str | None) -> str:
    """The page's main text in one line."""
    return " ".join(region(Lines().read(html))) if html else ""


def extract(pages: DataFrame, html: Column, keep: tuple[str, ...]) -> DataFrame:
    """keep's columns with text and n_chars, its code points; no shuffle."""
    kept = pages.select(*keep, html.alias("_html"))
    schema = StructType([*(kept.schema[c] for c in keep)]).add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, len(keep)):
                texts = [main_text(t) for t in p.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(p.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return arrow(kept, run, schema)


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    """The contract's main texts of pages."""
    return extract(table(spark, sf_dir, "pages"), F.col("html"), ("page_id", "url"))
