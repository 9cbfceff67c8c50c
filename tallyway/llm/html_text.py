"""Main text of web pages: text-to-tag ratios over the events of the standard library's streaming parser.

The parser's events become lines: a line is the text between two boundaries of block elements, whatever line feeds the source has (many
pages are one line of source), with references decoded and each run of white space one space. Elements that never hold an
article's own words, by their tag, role or class, are passed over as they stream by. Each line's ratio is its characters outside
links by the tags met since the line before; ratios are smoothed with a Gaussian along the page and cut at their standard deviation,
which clusters lines into content and the rest. The content region is the article or main element with most of the content,
or without one the innermost element that holds two thirds of it; all lines of the region are text, short ones too, but for lists
of links, and in a region without such an element for the lines before the first and after the last of the content cluster.

Defined results: a page whose html is null, empty or without content has the text '' of 0 characters. References that name nothing stay
as they are written; unclosed and misnested elements are closed by the next boundary that must close them. Very long pages are taken
whole. Repeated rows each give a row, null ids and urls stay null, other columns don't matter, an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, of blocks, and that are never an article's own words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead "
    "title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head iframe input label legend menu meter nav noembed noframes noscript "
    "object optgroup option output progress rp rt script search select style svg template textarea title video".split()
)
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Elements that a start tag closes, if one is open since the last element that scopes it.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "body": ("head",), "article": ("head",), "main": ("head",),
}
SCOPES = frozenset("ul ol dl table article aside main section nav body".split())
#: Parts of class names and ids of what surrounds an article: never part of one, and names of the layout, which may also enclose it.
NEVER = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner comment comments commentlist consent cookie cookies discussion disqus gdpr "
    "modal newsletter notice notices outbrain overlay popup promo promos promotion promotions recommended related reply respond share sharing "
    "sharebar social sponsor sponsored subscribe subscription taboola".split()
)
LAYOUT = frozenset("aside breadcrumb breadcrumbs footer header masthead menu nav navbar navigation pager pagination search sidebar sidenav toolbar topbar".split())
#: Class names that begin so say what surrounds the element and not what it is; those with such a part name an article's own header.
STATES, OWN = frozenset("has no with without is not".split()), frozenset("article content entry post section story".split())
UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
PART = re.compile(r"[^a-z0-9]+")
#: Standard deviation of the Gaussian in lines, and how far it reaches.
SIGMA, REACH = 1.0, 2
#: Share of the content that the innermost region holds, and of a list's characters that are links.
MOST, LINKED = 2 / 3, 2 / 3


@dataclass
class Line:
    text: str
    tags: int
    link_chars: int
    links: int
    box: int
    tag: str


@dataclass
class Box:
    tag: str
    parent: int


@dataclass
class Open:
    tag: str
    drops: str  # why its content isn't text: "", "never" or "layout"
    box: int


@dataclass
class Page:
    lines: list[Line] = field(default_factory=list)
    boxes: list[Box] = field(default_factory=lambda: [Box("", -1)])


def named(attrs: dict[str, str | None]) -> str:
    """Whether class or id say that the element is never part of an article, or layout: "never", "layout" or ""."""
    found = ""
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split():
        parts = PART.split(name)
        if parts[0] in STATES:
            continue
        if not NEVER.isdisjoint(parts):
            return "never"
        if not LAYOUT.isdisjoint(parts) and not ("header" in parts and not OWN.isdisjoint(parts)):
            found = "layout"
    return found


class Reader(HTMLParser):
    """Turns the events of one page into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open: list[Open] = [Open("", "", 0)]
        self.parts: list[str] = []
        self.tags = self.link_chars = self.links = self.depth = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # places in the source aren't asked for

    def parse_html_declaration(self, i: int) -> int:
        """Sections that only XML has are comments here, so that no markup raises."""
        return self.parse_bogus_comment(i) if self.rawdata[i : i + 3] == "<![" else super().parse_html_declaration(i)

    def boundary(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.open[-1]
            self.page.lines.append(Line(text, self.tags, min(self.link_chars, len(text)), self.links, top.box, next((o.tag for o in reversed(self.open) if o.tag in BLOCK), "")))
            self.tags = 0
        self.parts, self.link_chars, self.links = [], 0, 0

    def dropped(self, tag: str, attrs: dict[str, str | None]) -> str:
        held = self.open[-1].drops
        if tag in ("html", "body"):
            return ""
        own = named(attrs)
        if tag in ("article", "main"):
            return "never" if held == "never" or (tag == "article" and own == "never") else ""
        if held:
            return held
        if tag == "header":  # an article's own header holds its title
            return "" if any(o.tag in ("article", "main") for o in self.open) and own != "never" else "layout"
        if tag == "form":
            return "layout"
        if tag in DROPPED or "hidden" in attrs or re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I):
            return "never"
        return own or ("layout" if (attrs.get("role") or "").lower() in DROPPED_ROLES else "")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.boundary()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCK:
            self.boundary()
            self.closes(tag)
        about = dict(attrs)
        drops, box = self.dropped(tag, about), self.open[-1].box
        if tag in BLOCK and not drops:
            self.page.boxes.append(Box(tag, box))
            box = len(self.page.boxes) - 1
        if tag == "a" and not drops:
            self.depth += 1
            self.links += 1
        self.open.append(Open(tag, drops, box))

    def closes(self, tag: str) -> None:
        """Ends what the start of a block ends without saying so: a paragraph, or the item before."""
        wanted = CLOSES.get(tag, ()) + ("p",)
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in wanted:
                self.pop(k)
                if self.open[-1].tag not in wanted:
                    return
            elif self.open[k].tag in SCOPES or self.open[k].tag in BLOCK:
                return

    def pop(self, k: int) -> None:
        self.depth = max(0, self.depth - sum(o.tag == "a" and not o.drops for o in self.open[k:]))
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.boundary()
        elif tag == "br":
            self.parts.append(" ")
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self.pop(k)
                return
            if self.open[k].tag in BLOCK and (tag not in BLOCK or self.open[k].tag in SCOPES and tag in ("p", "li")):
                return  # an inline end tag closes nothing beyond the block it stands in

    def handle_data(self, data: str) -> None:
        if self.open[-1].drops:
            return
        self.parts.append(data)
        if self.depth:
            self.link_chars += len(" ".join(data.split()))


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian average along the page; beyond its ends there is nothing."""
    at = np.arange(-REACH, REACH + 1)
    kernel = np.exp(-(at**2) / (2 * SIGMA**2))
    return np.convolve(ratios, kernel / kernel.sum())[REACH:-REACH]


def clustered(lines: list[Line]) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are of the content cluster, with smoothed ratios at least as high as their standard deviation and not zero, and which are so by themselves."""
    ratios = np.array([(len(x.text) - x.link_chars) / max(1, x.tags) for x in lines])
    height = smoothed(ratios)
    least = height.std()
    return (height >= least) & (height > 0), (ratios >= least) & (ratios > 0)


def paths(page: Page) -> list[tuple[int, ...]]:
    """The boxes around each box, itself first."""
    out: list[tuple[int, ...]] = []
    for k, box in enumerate(page.boxes):
        out.append((k, *out[box.parent]) if box.parent >= 0 else (k,))
    return out


def region(page: Page, content: np.ndarray, around: list[tuple[int, ...]]) -> tuple[int, bool]:
    """The box whose lines are the text, and whether its tag says that it is an article."""
    weight, size = [0] * len(page.boxes), [0] * len(page.boxes)
    for line, good in zip(page.lines, content.tolist(), strict=True):
        for b in around[line.box]:
            weight[b] += len(line.text) if good else 0
            size[b] += len(line.text)
    said = [b for b, box in enumerate(page.boxes) if box.tag == "article" and size[b]]
    whole = [b for b, box in enumerate(page.boxes) if box.tag == "main" and size[b]]
    best = max(said, key=lambda b: (weight[b], size[b], -b), default=None)
    main = max(whole, key=lambda b: (weight[b], size[b], -b), default=None)
    if best is not None and main is not None and main in around[best] and 2 * weight[best] < weight[main]:
        best = None  # one of many
    best = main if best is None else best
    if best is not None and 5 * size[best] >= weight[0] - weight[best]:
        return best, True
    held = [b for b in range(len(page.boxes)) if weight[b] >= MOST * weight[0]]
    return max(held, key=lambda b: (len(around[b]), -b)), False


def menus(page: Page, alone: np.ndarray, around: list[tuple[int, ...]], top: int) -> set[int]:
    """Boxes inside ``top`` that are lists of links: none of their lines is content by itself, two or more links, and little else."""
    size: dict[int, list[int]] = {}
    for line, good in zip(page.lines, alone.tolist(), strict=True):
        for b in around[line.box]:
            if b == top:
                break
            told = size.setdefault(b, [0, 0, 0, 0])
            for k, v in enumerate((len(line.text), line.link_chars, line.links, int(good))):
                told[k] += v
    lists = {"ul", "ol", "dl", "div", "section", "table", "tr", "tbody"}
    return {b for b, (chars, linked, links, good) in size.items() if page.boxes[b].tag in lists and links >= 2 and not good and linked >= LINKED * chars}


def main_text(html: str | None) -> str:
    """The main text of one page, blocks apart by an empty line."""
    if not html:
        return ""
    reader = Reader()
    reader.feed(html)
    if UNFINISHED.match(reader.rawdata):  # markup that the page ends in is no text
        reader.rawdata = ""
    reader.close()
    reader.boundary()
    page = reader.page
    if not page.lines:
        return ""
    (content, alone), around = clustered(page.lines), paths(page)
    top, told = region(page, content, around)
    if not told and not content.any():
        return ""
    kept = [k for k, x in enumerate(page.lines) if top in around[x.box]]
    if not told:
        first, last = (f(k for k in kept if content[k]) for f in (min, max))
        while first - 1 in kept and page.lines[first - 1].tag in HEADINGS:
            first -= 1
        kept = [k for k in kept if first <= k <= last]
    left = menus(page, alone, around, top)
    return "\n\n".join(page.lines[k].text for k in kept if left.isdisjoint(around[page.lines[k].box]))


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) of every page; page by page in tasks, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
