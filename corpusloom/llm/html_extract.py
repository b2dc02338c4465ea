"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

The standard library's parser streams events; block boundaries cut the page into lines, each with
its text and the number of tags met since the line before. The ratio of characters to tags of each
line is smoothed along the page with a Gaussian and scored: regions (never headings, paragraphs or what
stands within a line) whose names speak of boilerplate and of nothing else count for a part only, as do lines that
are mostly links. Two-means clustering of the scores gives a threshold, and
the smallest region that holds all text above it is the main one. A page that is boilerplate by name as a whole
loses nothing, as only the relation of its scores counts.

Within the main region a line of named boilerplate stays only above the threshold, and a line that is mostly
links stays above it, in an article, or where it is not one of LIST such lines in a row; so short paragraphs and
headings stay. <article> and <main> are a check on the region: one found within them grows to the
whole, and below the threshold no line outside of them stays; an article without a line above the threshold that is mostly
links (the card of another story) goes. What HTML itself calls navigation, footers, asides, controls, scripts and
styles never takes part; a form does where the page's own structure lies in it. Of a page's header only
its heading stays, and only where the main region does not start with one.

Defined results: null or empty html gives the empty text; broken or cut markup is read as far as it
goes; pages of any length and depth are read whole, in time proportional to them; a null page_id or url is passed on;
repeated rows give repeated rows; an empty table gives no rows; columns other than
those named are not read, so clashing names do no harm.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

#: Fixed values of HTML: elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed values of HTML: elements that start and end a line of the page.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never part of the article: menus, sidebars, controls, scripts, styles, titles of drawings.
DROPPED = frozenset("head nav footer aside script style noscript template iframe button select textarea dialog menu title desc".split())
#: Roles that say the same of any element that holds others.
DROPPED_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar toolbar".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that hold a region of the page.
REGIONS = frozenset(("article", "main", "section", "div", "td", "body", "blockquote", "form"))
#: Elements that speak of boilerplate by their names: those that hold blocks.
HOLDERS = REGIONS - {"body", "blockquote", "form"} | {"ul", "ol", "dl", "li", "table", "fieldset", "details", "figure", "center"}
#: Elements that show that a form holds the page itself.
STRUCTURE = frozenset(("article", "main", "nav", "header", "footer", "h1"))
#: Words in class and id that name boilerplate.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer masthead comment "
    "comments disqus respond replies reply share sharing social related recommended toolbar pagination pager skip "
    "copyright disclaimer search".split()
)
#: Words that say nothing beside these.
PLAIN = frozenset(
    "main primary secondary top bottom left right upper lower inner outer box block bar area panel wrap wrapper container "
    "holder section list item items row col column group button buttons link links text title post posts page site "
    "story stories article articles form inline small large fixed sticky slot unit thread body content header us".split()
)
KEEP, DROP, HEADINGS_ONLY, PAGE_HEADER, SILENT = 0, 1, 2, 3, 4  # SILENT: dropped within a line, so its text is not even part of one
#: What a score counts for in a region named boilerplate, and in a line that is mostly links.
NAMED, LINKED = 0.4, 0.6
#: Lines of links in a row that make a list.
LIST = 3
#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0
_KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-3, 4)]


class Line(NamedTuple):
    """A line: text, tags before it, state, region, declared region (0: none), is a heading, linked characters, whether its region is named boilerplate, form."""

    text: str
    tags: int
    state: int
    region: int
    declared: int
    heading: bool
    linked: int
    named: bool
    form: int


def names_boilerplate(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether a class or id is made of words for boilerplate, and of others that say nothing; of articles only reader comments are told so."""
    for name, value in attrs:
        if name in ("class", "id") and value:
            for word in value.split():
                parts = {p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\dA-Za-z_]+", word)}
                if tag in ("article", "main"):
                    if parts & {"comment", "comments", "reply"}:
                        return True
                elif parts & HINTS and parts <= HINTS | PLAIN:
                    return True
    return False


class PageLines(HTMLParser):
    """Collects the lines of a page. Regions have numbers in the order of their start tags, so a region holds those up to its last."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents, self.last = [0], [0]
        self.articles: set[int] = set()
        self.page_forms: set[int] = set()
        self._open: list[tuple[str, int, int, int, bool, int]] = [("", KEEP, 0, 0, False, 0)]
        self._names: Counter[str] = Counter()
        self._parts: list[str] = []
        self._tags = 0
        self._heading = False
        self._linked = self._links = 0

    def _flush(self) -> None:
        text = " ".join("".join(self._parts).split()) if self._parts else ""
        if text:
            _, state, region, declared, named, form = self._open[-1]
            self.lines.append(Line(text, self._tags, state, region, declared, self._heading, self._linked, named, form))
            self._tags = 0
        self._parts = []
        self._linked = 0

    def _close(self, names: tuple[str, ...], fences: frozenset[str]) -> None:
        """Close the innermost open element of these names unless an element of `fences` stands above it."""
        if not any(self._names[n] for n in names):
            return
        for i in range(len(self._open) - 1, 0, -1):
            tag = self._open[i][0]
            if tag in names:
                for gone in self._open[i:]:
                    self._names[gone[0]] -= 1
                    if gone[0] in REGIONS:
                        self.last[gone[2]] = len(self.parents) - 1
                del self._open[i:]
                return
            if tag in fences:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag == "br":
            self._parts.append(" ")
            return
        if tag in BLOCK:
            self._flush()
            self._links = 0
            if tag == "li":
                self._close(("li",), frozenset(("ul", "ol", "menu")) | REGIONS)
            elif tag in ("td", "th"):
                self._close(("td", "th"), frozenset(("tr", "table")))
            elif tag == "tr":
                self._close(("tr",), frozenset(("table",)))
            elif tag in ("dd", "dt"):
                self._close(("dd", "dt"), frozenset(("dl",)))
            elif tag == "body":
                self._close(("head",), frozenset())
            if tag not in ("html", "head", "body"):
                self._close(("p",), REGIONS)
            self._heading = tag in HEADINGS
        if tag in VOID:
            return
        if tag == "a":
            self._links = 1
        _, state, region, declared, named, form = self._open[-1]
        given = dict(attrs) if attrs else {}
        if tag in STRUCTURE and form:
            self.page_forms.add(form)
        if state in (KEEP, HEADINGS_ONLY, PAGE_HEADER):
            if tag in DROPPED or tag in HOLDERS and ("hidden" in given or given.get("role") in DROPPED_ROLES):
                state = DROP if tag in BLOCK else SILENT
            elif tag == "header" and state == KEEP:
                state = HEADINGS_ONLY if declared else PAGE_HEADER
            elif tag in HOLDERS and attrs and names_boilerplate(tag, attrs):
                named = True
        if tag in REGIONS:
            self.parents.append(region)
            region = len(self.parents) - 1
            self.last.append(region)
            if tag == "form":
                form = region
            if not declared and (tag in ("article", "main") or given.get("role") in ("main", "article")):
                declared = region
                if tag == "article" or given.get("role") == "article":
                    self.articles.add(region)
            elif tag == "article":
                self.articles.add(region)
                if declared not in self.articles:
                    declared = region  # the article is what a <main> around it declares
        self._open.append((tag, state, region, declared, named, form))
        self._names[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCK:
            self._flush()
        if tag == "br":
            self._parts.append(" ")
        elif tag == "a":
            self._links = 0
        self._close((tag,), frozenset() if tag in REGIONS or tag in DROPPED or tag in ("html", "header", "table") else REGIONS)
        if tag in HEADINGS:
            self._heading = False

    def handle_data(self, data: str) -> None:
        if self._open[-1][1] != SILENT:
            self._parts.append(data)
            if self._links:
                self._linked += len(data)

    def close(self) -> None:
        super().close()
        self._flush()
        for left in self._open:
            if left[0] in REGIONS:
                self.last[left[2]] = len(self.parents) - 1
        self.last[0] = len(self.parents) - 1


def _smoothed(ratios: list[float]) -> list[float]:
    out, n = [], len(ratios)
    for i in range(n):
        total = weight = 0.0
        for d, k in enumerate(_KERNEL, -3):
            if 0 <= i + d < n:
                total += k * ratios[i + d]
                weight += k
        out.append(total / weight)
    return out


def _threshold(values: list[float]) -> float:
    """Two-means on the line: the middle between the centres of the low and of the high cluster."""
    low, high = min(values), max(values)
    for _ in range(16):
        cut = (low + high) / 2
        below = [v for v in values if v < cut]
        above = [v for v in values if v >= cut]
        if not below or not above:
            break
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _mostly_links(line: Line) -> bool:
    return line.linked * 2 > len(line.text)


def main_text(html: str | None) -> str:
    """The main text of a page, one line for each block."""
    if not html:
        return ""
    page = PageLines()
    page.feed(html)
    page.close()
    lines = page.lines
    live = [i for i, x in enumerate(lines) if (x.state == KEEP or x.state == HEADINGS_ONLY and x.heading) and (not x.form or x.form in page.page_forms)]
    if not live:
        return ""
    smooth = _smoothed([math.log1p(len(x.text) / max(1, x.tags)) for x in lines])
    score = [s * (NAMED if x.named else 1) * (LINKED if _mostly_links(x) else 1) for s, x in zip(smooth, lines)]
    cut = _threshold(score)
    dense = [i for i in live if score[i] >= cut] or live
    top = _region_of(dense, lines, page)
    # the added check: a region within an article that says so grows to the whole of it
    declared = {lines[i].declared for i in live} - {0}
    above = [r for r in declared if r <= top <= page.last[r]]
    top = min(above, default=top)
    cards = _cards(live, lines, set(dense), page)
    listed = _in_lists(live, lines)
    chosen = []
    for i in live:
        x, above_cut = lines[i], score[i] >= cut
        inside = top <= x.region <= page.last[top]
        if x.declared in cards or x.named and not above_cut:
            continue
        if x.declared in page.articles:
            fit = inside or above_cut or not _mostly_links(x)
        elif x.declared:
            fit = above_cut or i not in listed and (inside or not _mostly_links(x))
        else:
            fit = inside and (above_cut or not (_mostly_links(x) or declared))
        if fit:
            chosen.append(i)
    at = set(chosen)
    heads = [i for i in live if lines[i].heading and i not in at and not lines[i].named and any(j in at for j in range(i + 1, min(i + 3, len(lines))))]
    out = sorted(chosen + heads)
    if out and not lines[out[0]].heading:
        out = [i for i in range(out[0]) if lines[i].state == PAGE_HEADER and lines[i].heading][-1:] + out
    return "\n".join(lines[i].text for i in out)


def _cards(live: list[int], lines: list[Line], dense: set[int], page: PageLines) -> set[int]:
    """Articles without a line above the threshold that are mostly links, where another article has such a line."""
    size, linked, strong = Counter(), Counter(), set()
    for i in live:
        at = lines[i].declared
        if at in page.articles:
            size[at] += len(lines[i].text)
            linked[at] += lines[i].linked
            if i in dense:
                strong.add(at)
    return {r for r in size if strong and r not in strong and linked[r] * 2 > size[r]}


def _in_lists(live: list[int], lines: list[Line]) -> set[int]:
    """Lines that are mostly links among LIST such lines in a row or more."""
    out: set[int] = set()
    run: list[int] = []
    for i in [*live, None]:
        if i is not None and _mostly_links(lines[i]) and (not run or lines[i].region >= lines[run[0]].region):
            run.append(i)
            continue
        if len(run) >= LIST:
            out.update(run)
        run = [i] if i is not None and _mostly_links(lines[i]) else []
    return out


def _region_of(dense: list[int], lines: list[Line], page: PageLines) -> int:
    """The smallest region that holds all dense lines."""
    found = [lines[i].region for i in dense]
    top, final = min(found), max(found)
    while page.last[top] < final:
        top = page.parents[top]
    return top


def extract_main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page: key, url, text and n_chars (code points). One narrow pass, no shuffle."""
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["_key", "_url", "text", "n_chars"],
            )

    out = rows.mapInArrow(run, f"_key {kind}, _url string, text string, n_chars bigint")
    return out.withColumnsRenamed({"_key": key, "_url": url})


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
ORACLES: dict[str, str] = {}
