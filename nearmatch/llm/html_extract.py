"""Main-text extraction from HTML pages.

Method: events of the standard library's streaming parser are cut into lines
at block tags. A line's ratio is its text outside links over its tags. Ratios
are smoothed by a Gaussian; lines over a threshold taken from the page's own
smoothed ratios make clusters, and clusters are the content regions. An article
or main element is a hint: within one, a line needs but ``HINT`` of the threshold,
so that short paragraphs stay and lists of links go; outside, clusters are closed
over gaps of few lines and don't begin or end with lines that have less than
``EDGE`` of the threshold but for their neighbours. Where such elements hold at least half of the clusters' text,
clusters outside of them go; else (teasers, widgets) all clusters count.

Elements whose tag, class, id or role names a menu, header, footer, sidebar,
notice, advert, form or reader comment become one empty line. Those whose end
tag can be left out end where HTML ends them; of others that are never closed,
nothing is known to belong to them: the page is read again without skipping
them. A form with over half of a page's text, or with an article or main
element, is the page and not a form.

Null and empty html give an empty text, and no markup fails: what is no HTML is
text or nothing, as browsers have it; repeated rows give repeated results;
columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nearmatch.llm.common import table, text_batches

# Element names that never hold main text.
SKIPPED = frozenset(
    "aside button canvas dialog embed fieldset footer head header iframe input label menu nav noframes noscript object option script select style svg template textarea title".split()
)
# Elements that start and end a line.
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role attributes that mark what is not main text.
BOILERPLATE = frozenset(
    "ad ads adv advert advertisement adsense alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe toc toolbar widget widgets".split()
)
CONTAINERS = frozenset(("article", "main"))
_CELLS = frozenset("td th tr tbody tfoot thead".split())
# Of elements whose end tag can be left out, the start tags that end them.
ENDED_BY = {
    "p": _CELLS
    | frozenset(
        "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
    ),
    "li": _CELLS | {"li"},
    "dt": _CELLS | {"dt", "dd"},
    "dd": _CELLS | {"dt", "dd"},
    "option": frozenset(("option", "optgroup")),
    "td": _CELLS,
    "th": _CELLS,
    "tr": _CELLS - {"td", "th"},
    "tbody": _CELLS - {"td", "th", "tr"},
    "tfoot": _CELLS - {"td", "th", "tr"},
    "thead": _CELLS - {"td", "th", "tr"},
}
ENDING = frozenset().union(*ENDED_BY.values())
#: By a start tag, the elements that it ends.
ENDS = {tag: tuple(name for name, tags in ENDED_BY.items() if tag in tags) for tag in ENDING}
_LISTED = frozenset("article aside blockquote button details dir dl fieldset figure footer form header main menu nav object ol section select table td template th ul".split())
# Elements in which a start tag ends none of those around them.
KEPT_BY = {
    "p": frozenset("button caption object table td template th".split()),
    "li": _LISTED,
    "dt": _LISTED,
    "dd": _LISTED,
    "option": frozenset(("select",)),
} | dict.fromkeys(_CELLS, frozenset(("table", "template")))
#: Elements that are followed inside a skipped one.
FOLLOWED = BLOCKS | SKIPPED | ENDING
# Of these, the words that also rule out an article or main element.
OTHERS = frozenset("ad ads advert advertisement comment comments promo promoted related replies respond sponsor sponsored".split())
SIGMA = 1.5
#: Clusters this many lines apart are one.
GAP = 3
#: Of the threshold, what lines of an article or main element need.
HINT = 0.02
#: Of the threshold, what the first and last lines of a cluster outside need of their own.
EDGE = 0.1
#: Times that a page is read again for elements left open, before these end with the block around them; as often again, before none but RAW ones are skipped.
AGAIN = 4
# Of the skipped elements, those whose content is no text of the page even where their end is missing.
RAW = frozenset("canvas embed iframe input noframes noscript object option script select style svg template textarea title".split())

_NAMES = re.compile(r"[a-z0-9]+")
_WEIGHTS = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-4, 5)]


class _Line(NamedTuple):
    text: str  # empty: something skipped
    ratio: float
    container: int  # 0: none
    form: int  # 0: none


class _Lines(HTMLParser):
    """Collects the lines of a page, in time that grows with its length, however its elements are nested.

    open_: the start tags, by their numbers, of elements that aren't to be skipped, as their ends are missing; None: all but RAW ones.
    strict: a skipped element ends with any block around it.
    """

    def __init__(self, open_: frozenset[int] | None = frozenset(), strict: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.open_, self.strict = open_, strict
        self.lines: list[_Line] = []
        self.parts: list[str] = []
        self.linked = 0  # characters in links
        self.links = 0  # links that are open
        self.tags = 0
        self.skip_tag = ""
        self.n_starts = 0
        self.left_open: set[int] = set()
        self.inner: list[tuple[str, int]] = []  # the skipped element and what is open in it, with the numbers of their start tags
        self.at: dict[str, list[int]] = {}  # places in inner by name
        self.open: list[str] = []  # the blocks around, without paragraphs
        self.n_open: Counter[str] = Counter()
        self.containers: list[int] = []
        self.n_containers = 0
        self.form = self.n_forms = 0
        self.forms_with_containers: set[int] = set()

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                plain = max(0, len(text) - self.linked)
                self.lines.append(_Line(text, plain / max(1, self.tags), self.containers[-1] if self.containers else 0, self.form))
                self.tags = 0
            self.parts, self.linked = [], 0

    def gap(self) -> None:
        """A line for what is skipped."""
        if self.lines and self.lines[-1].text:
            self.lines.append(_Line("", 0.0, 0, 0))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Browsers drop <![...> up to its end; the parser's own version knows few kinds and fails on others."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def push(self, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.inner))
        self.inner.append((tag, self.n_starts))

    def cut(self, place: int) -> None:
        """End what is open in the skipped element from a place on, and that element if it is the first."""
        while len(self.inner) > place:
            self.at[self.inner.pop()[0]].pop()
        if not self.inner:
            self.skip_tag = ""

    def end_implied(self, tag: str) -> None:
        """Close what the start of tag ends in the skipped element, and that element if it is ended too."""
        place = len(self.inner)
        for name in ENDS[tag]:
            if places := self.at.get(name):
                # those with nothing above them that keeps them
                kept = max((at[-1] for k in KEPT_BY[name] if (at := self.at.get(k))), default=0)
                if (i := bisect_left(places, kept)) < len(places):
                    place = min(place, places[i])
        self.cut(place)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.n_starts += 1
        if self.skip_tag and tag in ENDING:
            self.end_implied(tag)
        if self.skip_tag:
            if tag not in VOID and (tag in FOLLOWED or tag == self.skip_tag):
                self.push(tag)
            return
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.flush()
            self.tags += 1
            return
        if tag in SKIPPED or attrs and tag not in ("html", "body") and is_boilerplate(tag, attrs):
            if tag in RAW or self.open_ is not None and self.n_starts not in self.open_:
                self.flush()
                self.gap()
                self.skip_tag = tag
                self.push(tag)
                return
            tag = "div" if tag in SKIPPED else tag
        if tag == "form":
            self.flush()
            self.n_forms += 1
            self.form = self.n_forms
        elif tag == "a":
            self.links += 1
        if tag in BLOCKS:
            self.flush()
            if tag != "p":
                if self.open and tag in ENDED_BY.get(self.open[-1], ()):
                    self.n_open[self.open.pop()] -= 1
                self.open.append(tag)
                self.n_open[tag] += 1
            if tag in CONTAINERS:
                self.n_containers += 1
                self.containers.append(self.n_containers)
                self.forms_with_containers.add(self.form)
        self.tags += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # browsers ignore the slash of <div/>; for svg and the like it ends the element
            if not self.skip_tag:
                self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        if self.skip_tag:
            if places := self.at.get(tag):
                self.cut(places[-1])
            elif self.strict and self.n_open[tag]:
                self.cut(0)
                self.handle_endtag(tag)
            elif tag in ("body", "html") or tag in CONTAINERS and self.skip_tag not in CONTAINERS and self.containers or self.skip_tag in ENDED_BY and self.n_open[tag]:
                self.note_open()
                self.cut(0)  # an element left open ends with what holds it
                self.handle_endtag(tag)
            return
        if tag in BLOCKS:
            self.flush()
            if self.n_open[tag]:
                while (last := self.open.pop()) != tag:
                    self.n_open[last] -= 1
                self.n_open[tag] -= 1
            if tag in CONTAINERS and self.containers:
                self.containers.pop()
        elif tag == "form":
            self.flush()
            self.form = 0
        elif tag == "a":
            self.links = max(0, self.links - 1)
        self.tags += 1

    def handle_data(self, data: str) -> None:
        if not self.skip_tag:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self.note_open()
        self.flush()

    def note_open(self) -> None:
        """The skipped element has no end, and nothing that is still open in it has."""
        if self.skip_tag and self.skip_tag not in ENDED_BY and self.skip_tag not in RAW:
            self.left_open.update(n for name, n in self.inner if name not in ENDED_BY and name not in RAW)


@lru_cache(maxsize=10_000)
def names_boilerplate(value: str, container: bool) -> bool:
    """Whether a class, id or role says that its element isn't main text. That a page has a sidebar, or none, says nothing."""
    words: set[str] = set()
    for name in value.lower().split():
        parts = _NAMES.findall(name)
        if parts and parts[0] not in ("has", "no", "with", "without"):
            words.update(parts)
    return not (OTHERS if container else BOILERPLATE).isdisjoint(words)


def is_boilerplate(tag: str, attrs: list) -> bool:
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if value and name in ("class", "id", "role") and names_boilerplate(value, tag in CONTAINERS):
            return True
    return False


def smooth(ratios: list[float]) -> list[float]:
    """Gaussian smoothing; weights beyond the ends are left out and the rest scaled up."""
    n, out = len(ratios), []
    for i in range(n):
        total = weight = 0.0
        for k, w in enumerate(_WEIGHTS, i - 4):
            if 0 <= k < n:
                total += w * ratios[k]
                weight += w
        out.append(total / weight)
    return out


def without_forms(lines: list[_Line], pages: set[int]) -> list[_Line]:
    """Lines that aren't in a form; forms in pages, and one with over half of all text, are none."""
    sizes: dict[int, int] = {}
    for x in lines:
        sizes[x.form] = sizes.get(x.form, 0) + len(x.text)
    total = sum(sizes.values())
    kept = {f for f, n in sizes.items() if f == 0 or f in pages or 2 * n > total}
    return [x for x in lines if x.form in kept]


def select(lines: list[_Line]) -> list[str]:
    """The lines of the content regions, in page order."""
    if not any(x.text for x in lines):
        return []
    smoothed = smooth([x.ratio for x in lines])
    mean = sum(smoothed) / len(smoothed)
    spread = math.sqrt(sum((x - mean) ** 2 for x in smoothed) / len(smoothed))
    limit = min(mean, spread) if spread > 1e-9 * mean else 0.0
    inside = [i for i, x in enumerate(lines) if x.text and x.container and smoothed[i] >= HINT * limit]
    above = [bool(x.text) and not x.container and smoothed[i] >= limit for i, x in enumerate(lines)]
    # clusters outside of containers: between lines that have enough of their own
    strong = [i for i, ok in enumerate(above) if ok and lines[i].ratio >= EDGE * limit] or [i for i, ok in enumerate(above) if ok]
    outside: set[int] = set(strong)
    for i, j in zip(strong, strong[1:]):
        between = range(i + 1, j)
        if all(not lines[k].container for k in between) and (all(above[k] for k in between) or all(lines[k].text for k in between) and j - i <= GAP):
            outside.update(between)
    size = lambda places: sum(len(lines[k].text) for k in places)
    kept = inside if size(inside) >= size(outside) else sorted({*inside, *outside})
    return [lines[k].text for k in kept]


def ended(html: str) -> str:
    """A page without the tags that no > ends: what follows the last one starts no tag. The parser would look for their ends again and again."""
    last = html.rfind(">")
    tail = html[last + 1 :]
    return html if tail.count("<") < 2 else html[: last + 1] + re.sub(r"<(?=[a-zA-Z/!?])[^<]*", " ", tail)


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    html = ended(html)
    open_: frozenset[int] | None = frozenset()
    for turn in range(2 * AGAIN + 2):
        parser = _Lines(open_, strict=turn >= AGAIN)
        parser.feed(html)
        parser.close()
        if not parser.left_open:
            break
        open_ = None if turn == 2 * AGAIN else frozenset() if turn == AGAIN - 1 else open_ | parser.left_open
    return " ".join(select(without_forms(parser.lines, parser.forms_with_containers - {0})))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    source = pages.select("page_id", "url", "html")
    id_type = source.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars bigint")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return extract_pages(table(spark, sf_dir, "pages"))
