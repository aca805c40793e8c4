"""Main text of web pages: parser events, text-to-tag ratios per line, smoothing, clustering.

The standard parser's events are cut into lines at block elements. Each line has
its text and its number of tags; the ratios are smoothed with a Gaussian over
neighbouring lines and split into two clusters. The lines of the upper cluster
say where the page has its content; the region is the innermost element that
holds all of them and the headings before them, and its blocks, also the short
ones, are the text. Elements
that are boilerplate by their kind, role or name are left out throughout; a name
says nothing where its elements hold most of the upper cluster.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclabel.session import ship_package

SIGMA, MOST = 1.0, 0.5

# Elements without readable text, boilerplate elements, elements that end a line, and names of boilerplate.
SILENT = frozenset("script style template noscript head title iframe object svg math canvas audio video select datalist textarea button map".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset".split())
CONTAINERS = frozenset("html body main article section div header figure blockquote details table tbody thead tfoot tr td th ul ol li dl dd dt center".split()) | BOILERPLATE
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 hr pre address hgroup figcaption summary caption legend option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disqus footer masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo "
    "promoted recommended related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe subscription topbar toolbar widget".split())
# Words that leave a name of boilerplate what it is: site-footer, comments-area.
AROUND = frozenset(
    "area articles bar block bottom box button buttons container content foot form global head header icon icons inner item items label left link links list main media "
    "module outer panel posts primary right secondary section site slot stories text title toggle top unit wrap wrapper".split())
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_END_OF = {"li": ("ul", "ol"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


@lru_cache(4096)
def _names_boilerplate(token: str) -> bool:
    """The whole class or id names boilerplate: has-sidebar and page-with-comments name what has it."""
    words = {w.lower() for w in _WORD.findall(token)}
    return bool(words & NAMES) and words <= NAMES | AROUND


class Element:
    """A container on the way from the page to a line; ``names`` are those of its classes and id that name boilerplate."""

    __slots__ = ("tag", "parent", "dropped", "names", "depth")

    def __init__(self, tag: str, parent: Element | None, dropped: bool, names: frozenset[str]):
        self.tag, self.parent, self.dropped, self.names = tag, parent, dropped, names
        self.depth = parent.depth + 1 if parent else 0


class Lines(HTMLParser):
    """Collects lines: (element, text, tags, characters in links), and the numbers of those that are headings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.here = Element("", None, False, frozenset())
        self.lines: list[tuple[Element, str, int, int]] = []
        self.headings: set[int] = set()
        self.heading = False
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.silent: list[str] = []
        self.in_link = False

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            if self.heading:
                self.headings.add(len(self.lines))
            self.lines.append((self.here, text, self.tags, self.linked))
        self.text, self.tags, self.linked = [], 0, 0

    def _boilerplate(self, tag: str, attrs) -> tuple[bool, frozenset[str]]:
        """Left out for its kind or role; its names of boilerplate."""
        given = {k: v or "" for k, v in attrs}
        if tag in BOILERPLATE or given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden") == "true":
            return True, frozenset()
        if "display:none" in given.get("style", "").replace(" ", "").lower():
            return True, frozenset()
        inside = self.here
        while inside is not None and inside.tag not in ("article", "main"):
            inside = inside.parent
        if tag == "header":
            return inside is None, frozenset()
        if tag in ("html", "body", "main", "article"):
            return False, frozenset()
        return False, frozenset(t for t in [*given.get("class", "").split(), given.get("id", "")] if _names_boilerplate(t))

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.append(tag)
            return
        if tag in SILENT:
            if tag in BLOCKS:
                self._end_line()
            self.silent.append(tag)
            return
        if tag in BLOCKS:
            self._end_line()
            self.in_link, self.heading = False, tag in HEADINGS
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.in_link = True
        elif tag in CONTAINERS:
            if tag in _END_OF:  # an open sibling ends here
                near = self.here
                while near.tag and near.tag not in _END_OF[tag]:
                    if near.tag == tag or {near.tag, tag} in ({"dd", "dt"}, {"td", "th"}):
                        self.here = near.parent
                        break
                    near = near.parent
            kind, names = self._boilerplate(tag, attrs)
            self.here = Element(tag, self.here, self.here.dropped or kind, names)
        elif tag not in VOID and attrs and tag in BLOCKS:
            kind, names = self._boilerplate(tag, attrs)
            if kind or names:  # a paragraph that is a notice: an element of its own until the next block
                self.here = Element(tag, self.here, self.here.dropped or kind, names)

    def handle_startendtag(self, tag, attrs):
        if tag not in ("svg", "math"):  # browsers close these two, and read <div/> as <div>
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.silent and tag in ("body", "html"):
            self.silent.clear()
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            elif tag == "head" and tag in self.silent:
                self.silent = self.silent[: self.silent.index(tag)]
            return
        if tag in BLOCKS:
            self._end_line()
            self.heading = False
            near = self.here
            while near is not None and near.tag != tag:
                near = near.parent
            if near is not None and near.parent is not None:
                self.here = near.parent
        self.tags += 1
        if tag == "a":
            self.in_link = False

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if self.in_link:
                self.linked += len(data.strip())

    def finish(self, page: str) -> list[tuple[Element, str, int, int]]:
        self.feed(page)
        self.close()
        self._end_line()
        return self.lines


def smoothed(ratios: list[float], sigma: float) -> list[float]:
    """Gaussian average over neighbouring lines."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        low, high = max(0, i - reach), min(len(ratios), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * r for w, r in zip(weights, ratios[low:high])) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """The border between two clusters of the values (two means, from the extremes)."""
    low, high = min(values), max(values)
    for _ in range(50):
        middle = (low + high) / 2
        below, above = [v for v in values if v <= middle], [v for v in values if v > middle]
        if not above:
            return -1.0
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _links_only(lines) -> set[int]:
    """Lines of lists of two items and more that are nothing but links: menus without a name."""
    lists: dict[int, list[int]] = {}
    for n, (element, _, _, _) in enumerate(lines):
        near = element
        while near is not None and near.tag not in ("ul", "ol", "menu"):
            near = near.parent
        if near is not None:
            lists.setdefault(id(near), []).append(n)
    return {n for of in lists.values() if len(of) > 1 and all(lines[n][3] >= 0.9 * len(lines[n][1].replace(" ", "")) for n in of) for n in of}


def _around(element: Element | None) -> Iterator[Element]:
    """The element and all it lies in."""
    while element is not None:
        yield element
        element = element.parent


def _marked(element: Element) -> Element | None:
    """The outermost article or main around."""
    return next(reversed([e for e in _around(element) if e.tag in ("article", "main")]), None)


def _upper(lines, good: list[bool], sigma: float) -> list[int]:
    """The good lines in the upper cluster of smoothed ratios."""
    if not any(good):
        return []
    ratios = smoothed([math.log1p(len(text) / max(1, tags)) if ok else 0.0 for (_, text, tags, _), ok in zip(lines, good)], sigma)
    border = threshold([r for r, ok in zip(ratios, good) if ok])
    return [n for n, (r, ok) in enumerate(zip(ratios, good)) if ok and r > border]


def _named(lines, good: list[bool], sigma: float) -> list[bool]:
    """Good lines that are left out for a name.

    A name does not count for an element that holds most of the upper lines, nor
    for elements of that name which hold most of them together. Where an article
    or main has lines without such names, the upper lines are those inside.
    """
    marked = [ok and _marked(line[0]) is not None for line, ok in zip(lines, good)]
    plain = any(ok and not any(e.names for e in _around(line[0])) for line, ok in zip(lines, marked))
    upper = _upper(lines, marked if plain else good, sigma)
    named = [[e for e in _around(line[0]) if e.names] if ok else [] for line, ok in zip(lines, good)]
    sizes = {n: len(lines[n][1]) for n in upper}
    most = MOST * sum(sizes.values())
    held, together = Counter(), Counter()
    for n, size in sizes.items():
        held.update({e: size for e in named[n]})
    for n, size in sizes.items():
        together.update({name: size for name in {name for e in named[n] if held[e] <= most for name in e.names}})
    counts = {e: held[e] <= most and any(together[name] <= most for name in e.names) for of in named for e in of}
    return [any(counts[e] for e in of) for of in named]


def _common(a: Element, b: Element) -> Element:
    """The innermost element around both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def main_text(page: str, sigma: float = SIGMA) -> str:
    """Blocks of the content region in page order, one per line; empty if there is none."""
    reader = Lines()
    lines = reader.finish(page)
    menus = _links_only(lines)
    good = [not line[0].dropped and n not in menus for n, line in enumerate(lines)]
    good = [ok and not named for ok, named in zip(good, _named(lines, good, sigma))]
    upper = _upper(lines, good, sigma)
    if not upper:
        return ""
    region = lines[upper[0]][0]
    for n in upper[1:]:
        region = _common(region, lines[n][0])
    # Headings no further before the content than the smoothing reaches belong to it, also with a short lead between;
    # those before an article or main only if it has none.
    before = [n for n in range(upper[0]) if good[n]]
    near = reach = math.ceil(3 * sigma)
    headed = upper[0] in reader.headings
    while before and near:
        n, near = before.pop(), near - 1
        if n in reader.headings:
            around = _common(region, lines[n][0])
            if headed and _marked(region) is not None and _marked(around) is None:
                break
            region, near, headed = around, reach, True
    # A line's own element is no region.
    while region.parent is not None and (region.tag not in CONTAINERS or region.tag in ("li", "tr", "td", "th", "dd", "dt", "blockquote", "figure")):
        region = region.parent
    region = _marked(region) or region

    def inside(element: Element) -> bool:
        while element.depth > region.depth:
            element = element.parent
        return element is region

    return "\n".join(line[1] for line, ok in zip(lines, good) if ok and inside(line[0]))


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text per row of ``pages``: page_id, url, text, n_chars (code points).

    Null or empty html, and pages without content, give the empty text. Rows with
    null or repeated ids are read one by one. An empty table gives an empty
    result. Other columns are ignored, whatever their names. No shuffle.
    """
    ship_package(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "") for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
