"""Main text of web pages: parser events, text-to-tag ratio, Gaussian smoothing, clustering.

The standard library's parser is fed the page and its events are turned into lines: a block element
or a line break ends a line. A line knows its text, how much of it is links, the tags that fell into
it and the region it lies in: every block that can hold others is one, and lists and tables that
aren't mostly links belong to the region around them. Each line's ratio of unlinked text to tags is
smoothed by a Gaussian along the lines around it, a threshold between the two clusters of ratios is
found, and regions whose smoothed ratio passes it are content, on every page. What a region says of
itself (menus, headers, footers, sidebars, adverts, notices, forms, comments; articles; by element,
ARIA role or words of class and id) shifts its ratio. A content region is kept whole, so that a
one-word paragraph of an article stays.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: standard deviation of the smoothing, in lines
SIGMA = 1.5
#: what marks add to the logarithm of a region's ratio: an article; boilerplate by words, by element, hidden
ARTICLE_WEIGHT = 1.5
BOILERPLATE_WEIGHTS = (0.0, -4.0, -8.0, -np.inf)
NAMED, ELEMENT, HIDDEN = 1, 2, 3
#: cluster means of logarithms that lie nearer are one cluster: all of the page is alike
LEAST_GAP = 2.0

# Element names of HTML, by what they mean here.
SILENT = frozenset("script style noscript template svg math canvas iframe object embed head title select option textarea button audio video map datalist".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu fieldset".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: blocks that are regions; of them, those that belong to the region around unless they are mostly links
CONTAINERS = frozenset("section article main div center details".split())
LISTS = frozenset("ul ol dl dir table td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: silent elements that pages leave open, and blocks that can't lie in them
UNCLOSED = frozenset("button select option textarea object canvas audio video map iframe embed datalist".split())
ENDS_SILENCE = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre header footer nav aside form fieldset figure hr".split())
_CONTROLS = re.compile(rf"<(/?(?:{'|'.join(sorted(UNCLOSED))}))\b", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that an opening tag of the same group ends, as in HTML without closing tags
IMPLIED_END = {"p": "p", "li": "li", "dt": "d", "dd": "d", "tr": "tr", "td": "t", "th": "t", "option": "option"}
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: words of class and id values that name boilerplate
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer masthead topbar cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup "
    "alert disclaimer copyright legal skip toolbar social share sharing comment comments commentlist disqus respond reply replies related recommended widget pagination pager login search".split()
)
CONTENT = frozenset(("article", "main"))
#: words that name boilerplate on a content element too, and outside of content only
ON_CONTENT = frozenset("ad advert comment comments reply respond related teaser promo sponsored".split())
OUTSIDE_CONTENT = frozenset(("header",))
#: parts of a class that speak of the page's layout: has-sidebar, with-comments
_LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no)[-_]\S+")
_MARKABLE = BLOCKS | {"span", "a", "ins"}
_OUTSIDE_WORDS = BOILERPLATE_WORDS | OUTSIDE_CONTENT

_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass
class Line:
    text: str
    tags: int
    #: number of the region the line lies in, how far it is marked as boilerplate, and whether it is an article
    region: int
    boilerplate: int
    article: bool
    #: characters of the text that are links
    linked: int = 0
    heading: bool = False


@dataclass
class _Open:
    tag: str
    region: int
    boilerplate: int
    article: bool
    silent: bool = field(default=False)


def _boilerplate(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """How far an element is marked as boilerplate: not at all, by a name or a form, by what it is, hidden."""
    found = 0
    if tag in BOILERPLATE:
        found = NAMED if tag in ("form", "fieldset") else ELEMENT
    elif tag == "header" and not in_article:
        found = NAMED
    for name, value in attrs:
        if name == "hidden":
            return HIDDEN
        if not value:
            continue
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return HIDDEN
        if name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in BOILERPLATE_ROLES:
            found = ELEMENT
        elif not found and name in ("class", "id") and tag not in ("html", "body"):
            words = {w.lower() for w in _WORDS.findall(_CAMEL.sub(r"\1 \2", _LAYOUT.sub(" ", value)))}
            named = ON_CONTENT if tag in CONTENT else BOILERPLATE_WORDS if in_article else _OUTSIDE_WORDS
            if not words.isdisjoint(named):
                found = NAMED
    return found


class LineParser(HTMLParser):
    """Events to lines; nothing but the open elements and the line at hand is kept besides."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self._stack: list[_Open] = [_Open("", 0, 0, False)]
        #: for each region the one around it, and whether it is a list
        self.regions: list[tuple[int, bool]] = [(0, False)]
        #: where in the stack the open elements of a name are, and the blocks other than paragraphs
        self._where: defaultdict[str, list[int]] = defaultdict(list)
        self._blocks: list[int] = []
        #: names of which the page opens more than it closes, and the silent element that is open
        self._unclosed: frozenset[str] = frozenset()
        self._hush = ""
        self._links = 0
        self._linked = 0
        self._text: list[str] = []
        self._tags = 0

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers of the source aren't needed, and counting them reads the page again."""
        return j

    def _end_line(self) -> None:
        text = " ".join("".join(self._text).split())
        top = self._stack[-1]
        if text:
            self.lines.append(Line(text, self._tags, top.region, top.boilerplate, top.article, min(self._linked, len(text)), any(o.tag in HEADINGS for o in self._stack[-3:])))
            self._tags = self._linked = 0
        self._text.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        top = self._stack[-1]
        if top.silent and tag in ENDS_SILENCE and self._hush in self._unclosed:
            while self._stack[-1].silent:  # a control that isn't closed doesn't hold what follows
                self._pop()
            top = self._stack[-1]
        if top.silent and tag not in ("body",):
            if tag not in VOID:
                self._push(_Open(tag, top.region, top.boilerplate, top.article, True))
            return
        if tag in BLOCKS:
            self._end_line()
        self._tags += 1
        if tag in VOID:
            return
        if tag in IMPLIED_END and top.tag and IMPLIED_END.get(top.tag) == IMPLIED_END[tag]:
            self._pop()
            top = self._stack[-1]
        if tag == "body" and top.silent:
            while len(self._stack) > 1 and self._stack[-1].silent:
                self._pop()
            top = self._stack[-1]
        bad = max(top.boilerplate, _boilerplate(tag, attrs, top.article)) if tag in _MARKABLE else top.boilerplate
        article = top.article or tag in CONTENT
        region = top.region
        changes = bad != top.boilerplate or article != top.article
        if changes or tag in CONTAINERS or tag in LISTS:
            if tag not in BLOCKS:
                self._end_line()
            self.regions.append((region, tag in LISTS and not changes))
            region = len(self.regions) - 1
        self._links += tag == "a"
        if tag in SILENT:
            self._hush = tag
        self._push(_Open(tag, region, bad, article, tag in SILENT))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            if self.CDATA_CONTENT_ELEMENTS and tag in self.CDATA_CONTENT_ELEMENTS:
                self.clear_cdata_mode()
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self._end_line()
            return
        if not self._where[tag]:
            return
        at = self._where[tag][-1]
        # a stray closing tag of an inline element doesn't close the blocks around it
        if tag not in BLOCKS and self._blocks and self._blocks[-1] > at:
            return
        if not self._stack[-1].silent:
            changes = self._stack[at - 1].boilerplate != self._stack[-1].boilerplate
            if tag in BLOCKS or changes or self._where["p"] and self._where["p"][-1] > at:
                self._end_line()
            self._tags += 1
        while len(self._stack) > at:
            gone = self._pop()
            self._links -= gone.tag == "a" and not gone.silent

    def _push(self, element: _Open) -> None:
        self._where[element.tag].append(len(self._stack))
        if element.tag in BLOCKS and element.tag != "p":
            self._blocks.append(len(self._stack))
        self._stack.append(element)

    def _pop(self) -> _Open:
        gone = self._stack.pop()
        self._where[gone.tag].pop()
        if self._blocks and self._blocks[-1] == len(self._stack):
            self._blocks.pop()
        return gone

    def read(self, html: str) -> list[Line]:
        """Lines of a whole page."""
        balance = Counter()
        for name in _CONTROLS.findall(html):
            balance[name.lower().removeprefix("/")] += -1 if name[0] == "/" else 1
        self._unclosed = frozenset(n for n, more in balance.items() if more > 0)
        self.feed(html)
        return self.done()

    def handle_data(self, data: str) -> None:
        if not self._stack[-1].silent:
            self._text.append(data)
            if self._links:
                self._linked += len(data.strip())

    def done(self) -> list[Line]:
        self.close()
        self._end_line()
        return self.lines


def tag_ratios(lines: list[Line]) -> np.ndarray:
    """Characters of unlinked text for each tag of a line."""
    return np.array([(len(x.text) - x.linked) / max(1, x.tags) for x in lines], float)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut and scaled anew."""
    if len(values) < 2:
        return values
    half = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    full = np.convolve(values, kernel)[half : half + len(values)]
    weight = np.convolve(np.ones(len(values)), kernel)[half : half + len(values)]
    return full / weight


def clusters(values: np.ndarray) -> tuple[float, float]:
    """The two means that one-dimensional 2-means finds from the extremes."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values < cut], values[values >= cut]
        if not len(below) or not len(above):
            break
        new = float(below.mean()), float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return low, high


def threshold(values: np.ndarray) -> float:
    """The mean of the two cluster means."""
    low, high = clusters(values)
    return (low + high) / 2


def merged_regions(lines: list[Line], regions: list[tuple[int, bool]]) -> list[int]:
    """The region that each region belongs to: lists that aren't mostly links go to the one around them."""
    size, linked = np.zeros(len(regions)), np.zeros(len(regions))
    for x in lines:
        size[x.region] += len(x.text)
        linked[x.region] += x.linked
    for r in range(len(regions) - 1, 0, -1):  # cells count in their table
        around = regions[r][0]
        if regions[around][1]:
            size[around] += size[r]
            linked[around] += linked[r]
    own = list(range(len(regions)))
    for r, (around, is_list) in enumerate(regions):
        if r and is_list and 2 * linked[r] < size[r]:
            own[r] = own[around]
    return own


def select_lines(lines: list[Line], regions: list[tuple[int, bool]]) -> list[str]:
    """Texts of the lines in content regions, in page order."""
    if not lines:
        return []
    own = merged_regions(lines, regions)
    at: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        at.setdefault(own[x.region], []).append(i)
    # blocks of one line are smoothed with those beside them, as paragraphs are, and one that is a heading
    # with what it heads; a region of more lines by itself; links never with text
    runs: dict[tuple, list[int]] = {}
    after = None
    for i in range(len(lines) - 1, -1, -1):
        x, r = lines[i], own[lines[i].region]
        alone = len(at[r]) == 1 and r > 0
        key = (alone, own[regions[r][0]] if alone else r, x.boilerplate, x.article, alone and 2 * x.linked >= len(x.text))
        if alone and x.heading and after and after[2:] == key[2:]:
            key = after
        runs.setdefault(key, []).append(i)
        after = key
    ratios, logs = tag_ratios(lines), np.zeros(len(lines))
    for members in runs.values():
        logs[members] = np.log1p(smooth(ratios[members]))
    low, high = clusters(logs)
    split = high - low >= LEAST_GAP
    cut = (low + high) / 2 if split else float(logs.min())
    weights = np.array([len(x.text) for x in lines], float)
    scores = {r: float(np.average(logs[m], weights=weights[m])) for r, m in at.items()}
    marks = {r: (lines[m[0]].boilerplate, lines[m[0]].article) for r, m in at.items()}
    content = {r for r, v in scores.items() if v + (BOILERPLATE_WEIGHTS[marks[r][0]] or ARTICLE_WEIGHT * marks[r][1]) >= cut - 1e-9}
    if not content and split:  # a form or a name around the whole page says nothing
        content = {r for r, v in scores.items() if marks[r][0] <= NAMED and v >= cut}
    return [x.text for x in lines if own[x.region] in content]


def main_text(html: str | None) -> str:
    """The page's main text: blocks in page order joined by one blank; empty if there is none."""
    if not html:
        return ""
    parser = LineParser()
    return " ".join(select_lines(parser.read(html), parser.regions))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``. Null, empty and tag-only pages have an
    empty text. Broken markup loses no text: closing tags that close nothing are passed over, a silent
    control (button, select and the like) of which the page opens more than it closes ends at the next
    block, and only an open script, style, title or textarea holds all that follows, as in browsers. Time
    is in proportion to a page's length. Repeated rows come out repeated; ties at the threshold are
    content; an empty table gives an empty table; other columns are ignored."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
