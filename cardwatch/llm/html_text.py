"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser gives events; block elements cut the text into
lines, each with its characters and tags. The ratio of the two, smoothed by a
Gaussian over neighbouring lines, is cut where it splits the lines into two
clusters best; the upper cluster shows which element holds the content: the
smallest around all of it, or the article or main around that. The text is that
of all lines of this element, short ones too, but for those in elements that
are no content by their name, role or class. End tags that HTML lets a page
leave out are added.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.words import in_batches

#: Elements that end the line before them and the one they hold.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is no content.
NEVER = frozenset(
    "script style head title template noscript iframe object svg math canvas audio video nav aside footer menu "
    "button select textarea input dialog fieldset".split()
)
#: Elements that are followed as holders of lines.
HOLDERS = frozenset("html body article main section div td header details figure blockquote center".split())
#: Holders that are parts of the content, not all of it.
PARTS = frozenset("section td header details figure blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Further elements that are followed, so that their ends are known.
FOLLOWED = frozenset("p li ul ol dl dt dd table caption thead tbody tfoot tr th".split())
#: Start tags that do not end the head, and those that end a paragraph.
IN_HEAD = frozenset("title meta link script style noscript template base head".split())
ENDS_P = (BLOCKS - frozenset("body head html legend title caption tbody td tfoot th thead tr".split())) | {"main"}
_NONE, _P = frozenset[str](), frozenset(("p",))
P_WITHIN = frozenset("table caption td th button object template".split())
_LIST, _TABLE = frozenset("ul ol menu table td th section article main aside nav blockquote".split()), frozenset(("table",))
_TERMS = frozenset("dl table td th section article main aside nav blockquote".split())
_CELLS, _ROWS = frozenset(("td", "th", "caption")), frozenset(("tr",))
_BODIES = frozenset("thead tbody tfoot".split())
#: Start tags that end others: which, and what these are not looked for beyond.
ENDS = {
    "li": [(frozenset(("li",)), _LIST)],
    **dict.fromkeys(("dt", "dd"), [(frozenset(("dt", "dd")), _TERMS)]),
    **dict.fromkeys(("td", "th"), [(_CELLS, _TABLE)]),
    "tr": [(_ROWS, _TABLE), (_CELLS, _TABLE)],
    **dict.fromkeys(("thead", "tbody", "tfoot"), [(_BODIES, _TABLE), (_ROWS, _TABLE), (_CELLS, _TABLE)]),
}
#: What an end tag does not reach beyond.
END_WITHIN = {
    "p": P_WITHIN, "li": frozenset("ul ol menu table td th".split()), **dict.fromkeys(("dt", "dd"), frozenset("dl table td th".split())),
    **dict.fromkeys(("td", "th", "caption", "tr", "thead", "tbody", "tfoot"), _TABLE),
}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Roles, and names in a class or id, that mark an element as no content.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
MARKERS = frozenset(
    "ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs consent cookie cookies "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination "
    "popup promo promotion related share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar toc widget widgets".split()
)
#: Names of reader comments, which are never content.
COMMENTS = frozenset("comment comments disqus replies respond".split())
#: A name of several words marks an element if one of them does and the others are of these: site-header, comment-list, left_sidebar.
BESIDE = frozenset(
    "area author bar bars block body bottom box container content form global group inner item items left links list main outer page panel "
    "primary right secondary section site sub thread title top user widget wrap wrapper".split()
)
#: Width of the smoothing, in lines, and how many lines to either side it reaches.
SIGMA, REACH = 1.5, 4

_TAG = re.compile(r"<[A-Za-z/!?]")
_WORD = re.compile(r"[a-z]+")


class _Lines(HTMLParser):
    """Lines of a page: text, tags met, characters in links, whether it can be content, the marked elements around it, whether it is a paragraph, and its holders from the outermost one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, tuple[int, ...], bool, tuple[int, ...]]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0
        self.links = 0
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, no content, marked, holder
        self.opened: Counter[str] = Counter()  # open elements by tag
        self.hidden = 0
        self.marked: tuple[int, ...] = ()
        self.begun: tuple[bool, tuple[int, ...], bool] | None = None  # as the line's first text was met
        self.marks = 0
        self.holding: set[int] = set()  # marked elements with an article or main
        self.holders: tuple[int, ...] = ()
        self.kinds: list[str] = [""]  # of each holder
        self.articles = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.linked, *self.begun, self.holders))
                self.tags = self.linked = 0
            self.parts = []
            self.begun = None

    def _pop(self, k: int) -> None:
        """Ends the open elements from place ``k`` on."""
        while len(self.open) > k:
            name, hid, mark, held = self.open.pop()
            self.opened[name] -= 1
            self.hidden -= hid
            self.articles -= name in ("article", "main")
            if mark:
                self.marked = self.marked[:-1]
            if held:
                self.holders = self.holders[:-1]

    def _place(self, tags: frozenset[str], within: frozenset[str]) -> int:
        """Place of the innermost open element of ``tags``, not looked for beyond one of ``within``; -1 without."""
        if not any(self.opened[t] for t in tags):
            return -1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                return k
            if self.open[k][0] in within:
                return -1
        return -1

    def _imply(self, tag: str) -> None:
        """End tags that the start of ``tag`` stands for."""
        if self.open and tag not in IN_HEAD and self.open[-1][0] == "head":
            self._pop(len(self.open) - 1)
        if tag in ENDS_P and (k := self._place(_P, P_WITHIN)) >= 0:
            self.flush()
            self._pop(k)
        for tags, within in ENDS.get(tag, ()):
            if (k := self._place(tags, within)) >= 0:
                self.flush()
                self._pop(k)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        self._imply(tag)
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.links = 1
        elif tag in HEADINGS:
            self.links = -1  # a linked heading is no list of links
        if tag in VOID or not (tag in HOLDERS or tag in NEVER or tag in FOLLOWED or tag == "form" or attrs):
            return
        mark, hides = False, tag in NEVER
        if not hides:
            mark = (tag == "header" and not self.articles) or tag == "form"
            if attrs and tag not in ("html", "body"):
                hides = (tag not in ("article", "main") and _concealed(attrs)) or (tag != "main" and _marked(attrs, COMMENTS, tag == "p"))
                mark = mark or _marked(attrs, MARKERS, tag == "p") or _has_role(attrs)
        holds = tag in HOLDERS
        if not (hides or mark or holds or tag in FOLLOWED):
            return
        self.open.append((tag, hides, mark, holds))
        self.opened[tag] += 1
        self.hidden += hides
        if tag in ("article", "main"):
            self.articles += 1
            self.holding.update(self.marked)
        if mark:
            self.marks += 1
            self.marked = (*self.marked, self.marks)
        if holds:
            self.holders = (*self.holders, len(self.kinds))
            self.kinds.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag == "a" or tag in HEADINGS:
            self.links = 0
        if tag in ("html", "body"):
            return  # what follows them is in the body as well
        if (k := self._place(frozenset((tag,)), END_WITHIN.get(tag, _NONE))) >= 0:
            self._pop(k)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self._pop(len(self.open) - 1)
        self.parts.append(data)
        if self.begun is None and not data.isspace():
            self.begun = (not self.hidden, self.marked, self.opened["p"] > 0)
        if self.links > 0:
            self.linked += len(data.strip())


def _concealed(attrs: list[tuple[str, str | None]]) -> bool:
    return any(
        name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower())
        for name, value in attrs
    )


def _marked(attrs: list[tuple[str, str | None]], names: frozenset[str], whole: bool) -> bool:
    """Whether a name in a class or id is one of ``names``, alone or, unless ``whole``, among words that say where or what it is."""
    for name, value in attrs:
        if value and name in ("class", "id"):
            for token in value.lower().split():
                words = _WORD.findall(token)
                if token in names or (not whole and not names.isdisjoint(words) and all(w in names or w in MARKERS or w in COMMENTS or w in BESIDE for w in words)):
                    return True
    return False


def _has_role(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name == "role" and value and value.lower() in ROLES for name, value in attrs)


_KERNEL = np.array([math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-REACH, REACH + 1)])
_KERNEL /= _KERNEL.sum()


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian mean of each line and those around it; the ends are carried on."""
    return np.convolve(np.pad(ratios, REACH, mode="edge"), _KERNEL, mode="valid")


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """The values above the cut that leaves the least variance in both clusters; all of equal values."""
    ordered = np.sort(values)
    if ordered[0] == ordered[-1]:
        return np.ones(len(values), bool)
    n = np.arange(1, len(ordered))
    sums = np.cumsum(ordered)
    low, high = sums[:-1] / n, (sums[-1] - sums[:-1]) / (len(ordered) - n)
    between = n * (len(ordered) - n) * np.square(high - low)
    between[ordered[1:] == ordered[:-1]] = -1
    k = int(np.argmax(between))
    return values > (ordered[k] + ordered[k + 1]) / 2 if ordered[k] < ordered[k + 1] else values >= ordered[k]


def _ended(html: str) -> str:
    """A page cut off inside a comment or a tag, up to there."""
    k = html.rfind("<!--")
    if k >= 0 and html.find("-->", k + 2) < 0:
        html = html[:k]
    k = html.rfind("<")
    return html[:k] if k >= 0 and html.find(">", k) < 0 and _TAG.match(html, k) else html


def main_text(html: str | None) -> str:
    """The content of one page; empty for null, empty or textless pages."""
    parser = _Lines()
    parser.feed(_ended(html or ""))
    parser.close()
    parser.flush()
    lines = [(text, tags, linked, ok and not hidden, holders) for (text, tags, linked, ok, _, _, holders), hidden in zip(parser.lines, _hidden(parser))]
    shown = [k for k, x in enumerate(lines) if x[3]]
    if not shown:
        return ""
    kept = _content([lines[k][4] for k in shown], _upper(lines, shown), parser.kinds, [(len(lines[k][0]), lines[k][2]) for k in shown])
    return "\n".join(lines[k][0] for k, keep in zip(shown, kept) if keep)


def _upper(lines: list[tuple], shown: list[int]) -> np.ndarray:
    """Which of the lines ``shown`` are in the upper cluster, without those that only their neighbours lift into it."""
    ratios = np.zeros(len(lines))
    ratios[shown] = [len(lines[k][0]) / max(1, lines[k][1]) for k in shown]
    means = smoothed(ratios)[shown]
    upper = upper_cluster(means)
    own = upper & (ratios[shown] >= means[upper].min())
    return own if own.any() else upper


def _hidden(page: _Lines) -> list[bool]:
    """Of each line: whether a marked element hides it.

    A marked element is shown if it holds an article or main and none is
    outside all marked elements. One that holds none is shown if there is no
    paragraph outside marked elements, in an article or main if the page has
    any. How long the parts are does not matter.
    """
    around = [x[4] for x in page.lines]
    if not any(around):
        return [False] * len(around)
    can = [k for k, x in enumerate(page.lines) if x[3]]
    within = {k for k in can if any(page.kinds[h] in ("article", "main") for h in page.lines[k][6])}
    if not any(not around[k] for k in within):
        around = [tuple(m for m in x if m not in page.holding) for x in around]
    asked = [k for k in can if k in within or not within]
    depths = [len(around[k]) for k in asked if page.lines[k][5]]
    if depths and min(depths):
        # Those marked elements alone that a paragraph is the least deep in.
        shown = {m for k in asked if page.lines[k][5] and len(around[k]) == min(depths) for m in around[k]}
        around = [tuple(m for m in x if m not in shown) for x in around]
    return [bool(x) for x in around]


def _content(around: list[tuple[int, ...]], upper: np.ndarray, kinds: list[str], sizes: list[tuple[int, int]]) -> list[bool]:
    """Which lines belong to the content: those of the smallest holder of all upper lines, or of the outermost article or main around it.

    Without an article, parts such as sections widen to what holds them, and
    siblings that are not mostly links are taken back.
    """
    path: tuple[int, ...] | None = None
    for holders, is_upper in zip(around, upper):
        if is_upper:
            path = holders if path is None else path[: next((k for k, (x, y) in enumerate(zip(path, holders)) if x != y), min(len(path), len(holders)))]
    path = path or ()
    for holder in path:
        if kinds[holder] in ("article", "main"):
            return [holder in x for x in around]
    depth = len(path)
    kept = [x[:depth] == path for x in around]
    while depth and kinds[path[depth - 1]] not in ("body", "html"):
        part = kinds[path[depth - 1]] in PARTS
        depth -= 1
        _take_back(kept, around, path[:depth], sizes)
        if not part:
            break
    return kept


def _take_back(kept: list[bool], around: list[tuple[int, ...]], outer: tuple[int, ...], sizes: list[tuple[int, int]]) -> None:
    """Keeps the lines in ``outer`` of all its children, and of runs of lines between these, that are not mostly links."""
    depth, runs, last = len(outer), [], object()
    for k, x in enumerate(around):
        if x[:depth] != outer:
            last = object()
            continue
        child = x[depth] if len(x) > depth else None
        if child != last:
            runs.append([])
        runs[-1].append(k)
        last = child
    for run in runs:
        if 2 * sum(sizes[k][1] for k in run) < sum(sizes[k][0] for k in run):
            for k in run:
                kept[k] = True


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Character references are decoded, white space in a block becomes one space,
    blocks are joined by line feeds. A null, empty or textless page gives the
    empty text. Every row is treated by itself, so repeated rows repeat; null
    ids and urls stay null; other columns are not read.
    """
    given = in_batches(pages).select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = dict(given.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return given.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
