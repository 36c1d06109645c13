"""Main text of web pages by line-block distribution.

What decides is the distribution of text over the page's lines: of each line the characters outside links less those in
links. Marks of tags and class names are weights in it: text in article or main counts twice, text of marked side parts
counts against the blocks that hold it and is never given.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow, plus

#: Lines summed in a window, and its weight at which text surges; a page with less surges at its peak.
WINDOW, SURGE = 3, 80
#: How often a character in article or main counts where their text is weighed against the rest of the page.
MAIN_WEIGHT = 2

#: Elements that go with what is in them; without an end tag, the first four run to the page's end, and of the others only the tag goes.
_DROP = "script|style|textarea|title|noscript|template|svg|iframe|select|button"
_TO_END = frozenset(_DROP.split("|")[:4])
_ENDS = {x: re.compile(rf"</{x}\s*>", re.I) for x in _DROP.split("|")}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_DROP})\b[^>]*+(?<!/)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
_MAIN = frozenset("article main".split())
_HOLD = frozenset("article center dd div main section td".split())
_ENDLESS = frozenset("p li dt dd tr td th".split())
#: Elements of a phrase: their words are the sentence's, whatever their class says.
_PHRASE = frozenset("a abbr b cite code em i mark q s small strong sub sup u".split())
#: Words of class, id or role that mark what isn't main text.
_SIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
_KEEP_WORDS = frozenset("article content entry post story body".split())
#: First words that say what a name's last word is, and those that say what else the page has.
_KINDS, _STATES = frozenset("ad ads advert promo related sponsored".split()), frozenset("has is no with without".split())
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names_side(name: str) -> bool:
    """Whether a class name marks a side part. The last word of a compound names the part: article-comments are comments, a comment-body is a body, a post-header an article's own header; another word marks it where the last one says nothing."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in _STATES:
        return False
    if words[-1] == "header" and set(words) & _KEEP_WORDS:
        return False
    return words[-1] in _SIDE_WORDS or words[0] in _KINDS or bool(set(words) & _SIDE_WORDS) and words[-1] not in _KEEP_WORDS


def _marked(attributes: str) -> bool:
    return "=" in attributes and any(_names_side(name) for m in _NAMES.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").split())


class Line(NamedTuple):
    """A block's text, white space squeezed: how many characters are in links, whether it's in a marked side part or in article or main, and the innermost container that holds it."""

    text: str
    linked: int
    side: bool
    main: bool
    holder: int


class Containers:
    """The page's containers by number, 0 being the page, in the order in which they open: the one that holds each, and the last one that opened within it."""

    def __init__(self) -> None:
        self.above, self.last = [0], [0]

    def open(self, above: int) -> int:
        self.above.append(above)
        self.last.append(len(self.last))
        return len(self.last) - 1

    def close(self, number: int) -> None:
        self.last[number] = len(self.last) - 1

    def holds(self, outer: int, inner: int) -> bool:
        return outer <= inner <= self.last[outer]

    def common(self, some: list[int]) -> int:
        """The innermost container that holds all of some: that of the first and the last to open."""
        least, most = min(some), max(some)
        while not self.holds(least, most):
            least = self.above[least]
        return least


class _Open(NamedTuple):
    name: str
    side: bool
    main: bool
    muted: bool  # in a marked inline element, whose text goes at once
    link: bool
    holder: int


_ROOT = _Open("", False, False, False, False, 0)


def lines(page: str) -> tuple[list[Line], Containers]:
    """The page's text lines, one a block, and its containers, in time linear in the page."""
    out: list[Line] = []
    held_by = Containers()
    stack = [_ROOT]
    opened: Counter[str] = Counter()
    held: list[str] = []
    linked, first = 0, _ROOT

    def add(s: str) -> None:
        nonlocal linked, first
        top = stack[-1]
        if top.muted:
            return
        s = unescape(s) if "&" in s else s
        if not held:
            first = top
        held.append(s)
        if top.link:
            linked += len(" ".join(s.split()))

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(Line(text, min(linked, len(text)), first.side, first.main, first.holder))
        linked = 0

    def pop() -> None:
        gone = stack.pop()
        opened[gone.name] -= 1
        if gone.holder != stack[-1].holder:
            held_by.close(gone.holder)

    at = 0
    open_ended: set[str] = set()  # names without an end tag from here on
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[1] and (gone := m[1].lower()) not in open_ended:
            if end := _ENDS[gone].search(page, at):
                at = end.end()
            elif gone in _TO_END:
                at = len(page)
            else:
                open_ended.add(gone)
        name = m[3] or m[6]
        if not name:
            continue
        name, closing, attributes = name.lower(), m[2] or m[5], m[4] or m[7] or ""
        if name == "br":
            if held:
                held.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if closing:
            if opened[name] > 0:
                while stack[-1].name != name:
                    pop()
                pop()
        elif name not in _VOID and not attributes.endswith("/"):
            if name in _ENDLESS and stack[-1].name == name:
                pop()  # its end tag may be left out
            above = stack[-1]
            marked = name in _SIDE and not (name == "header" and above.main) or name not in ("html", "body", "main") and _marked(attributes)
            holder = held_by.open(above.holder) if name in _HOLD else above.holder
            muted = above.muted or marked and name not in _BLOCK and name not in _PHRASE
            stack.append(_Open(name, above.side or marked and name not in _PHRASE, above.main or name in _MAIN, muted, above.link or name == "a", holder))
            opened[name] += 1
    if at < len(page):
        add(page[at:])
    flush()
    while len(stack) > 1:
        pop()
    held_by.close(0)
    return out, held_by


def _stretches(weights: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(first line, end, weight of the heaviest block) of the stretches of lines whose blocks weigh something."""
    sums = np.convolve(weights, np.ones(window, np.int64))  # sums[i] is of the lines i - window + 1 to i
    filled = np.concatenate([[False], sums > 0, [False]])
    edges = np.flatnonzero(filled[1:] != filled[:-1]).reshape(-1, 2).tolist()
    return [(max(0, first - window + 1), min(len(weights), last), int(sums[first:last].max())) for first, last in edges]


def _cores(weights: np.ndarray, window: int, level: float) -> list[tuple[int, int]]:
    """(surge, dive) of the stretches in which a block weighs level: their first line of a block's mean share of it, and the line after their last."""
    out = []
    for first, last, top in _stretches(weights, window):
        if top >= level:
            heavy = first + np.flatnonzero(weights[first:last] * window >= level)
            out.append((int(heavy[0]), int(heavy[-1]) + 1))
    return out


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """Text between the surge and dive points of the line-block distribution, a block a line.

    A line weighs its characters outside links less those in links, one of a side part the negative of its characters.
    A block is `window` lines and weighs their sum. Text surges where a block weighs `surge`, or the page's heaviest
    block if that has less, and dives where blocks weigh nothing; the points are the first and the last line between
    that weigh a line's share of it. The lines in article or main and those outside have a distribution each; of the
    two, the one is taken that holds more text between its points, where that in article or main counts MAIN_WEIGHT
    times. All of it between the points is kept but side parts, and of what lies around them: in article or main the
    rest of these, elsewhere the lines outside links that lie in the container that holds all of the kept ones, and in
    the blocks of the points those in the container of that.
    """
    found, containers = lines(page)
    if not found:
        return ""
    inside, side = np.array([x.main for x in found], bool), np.array([x.side for x in found], bool)
    sizes = np.array([len(x.text) for x in found], np.int64)
    weights = np.where(side, -sizes, sizes - 2 * np.array([x.linked for x in found], np.int64))
    parts = [(where, weights * where, weight) for where, weight in ((inside, MAIN_WEIGHT), (~inside, 1))]
    level = min(surge, max((top for _, w, _ in parts for _, _, top in _stretches(w, window)), default=0))
    if level <= 0:  # links at most: what isn't marked
        return "\n".join(x.text for x in found if not x.side and (x.main or not x.linked))
    cores = [_cores(w, window, level) for _, w, _ in parts]
    held = [weight * sum(int(np.maximum(w[a:b], 0).sum()) for a, b in core) for (_, w, weight), core in zip(parts, cores, strict=True)]
    taken = int(held[1] > held[0])
    where = parts[taken][0]
    keep = np.zeros(len(found), bool)
    for a, b in cores[taken]:
        keep[a:b] = True
    keep &= where & ~side
    if taken == 0:
        keep |= inside & ~side
    else:
        common = containers.common([found[i].holder for i in np.flatnonzero(keep).tolist()])
        points = np.zeros(len(found), bool)  # the blocks that hold a surge or a dive point
        for a, b in cores[taken]:
            points[max(0, a - window + 1) : b + window - 1] = True
        around = containers.above[common]
        for i in np.flatnonzero(where & (weights > 0)).tolist():
            holder = found[i].holder
            keep[i] |= containers.holds(common, holder) if common else not holder
            keep[i] |= points[i] and around > 0 and containers.holds(around, holder)
    return "\n".join(x.text for x, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """Replace html by main_text string: the text of each page's main part, blocks joined by a line feed.

    A null or empty page, or one without text, gives the empty text; very long pages are read whole; repeated rows
    each get theirs. Other columns stay; one named main_text is replaced.
    """
    pages = pages.drop("main_text")
    names = [c for c in pages.columns if c != html_col]
    source = pages.select(*names, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(batch.num_rows, 1 + batch.num_rows * 8_000_000 // max(1, batch.column(len(names)).nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = [main_text(x, window, surge) if x else "" for x in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*names, "main_text"])

    return in_arrow(source, run, plus(source.select(*names), main_text="string"))
