"""Main text of web pages by the distribution of text over lines of blocks.

Markup is stripped to one line for each block, in page order; where an element that holds blocks begins or ends (a division,
list, section, menu, footer), as many empty lines follow as a window has, so no window reaches over such an edge. A line
weighs its characters outside of links, and nothing where half of it or more is links. Lengths are summed over sliding
windows of WINDOW lines, all lines of the page included: menus, adverts and footers too. Text surges where a window reaches SURGE
characters, or SHARE of the page's highest window if that is more, and dives at the edge after it. What lies between
a surge and its dive is main text, and so are lines of the same element between two surges, unless a window over
them sums to nothing, as over a menu. A heading of the first rank surges by itself.

Only then marks and names are looked at, for what lengths can't tell. If the page marks an article or a main part and a surge lies in
it, the whole of that part is main text, short ends and lists of links included, and what surges beside it is not. Lines of elements
that HTML names as menus, footers, sidebars, forms and the like, and headers outside of an article, go; so do those whose class or
id says that they hold reader comments, adverts or notices, as those can be long prose: all parts of one of its names
must be known words, so "ad-banner" and "comments" are, and "ad-hoc", "related-work" and "entry-header" are not. If that takes
all that surged, windows are summed once more without those lines.

Null pages and pages without text give an empty text. A page without anything but links is empty, unless it marks an article. A page is
read to its end, closed or not, and in time linear in its length, however malformed: the start of an article ends
whatever was left open before it. Rows are treated one by one; pages with nulls in other columns and repeated rows are
like others. Empty tables give no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..cluster import ship

#: Lines of a window; characters of a window that make it a surge; or this share of the highest.
WINDOW, SURGE, SHARE = 3, 120, 0.35
_RAW = frozenset("script style noscript template svg iframe textarea select object head title".split())
_BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose start and end are edges.
_EDGES = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
_HOLDERS = frozenset("div section td th article main".split())
_APART = frozenset("nav footer aside form button menu dialog".split())
#: Words of a class or id that say what an element holds, and those that may stand beside them.
_SAYS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent notice notices comment comments respond reply replies disqus newsletter subscribe popup modal navbar breadcrumb breadcrumbs sidebar widget footer menu nav".split())
_BESIDE = frozenset("area banner bar block body box container content form group header inner item items left link links list main message meta outer page panel right section signup site slot space text thread title top unit wrap wrapper".split())
_OWN = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9]*")
_STOP = re.compile(r"[>\"']")
_ENDS = {name: re.compile(rf"</{name}(?![a-zA-Z0-9])[^<>]*>?", re.I) for name in _RAW}


@dataclass
class Line:
    text: str
    weight: int
    holder: int
    part: int  # the outermost article or main part that it lies in, from 1, or 0
    apart: bool
    first_rank: bool
    edge: bool  # whether an element that holds blocks began or ended before it


class Reader:
    """Text and tags of a page, each read once. What isn't found after some place is not looked for again."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Where the tag that starts before `at` ends; a bracket in a quoted value doesn't end it. -1 if it never does."""
        if self.find(">", at) < 0:
            return -1
        start = at
        while m := _STOP.search(self.page, at):
            if m[0] == ">":
                return m.start()
            at = m.end()
            if self.page[m.start() - 1] == "=" or self.page[m.start() - 1].isspace():
                close = self.find(m[0], at)
                if close >= 0 and "<" not in self.page[at:close]:
                    at = close + 1
        return self.find(">", start)

    def tokens(self) -> Iterator[tuple[str, str, str]]:
        """(text, "", ""), or ("", name, tag) with a slash before the names of closing tags."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            open_ = self.find("<", at)
            if open_ != at:
                stop = n if open_ < 0 else open_
                yield page[at:stop], "", ""
                at = stop
                continue
            if page.startswith("<!--", at):
                stop = self.find("-->", at + 4)
                at = n if stop < 0 else stop + 3
                continue
            sign = page[at + 1 : at + 2]
            closing = sign == "/"
            name = _NAME.match(page, at + 1 + closing)
            if not name and sign not in ("!", "?", "/") or (stop := self.tag_end(at + 1)) < 0:
                yield "<", "", ""
                at += 1
                continue
            tag, at = page[at : stop + 1], stop + 1
            if not name:
                continue
            low = name[0].lower()
            if low in _RAW:
                if not closing and not tag.endswith("/>"):
                    end = None if low in self.gone else _ENDS[low].search(page, at)
                    if end is None:
                        self.gone.add(low)
                    at = end.end() if end else n
                continue
            yield "", ("/" if closing else "") + low, tag


def _says_apart(tag: str) -> bool:
    for found in _OWN.findall(tag):
        for one in "".join(found).split():
            parts = [p.lower() for p in _PARTS.split(one) if p]
            if any(p in _SAYS for p in parts) and all(p in _SAYS or p in _BESIDE for p in parts):
                return True
    return False


def lines_of(page: str) -> list[Line]:
    """Every block's line in page order."""
    out: list[Line] = []
    now: list[str] = []
    linked, in_link, first_rank, edge, part = 0, False, False, True, 0
    open_: list[tuple[str, int]] = [("", 0)]  # elements that hold lines, with their numbers
    many: Counter[str] = Counter()
    holders, skip, depth = 0, "", 0

    def end() -> None:
        nonlocal now, linked, edge
        text = " ".join(html.unescape("".join(now)).split())
        if text:
            weight = 0 if 2 * linked >= len(text) else len(text) - linked
            out.append(Line(text, weight, open_[-1][1], part if many["article"] + many["main"] > 0 else 0, bool(skip), first_rank, edge))
            edge = False
        now, linked = [], 0

    for text, name, tag in Reader(page).tokens():
        if not name:
            now.append(text)
            if in_link:
                linked += len(text.strip())
            continue
        closing, name = name[0] == "/", name.lstrip("/")
        if name == "br":
            now.append(" ")
        elif name == "a":
            in_link = not closing
        if name in _BLOCKS:
            end()
        edge = edge or name in _EDGES
        if name == "h1":
            first_rank = not closing
        marks_part = name in ("article", "main")
        if marks_part and (closing or not skip or not many["article"] + many["main"]):
            skip, depth, in_link = "", 0, False
        if name in _HOLDERS:
            if not closing:
                part += marks_part and not many["article"] + many["main"]
                holders += 1
                open_.append((name, holders))
                many[name] += 1
            elif many[name]:
                while open_[-1][0] != name:
                    many[open_.pop()[0]] -= 1
                many[open_.pop()[0]] -= 1
        if skip:
            if name == skip:
                depth += -1 if closing else 1
                if depth <= 0:
                    end()
                    skip, depth = "", 0
        elif not closing and name not in _VOID and not marks_part and name not in ("html", "body", "h1", "h2", "h3", "h4", "h5", "h6"):
            if name in _APART or name == "header" and not many["article"] + many["main"] or _says_apart(tag):
                end()
                skip, depth = name, 1
    end()
    return out


def surges(weights: list[int], window: int) -> int:
    """The highest sum over a window."""
    total = best = sum(weights[:window])
    for i in range(window, len(weights)):
        total += weights[i] - weights[i - window]
        best = max(best, total)
    return best


def dives(weights: list[int], window: int) -> list[bool]:
    """Whether each line is covered by a window that sums to 0."""
    out, run = [False] * len(weights), 0
    for i, w in enumerate(weights):
        run = 0 if w else run + 1
        if run == window:
            out[i - window + 1 : i + 1] = [True] * window
        elif run > window:
            out[i] = True
    return out


def surging(lines: list[Line], window: int, surge: int, share: float) -> list[bool]:
    """Whether each line lies between a surge and its dive, or between two surges of its element."""
    runs: list[list[int]] = []
    for i, x in enumerate(lines):
        if x.edge or not runs:
            runs.append([])
        runs[-1].append(i)
    highest = [surges([lines[i].weight for i in run], window) for run in runs]
    top = max(highest, default=0)
    level = min(max(surge, share * top), top)
    out = [x.first_rank for x in lines]
    ends: dict[int, list[int]] = {}
    for run, high in zip(runs, highest, strict=True):
        if top and high >= level:
            for i in run:
                out[i] = True
                ends.setdefault(lines[i].holder, [i, i])[1] = i
    of: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        if x.holder in ends and ends[x.holder][0] <= i <= ends[x.holder][1]:
            of.setdefault(x.holder, []).append(i)
    for at in of.values():
        for i, gone in zip(at, dives([lines[i].weight for i in at], window), strict=True):
            out[i] = lines[i].first_rank or not gone
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE, share: float = SHARE) -> str:
    lines = lines_of(page or "")
    found = surging(lines, window, surge, share)
    if not any(f and not x.apart and not x.first_rank for x, f in zip(lines, found, strict=True)):
        lines = [x for x in lines if not x.apart]
        found = surging(lines, window, surge, share)
    parts = {x.part for x, f in zip(lines, found, strict=True) if f and x.part and not x.apart} or {x.part for x in lines} - {0}
    return "\n\n".join(x.text for x, f in zip(lines, found, strict=True) if not x.apart and (x.part in parts if parts else f))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text and n_chars (code points) of every page."""
    have = pages.select(key, url, page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    ship(pages.sparkSession)
    kinds = dict(have.dtypes)
    return have.mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
