"""Main text of web pages: flat blocks, judged by a decision tree on word counts and link densities.

Markup is cut into blocks at block-level tags; inline tags leave no gap. A block has its number of words and the share
of its words inside links, and both of the block before it and after it. A tree grown on the small labelled table below
says from these six figures which blocks are text; class names, ids and roles are never looked at. Scripts, styles and controls give no block, and what stands in an
element that the standard keeps for menus, footers, sidebars, forms, dialogs or (an article in an article) comments is left out whatever the tree says, but counts as a neighbour.
Everything happens within one page, so pages need no shuffle.

Edge cases: null or empty html gives an empty text; unclosed and stray tags are taken as they come, in time in proportion to the page; a control without an
end tag ends with its tag, only script, style, title, textarea and the like run on to the end of the page; a lone "<" is
text; unknown references stay as written; repeated rows and null ids stay; other columns are not read.
"""

from __future__ import annotations

import functools
import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after")
#: Labelled blocks, by hand: the six features, then whether the block is main text. Fixed values.
LABELLED = """
1 1 0 0 1 1 0
1 1 1 1 1 1 0
1 1 1 1 9 0 0
2 1 1 1 12 0 0
3 1 2 1 4 1 0
4 1 3 1 4 1 0
2 1 0 0 2 1 0
2 1 0 0 40 0 0
5 1 50 0 4 1 0
3 1 60 0 3 1 0
6 1 60 0 50 0 0
2 1 3 1 0 0 0
4 .5 3 1 5 .8 0
20 .9 10 1 12 1 0
35 .8 4 1 5 1 0
4 0 1 1 8 0 0
5 0 2 1 12 0 0
7 0 1 1 11 0 0
8 0 3 1 7 0 0
9 0 1 1 8 0 0
12 0 1 1 13 0 0
13 0 1 1 9 0 0
15 0 1 1 14 0 0
16 0 1 1 10 0 0
22 0 1 1 12 0 0
6 0 3 1 90 0 1
8 0 2 1 45 0 1
12 0 1 1 70 0 1
45 0 6 1 50 0 1
60 0 1 1 5 0 1
40 0 2 1 3 0 1
34 0 5 1 4 0 1
12 0 9 0 40 0 1
8 0 9 0 25 0 1
7 0 16 0 3 0 1
14 0 4 0 2 0 1
9 0 12 0 1 0 1
2 0 8 0 33 0 1
9 0 0 0 40 0 1
5 0 0 0 60 0 1
12 0 0 0 25 0 1
2 0 0 0 2 1 0
3 0 0 0 1 1 0
4 0 0 0 6 1 0
1 0 12 0 30 0 1
1 0 60 0 20 0 1
1 0 2 0 10 0 1
2 0 1 0 15 0 1
2 0 70 0 9 0 1
3 0 40 0 90 0 1
4 0 13 0 11 0 1
6 0 5 0 8 0 1
10 0 60 0 16 0 1
15 0 90 0 12 0 1
18 0 2 0 9 0 1
1 0 5 0 1 0 1
2 0 3 0 4 0 1
2 0 40 0 7 0 1
3 0 20 0 12 0 1
4 0 1 0 2 0 1
5 0 13 0 5 0 1
7 0 6 0 7 0 1
8 0 8 0 1 0 1
8 0 121 0 1 0 1
9 0 47 0 7 0 1
9 0 116 0 7 0 1
10 0 67 0 3 0 1
11 0 30 0 14 0 1
13 0 144 0 5 0 1
16 0 120 0 2 0 1
17 0 9 0 6 0 1
25 .1 40 0 30 0 1
60 .4 20 0 30 0 1
120 0 20 0 90 0 1
200 0 3 0 1 0 1
2000 0 10 0 12 0 1
22 0 35 0 3 1 1
55 0 12 0 6 1 1
90 .1 40 0 2 1 1
3 0 30 0 2 1 0
4 0 38 0 2 1 0
5 0 20 0 3 1 0
3 0 55 0 0 0 0
6 0 4 1 0 0 0
8 0 25 0 0 0 0
9 .2 120 0 0 0 0
10 0 1 0 0 0 0
11 0 9 0 0 0 0
12 0 60 0 0 0 0
14 0 2 0 0 0 0
15 0 2000 0 0 0 0
16 0 300 0 0 0 0
18 0 40 0 0 0 0
26 0 30 0 0 0 1
32 0 20 0 0 0 1
40 0 3 0 0 0 1
45 0 40 0 0 0 1
90 0 50 0 0 0 1
150 .1 0 0 0 0 1
60 0 0 0 0 0 1
6 0 0 0 0 0 0
"""
SKIPPED = frozenset("script style noscript template svg math iframe object canvas select button textarea head title".split())
BOILER = frozenset("nav footer aside form menu dialog".split())
BLOCK = frozenset(("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that need no end tag; one of them never holds what follows it.
LOOSE = frozenset("p li dt dd tr td th option".split())
TOKENS = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ENDS = {t: re.compile(rf"</{t}(?![A-Za-z0-9])[^>]*>?", re.I) for t in SKIPPED}
#: Of those, the ones whose content is no markup: without an end tag they run on to the end of the page.
RAW = frozenset("script style noscript template iframe textarea title".split())


class _Open:
    """Open elements, with their places by name, so that any tag is found or missed at once."""

    def __init__(self):
        self.stack: list[tuple[str, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []             # of block elements that an optional end tag does not reach across
        self.boiler = self.links = 0
        self.forms: list[int] = []             # of forms that count as boilerplate

    def push(self, tag: str, boiler: bool) -> None:
        at = len(self.stack)
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK and tag not in LOOSE:
            self.walls.append(at)
        if tag == "form" and boiler:
            self.forms.append(at)
        self.stack.append((tag, boiler))
        self.boiler += boiler
        self.links += tag == "a"

    def pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            tag, boiler = self.stack.pop()
            self.places[tag].pop()
            if self.walls and self.walls[-1] == len(self.stack):
                self.walls.pop()
            if self.forms and self.forms[-1] == len(self.stack):
                self.forms.pop()
            self.boiler -= boiler
            self.links -= tag == "a"

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def release_forms(self) -> None:
        """A form around the whole page is no form."""
        for at in self.forms:
            self.stack[at] = ("form", False)
            self.boiler -= 1
        self.forms.clear()


def blocks_of(page: str | None) -> list[tuple[str, int, float, bool]]:
    """(text, words, share of them in links, whether in an element for something else than text) of every block, in page order."""
    page, out, opened, unended = page or "", [], _Open(), set()
    parts: list[tuple[str, bool]] = []

    def close_block() -> None:
        if parts:
            text = " ".join(references.unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = sum(len(references.unescape(p).split()) for p, in_link in parts if in_link)
                words = len(text.split())
                out.append((text, words, min(1.0, linked / words), opened.boiler > 0))
            parts.clear()

    at = 0
    while at < len(page):
        found = TOKENS.search(page, at)
        if found is None:
            parts.append((page[at:], opened.links > 0))
            break
        if found.start() > at:
            parts.append((page[at:found.start()], opened.links > 0))
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if tag in SKIPPED:
            if not closing and tag != "head" and not attributes.rstrip().endswith("/") and tag not in unended:
                end = ENDS[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    at = len(page)
                else:
                    unended.add(tag)
            continue
        if tag in BLOCK:
            close_block()
        if tag in VOID:
            continue
        if closing:
            if (place := opened.last(tag)) >= 0:
                opened.pop_to(place)
            continue
        if tag in LOOSE and opened.last(tag) > (opened.walls[-1] if opened.walls else -1):      # an open one ends where its like begins
            opened.pop_to(opened.last(tag))
        inside = max(opened.last("article"), opened.last("main")) >= 0
        if tag in ("article", "main"):
            opened.release_forms()
        opened.push(tag, tag in BOILER or (tag == "header" and not inside) or (tag == "article" and opened.last(tag) >= 0))
    close_block()
    return out


def features_of(blocks: list[tuple[str, int, float, bool]]) -> np.ndarray:
    if not blocks:
        return np.zeros((0, len(FEATURES)))
    own = np.array([b[1:3] for b in blocks], float)
    edge = np.zeros((1, 2))
    return np.concatenate([own, np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple:
    """Gini tree: ('leaf', label) or (feature, cut, below, above); ties go to the first feature and cut."""
    ones = y.sum()
    if depth == 0 or ones in (0, len(y)):
        return ("leaf", bool(2 * ones >= len(y)))
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            impurity = sum(2 * s.sum() * (len(s) - s.sum()) / len(s) for s in (y[low], y[~low]))
            if impurity < best[0] - 1e-12:
                best = (impurity, f, cut)
    if best[0] == np.inf:
        return ("leaf", bool(2 * ones >= len(y)))
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@functools.cache
def tree() -> tuple:
    rows = np.array([[float(v) for v in line.split()] for line in LABELLED.strip().split("\n")])
    return grow(rows[:, :-1], rows[:, -1].astype(int))


def judge(node: tuple, row: np.ndarray) -> bool:
    while node[0] != "leaf":
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node[1]


def main_text(page: str | None, node: tuple) -> str:
    blocks = blocks_of(page)
    return " ".join(b[0] for b, row in zip(blocks, features_of(blocks)) if not b[3] and judge(node, row))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    node = tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, node) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
