"""Main-text extraction: flat text blocks classified by a decision tree.

A page is cut into text blocks at block-level tags. A block's features are its word count, link density and number of links,
the word counts and link densities of its neighbours, whether it is a heading, and two marks: whether an
enclosing element is marked as an article, and whether a nearer one is marked as a part that is none (menus, sidebars,
adverts, forms, comments). A decision tree, grown from a small labelled table below, says which
blocks are main text; they are joined in page order. The marks are features like the others: a row of links inside an article goes,
and paragraphs that an article element does not enclose may stay.

Work is one pass over the rows without a shuffle; each page is held whole by one row's turn.

Defined results: null html is the empty page, with empty text; long pages are read whole; markup that never closes reaches to
the page's end; repeated rows each return; an empty table gives an empty result. Columns other
than id and html pass untouched, but for one that has the result's name, which the result replaces.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|title|object|canvas)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
#: Fixed values of the HTML standard: elements that stand inside a line, and those without content.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are no article, and names (of class, id or role) that tell of one or the other.
ASIDE = set("nav footer aside form menu dialog button fieldset figure-ad".split())
MAIN_NAMES = set("article articlebody articlecontent content entry entrycontent main maincontent post postbody postcontent story storybody".split())
ASIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog discussion disqus footer form "
    "gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification pagination pager popup privacy promo recommended related replies reply respond search share sharing shop sidebar "
    "signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)

ASIDE_BEGINNINGS = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "related", "sidebar", "sponsor", "subscri")
#: Parts of a name that make it tell of the whole's state, not of what the element is.
STATES = set("has no not with without open closed enabled disabled".split())


@dataclass(slots=True)
class Block:
    text: str
    words: int
    links: float  # share of words inside links
    anchors: int  # links
    main: int  # an enclosing element marks an article
    aside: int  # an enclosing element, nearer than the article's, marks another part
    heading: int


def _mark(tag: str, attrs: str, in_main: bool) -> int:
    """1 for an element that marks an article, -1 for another page part, 0 for neither."""
    names: list[str] = []
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style" and _NO_DISPLAY.search(value) or name == "aria-hidden" and value.lower() == "true":
            return -1
        if name in ("class", "id", "role"):
            names += value.split()
    if tag in ("body", "html"):
        return 0
    if tag in ASIDE or tag == "header" and not in_main:
        return -1
    wholes = {re.sub("[^a-z]", "", n.lower()) for n in names}
    if tag in ("article", "main"):  # part of a name is no reason against it
        return -1 if wholes & ASIDE_NAMES else 1
    aside = False
    for name in names:
        parts = [p.lower() for p in _PART.findall(name)]
        if not STATES.intersection(parts):
            found = {p for p in parts if p in ASIDE_NAMES or p.startswith(ASIDE_BEGINNINGS)}
            if in_main or {"article", "entry", "post", "story"}.intersection(parts):
                found.discard("header")  # an article's own headline
            aside = aside or bool(found)
    return -1 if aside else int(bool(wholes & MAIN_NAMES))


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in page order."""
    out: list[Block] = []
    open_tags: list[tuple[str, int]] = []  # elements that hold blocks, with the mark in force inside
    piece: list[tuple[str, bool]] = []
    state, link, heading, line_mark, anchors = 0, 0, 0, 0, 0

    def end() -> None:
        nonlocal anchors
        if piece:
            text = _SPACE.sub(" ", html.unescape("".join(p for p, _ in piece))).strip()
            if text:
                words = text.count(" ") + 1
                linked = sum(len(p.split()) for p, inside in piece if inside)
                mark = line_mark or state
                out.append(Block(text, words, min(1.0, linked / words), anchors, int(mark > 0), int(mark < 0), heading))
            piece.clear()
        anchors = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece.append((page[at : m.start()], link > 0))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                link = 0 if m["close"] else 1
                anchors += link
            continue
        end()
        link = 0
        if m["close"]:
            line_mark = 0
            if tag[0] == "h" and tag[1:].isdigit():
                heading = 0
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == tag:
                    del open_tags[k:]
                    state = open_tags[-1][1] if open_tags else 0
                    break
            continue
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        own = _mark(tag, m["attrs"], state > 0)
        if tag == "p" or tag == "li" or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            line_mark = own if own < 0 else 0
            heading = int(tag[0] == "h")
            continue
        line_mark = heading = 0
        state = own if own < 0 or own > 0 and state >= 0 else state
        open_tags.append((tag, state))
    if at < len(page):
        piece.append((page[at:], link > 0))
    end()
    return out


_NONE = Block("", 0, 0.0, 0, 0, 0, 0)


def block_features(found: list[Block]) -> list[tuple[float, ...]]:
    """For each block: words, link density, links, heading, words and link density before and after, whether an article's
    mark encloses it, whether another part's does, and whether any block of the page lies in a marked article."""
    around = [_NONE, *found, _NONE]
    marked = int(any(b.main for b in found))
    return [(b.words, b.links, b.anchors, b.heading, p.words, p.links, n.words, n.links, b.main, b.aside, marked) for p, b, n in zip(around, found, around[2:], strict=False)]


#: Labelled pages: each block is written as label, mark (m article, a other part, - none), words, percent of linked words,
#: h for a heading, and x and a number where there are more links than one.
TRAINING = """
0a6,100 0a8,0 1m8,0h 1m1,0 1m40,0 1m2,0 1m120,5 0a12,0
0a1,100 0a1,100 0a1,100 0a9,0 1m12,0h 1m90,0 1m60,2 1m3,0 0a10,20
0a4,100 1m30,0 1m25,40 1m4,0h 1m80,0 0a30,10 0a45,0 0a14,0
0-2,100 0-2,100 0-2,100 1-9,0h 1-60,0 1-45,3 1-70,0 0-4,100 0-9,80
0-3,100 1-7,0h 1-35,0 1-50,10 1-28,0 0-5,60 0-3,100
0a2,0 0a25,0 1m10,0h 1m10,0 1m55,0 0a60,0 1m48,0 0a50,0 0a70,0
0-5,100 0-6,0 1-40,0 1-18,0 1-90,0 0-6,0 0-3,100
0a10,50 0a20,0 1m6,0 1m5,100 1m33,0 0a3,0
0-1,100 0-1,100 1-100,0 1-6,0h 1-70,0 1-22,0 0-8,50 0-6,0
0a5,0 0-3,0 1m5,0 1m200,0 0-4,0 0a3,100
0a40,0 0-12,0 1m70,0 1m1,0 1m9,100 1m16,0 0-20,0 0a80,0
0-3,100 0-4,0 0-2,100 1-6,0h 1-24,0 1-5,0 1-32,0 0-7,90 0-2,0
0-2,100 0-3,100 1-5,0h 1-41,0 1-41,0 1-41,0 0-2,100
0-2,100 1-5,0h 1-55,0 1-12,0 1-160,0 1-38,0 0-1,100 0-1,100
0-6,80 1-9,0h 1-14,0 1-30,0 1-21,20 1-44,0 0-3,100 0-2,0
0-1,100 0-2,0 1-80,0 1-11,0 1-95,0 1-61,0 0-10,70 0-5,0
0-4,100 1-3,0h 1-19,0 1-27,0 1-8,0 1-130,4 0-6,100 0-9,0
1-4,0h 1-48,0 1-52,0 1-47,0 1-13,0h 1-66,0 0-4,100
0-2,100 1-33,0 1-36,0 1-210,0 1-24,0 0-12,100 0-3,0
0-7,60 0-3,100 1-8,0h 1-17,0 1-15,0 1-40,0 0-2,100 0-8,0
1m1,0
1m3,100
1m7,0h 1m2,0
0a40,0 0a38,0 0-22,0 1m1,0 1m2,100 0a90,0 0-20,0
0a15,0 1m3,0h 1m1,0 0a25,0 1m4,100 0a33,5 1m2,0 0-12,0 0a44,0
0-30,0 0a20,0 0a21,0 1m2,0 1m1,50 1m150,0 0-31,0 0-12,0
0a100,0 0a12,0h 0a55,0 1m20,100 1m6,0h 1m1,100 0a3,0h 0a61,0
0-9,0h 0-25,0 1m5,0h 1m3,0 1m2,0 0-8,0h 0-20,0 0a200,0
0a2,0 0a18,0 0a30,0 0a26,0 1m9,0 0a37,0 0a41,0 0a28,0
0a11,0 1m2,30 0a50,0 1m1,0h 0a64,0 1m3,0 0a72,0 1m30,60
1m6,0h 1m70,0 0m1,100 0m1,100 0m1,100
0m2,100 0m1,100 0m3,100 1m9,0h 1m44,0 1m130,2
1m5,0h 1m25,0 0m3,100x3 1m60,0 0m4,100x4
1m7,0 0m1,100 0m2,100 0m1,100 1m12,0 1m4,0 1m33,10x3
0m5,90x4 1m90,0 1m1,0 1m2,0 0m8,100x5 1m61,0 1m200,6x9
1m8,0h 1m3,0 1m250,4x6 0m1,100 0m1,100 0m2,100 0m1,100
1m11,0 1m22,30x2 1m17,25x2 1m52,20x4 0m6,85x5 0m3,100 0m2,100
1m1,0h 1m1,0 1m1,0 1m40,0 1m2,0h 1m300,1x2 0m12,100x6
1m14,0 1m6,0 1m9,35x2 1m80,0 1m7,50 1m5,0 0m9,80x6 0m10,90x5
0a3,100x3 1m4,0h 1m45,0 1m1,0 1m18,45x3 1m65,0 0m5,100x2 0m7,100x3
0a2,100x2 0a6,0 1-9,0h 1-95,0 1-120,0 1-80,0 0a5,100 1m4,0
0a2,100 1m15,0 1-7,0h 1-110,0 1-90,2 1-140,0 1-85,0 0-3,100 0a60,0
1m12,0 0-2,100x2 0-3,100x3 1-8,0h 1-130,1 1-75,0 1-100,0 1-200,0 0a20,0 0-5,0
0-2,100 0-2,100 0-18,0 0-14,0 1m6,0h 1m80,0 1m90,0 1m75,0 0-15,0 0-16,20 0-2,100
0-4,100 0-11,0 1m30,0 1m100,0 0-26,0 0-28,0 0a130,0 0-22,0 0a95,0
0-12,50 0-24,0 0-9,0 0a110,0 0-21,0 1m9,0 1m1,0 0a150,0 0-19,0 0-27,30
0a120,0 0a130,0 0a90,0 1m8,0h 1m95,0 1m110,0 0a100,0 0a85,0 0a140,0
1m5,0h 1m40,0 1m6,100 1m8,0 1m3,100 1m2,0 1m9,100
1m4,100 1m30,0 1m7,100 1m6,0 1m11,100 1m5,0 0a12,0
1m2,0 1m5,100 1m3,0 1m10,100 1m1,0 1m8,100 1m14,0
1m80,0 0m4,100 0m9,100 0m3,100 0m7,100 0m12,100 1m60,0
0m14,100 0m11,100 0m2,100x2 1m3,0 0m13,100x3 1m9,0 0m6,100x2
0a9,100 0-45,0 0a3,0 1m6,0h 1m70,0 1m50,0 0a8,100 0-60,0 0a7,100
0-55,0 0a6,100x3 1m90,0 1m33,0 0-80,2 0a10,0 0a5,100
0-2,100 0-90,0 0-3,100 1m4,0h 1m25,0 1m120,0 0-7,0 0-48,0 0-2,100x2
0a4,0 0-38,0 0-9,0 1m100,0 1m7,0 0a11,0 0-110,0 0a6,0
0a30,0 1-9,0h 1-60,0 1-45,0 0a50,0 0a90,0
0a6,0h 0a70,0 1-30,0 1-85,0 0a22,0 0a40,0 0a35,0
0a12,0 0a9,0 0a28,0 1-7,0h 1-50,0 1-25,0 0a120,0 0a60,0
0a8,0h 0a55,0 0a14,0 1-4,0h 1-100,0 1-18,0 1-75,0 0a10,0h 0a44,0 0a65,0
0-41,0 1m2,0h 1m9,0 0a12,0 0-66,0 0-4,100
0a80,0 0a1,0 1m2,0 0a300,0 0a4,0h 0a110,0 0a75,0 0a95,0
"""


def training_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of ``TRAINING``."""
    rows, labels = [], []
    for line in TRAINING.split("\n"):
        page = []
        for label, mark, words, links, heading, anchors in re.findall(r"([01])([ma-])(\d+),(\d+)(h?)(?:x(\d+))?", line):
            labels.append(int(label))
            page.append(Block("", int(words), int(links) / 100, int(anchors or int(links) > 0), int(mark == "m"), int(mark == "a"), int(heading == "h")))
        rows += block_features(page)
    return np.array(rows, float), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2):
    """A decision tree by Gini impurity: a label, or (feature, threshold, tree up to it, tree above)."""
    ones = int(y.sum())
    if depth == 0 or ones in (0, len(y)):
        return int(2 * ones > len(y))
    best = (2.0, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            n = int(low.sum())
            if n < least or len(y) - n < least:
                continue
            p, q = y[low].mean(), y[~low].mean()
            impurity = (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
            if impurity < best[0] - 1e-12:
                best = (impurity, f, float(t))
    if best[0] > 1:
        return int(2 * ones > len(y))
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


@lru_cache(maxsize=1)
def tree():
    """The tree that is grown from the labelled table."""
    return grow(*training_table())


def decide(node, row) -> int:
    while not isinstance(node, int):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def main_text(page: str | None, node=None) -> str:
    """The main text of one page."""
    found = blocks(page or "")
    node = tree() if node is None else node
    return " ".join(b.text for b, row in zip(found, block_features(found), strict=True) if decide(node, row))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """``pages`` with a column of the main text."""

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        node = tree()
        return pd.Series([main_text(p, node) for p in col], dtype=object)

    return pages.withColumn(text_col, run(F.col(html_col).cast("string")))
