"""Main text of web pages from flat text blocks and a decision tree.

A page is read as a row of text blocks. A block is described by its number of words and its link
density, by those of the blocks before and after it, and by a few flags of the elements around it. A
small decision tree, trained on a labelled table of blocks, says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Element names by role, and words in class, id and role that mark boilerplate or text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option "
    "p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas xmp noembed noframes".split())
ASIDE = frozenset("nav footer aside form menu dialog button select header fieldset".split())
TEXT = frozenset("article main".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments "
    "consent contentinfo cookie cookies copyright disclaimer disqus footer header legal login masthead menu modal nav "
    "navbar navigation newsletter notice notification pagination popup promo promotion related replies reply "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget alert".split()
)
TEXT_WORDS = frozenset("article body content entry main post story".split())
CLOSES_P = BLOCKS - {"button", "label", "option", "optgroup", "legend", "caption"}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Words of asides that can hold articles of their own, as comments and teasers do.
HOLDS_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising comment comments disqus modal newsletter popup promo promotion "
    "related replies reply respond sponsor sponsored widget".split()
)
# How sure a name is: of a page's layout, of the element's own role, or hidden. An article within the first
# is text again, and main within the first two.
LAYOUT, OWN, HIDDEN = 1, 2, 3
WORD = re.compile(r"\S+")


@dataclass
class Block:
    """Text of a block with what the tree needs; `at` is its place in the page's source."""

    text: str
    linked: int
    words: int
    aside: bool
    named: bool
    inside: bool
    heading: bool
    at: int


def _named(token: str) -> int:
    """What a word of class, id or role says of an element: 0, LAYOUT or OWN."""
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    found, text = ASIDE_WORDS.intersection(words), TEXT_WORDS.intersection(words)
    if words[:1] in (["has"], ["no"], ["with"]) or text and words[-1] in ("wrap", "wrapper", "container", "layout"):
        return 0
    if found == {"header"} and words[0] in ("article", "entry", "post", "story"):
        return 0
    if not found:
        return 0
    return OWN if len(words) == 1 or found & HOLDS_WORDS else LAYOUT


def _flags(name: str, attributes: str) -> tuple[bool, int, bool]:
    """(element apart from the text, how it is named or hidden as such, element of the main text)."""
    aside, named, inside = name in ASIDE, 0, name in TEXT
    for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            named = HIDDEN
        elif key == "style":
            named = HIDDEN if "display:none" in value.replace(" ", "") else named
        elif key in ("class", "id", "role") and name not in ("html", "body"):
            named = max(named, *map(_named, value.split()), 0)
            inside = inside or bool(TEXT_WORDS.intersection(re.split(r"[^a-z]+", value)))
    return aside, named, inside


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order; empty ones are left out."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple] = []  # name, aside, named, inside of the open elements, each with those around it
    parts: list[tuple[str, bool]] = []
    links, first, raw = 0, 0, None

    def end_block() -> None:
        nonlocal parts
        if not parts:
            return
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = len(WORD.findall(html.unescape(" ".join(p for p, in_link in parts if in_link))))
            top = stack[-1] if stack else ("", False, 0, False)
            heading = any(s[0] in HEADINGS for s in stack[-3:])
            out.append(Block(text, linked, len(text.split(" ")), top[1], top[2] > 0, top[3], heading, first))
        parts = []

    def add(text: str, at: int) -> None:
        nonlocal first
        if not parts:
            first = at
        parts.append((text, links > 0))

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            add(page[at:end], at)
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1] or m[4] or "", m[2] or m[5], m[3] or m[6] or "")
        if name is None:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")), m.start())
            continue
        name = name.lower()
        if name in RAW and not closing and not attributes.rstrip().endswith("/"):
            raw = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = raw.end() if raw else len(page)
            continue
        if name == "br":
            add(" ", m.start())
            continue
        if name == "a":
            links = max(0, links - 1) if closing else 1
            continue
        if name not in BLOCKS:
            continue
        end_block()
        links = 0 if name in ("li", "p", "td", "div", "nav", "ul") else links
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in VOID:
            continue
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
        if stack and name in ("li", "option", "td", "th", "tr", "dt", "dd") and stack[-1][0] == name:
            stack.pop()
        aside, named, inside = _flags(name, attributes)
        around = stack[-1] if stack else ("", False, 0, False)
        if name == "header" and around[3]:
            aside, named = False, named if named == HIDDEN else 0
        above = around[2]
        if name in TEXT and above <= (OWN if name == "main" else LAYOUT):
            above = 0
        stack.append((name, aside or around[1], max(named, above), inside or around[3]))
    end_block()
    return out


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "named", "inside", "heading",
)


def features(found: list[Block]) -> np.ndarray:
    words = np.array([b.words for b in found], dtype=float)
    links = np.array([min(1.0, b.linked / b.words) for b in found])
    flags = np.array([(b.aside, b.named, b.inside, b.heading) for b in found], dtype=float).reshape(-1, 4)
    before, after = (lambda v: np.r_[0.0, v[:-1]]), (lambda v: np.r_[v[1:], 0.0])
    return np.column_stack([words, links, before(words), before(links), after(words), after(links), flags])


@dataclass(frozen=True)
class Tree:
    """Arrays of nodes: feature (-1 for a leaf), threshold, left, right, verdict."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    verdict: tuple[bool, ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(x), dtype=int)
        while (open_ := feature[at] >= 0).any():
            rows = np.flatnonzero(open_)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
        return np.array(self.verdict)[at]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Tree:
    """A tree by Gini impurity; ties go to the first feature and the lowest threshold."""
    nodes: list[list] = []

    def gini(part: np.ndarray) -> float:
        p = part.mean()
        return 2 * p * (1 - p) * len(part)

    def node(rows: np.ndarray, level: int) -> int:
        here = len(nodes)
        nodes.append([-1, 0.0, 0, 0, bool(y[rows].mean() >= 0.5)])
        best = (gini(y[rows]) - 1e-9, None)
        if level < depth and 0 < y[rows].mean() < 1:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[rows, f] <= cut
                    if min(low.sum(), (~low).sum()) >= least:
                        cost = gini(y[rows][low]) + gini(y[rows][~low])
                        if cost < best[0] - 1e-9:
                            best = (cost, (f, cut))
        if best[1] is not None:
            f, cut = best[1]
            low = x[rows, f] <= cut
            nodes[here][0], nodes[here][1] = f, float(cut)
            nodes[here][2] = node(rows[low], level + 1)
            nodes[here][3] = node(rows[~low], level + 1)
        return here

    node(np.arange(len(y)), 0)
    return Tree(*(tuple(c) for c in zip(*nodes, strict=True)))


def labelled_blocks(pages: list[list[tuple[int, str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of pages given as pieces (label, source)."""
    xs, ys = [], []
    for pieces in pages:
        starts = np.cumsum([0, *(len(s) for _, s in pieces)])
        found = blocks("".join(s for _, s in pieces))
        xs.append(features(found))
        ys += [pieces[int(np.searchsorted(starts, b.at, side="right")) - 1][0] for b in found]
    return np.concatenate(xs), np.array(ys, dtype=float)


def trained() -> Tree:
    from akin.llm.html_examples import PAGES

    return grow(*labelled_blocks(PAGES))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n\n".join(b.text for b, kept in zip(found, tree.predict(features(found)), strict=True) if kept)


def extracted(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """`pages` with text and n_chars (code points) from the column html, for every row.

    A null or empty page, or one without main text, gives an empty text. White space inside a block is
    one blank; blocks are joined by an empty line. Repeated rows give equal results. Columns of `pages`
    named text or n_chars are replaced. An empty table gives an empty table.
    """
    tree = tree or trained()

    @pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, tree) for p in batch], dtype="object")

    out = pages.withColumn("text", extract(F.col("html").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast("long"))
