"""Main text of web pages: flat text blocks and a decision tree over their neighbours."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import quoted

# Elements of HTML by what they do to a flow of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math canvas iframe object select textarea button head title datalist audio video".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
#: Elements and roles that say what a part of a page is: 1 its article, -1 beside it.
PARTS = {"article": 1, "main": 1} | dict.fromkeys("nav footer aside form dialog menu search fieldset".split(), -1)
ROLES = {"article": 1, "main": 1} | dict.fromkeys(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split(), -1
)
#: Words by which classes and ids name what a part of a page is.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent "
    "gdpr notice notices nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets related "
    "recommended recommendations share sharing social comment comments reply replies responses discussion footer header masthead "
    "topbar popup modal overlay newsletter subscribe subscription signup login paywall copyright disclaimer pagination pager toolbar".split()
)
INSIDE = frozenset("article content story entry post body main text prose".split())
#: What makes a name say something about a whole page instead: ``no-sidebar``, ``menu-open``.
STATE = frozenset("has no with without layout page template grid open closed free enabled disabled active wrapper container".split())

#: Raw elements whole, comments and declarations, tags with quoted values, tags.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACES = re.compile(r"[\s ]+")


_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def named(name: str) -> int:
    """What one class or id says: 1 an article, -1 something beside it, 0 neither.

    The last word of a name says what it is and the first what it belongs to:
    ``entry-content`` is an article, ``post-comments`` and ``comment-body`` are beside it.
    """
    words = [w.lower() for w in _NAME.findall(name)]
    if not words or words[0] in STATE or words[-1] in STATE:
        return 0
    if words[-1] == "header" and words[0] in INSIDE:
        return 0
    if words[-1] in BESIDE or words[0] in BESIDE:
        return -1
    return int(words[-1] in INSIDE)


def part_of(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """What an element says of itself: by its kind or role, else by its names, which
    say nothing where they contradict each other. A header in an article is its own, and
    an ``article`` whose names all say something else is none (a comment is marked so)."""
    role = ROLES.get(attributes.get("role", "").lower(), 0)
    kind = PARTS.get(tag, 0) or (-1 if tag == "header" and not inside else 0)
    says = {named(x) for k in ("class", "id") for x in attributes.get(k, "").split()} - {0}
    own = says.pop() if len(says) == 1 else 0
    if kind > 0 and own < 0 and not role:
        return own
    return role or kind or own


def unseen(tag: str, attributes: dict[str, str]) -> bool:
    """Whether a browser shows nothing of an element."""
    style = attributes.get("style", "").lower().replace(" ", "")
    return tag in HIDDEN or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


@dataclass
class Block:
    text: str
    words: int
    links: int
    part: int  # 1 in an article, -1 in a part beside it, 0 if nothing says


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order: text between block-level tags. One
    pass, whose time is in proportion to the page however deep its tags nest."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # tag, whether it hides, what it is part of
    outer: list[int] = []  # places in the stack of tags that are not inline
    opened: dict[str, int] = {}
    hides = anchors = 0

    def flush() -> None:
        if not parts:
            return
        text = _SPACES.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            links = len(html.unescape(" ".join(linked)).split())
            out.append(Block(text, len(text.split()), links, stack[-1][2] if stack else 0))
        parts.clear()
        linked.clear()

    def pop() -> str:
        nonlocal hides, anchors
        tag, hid, _ = stack.pop()
        opened[tag] -= 1
        hides -= hid
        anchors -= tag == "a"
        if outer and outer[-1] == len(stack):
            outer.pop()
        return tag

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at and not hides:
            parts.append(page[at:stop])
            if anchors:
                linked.append(page[at:stop])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag == "br":
            if not hides:
                parts.append("\n")
            continue
        if tag not in INLINE:
            flush()
        if m[1] or m[4]:
            # What is open inside the element ends with it; a stray end tag says nothing.
            while opened.get(tag) and pop() != tag:
                pass
            continue
        rest = m[3] or m[6] or ""
        if tag in VOID or rest.endswith("/") and tag not in RAW:
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and outer and stack[outer[-1]][0] == tag:
            # A new one ends an open one of its kind, and the inline tags left in it.
            top = outer[-1]
            while len(stack) > top:
                pop()
        attributes = {k.lower(): html.unescape(v.strip("\"'")) for k, v in reversed(_ATTR.findall(rest))} if rest else {}
        above = stack[-1][2] if stack else 0
        if tag in ("html", "body"):
            hid, part = False, 0
        else:
            hid, part = unseen(tag, attributes), part_of(tag, attributes, above > 0) or above
            if above < 0 and tag != "main":
                part = -1
        if tag not in INLINE:
            outer.append(len(stack))
        stack.append((tag, hid, part))
        opened[tag] = opened.get(tag, 0) + 1
        hides += hid
        anchors += tag == "a"
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            pop()
    flush()
    return out


#: How many blocks before and after one say something about it.
NEAR = 2
#: Sizes and link densities of a block and of its neighbours, the nearest first.
SIZES = ("words", "density", *(f"{what}_{side}{k}" for k in range(1, NEAR + 1) for side in ("before", "after") for what in ("words", "density")))
#: What markup names: the block's part, and whether any block is named as in an article.
NAMES = ("part", "any_article")


def features(found: list[Block]) -> np.ndarray:
    """A row per block: ``SIZES``, then ``NAMES``. There is nothing beyond a page's ends:
    0 words, and a density of -1."""
    n = len(found)
    out = np.zeros((n, len(SIZES) + len(NAMES)))
    words = np.array([b.words for b in found], dtype=float)
    density = np.minimum(1.0, np.array([b.links for b in found], dtype=float) / np.maximum(words, 1))
    out[:, 0], out[:, 1] = words, density
    for k in range(1, NEAR + 1):
        at = 2 + 4 * (k - 1)
        out[:, [at + 1, at + 3]] = -1
        if n > k:
            out[k:, at], out[k:, at + 1] = words[:-k], density[:-k]
            out[:-k, at + 2], out[:-k, at + 3] = words[k:], density[k:]
    out[:, -2] = [b.part for b in found]
    out[:, -1] = any(b.part > 0 for b in found)
    return out


@dataclass
class Node:
    share: float
    feature: int = -1
    most: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


#: A leaf of sizes and densities is left open, and names are asked, where the share of
#: blocks of the main text in it is neither below this nor above its complement.
OPEN = 0.01


def _split(rows: np.ndarray, labels: np.ndarray, columns: range, least: int) -> tuple[int, float] | None:
    """The column and cut of the least Gini impurity; ties take the first column."""
    n, total, best = len(labels), labels.sum(), None
    k = np.arange(1, n)
    for f in columns:
        order = np.argsort(rows[:, f], kind="stable")
        x, left = rows[order, f], np.cumsum(labels[order])[:-1]
        fine = (x[:-1] < x[1:]) & (k >= least) & (n - k >= least)
        if not fine.any():
            continue
        right = total - left
        gini = np.where(fine, left * (k - left) / k + right * (n - k - right) / (n - k), np.inf)
        at = int(np.argmin(gini))
        if best is None or gini[at] < best[0] - 1e-9:
            best = (float(gini[at]), f, float((x[at] + x[at + 1]) / 2))
    if best is None or best[0] >= total * (n - total) / n - 1e-9:
        return None
    return best[1], best[2]


def fit_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 4, least: int = 50, more: int = 8, fewer: int = 2) -> Node:
    """A binary classification tree. The first ``depth`` questions are for sizes and
    densities alone, with ``least`` blocks on either side; where these leave a leaf open
    (``OPEN``), names are among what ``more`` questions may ask, with ``fewer`` blocks."""
    sizes, every = range(len(SIZES)), range(len(SIZES) + len(NAMES))

    def grow(at: np.ndarray, deep: int, columns: range) -> Node:
        share = float(labels[at].mean())
        cut = _split(rows[at], labels[at], columns, least if columns is sizes else fewer) if deep and 0 < share < 1 else None
        if cut is None:
            if columns is sizes and OPEN < share < 1 - OPEN:
                return grow(at, more, every)
            return Node(share)
        low = rows[at, cut[0]] <= cut[1]
        return Node(share, *cut, grow(at[low], deep - 1, columns), grow(at[~low], deep - 1, columns))

    return grow(np.arange(len(labels)), depth, sizes)


def leaf(tree: Node, row: np.ndarray) -> tuple[float, bool]:
    """The share of the main text among blocks like this one, and whether names were asked."""
    named_ = False
    while tree.feature >= 0:
        named_ |= tree.feature >= len(SIZES)
        tree = tree.low if row[tree.feature] <= tree.most else tree.high
    return tree.share, named_


def accept(tree: Node, row: np.ndarray) -> bool:
    return leaf(tree, row)[0] >= 0.5


def _sample(words: int, links: int = 0) -> str:
    plain = " ".join(["word"] * (words - links))
    return (plain + (" " if plain and links else "") + ("<a href=x>" + " ".join(["link"] * links) + "</a>" if links else "")) or ""


#: The labelled table: flat layouts of common kinds of pages, most with markup that
#: says nothing, as (markup before, words, linked words, markup after, label); 1 is main.
LABELLED = (
    # An article that its markup names, between parts that are named too.
    [("<nav><ul><li>", 1, 1, "</li>", 0), ("<li>", 2, 2, "</li>", 0), ("<li>", 1, 1, "</li></ul></nav>", 0), ("<div class=ad>", 9, 0, "</div>", 0), ("<article><h1>", 8, 0, "</h1>", 1), ("<p>", 40, 0, "</p>", 1), ("<p>", 2, 0, "</p>", 1), ("<p>", 90, 3, "</p>", 1), ("<p>", 5, 5, "</p>", 1), ("<p>", 1, 0, "</p></article>", 1), ("<footer>", 12, 1, "</footer>", 0)],
    [("<header><div>", 4, 0, "</div></header>", 0), ("<main><h1>", 6, 0, "</h1>", 1), ("<p>", 1, 0, "</p>", 1), ("<h2>", 2, 0, "</h2>", 1), ("<ul><li>", 3, 0, "</li>", 1), ("<li>", 5, 5, "</li></ul>", 1), ("<aside>", 30, 0, "</aside>", 0), ("<p>", 25, 25, "</p>", 1), ("<form><p>", 22, 0, "</p></form></main>", 0), ("<div class=comments><p>", 44, 0, "</p>", 0), ("<p>", 61, 0, "</p></div>", 0), ("<div>", 31, 0, "</div>", 0), ("<footer><p>", 30, 2, "</p></footer>", 0)],
    [("<div class=cookie-notice>", 25, 2, "</div>", 0), ("<div class=entry-content><h1>", 7, 0, "</h1>", 1), ("<p>", 60, 0, "</p>", 1), ("<p>", 4, 0, "</p>", 1), ("<p>", 12, 12, "</p></div>", 1), ("<div class=sidebar><p>", 20, 0, "</p></div>", 0), ("<div>", 3, 3, "</div>", 0), ("<div>", 18, 0, "</div>", 0), ("<div class=footer>", 8, 2, "</div>", 0)],
    [("<div>", 14, 0, "</div>", 0), ("<nav><ul><li>", 2, 2, "</li>", 0), ("<li>", 3, 3, "</li></ul></nav>", 0), ("<article><h1>", 6, 0, "</h1>", 1), ("<p>", 5, 0, "</p>", 1), ("<p>", 4, 4, "</p>", 1), ("<h2>", 3, 0, "</h2>", 1), ("<p>", 9, 0, "</p>", 1), ("<ul><li>", 2, 2, "</li>", 1), ("<li>", 4, 0, "</li></ul></article>", 1), ("<div>", 26, 0, "</div>", 0), ("<div>", 12, 0, "</div>", 0), ("<footer>", 9, 0, "</footer>", 0)],
    [("<header><div>", 2, 2, "</div></header>", 0), ("<div>", 40, 2, "</div>", 0), ("<nav><p>", 3, 3, "</p></nav>", 0), ("<main><h1>", 3, 0, "</h1>", 1), ("<p>", 55, 0, "</p>", 1), ("<p>", 7, 7, "</p>", 1), ("<h2>", 2, 0, "</h2>", 1), ("<p>", 6, 0, "</p></main>", 1), ("<div>", 33, 0, "</div>", 0), ("<div>", 7, 0, "</div>", 0), ("<div>", 65, 0, "</div>", 0), ("<div>", 15, 0, "</div>", 0)],
    [("<ul><li>", 2, 2, "</li>", 0), ("<li>", 1, 1, "</li></ul>", 0), ("<article><h1>", 2, 0, "</h1>", 1), ("<p>", 1, 0, "</p>", 1), ("<p>", 6, 6, "</p>", 1), ("<p>", 20, 0, "</p>", 1), ("<p>", 4, 4, "</p>", 1), ("<p>", 3, 0, "</p>", 1), ("<p>", 8, 8, "</p>", 1), ("<p>", 1, 0, "</p>", 1), ("<p>", 2, 2, "</p>", 1), ("<p>", 2, 0, "</p></article>", 1), ("<div>", 4, 4, "</div>", 0), ("<div>", 20, 0, "</div>", 0), ("<div>", 3, 3, "</div>", 0)],
    # News in plain divisions: links above and below, a notice, a list of more stories.
    [("<div>", 2, 2, "</div>", 0), ("<div>", 1, 1, "</div>", 0), ("<div>", 3, 3, "</div>", 0), ("<div>", 9, 0, "</div>", 0), ("<h1>", 9, 0, "</h1>", 1), ("<div>", 27, 0, "</div>", 1), ("<p>", 52, 0, "</p>", 1), ("<p>", 38, 2, "</p>", 1), ("<p>", 6, 0, "</p>", 1), ("<p>", 71, 0, "</p>", 1), ("<p>", 24, 1, "</p>", 1), ("<h3>", 2, 0, "</h3>", 0), ("<div>", 8, 8, "</div>", 0), ("<div>", 11, 11, "</div>", 0), ("<div>", 7, 7, "</div>", 0), ("<div>", 10, 3, "</div>", 0)],
    [("<div>", 5, 5, "</div>", 0), ("<div>", 4, 0, "</div>", 0), ("<div>", 6, 6, "</div>", 0), ("<h2>", 7, 0, "</h2>", 1), ("<p>", 33, 0, "</p>", 1), ("<p>", 19, 0, "</p>", 1), ("<p>", 8, 0, "</p>", 1), ("<p>", 46, 5, "</p>", 1), ("<p>", 29, 0, "</p>", 1), ("<div>", 4, 4, "</div>", 0), ("<div>", 14, 12, "</div>", 0), ("<div>", 6, 2, "</div>", 0), ("<div>", 5, 0, "</div>", 0)],
    # Parts beside the text are named, the text itself is not.
    [("<nav><p>", 2, 2, "</p></nav>", 0), ("<div class=cookie-notice>", 23, 2, "</div>", 0), ("<h1>", 8, 0, "</h1>", 1), ("<p>", 45, 0, "</p>", 1), ("<p>", 5, 0, "</p>", 1), ("<div class=advert>", 14, 0, "</div>", 0), ("<p>", 37, 2, "</p>", 1), ("<p>", 50, 0, "</p>", 1), ("<aside><p>", 28, 0, "</p></aside>", 0), ("<div class=comments><p>", 33, 0, "</p>", 0), ("<p>", 58, 0, "</p>", 0), ("<p>", 21, 0, "</p></div>", 0), ("<footer><p>", 26, 1, "</p></footer>", 0)],
    [("<header><p>", 5, 0, "</p></header>", 0), ("<div class=sidebar><p>", 30, 0, "</p>", 0), ("<p>", 41, 0, "</p></div>", 0), ("<h2>", 6, 0, "</h2>", 1), ("<p>", 62, 0, "</p>", 1), ("<p>", 27, 1, "</p>", 1), ("<p>", 34, 0, "</p>", 1), ("<form><p>", 16, 0, "</p></form>", 0), ("<section id=comments><p>", 39, 0, "</p>", 0), ("<p>", 24, 0, "</p></section>", 0), ("<div>", 4, 4, "</div>", 0), ("<div class=footer><p>", 35, 0, "</p></div>", 0)],
    # A page laid out as a table, its menu in the first column.
    [("<table><tr><td>", 1, 1, "</td>", 0), ("<td>", 2, 2, "</td>", 0), ("<td>", 1, 1, "</td></tr>", 0), ("<tr><td>", 5, 0, "</td>", 1), ("<td>", 85, 0, "</td></tr>", 1), ("<tr><td>", 64, 4, "</td></tr>", 1), ("<tr><td>", 17, 0, "</td></tr>", 1), ("<tr><td>", 42, 0, "</td></tr>", 1), ("<tr><td>", 3, 3, "</td>", 0), ("<td>", 2, 2, "</td>", 0), ("<td>", 7, 0, "</td></tr></table>", 0)],
    # An encyclopedia: many links in the prose, lists of links at the end.
    [("<div>", 3, 3, "</div>", 0), ("<div>", 5, 4, "</div>", 0), ("<h1>", 3, 0, "</h1>", 1), ("<p>", 68, 14, "</p>", 1), ("<p>", 95, 21, "</p>", 1), ("<h2>", 2, 0, "</h2>", 1), ("<p>", 57, 13, "</p>", 1), ("<p>", 20, 5, "</p>", 1), ("<h2>", 1, 0, "</h2>", 1), ("<p>", 44, 9, "</p>", 1), ("<h2>", 2, 0, "</h2>", 0), ("<ul><li>", 6, 6, "</li>", 0), ("<li>", 4, 4, "</li>", 0), ("<li>", 9, 8, "</li></ul>", 0), ("<div>", 15, 9, "</div>", 0)],
    # A blog post with a byline, steps, and teasers of other posts.
    [("<div>", 4, 4, "</div>", 0), ("<div>", 2, 0, "</div>", 0), ("<div>", 3, 3, "</div>", 0), ("<h1>", 11, 0, "</h1>", 1), ("<p>", 22, 0, "</p>", 1), ("<ol><li>", 9, 0, "</li>", 1), ("<li>", 13, 0, "</li>", 1), ("<li>", 7, 0, "</li>", 1), ("<li>", 16, 0, "</li></ol>", 1), ("<p>", 41, 3, "</p>", 1), ("<p>", 35, 0, "</p>", 1), ("<div>", 6, 6, "</div>", 0), ("<div>", 13, 7, "</div>", 0), ("<div>", 12, 6, "</div>", 0), ("<div>", 4, 4, "</div>", 0), ("<div>", 9, 1, "</div>", 0)],
    # A shop: a description among prices, buttons and links.
    [("<div>", 2, 2, "</div>", 0), ("<div>", 1, 1, "</div>", 0), ("<div>", 2, 0, "</div>", 0), ("<div>", 3, 3, "</div>", 0), ("<div>", 1, 0, "</div>", 0), ("<div>", 2, 2, "</div>", 0), ("<h1>", 6, 0, "</h1>", 1), ("<p>", 48, 0, "</p>", 1), ("<p>", 31, 0, "</p>", 1), ("<div>", 3, 3, "</div>", 0), ("<div>", 2, 0, "</div>", 0), ("<div>", 2, 2, "</div>", 0), ("<div>", 3, 0, "</div>", 0), ("<div>", 5, 5, "</div>", 0)],
    # Articles that end their page, hold lists of links or parts with odd names, and comments
    # that are marked as articles.
    [("<nav><ul><li>", 2, 2, "</li>", 0), ("<li>", 1, 1, "</li>", 0), ("<li>", 3, 3, "</li></ul></nav>", 0), ("<article><h1>", 5, 0, "</h1>", 1), ("<p>", 45, 0, "</p>", 1), ("<p>", 12, 0, "</p>", 1), ("<p>", 30, 0, "</p></article>", 1)],
    [("<main><h1>", 4, 0, "</h1>", 1), ("<ul><li>", 2, 2, "</li>", 0), ("<li>", 2, 2, "</li>", 0), ("<li>", 3, 3, "</li>", 0), ("<li>", 1, 1, "</li>", 0), ("<li>", 2, 2, "</li>", 0), ("<li>", 2, 2, "</li></ul>", 0), ("<p>", 60, 0, "</p>", 1), ("<p>", 38, 0, "</p></main>", 1), ("<footer>", 9, 0, "</footer>", 0)],
    [("<article><h1>", 7, 0, "</h1>", 1), ("<p>", 55, 0, "</p>", 1), ("<p>", 30, 0, "</p></article>", 1), ("<article class=comment><p>", 28, 0, "</p></article>", 0), ("<article class=comment><p>", 17, 0, "</p></article>", 0), ("<footer>", 10, 0, "</footer>", 0)],
    [("<article><h1>", 6, 0, "</h1>", 1), ("<p>", 52, 0, "</p>", 1), ("<div class=share-price><p>", 50, 0, "</p></div>", 1), ("<p>", 33, 0, "</p>", 1), ("<p>", 41, 0, "</p></article>", 1)],
    [("<article><h1>", 2, 0, "</h1>", 1), ("<p>", 1, 0, "</p>", 1), ("<div class=post-comments><p>", 1, 0, "</p></div></article>", 0)],
    [("<div role=navigation><p>", 1, 0, "</p></div>", 0), ("<div id=mainContent><p>", 1, 0, "</p></div>", 1), ("<div class=comment-body><p>", 45, 0, "</p></div>", 0)],
    [("<article><h1>", 3, 0, "</h1>", 1), ("<p>", 2, 0, "</p></article>", 1), ("<section id=comments><p>", 12, 0, "</p></section>", 0), ("<footer>", 1, 0, "</footer>", 0)],
    # A short text between a menu and a list of links.
    [("<div>", 1, 1, "</div>", 0), ("<div>", 2, 2, "</div>", 0), ("<div>", 2, 2, "</div>", 0), ("<h2>", 7, 0, "</h2>", 1), ("<p>", 58, 0, "</p>", 1), ("<p>", 20, 0, "</p>", 1), ("<ul><li>", 7, 7, "</li>", 0), ("<li>", 10, 10, "</li>", 0), ("<li>", 9, 9, "</li></ul>", 0)],
    # Texts with little or nothing around them.
    [("<p>", 1, 0, "</p>", 1), ("<p>", 1, 0, "</p>", 1)],
    [("<p>", 12, 0, "</p>", 1)],
    [("<h1>", 5, 0, "</h1>", 1), ("<p>", 70, 1, "</p>", 1), ("<p>", 33, 0, "</p>", 1), ("<p>", 28, 0, "", 1)],
    [("<h1>", 4, 0, "</h1>", 1), ("<p>", 21, 0, "</p>", 1), ("<p>", 18, 0, "</p>", 1), ("<p>", 26, 0, "</p>", 1), ("<p>", 3, 3, "</p>", 0)],
)


#: How often each labelled layout is laid out, and by how many doublings lengths vary.
LAYOUTS, DOUBLINGS = 12, 1.5


def laid_out(page: list[tuple[str, int, int, str, int]], rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A labelled layout as markup, every block longer or shorter, and its labels."""
    markup = []
    for before, words, links, after, _ in page:
        times = 2 ** rng.uniform(-DOUBLINGS, DOUBLINGS)
        n = max(1, round(words * times))
        markup.append(before + _sample(n, n if links == words else round(n * links / words)) + after)
    return "".join(markup), [bool(x) for *_, x in page]


@lru_cache(maxsize=1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``LABELLED``, each layout at several lengths of its blocks."""
    rng, rows, labels = np.random.default_rng(7), [], []
    for page in LABELLED:
        for _ in range(LAYOUTS):
            markup, marks = laid_out(page, rng)
            found = blocks(markup)
            if len(found) != len(marks):
                raise ValueError("a labelled page does not split into its rows")
            rows.append(features(found))
            labels += marks
    return np.concatenate(rows), np.array(labels, dtype=float)


@lru_cache(maxsize=1)
def trained() -> Node:
    """The tree fitted to ``LABELLED`` alone."""
    return fit_tree(*_table())


def train(pages: DataFrame, page: str = "html", sample_pages: int = 200, sample_blocks: int = 40_000) -> Node:
    """A tree fitted to ``LABELLED`` and to the blocks of at most ``sample_pages`` different
    pages whose markup names an article, ``sample_blocks`` blocks at most: those that are in
    one are the main text. Each is learned twice, the second time without any name, so that
    sizes decide whatever they can. They are the pages of the least hashes, so reruns agree, and only
    sizes and labels reach the driver. Without such a page the tree is that of ``LABELLED``.
    """
    held = pages.select(quoted(page).alias("x")).filter(F.col("x").rlike("(?i)<article|role=.?article"))
    first = held.select(F.xxhash64("x").alias("h")).distinct().orderBy("h").limit(sample_pages)

    def sized(batches):
        for batch in batches:
            found = [blocks(x) for x in batch["x"]]
            sizes = [[[b.words, b.links, b.part] for b in f[:sample_blocks]] for f in found]
            yield pd.DataFrame({"h": batch["h"], "b": sizes})

    rows = held.withColumn("h", F.xxhash64("x")).join(F.broadcast(first.withColumnRenamed("h", "k")), F.col("h") == F.col("k"), "left_semi")
    got = rows.groupBy("h").agg(F.min("x").alias("x")).mapInPandas(sized, "h long, b array<array<long>>").orderBy("h").toPandas()
    table, labels = _table()
    rows, marks, left = [table], [labels], sample_blocks
    for found in got["b"]:
        page_blocks = [Block("", int(w), int(k), int(p)) for w, k, p in found]
        if not any(b.part > 0 for b in page_blocks) or len(page_blocks) > left:
            continue
        left -= len(page_blocks)
        known = features(page_blocks)
        silent = known.copy()
        silent[:, len(SIZES) :] = 0
        rows += [known, silent]
        marks += [np.array([b.part > 0 for b in page_blocks], dtype=float)] * 2
    return fit_tree(np.concatenate(rows), np.concatenate(marks))


def main_text(page: str | None, tree: Node | None = None) -> str:
    found = blocks(page or "")
    tree = tree or trained()
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if accept(tree, row))


def extract(pages: DataFrame, page: str = "html", tree: Node | None = None) -> DataFrame:
    """Add ``text``: the main text of each whole page, blocks joined by a line end.

    A page is cut at block-level tags into flat text blocks. A decision tree (by default the
    one that ``train`` fits to these pages) accepts a block by its word count and
    link density and those of the two blocks before and after it. Only where these leave
    it open does it ask what the markup names. Each row stands alone: no shuffle, bounded
    Arrow batches, no hot host.

    Character references are decoded once, white space in a block becomes one space,
    blocks are trimmed. Null and empty pages give empty texts, broken or cut-off
    markup what can be read of it; any length is read to its end. Repeated rows give
    repeated results. A column named ``text`` in any case is replaced unless it is
    the page itself; others pass through. An empty table gives an empty result.
    """

    tree = tree or train(pages, page)

    @F.pandas_udf("string")
    def text(found: pd.Series) -> pd.Series:
        return found.map(lambda x: main_text(x, tree))

    rest = [quoted(c) for c in pages.columns if c.lower() != "text"]
    return pages.select(*rest, text(quoted(page)).alias("text"))
