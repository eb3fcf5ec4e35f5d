"""Main text of web pages by tree scoring.

Every paragraph gives points for its length and its commas to its ancestors, fewer the further they are; a container's
points are discounted by the share of its text that is in links. The container with the most points is kept, widened to
the ``article`` or ``main`` element around it, together with siblings that have enough points or read like prose. Containers
that announce themselves as menu, header, footer, sidebar, notice, advert, form or reader comments do not count; inside
``article`` and ``main``, where names often come from headings, only if their links or their points say so too.

Null and empty pages give an empty text. Very long pages are read whole; one pass builds the tree without recursion, so
depth does not matter. Broken markup is read as browsers do: unclosed elements end with their parents. Repeated rows give
equal results. Empty table: no rows. Extra columns pass through unless they are named text or n_chars.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[a-zA-Z/][^>]*+\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Names of HTML elements.
RAW = frozenset("script style noscript template textarea title iframe svg math object xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li td th pre blockquote dd dt figcaption caption summary".split())
#: Elements whose class and id can announce something else than main text.
NAMED = BLOCK - PROSE
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"} | {"hr"}
#: An opening tag ends an open one of these, unless an element of the second set is between.
SAME = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that are never main text.
UNWANTED = frozenset("nav footer aside form button select input dialog menu search head fieldset label datalist canvas audio video".split())
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class and id names that announce something else than main text.
UNWANTED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc "
    "header masthead topbar footer bottombar sidebar sidebars aside widget widgets rail "
    "comment comments commentlist disqus replies reply respond discussion responses "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search copyright".split()
)
WANTED_NAMES = frozenset("article body content contents entry main post story text blog page".split())
#: Classes, not ids, that never stand for a part of the article.
NEVER_TEXT = frozenset("ads adv advert adverts advertisement advertising adsense adslot cookie cookies gdpr sidebar sidebars comment comments commentlist disqus".split())
KEPT_ROOTS = frozenset("html body article main".split())


class Tree:
    """Elements by number in page order: parent, tag, whether unwanted, attributes' weight, and pieces of text."""

    def __init__(self):
        self.parent, self.tag, self.bad, self.weight = [-1], ["html"], [False], [0.0]
        self.block, self.linked, self.article = [0], [False], [False]
        #: Element to attribute: parts of an article with an unwanted name, whose text decides.
        self.doubtful: dict[int, str] = {}
        self.open: Counter[str] = Counter()
        #: (element, text) in page order; text None is a line break.
        self.pieces: list[tuple[int, str | None]] = []

    def add(self, parent: int, tag: str, attributes: str) -> int:
        n = len(self.tag)
        bad, weight = self.bad[parent], 0.0
        if not bad:
            bad, weight = self.judged(n, parent, tag, attributes)
        self.parent.append(parent)
        self.tag.append(tag)
        self.bad.append(bad)
        self.weight.append(weight)
        self.block.append(n if tag in BLOCK else self.block[parent])
        self.linked.append(tag == "a" or self.linked[parent])
        self.article.append(tag in ("article", "main") or self.article[parent])
        return n

    def leave(self, stack: list[int], depth: int) -> None:
        """Ends the open elements from ``depth`` on."""
        self.open.subtract(self.tag[e] for e in stack[depth:])
        del stack[depth:]

    def judged(self, n: int, parent: int, tag: str, attributes: str) -> tuple[bool, float]:
        if tag in UNWANTED:
            return True, 0.0
        inside = tag == "header" and self.article[parent]
        if tag == "header" and not inside:
            return True, 0.0
        weight = {"article": 30.0, "main": 20.0}.get(tag, 0.0)
        if len(attributes) < 3:
            return False, weight
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), max(values, key=len)
            if name in ("class", "id"):
                parts = {p.lower() for p in NAME_PART.findall(value)}
                unwanted = parts & UNWANTED_NAMES
                if unwanted and tag in NAMED and tag not in KEPT_ROOTS and not inside and not (tag == "div" and parts & {"article", "story", "post"} and parts & {"page", "content", "body", "text"}):
                    if name == "class" and parts <= NEVER_TEXT or not self.article[parent]:
                        return True, 0.0
                    if unwanted != {"header"}:  # as for the element of that name
                        self.doubtful[n] = "class" if self.doubtful.get(n) == "class" else name
                weight += 10.0 * bool(parts & WANTED_NAMES)
            elif name == "role" and tag not in KEPT_ROOTS and value.lower() in UNWANTED_ROLES:
                return True, 0.0
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, 0.0
            elif name == "role" and value.lower() in ("main", "article") or name == "itemprop" and value.lower() == "articlebody":
                weight += 20.0
        return False, weight


def parse(page: str) -> Tree:
    tree, stack, at, low = Tree(), [0], 0, None
    while True:
        found = TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text and not tree.bad[stack[-1]]:
            tree.pieces.append((stack[-1], html.unescape(text) if "&" in text else text))
        if not found:
            return tree
        at = found.end()
        close, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            if found[0].startswith("<![CDATA[") and not tree.bad[stack[-1]]:
                tree.pieces.append((stack[-1], found[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if close:
            end_element(tree, stack, name)
        elif name in RAW:
            if not attributes.endswith("/") or name in ("script", "style", "title", "textarea"):
                low = low or page.lower()
                end = low.find(f"</{name}", at)
                at = len(page) if end < 0 or len(low) != len(page) and not same_end(page, end, name) else page.find(">", end) + 1 or len(page)
        elif name == "br":
            tree.pieces.append((stack[-1], None))
        elif name not in VOID and name not in ("html", "body"):
            start_element(tree, stack, name, attributes)
        elif name == "body":
            while tree.tag[stack[-1]] == "head":
                tree.leave(stack, len(stack) - 1)


def same_end(page: str, end: int, name: str) -> bool:
    return page[end : end + 2 + len(name)].lower() == f"</{name}"


def end_element(tree: Tree, stack: list[int], name: str) -> None:
    if not tree.open[name]:
        return
    for depth in range(len(stack) - 1, 0, -1):
        if tree.tag[stack[depth]] == name:
            tree.leave(stack, depth)
            return
        if tree.tag[stack[depth]] in ("article", "main", "body", "table") and name not in BLOCK:
            return


def start_element(tree: Tree, stack: list[int], name: str, attributes: str) -> None:
    if tree.tag[stack[-1]] == "head":  # a head that was not closed
        if name in ("meta", "link", "base"):
            return
        tree.leave(stack, len(stack) - 1)
    if name in CLOSES_P and tree.open["p"]:
        for depth in range(len(stack) - 1, 0, -1):
            tag = tree.tag[stack[depth]]
            if tag == "p":
                tree.leave(stack, depth)
                break
            if tag in BLOCK:
                break
    if name in SAME:
        ends, limits = SAME[name]
        for depth in range(len(stack) - 1, 0, -1):
            tag = tree.tag[stack[depth]]
            if tag in ends:
                tree.leave(stack, depth)
                break
            if tag in limits:
                break
    stack.append(tree.add(stack[-1], name, attributes))
    tree.open[name] += 1


def measured(tree: Tree) -> tuple[list[float], list[float], list[float]]:
    """Points, text length and linked length of every element."""
    n = len(tree.tag)
    own, commas = [0] * n, [0] * n
    length, linked = [0.0] * n, [0.0] * n
    for element, text in tree.pieces:
        if text is None or text.isspace():
            continue
        size = len(text)
        length[element] += size
        own[tree.block[element]] += size
        commas[tree.block[element]] += text.count(",") + text.count("，") + text.count("、")
        if tree.linked[element]:
            linked[element] += size
            own[tree.block[element]] -= size  # links give no points
    points = [0.0] * n
    for block in range(n):
        if own[block] > 0:
            gain = commas[block] + min(own[block] / 100, 3.0) + (1.0 if own[block] >= 25 else 0.0)
            at, share = tree.parent[block] if tree.tag[block] in PROSE and block else block, 1.0
            while at >= 0 and share > 1e-9:  # halved from level to level; what is left of it then is nothing
                points[at] += gain * share
                at, share = tree.parent[at], share / 2
    for element in range(n - 1, 0, -1):
        length[tree.parent[element]] += length[element]
        linked[tree.parent[element]] += linked[element]
    return points, length, linked


def settle(tree: Tree) -> None:
    """Discards the doubtful parts that are mostly links or have few points. An id alone may come from a heading: then any
    prose outside links is enough."""
    points, length, linked = measured(tree)
    prose = in_prose(tree)
    discarded = False
    for e, name in tree.doubtful.items():
        few = points[e] < 2.0 and (name == "class" or not prose[e])
        if few or 2 * linked[e] >= length[e]:
            tree.bad[e] = discarded = True
    if discarded:
        for e in range(1, len(tree.tag)):
            tree.bad[e] = tree.bad[e] or tree.bad[tree.parent[e]]
        tree.pieces = [piece for piece in tree.pieces if not tree.bad[piece[0]]]


def in_prose(tree: Tree) -> list[float]:
    """Length of every element's text in paragraphs, headings and the like, without links."""
    prose = [0.0] * len(tree.tag)
    for element, text in tree.pieces:
        if text is not None and not text.isspace() and not tree.linked[element] and tree.tag[tree.block[element]] in PROSE:
            prose[element] += len(text)
    for element in range(len(tree.tag) - 1, 0, -1):
        prose[tree.parent[element]] += prose[element]
    return prose


def chosen(tree: Tree) -> set[int]:
    """Roots of the kept parts: the best container, or the article around it, and the siblings that belong to it."""
    points, length, linked = measured(tree)
    n = len(tree.tag)

    def density(e: int) -> float:
        return linked[e] / length[e] if length[e] else 0.0

    def value(e: int) -> float:
        return (points[e] + (tree.weight[e] if points[e] > 0 else 0.0)) * (1 - density(e))

    containers = [e for e in range(n) if not tree.bad[e] and points[e] > 0 and (tree.tag[e] in BLOCK or not e)]
    if not containers:
        return {e for e in range(n) if not tree.bad[e] and length[e] and tree.tag[e] in PROSE and density(e) < 0.5}
    best = max(containers, key=lambda e: (value(e), -e))
    around, outer = tree.parent[best], None
    while around > 0:
        if tree.tag[around] in ("article", "main"):
            outer = around
            break
        around = tree.parent[around]
    if outer is not None:
        best = outer
    if best == 0:
        return {0}
    kept = {best}
    if tree.tag[best] not in ("article", "main"):
        bar, text = 0.2 * value(best), in_prose(tree)
        for e in range(n):
            if tree.parent[e] == tree.parent[best] and not tree.bad[e] and e != best:
                prose = density(e) < 0.25 and length[e] > 0 and (tree.tag[e] in PROSE or tree.tag[e] in BLOCK and 2 * text[e] >= length[e])
                if value(e) >= bar or prose:
                    kept.add(e)
    return kept


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = parse(page)
    if not tree.pieces:
        return ""
    if tree.doubtful:
        settle(tree)
    kept = chosen(tree)
    inside = [False] * len(tree.tag)
    for e in range(len(tree.tag)):
        inside[e] = e in kept or e > 0 and inside[tree.parent[e]]
    blocks, now, last = [], [], -1
    for element, text in tree.pieces:
        if not inside[element] or tree.bad[element]:
            continue
        if tree.block[element] != last:
            blocks.append("".join(now))
            now, last = [], tree.block[element]
        now.append(" " if text is None else text)
    blocks.append("".join(now))
    return " ".join(filter(None, (" ".join(b.split()) for b in blocks)))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Adds ``text``, the page's main text, and ``n_chars``, its code points."""

    @F.pandas_udf("string")
    def texts(htmls: pd.Series) -> pd.Series:
        return htmls.map(main_text, na_action=None)

    return pages.withColumn("text", texts(F.col(column))).withColumn("n_chars", F.length("text").cast("long"))
