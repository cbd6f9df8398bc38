"""Main text of web pages by composite text density.

Each node of a page's tree gets a density: characters per tag, weighed down where the
characters or tags belong to links. The node whose children's densities sum up highest is
the core of the article; text that stands in a node itself counts like a child of one tag.
From there the path to ``body`` is climbed to the highest node that is at least as dense as
what holds all of the page's text (the path's threshold), or to the outermost article
element that is.

What is no article by its tag or role (menus, forms, scripts) is taken out before, so that
neither dense notices nor reader comments can win. So is an element whose class or id says
nothing but that it is one of these ("site-footer", but not "share-price"); names give way
where a page would have no text without these elements.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>"']*(?:(?:"[^"<]*"|'[^'<]*')[^<>"']*)*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>""", re.S)
#: One attribute after another, so that nothing inside a value is taken for one.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?|["'][^"']*["']?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")

# Elements and names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption html legend option optgroup tbody td tfoot th thead tr".split())
#: An element is ended by the start of one of the same group, unless a container stands between.
GROUPS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select", "datalist"})}
NEVER = frozenset("nav aside form button select datalist dialog menu footer search audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status tablist".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentary consent
    cookie cookies disqus dropdown footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices
    notification notifications overlay pager pagination paywall popup promo promotion promotions recommended related replies respond search
    share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription toast toolbar widget widgets""".split()
)
#: Words that only say where such an element is, or that it is one.
PLACES = frozenset("site page main global top bottom left right upper lower primary secondary inner outer box block bar area container wrapper wrap section list item items article post posts reader user the and by".split())
#: What an article has of its own: its header holds its heading.
OWN = frozenset("header masthead".split())
LISTS = frozenset("ul ol dl".split())


def _named(value: str, in_article: bool) -> bool:
    """Does a class or id consist of words for what is no article, with words for places at most?"""
    for one in value.split():
        words = [word.lower() for word in WORD.findall(one) if not word.isdigit()]
        known = NAMES.intersection(words)
        if known and all(w in NAMES or w in PLACES for w in words) and not (in_article and known <= OWN):
            return True
    return False


def _unwanted(tag: str, attributes: str, in_article: bool) -> int:
    """2 for an element that is no article by its tag, role or style, 1 for one that is so named, else 0."""
    if tag in NEVER or (tag == "header" and not in_article):
        return 2
    if not attributes or tag in ("html", "body", "main"):
        return 0
    found = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            found = found or int(_named(value, in_article))
        elif name == "role":
            if value.lower() in ROLES:
                return 2
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return 2
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
    return found


class _Page:
    """A page's tree as lists by node, in page order, and its pieces of text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.unwanted, self.end = ["#"], [-1], [0], [0]
        self.pieces: list[tuple[int, int, str]] = []  # node, block, text
        self.stack, self.block, self.articles = [0], 0, 0
        at, lowered = 0, None
        for found in TAG.finditer(source):
            start = found.start()
            if start < at:
                continue  # inside an element without markup
            if start > at:
                self.pieces.append((self.stack[-1], self.block, source[at:start]))
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name = name.lower()
            if found[1] or found[4]:
                self._close(name)
                continue
            attributes = found[3] or found[6] or ""
            if name in RAW and not attributes.endswith("/"):
                lowered = source.lower() if lowered is None or len(lowered) != len(source) else lowered
                stop = lowered.find(f"</{name}", at)
                stop = len(source) if stop < 0 else lowered.find(">", stop) + 1 or len(source)
                at = stop
                continue
            self._open(name, attributes)
        if at < len(source):
            self.pieces.append((self.stack[-1], self.block, source[at:]))
        while self.stack:
            self._pop()

    def _pop(self) -> None:
        node = self.stack.pop()
        self.end[node] = len(self.tag)
        self.articles -= self.tag[node] in ("article", "main")
        if self.tag[node] in BLOCK:
            self.block += 1

    def _pop_to(self, height: int) -> None:
        while len(self.stack) > height:
            self._pop()

    def _find(self, wanted, stops) -> int:
        for height in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[height]]
            if tag in wanted:
                return height
            if tag in stops:
                return -1
        return -1

    def _open(self, name: str, attributes: str) -> None:
        if name == "br":
            self.pieces.append((self.stack[-1], self.block, " "))
        if name in CLOSES_P:
            height = self._find(("p",), ("table", "td", "th", "button", "caption"))
            if height > 0:
                self._pop_to(height)
        if name in GROUPS:
            same, stops = GROUPS[name]
            while (height := self._find(same, stops)) > 0:
                self._pop_to(height)
        if name in BLOCK:
            self.block += 1
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        self.unwanted.append(_unwanted(name, attributes, self.articles > 0))
        self.end.append(node + 1)
        if name not in VOID:
            self.stack.append(node)
            self.articles += name in ("article", "main")

    def _close(self, name: str) -> None:
        if name in ("html", "body"):
            return  # what follows still belongs to the page
        height = self._find((name,), BLOCK if name not in BLOCK else ())
        if height > 0:
            self._pop_to(height)


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag; links lower it through the logarithm and through its base."""
    if not chars:
        return 0.0
    tags, link_tags, linked = max(tags, 1), max(link_tags, 1), max(link_chars, 1)
    plain = max(chars - link_chars, 1)
    base = math.log(chars / plain * link_chars + share * chars + math.e)
    return chars / tags * max(math.log(chars / linked * tags / link_tags), 0.0) / max(math.log(base), 1.0)


class _Measured:
    """Characters, tags and densities of the nodes of a page, without unwanted ones."""

    def __init__(self, page: _Page, named: bool):
        n, tag, parent = len(page.tag), page.tag, page.parent
        # Wrappers of an article may be named after what stands beside it.
        holds = [False] * n
        for node in range(n - 1, 0, -1):
            if (tag[node] in ("article", "main") and not page.unwanted[node]) or holds[node]:
                holds[parent[node]] = True
        self.out, linked = [False] * n, [False] * n
        for node in range(1, n):
            up = parent[node]
            self.out[node] = self.out[up] or page.unwanted[node] == 2 and not (holds[node] and tag[node] not in NEVER) or (named and page.unwanted[node] == 1 and not holds[node])
            linked[node] = linked[up] or tag[node] == "a"
        self.chars, self.tags, self.link_chars, self.link_tags = ([0] * n for _ in range(4))
        own = [0] * n
        self.kept: list[tuple[int, int, str]] = []
        for node, block, raw in page.pieces:
            if self.out[node]:
                continue
            text = html.unescape(raw) if "&" in raw else raw
            self.kept.append((node, block, text))
            own[node] += len(SPACE.sub(" ", text.strip()))
        for node in range(n - 1, -1, -1):
            self.chars[node] += own[node]
            self.link_chars[node] += own[node] if linked[node] else 0
            if node and not self.out[node]:
                up = parent[node]
                self.chars[up] += self.chars[node]
                self.link_chars[up] += self.link_chars[node]
                self.tags[up] += self.tags[node] + 1
                self.link_tags[up] += self.link_tags[node] + (tag[node] == "a")
        self.share = self.link_chars[0] / max(self.chars[0], 1)
        self.density = [_density(self.chars[i], self.tags[i], self.link_chars[i], self.link_tags[i], self.share) for i in range(n)]
        self.sums = [_density(o, 1, o if x else 0, int(x), self.share) for o, x in zip(own, linked, strict=True)]
        for node in range(1, n):
            if not self.out[node]:
                self.sums[parent[node]] += self.density[node]


def _core(page: _Page, m: _Measured) -> int:
    """The node that holds the article."""
    n, tag, parent = len(page.tag), page.tag, page.parent
    best = max((i for i in range(n) if not m.out[i]), key=lambda i: (m.sums[i], -i))
    path = [best]
    while path[-1] > 0:
        path.append(parent[path[-1]])
    # The last node on the way down that still holds all of the text stands for the body.
    whole = next(i for i, node in enumerate(path) if m.chars[node] == m.chars[0])
    threshold = m.density[path[whole]]
    dense = [node for node in path[: whole + 1] if m.density[node] >= threshold]
    articles = [node for node in dense if tag[node] == "article"] or [node for node in dense if tag[node] == "main"]
    if articles:
        return articles[-1]
    inner = [node for node in dense if node != path[whole]]
    core = inner[-1] if inner else best
    # Inline elements and single blocks of a body without a container belong with their neighbours.
    while core > 0 and tag[core] not in ("#", "html", "body", "article", "main", "div", "section", "table", "tr", "tbody", "td", "center", "details"):
        core = parent[core]
    return core


def _menu(page: _Page, m: _Measured, node: int) -> bool:
    """Is a list a menu: nothing but links, each of a few words?"""
    return page.tag[node] in LISTS and m.link_chars[node] == m.chars[node] and m.chars[node] < 40 * m.link_tags[node]


def extract(source: str | None) -> str:
    """The article's blocks, joined by blank lines; empty if the page has none."""
    if not source:
        return ""
    page = _Page(source)
    m = _Measured(page, True)
    if not m.chars[0]:
        m = _Measured(page, False)
    if not m.chars[0]:
        return ""
    core = _core(page, m)
    stop = page.end[core]
    dropped = {core: False}
    for node in range(core + 1, stop):
        dropped[node] = dropped[page.parent[node]] or _menu(page, m, node)
    blocks: list[str] = []
    last, held = None, []
    for node, block, text in [*((a, b, c) for a, b, c in m.kept if core <= a < stop and not dropped[a]), (0, -1, "")]:
        if block != last and held:
            line = SPACE.sub(" ", "".join(held)).strip()
            if line:
                blocks.append(line)
            held = []
        last = block
        held.append(text)
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Null, empty and article-less pages have an empty text. Repeated rows are extracted
    each for itself; other columns are left out. An empty table gives no row.
    """

    @F.pandas_udf("string")
    def of(sources):
        import pandas as pd

        return pd.Series(np.array([extract(s) for s in sources], dtype=object), dtype=object)

    return pages.select("page_id", "url", of("html").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
