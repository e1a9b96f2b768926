"""Items in HTML pages and XML feeds."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a maker's page holds its items and their names; the first selector that finds any counts.
CONTAINERS = (".goods_list_item", ".block-thumbnail-t", ".item")
NAMES = (".name", ".goods-name", "h2")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NO_CLASSES: frozenset = frozenset()


class Node:
    """An element: name, attributes, parent, children and texts in order."""

    __slots__ = ("name", "attributes", "parent", "content", "classes")

    def __init__(self, name: str, attributes: dict, parent: Node | None) -> None:
        self.name, self.attributes, self.parent, self.content = name, attributes, parent, []
        given = attributes.get("class")
        self.classes = frozenset(given.split()) if given else _NO_CLASSES

    def walk(self) -> list[Node]:
        """The elements below, in document order."""
        out, stack = [], [c for c in reversed(self.content) if c.__class__ is Node]
        while stack:
            n = stack.pop()
            out.append(n)
            if n.content:
                stack += [c for c in reversed(n.content) if c.__class__ is Node]
        return out

    def pieces(self):
        """The texts below, in document order."""
        stack = list(reversed(self.content))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            else:
                stack.extend(reversed(c.content))

    def fits(self, simple: tuple[str, frozenset]) -> bool:
        """Whether a simple selector (name, .class, or name.class), as :func:`_chains` gives it, fits."""
        name, classes = simple
        return (not name or self.name == name) and classes <= self.classes

    def select(self, selector: str) -> list[Node]:
        """The elements below that fit a selector of simple ones with descent, or one of several by commas."""
        chains = _chains(selector)
        if len(chains) == 1 and len(chains[0]) == 1:
            (name, classes), = chains[0]
            return [n for n in self.walk() if classes <= n.classes and (not name or n.name == name)]
        return [n for n in self.walk() if any(n.fits(last) and (not rest or self._below(n, rest)) for *rest, last in chains)]

    def _below(self, node: Node, rest: list) -> bool:
        """Whether elements above a node, and below this one, fit the rest of a chain."""
        up = node.parent
        while rest and up is not None and up is not self:
            if up.fits(rest[-1]):
                rest = rest[:-1]
            up = up.parent
        return not rest


@lru_cache(maxsize=256)
def _chains(selector: str) -> list[list[tuple[str, frozenset]]]:
    """The alternatives of a selector, each a list of simple selectors by name and classes."""
    simple = lambda s: (s.split(".")[0], frozenset(s.split(".")[1:]))
    return [[simple(s) for s in alternative.split()] for alternative in selector.split(",")]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.content.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.content.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        up = self.at
        while up is not None and up.name != tag:
            up = up.parent
        if up is not None and up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        self.at.content.append(data)


def tree(html: str) -> Node:
    """A page's element tree; malformed markup gives what can be read."""
    b = _Builder()
    try:
        b.feed(html)
        b.close()
    except Exception:  # markup that the parser gives up on: the elements before it are there
        pass
    return b.root


def listed_items(html: str, base: str, containers: tuple[str, ...], names: tuple[str, ...], most: int) -> list[dict]:
    """Items of the first container selector that finds any: the name by the first name selector, and the first link."""
    root = tree(html)
    found = next((n for n in map(root.select, containers) if n), [])
    out = []
    for el in found[:most]:
        link = next(iter(el.select("a")), None)
        name = next((n[0] for n in map(el.select, names) if n), None)
        if link is not None and name is not None:
            href = link.attributes.get("href")
            out.append({"title": "".join(name.pieces()).strip(), "url": urljoin(base, href) if href else base})
    return out


def headed_links(html: str, container: str, heading: str, most: int) -> list[dict]:
    """The first heading link of each of the first containers, its texts stripped piece by piece."""
    out = []
    for el in tree(html).select(container)[:most]:
        link = next(iter(el.select(heading)), None)
        if link is not None:
            out.append({"title": "".join(p.strip() for p in link.pieces()), "url": link.attributes.get("href")})
    return out


_LINKS = "array<struct<title:string,url:string>>"


def _by_batch(function, html: Column, *more: Column) -> Column:
    @F.pandas_udf(_LINKS)
    def run(pages: pd.Series, *rest: pd.Series) -> pd.Series:
        return pd.Series([function(p, *r) if p else [] for p, *r in zip(pages, *rest)])

    return run(html, *more)


def maker_items(html: Column | str, base: str, containers: tuple[str, ...] = CONTAINERS, names: tuple[str, ...] = NAMES, most: int = 5) -> Column:
    """Items of a maker's page as an array; whole batches of pages go to Python, as no built-in reads HTML."""
    return _by_batch(lambda p: listed_items(p, base, containers, names, most), F.col(html) if isinstance(html, str) else html)


def related_links(html: Column | str, container: str = "article", heading: str = "h2.entry-title a, h2 a", most: int = 3) -> Column:
    """Related links of a page as an array."""
    return _by_batch(lambda p: headed_links(p, container, heading, most), F.col(html) if isinstance(html, str) else html)


def resolved(url: Column | str, base: Column | str) -> Column:
    """A link resolved against the address of its page."""
    @F.pandas_udf("string")
    def join(u: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else urljoin(y or "", x) for x, y in zip(u, b)])

    return join(F.col(url) if isinstance(url, str) else url, F.col(base) if isinstance(base, str) else base)


def element_text(html: Column | str, name: str) -> Column:
    """The text of the first element of a name that holds no other markup, decoded of the five predefined references; built-in only."""
    c = F.col(html) if isinstance(html, str) else html
    raw = F.regexp_extract(c, rf"(?is)<{re.escape(name)}(?:\s[^>]*)?>([^<]*)</{re.escape(name)}>", 1)
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(ref), F.lit(char))
    return raw


def link_targets(html: Column | str, most: int) -> Column:
    """The targets of the first links, as written; built-in only."""
    c = F.col(html) if isinstance(html, str) else html
    return F.slice(F.regexp_extract_all(c, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1)), 1, most)


def feed_items(xml: Column | str, most: int | None = None, fields: tuple[str, ...] = ("title", "link", "pubDate")) -> Column:
    """Items of a feed, at any depth, as an array of structs of texts; XML that can't be read gives none."""
    c = F.col(xml) if isinstance(xml, str) else xml
    item = ", ".join(f"`{f}` STRING" for f in fields)
    rss = F.from_xml(c, f"channel STRUCT<item: ARRAY<STRUCT<{item.replace('` STRING', '`: STRING')}>>>, item ARRAY<STRUCT<{item.replace('` STRING', '`: STRING')}>>")
    items = F.coalesce(rss["channel"]["item"], rss["item"], F.array().cast(f"array<struct<{','.join(f'`{f}`:string' for f in fields)}>>"))
    return items if most is None else F.slice(items, 1, most)


def news(feeds: DataFrame, xml: str, most: int = 10) -> DataFrame:
    """``(pos, title, url, published)`` of the first items of each feed."""
    rows = feeds.select(F.posexplode(feed_items(xml, most)).alias("pos", "i"))
    return rows.select("pos", F.col("i.title").alias("title"), F.col("i.link").alias("url"), F.col("i.pubDate").alias("published"))


def trends(feeds: DataFrame, xml: str, unknown: str = "unknown") -> DataFrame:
    """``(pos, query, traffic)`` of a trends feed."""
    rows = feeds.select(F.posexplode(feed_items(xml, None, ("title", "approx_traffic"))).alias("pos", "i"))
    return rows.select("pos", F.col("i.title").alias("query"), F.coalesce("i.approx_traffic", F.lit(unknown)).alias("traffic"))
