"""Table functions over pages and feeds, for lateral joins: rows as they are met, those before an error, and fixed rows where there are none."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urljoin
from xml.etree.ElementTree import ParseError, XMLPullParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from fennelmill.sources.markup import CONTAINERS, NAMES, Node, tree

#: Characters of a feed that are parsed at a time.
_PIECE = 1 << 14
_ITEM = "pos: int, title: string, url: string, origin: string"


def _numbered(found: Iterator[tuple[str, str | None]], fixed: Callable[[], list[tuple[str, str]]], origin: str) -> Iterator[tuple]:
    """The rows found before an error, from 0, or the fixed ones."""
    pos = -1
    try:
        for pos, (title, url) in enumerate(found):
            yield pos, title, url, "page"
    except Exception:  # a link that can't be resolved, say: what was found stays
        pass
    if pos < 0:
        for pos, (title, url) in enumerate(fixed()):
            yield pos, title, url, origin


def items_of(root: Node, base: str, containers: tuple[str, ...], names: tuple[str, ...], most: int) -> Iterator[tuple[str, str]]:
    """Items of the first container selector that finds any: the name by the first name selector, and the first link."""
    for el in next((n for n in map(root.select, containers) if n), [])[:most]:
        link = next(iter(el.select("a")), None)
        name = next((n[0] for n in map(el.select, names) if n), None)
        if link is not None and name is not None:
            yield "".join(name.pieces()).strip(), urljoin(base, link.attributes.get("href") or "")


def links_of(root: Node, container: str, heading: str, most: int) -> Iterator[tuple[str, str | None]]:
    """The first heading link of each of the first containers, its texts stripped piece by piece."""
    for el in root.select(container)[:most]:
        if (link := next(iter(el.select(heading)), None)) is not None:
            yield "".join(p.strip() for p in link.pieces()), link.attributes.get("href")


def maker_rows(base: str, unreachable: list[tuple[str, str]] = [], nothing: list[tuple[str, str]] = [], containers: tuple[str, ...] = CONTAINERS, names: tuple[str, ...] = NAMES, most: int = 5):
    """A table function ``html -> (pos, title, url, origin)`` over a maker's page.

    ``origin`` is ``page``; or ``unreachable`` for the fixed rows of a page that could not be had (NULL), or ``nothing`` for
    those of one without any item. A page that breaks off, or an item that can't be read, ends the rows, and those before stay.
    """

    class MakerRows:
        def eval(self, html: str) -> Iterator[tuple]:
            if html is None:
                yield from _numbered(iter(()), lambda: unreachable, "unreachable")
            else:
                yield from _numbered(items_of(tree(html), base, containers, names, most), lambda: nothing, "nothing")

    return F.udtf(MakerRows, returnType=_ITEM)


def related_rows(container: str = "article", heading: str = "h2.entry-title a, h2 a", most: int = 3):
    """A table function ``html -> (pos, title, url, origin)`` over the related links of a page; none for NULL, those before an error."""

    class RelatedRows:
        def eval(self, html: str) -> Iterator[tuple]:
            yield from _numbered(links_of(tree(html or ""), container, heading, most), list, "page")

    return F.udtf(RelatedRows, returnType=_ITEM)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _fields(el, fields: tuple[str, ...]) -> dict[str, str | None]:
    """The texts of an item's children by local names, the first of each name."""
    found = dict.fromkeys(fields)
    for c in el:
        name = _local(c.tag)
        if name in found and found[name] is None:
            found[name] = c.text or ""
    return found


def _items(xml: str, fields: tuple[str, ...]) -> Iterator[dict[str, str | None]]:
    """The items of a feed, by local names, as they end; an error ends them."""
    short = len(xml) <= _PIECE  # what has been read of a longer feed is let go of, for which its parents have to be known
    parser = XMLPullParser(("end",) if short else ("start", "end"))
    above: list = []
    for at in range(0, len(xml), _PIECE):
        try:
            parser.feed(xml[at : at + _PIECE])
            broken = False
        except ParseError:
            broken = True
        try:
            for event, el in parser.read_events():
                if event == "start":
                    above.append(el)
                    continue
                if above:
                    above.pop()
                if _local(el.tag) == "item":
                    yield _fields(el, fields)
                    if above:
                        above[-1].remove(el)
        except ParseError:
            return
        if broken:
            return


def _news(xml: str | None, most: int, required: tuple[str, ...]) -> Iterator[tuple]:
    for pos, item in enumerate(_items(xml or "", ("title", "link", "pubDate"))):
        if pos == most or any(item[f] is None for f in required):
            return
        yield pos, item["title"], item["link"], item["pubDate"]


def _trends(xml: str | None, fallback: tuple[str, str], unknown: str) -> Iterator[tuple]:
    pos = -1
    for pos, item in enumerate(_items(xml or "", ("title", "approx_traffic"))):
        yield pos, item["title"], unknown if item["approx_traffic"] is None else item["approx_traffic"]
    if pos < 0:
        yield 0, *fallback


_NEWS, _TRENDS = "pos: int, title: string, url: string, published: string", "pos: int, query: string, traffic: string"


def _by_batch(rows: Callable[[str | None], Iterator[tuple]], kind: str, xml: Column | str) -> Column:
    """The rows of each feed as an array; feeds go to Python by batches, and their rows come back as columns of all of a batch."""
    types = [pa.int32() if k.strip() == "int" else pa.string() for k in (f.split(":")[1] for f in kind.split(","))]
    names = [f.split(":")[0].strip() for f in kind.split(",")]

    @F.arrow_udf(f"array<struct<{kind}>>")
    def run(feeds: pa.Array) -> pa.Array:
        ends, found = [0], []
        for feed in feeds.to_pylist():
            found.extend(rows(feed))
            ends.append(len(found))
        columns = zip(*found) if found else [()] * len(types)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names))

    return run(F.col(xml) if isinstance(xml, str) else xml)


def news_items(xml: Column | str, most: int = 10, required: tuple[str, ...] = ("title", "link", "pubDate")) -> Column:
    """The rows of :func:`news_rows` as an array, for many feeds: a table function takes each by itself, this whole batches."""
    return _by_batch(lambda x: _news(x, most, required), _NEWS, xml)


def trend_items(xml: Column | str, fallback: tuple[str, str], unknown: str = "unknown") -> Column:
    """The rows of :func:`trend_rows` as an array, for many feeds."""
    return _by_batch(lambda x: _trends(x, fallback, unknown), _TRENDS, xml)


def news_rows(most: int = 10, required: tuple[str, ...] = ("title", "link", "pubDate")):
    """A table function ``xml -> (pos, title, url, published)`` over the first items of a feed.

    A feed may break off anywhere: items that ended before stay. An item without a required field ends the rows too.
    """

    class NewsRows:
        def eval(self, xml: str) -> Iterator[tuple]:
            yield from _news(xml, most, required)

    return F.udtf(NewsRows, returnType=_NEWS)


def trend_rows(fallback: tuple[str, str], unknown: str = "unknown"):
    """A table function ``xml -> (pos, query, traffic)`` over a trends feed; the fallback row for one that gives no item, or is NULL."""

    class TrendRows:
        def eval(self, xml: str) -> Iterator[tuple]:
            yield from _trends(xml, fallback, unknown)

    return F.udtf(TrendRows, returnType=_TRENDS)
