"""Main text of web pages by two passes of block rules.

The first pass judges each block alone by link density, length and stop-word density, with the same rules for all blocks;
what is too short to judge, in between, or without any sign of prose stays open. The second pass gives open blocks the
label of their nearest decided neighbours. Where a page marks its article, the article is the surroundings of the blocks
inside it: their neighbours are sought within it, its edges count as good, and what lies outside of it is no main text.
Regions that markup names as navigation, forms, notices, adverts or comments hold no main text either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fennelmill.llm.common import slices, small_batches

#: Frequent words of the languages expected, lower case.
STOP_WORDS = frozenset(
    """the of and to in a is it that for was on are as with his they be at this have from or one had by not but what all were when we there can an your which their if will
    der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über
    de la le les et des en un une du que est pour qui dans par sur pas plus au ne se ce il sont avec son aux ou mais comme nous sa leur
    el los las y del una con por para su al lo como más pero sus o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo""".split()
)
#: Frequent letters of running Chinese and Japanese text, and the scripts that have no spaces.
STOP_LETTERS = frozenset("的了是在不有和人这我他们就也说对为与以于而及其之一上中个到要会可你着没那被から、。はがのをにでともしたてるいれなまですっ")
_UNSPACED = re.compile("[\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
#: Elements that make blocks, elements whose content is no text, and regions without main text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead title tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template svg iframe object textarea title canvas audio video map".split())
REGION_TAGS = frozenset("nav footer aside form button select menu dialog head fieldset".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that name a region without main text, and words that such names hold besides.
_FOREIGN = frozenset(
    """ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar pagination pager
    cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall comment comments commentlist respond replies reply disqus related recommended recommendations trending popular
    share sharing social widget widgets tags toc search skip copyright complementary contentinfo""".split()
)
_BESIDE = frozenset(
    """list box bar block container wrapper wrap area item items link links button buttons btn inner outer group panel row column col grid card cards top bottom left right header title heading body form field
    post posts page site global icon icons count mobile desktop inline sticky fixed floating small large big main primary secondary horizontal vertical slot unit text thread message messages footer js is has tag media dialog no with without in user reader content google native this label section""".split()
)
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
#: The same where no article is marked, where names often say it in part.
_REGION = re.compile(
    r"(?:^|[\s_-])(?<!\bhas-)(?<!\bno-)(?<!\bwith-)(?<!\bwithout-)(?:ads?|advert(?:s|isement|ising|orial)?|sponsor(?:ed|s)?|promo(?:tion|ted)?|banner|sidebar|side-bar|menu|nav(?:bar|igation)?|breadcrumbs?|footer|foot|masthead|topbar|toolbar|pagination|pager"
    r"|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|comments?|commentlist|respond|replies|reply|disqus|related|recommended|recommendations|trending|popular"
    r"|share|sharing|social|widgets?|tags|toc|search|skip|copyright|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: The same outside articles only, and for article elements themselves, whose classes often name topics.
_PAGE_HEAD = re.compile(r"(?:^|[\s_-])(?:header|head|hero|branding)(?:$|[\s_-])", re.I)
_OTHER_ARTICLE = re.compile(r"(?:^|\s)(?:comments?(?:-\S+)?|repl(?:y|ies)|related\S*|ads?|advert\S*|sponsor\S*|promo\S*|teaser\S*|recommended\S*)(?:$|\s)", re.I)
#: Names of the element that holds the article on pages without an article element.
_CONTENT = re.compile(r"(?:^|\s)(?:main|content|main[_-]?content|page[_-]content|article|article[_-](?:body|content|text)|post|post[_-](?:body|content|text)|entry|entry[_-]content|story|story[_-]body|blog[_-]post|text)(?:$|\s)", re.I)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))", re.I)
_EDGES = re.compile(r"^\W+|\W+$")
_RIGHTS = re.compile(r"(?:©|\(c\)\s)", re.I)


def _foreign(names: str) -> bool:
    """Whether one of the names in a class, id or role says of all of an element that it is no main text.

    Every part of the name has to say so, or say nothing: ``related-links`` is such a name, ``related-work`` is none.
    """
    for name in names.split():
        parts = [p for p in _PARTS.split(name) if p and not p.isdigit()]
        lower = [p.lower() for p in parts]
        if lower and lower[0] not in ("has", "no", "with", "without") and any(p in _FOREIGN for p in lower) and all(p in _FOREIGN or p in _BESIDE for p in lower):
            return True
    return False


_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOPS_TAG = re.compile(r"[>\"']")
#: Inline end tags do not reach beyond these.
_BARRIERS = frozenset("article main body td th li".split())


@dataclass(frozen=True)
class BlockRules:
    """Thresholds of the first pass: characters, share of linked characters, and shares of stop words."""

    short: int = 70
    long: int = 200
    links: float = 0.33
    stops_low: float = 0.12
    stops_high: float = 0.3


@dataclass
class Block:
    """A run of text between block elements; ``article`` numbers the article it stands in, 0 is the page."""

    text: str
    linked: int
    heading: bool
    article: int
    label: str = ""


class Scanner:
    """Text pieces and tags of a page in one forward pass: no part of a page is searched more often than a fixed number of times.

    A quoted attribute value may hold ``>``. Where a quote of a tag never closes, the tag ends at its first ``>``; where no
    ``>`` follows, the rest of the page is text; a comment that never closes takes the rest of the page.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.last = {c: html.rfind(c) for c in ">\"'"}
        self.never: set[int] = set()  # quotes from which no end of a tag is reached
        self.no_end: set[str] = set()  # raw elements that no end tag follows

    def _tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose attributes begin here; one must follow."""
        html, passed, p = self.html, [], at
        while (m := _STOPS_TAG.search(html, p)) is not None:
            c, q = m.group(), m.start()
            if c == ">":
                return q
            if q in self.never or self.last[c] <= q:
                break
            passed.append(q)
            p = html.index(c, q + 1) + 1
        self.never.update(passed)
        return html.index(">", at)

    def raw_end(self, name: str, at: int) -> int | None:
        """Where a raw element that is open here ends, or None."""
        if name in self.no_end:
            return None
        m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.html, at)
        if m is None:
            self.no_end.add(name)
            return None
        return m.end()

    def pieces(self) -> Iterator[tuple[str, str, str, str]]:
        """``(text, slash, name, attributes)``: a piece of text and the tag behind it; the name is empty behind the last.

        What a raw element holds is skipped; of script, style, textarea and title without an end it is the rest of the page.
        """
        html, size, at, begun = self.html, len(self.html), 0, 0
        held: list[str] = []
        while (at := html.find("<", at)) >= 0:
            m = _TAG.match(html, at)
            if m is not None and self.last[">"] > at:
                held.append(html[begun:at])
                end = self._tag_end(m.end())
                slash, name, attributes = m.group(1), m.group(2).lower(), html[m.end() : end]
                yield "".join(held), slash, name, attributes
                held.clear()
                at = end + 1
                if not slash and name in RAW_TAGS and not attributes.endswith("/"):
                    to = self.raw_end(name, at)
                    at = to if to is not None else size if name in ("script", "style", "textarea", "title") else at
                begun = at
                continue
            for opens, closes in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
                if html.startswith(opens, at):
                    held.append(html[begun:at])
                    to = html.find(closes, at + len(opens))
                    if to < 0 and closes == ">":
                        held.append(html[at:])
                    begun = at = size if to < 0 else to + len(closes)
                    break
            else:
                at += 1
        yield "".join(held) + html[begun:], "", "", ""


class Reader:
    """Builds blocks out of pieces. Open elements are counted by name, so that an end tag costs only what it closes."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.open: list[tuple[str, bool, list[int] | None, bool]] = []  # name, bars text, article list it opens, is a barrier
        self.counts: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = [{}]  # counts since each open barrier
        self.block_at: list[int] = []  # places of open block elements
        self.barred = self.link = self.heading = self.breaks = self.articles = 0
        self.marked: list[int] = []  # open articles by element, and by name
        self.named: list[int] = []
        self.by_element: set[int] = set()

    def text(self, piece: str) -> None:
        if self.barred:
            return
        piece = unescape(piece)
        self.parts.append(piece)
        if self.link:
            self.linked.append(piece)
        if self.breaks and not piece.isspace():
            self.breaks = 0

    def flush(self) -> None:
        self.breaks = 0
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            size = len(" ".join(" ".join(self.linked).split())) if self.linked else 0
            self.blocks.append(Block(text, size, self.heading > 0, (self.marked or self.named or [0])[-1]))
        self.parts.clear()
        self.linked.clear()

    def close(self, index: int) -> None:
        """End all elements from this place on."""
        while len(self.open) > index:
            name, bars, article, barrier = self.open.pop()
            self.counts[name] -= 1
            if barrier:
                self.scopes.pop()
            else:
                self.scopes[-1][name] -= 1
            if self.block_at and self.block_at[-1] == len(self.open):
                self.block_at.pop()
            self.barred -= bars
            self.link -= name == "a"
            self.heading -= name in HEADINGS
            if article is not None:
                article.pop()

    def end(self, name: str) -> None:
        if name in BLOCK_TAGS:
            self.flush()
        reach = self.counts if name in BLOCK_TAGS or name in _BARRIERS else self.scopes[-1]
        if reach.get(name):
            i = len(self.open) - 1
            while self.open[i][0] != name:
                i -= 1
            self.close(i)

    def begin(self, name: str, attributes: str) -> None:
        if name in RAW_TAGS and not attributes.endswith("/"):
            if name == "title":
                self.flush()
            return
        if name == "br":
            self.breaks += 1
            self.parts.append(" ")
            if self.breaks > 1:
                self.flush()
            return
        if name in BLOCK_TAGS:
            self.flush()
        elif name in ("td", "th", "img"):
            self.parts.append(" ")
        if name in VOID_TAGS or attributes.endswith("/"):
            return
        if name in BLOCK_TAGS and self.block_at:  # an open paragraph ends where a block begins, an item where the next does
            above = self.open[self.block_at[-1]][0]
            if above == "p" or (name == "li" and above == "li"):
                self.close(self.block_at[-1])
        inside = bool(self.marked or self.named)
        bars = name in REGION_TAGS or (name == "header" and not inside)
        names = " ".join(next(filter(None, x.groups()), "") for x in _NAMED.finditer(attributes)) if attributes else ""
        if attributes and not bars and name not in ("html", "body", "main"):
            named = name not in HEADINGS and names and (_OTHER_ARTICLE.search(names) if name == "article" else _foreign(names) if inside or name == "body" else _REGION.search(names))
            bars = bool(_HIDDEN.search(attributes) or named or names and not inside and name in ("div", "section") and _PAGE_HEAD.search(names))
        article = None
        if not self.barred and not bars:
            if name in ("article", "main"):
                article = self.marked
            elif name in ("div", "section", "td") and names and _CONTENT.search(names):
                article = self.named
        if article is not None:
            self.articles += 1
            article.append(self.articles)
            if article is self.marked:
                self.by_element.add(self.articles)
        if name in BLOCK_TAGS:
            self.block_at.append(len(self.open))
        self.barred += bars
        self.link += name == "a"
        self.heading += name in HEADINGS
        self.counts[name] = self.counts.get(name, 0) + 1
        if barrier := name in _BARRIERS:
            self.scopes.append({})
        else:
            self.scopes[-1][name] = self.scopes[-1].get(name, 0) + 1
        self.open.append((name, bars, article, barrier))


def blocks_of(html: str) -> list[Block]:
    """The page's blocks in order, without those of barred regions.

    A page that marks articles by element gives only the blocks inside them; else one that marks them by name, if most of
    its text that is no link stands there.
    """
    reader = Reader()
    for text, slash, name, attributes in Scanner(html).pieces():
        if text:
            reader.text(text)
        if slash:
            reader.end(name)
        elif name:
            reader.begin(name, attributes)
    reader.flush()
    if inside := [b for b in reader.blocks if b.article in reader.by_element]:
        return inside
    named = [b for b in reader.blocks if b.article]
    if 2 * sum(len(b.text) for b in named) > sum(len(b.text) - b.linked for b in reader.blocks):
        return named
    for b in reader.blocks:  # a name that most of the page's text stands beside says nothing
        b.article = 0
    return reader.blocks


def first_pass(block: Block, rules: BlockRules = BlockRules()) -> str:
    """``good``, ``bad``, ``near`` or ``short``, by the block alone; the two latter stay open.

    A block is bad if links hold too much of it (headings link as a whole, and stay open) or if it is a rights line, short and opened by a copyright
    sign; good if it is long and dense in stop words. Between the densities it is near; a block that is short or sparse in stop words says nothing by
    itself. Scripts without spaces have letters in place of words, and need fewer of them.
    """
    n = len(block.text)
    if block.linked > rules.links * n and not block.heading or n < rules.long and _RIGHTS.match(block.text):
        return "bad"
    unspaced = len(_UNSPACED.findall(block.text))
    if 2 * unspaced > n:  # a letter of these scripts says about as much as three of others
        stops, words, n = sum(c in STOP_LETTERS for c in block.text), unspaced, 3 * n
    else:
        words = block.text.lower().split()
        stops, words = sum(_EDGES.sub("", w) in STOP_WORDS for w in words), len(words)
    if n < rules.short:
        return "short"
    if stops >= rules.stops_high * words:
        return "good" if n > rules.long else "near"
    return "near" if stops >= rules.stops_low * words else "short"


def second_pass(blocks: list[Block], rules: BlockRules = BlockRules()) -> None:
    """Open blocks inherit the label of their nearest decided neighbours: first those that are near, then the short ones.

    Neighbours are sought in the block's section, from one heading to the next, and in its surroundings: its article,
    whose ends are good, or the page, whose ends are bad. A ``near`` block needs one good neighbour. A ``short`` one, for
    which near blocks now count as decided, takes the label of the closer neighbour and is good if two equally close ones differ,
    where a bad neighbour that is short itself, as menus and rights lines are, counts as two blocks further away; within an
    article one good neighbour is enough. A heading takes the label of what follows. A block whose section has no decided one takes
    the label of the next that follows, or else of the last before. Where a page without any article has no good block at
    all, its near blocks below the first heading are good, or else all near ones; without these, the short ones between a heading and the next bad block.
    """
    if not any(b.label == "good" or b.article for b in blocks):
        first = next((i for i, b in enumerate(blocks) if b.heading), 0)
        near = [b for b in blocks[first:] if b.label == "near"] or [b for b in blocks if b.label == "near"]
        for b in near:
            b.label = "good"
        if not near:
            under = False
            for b in blocks:
                under = b.label != "bad" and (under or b.heading)
                b.label = "good" if under and not b.heading else b.label
    for turn in ("near", "short"):
        above, below, before, after = (_decided(blocks, step, rules, whole) for whole in (False, True) for step in (1, -1))
        labels = {}
        for i, b in enumerate(blocks):
            if b.label == turn:
                (x, far_x), (y, far_y) = above[i], below[i]
                if b.heading or not (x or y):
                    labels[i] = (y or after[i][0] or before[i][0]) == "good"
                elif turn == "near" or b.article or not (x and y):
                    labels[i] = "good" in (x, y)
                else:
                    labels[i] = x == "good" if x == y else (x == "good") == (far_x < far_y) or far_x == far_y
        for i, good in labels.items():
            blocks[i].label = "good" if good else "bad"


def _decided(blocks: list[Block], step: int, rules: BlockRules, whole: bool) -> list[tuple[str, int]]:
    """For each block the nearest decided label on one side, within its surroundings and section, or the ``whole`` surroundings, and how far it is."""
    out: list[tuple[str, int]] = [("", 0)] * len(blocks)
    seen: dict[int, tuple[str, int]] = {}
    passed: dict[int, int] = {}
    for i in range(len(blocks))[::step]:
        b = blocks[i]
        at = passed[b.article] = passed.get(b.article, 0) + 1
        if b.heading and step > 0 and not whole:
            seen[b.article] = "", at
        label, place = seen.get(b.article, ("good" if b.article else "bad", 0))
        out[i] = label, at - place
        if b.label in ("good", "bad"):
            seen[b.article] = b.label, at - 2 * (b.label == "bad" and len(b.text) < rules.long // 2)
        elif b.heading and step < 0 and not whole:
            seen[b.article] = "", at
    return out


def main_text(html: str, rules: BlockRules = BlockRules()) -> str:
    """The page's main text: its good blocks in order, one to a line."""
    blocks = blocks_of(html)
    for b in blocks:
        b.label = first_pass(b, rules)
    second_pass(blocks, rules)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract(df: DataFrame, rules: BlockRules = BlockRules(), html_column: str = "html") -> DataFrame:
    """``df`` without its html, with ``text`` (main text) and ``n_chars`` (code points of it), without a shuffle.

    Character references are decoded, white space inside a block becomes one space, and blocks are joined by a newline.

    Edge cases: NULL or empty html, or a page without main text, has an empty text; malformed markup is read as far as
    it goes; very long pages are read whole; other columns are kept as they are, but those named ``text`` or
    ``n_chars`` are replaced; repeated rows give repeated results; an empty table gives no rows.
    """
    kept = [c for c in df.columns if c != html_column and c.lower() not in ("text", "n_chars")]
    source = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(f"`{html_column}`").cast("string").alias("html"))
    small_batches(df.sparkSession)
    schema = ", ".join(f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(h, rules) if h else "" for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*(f"c{i}" for i in range(len(kept))), "text", "n_chars"])

    out = source.mapInArrow(run, f"{schema + ', ' if schema else ''}text string, n_chars long")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "text", "n_chars")
