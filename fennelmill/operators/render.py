"""Documents as text: Markdown with a header, as one column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fennelmill.functions.scalars import text
from fennelmill.operators.articles import cheapest_nested


@dataclass(frozen=True)
class Layout:
    """Fixed texts of a rendered document."""

    disclosure: str = "> Links may be referral links. Updated: "
    signal: str = "> Why now: "
    top: str = "## Top three"
    table: str = "| no. | item | score | why | link |\n|:---:|:---|:---:|:---|:---:|"
    details: str = "## All items"
    price: str = "- **price**: "
    cheapest: str = " **(lowest)**"
    score: str = "- **score**: "
    shops: tuple = ("shop A", "shop B", "shop C")
    pros: str = "> **for**: "
    cons: str = "> **against**: "
    features: str = "#### Features"
    videos: str = "## Videos"
    books: str = "## Books"
    maker: str = "## From the maker"
    news: str = "## News"
    links: str = "## Read on"
    comment: str = "> **A word from us**: "
    disclaimer: str = "---\nPrices and stock are those of the time of writing."
    no_title: str = "No Title"


def lines(*parts: Column) -> Column:
    """Lines joined by newlines; NULL ones are left out."""
    return F.concat_ws("\n", *parts)


def if_some(array: Column | str, block: Column) -> Column:
    """A block, or NULL where its array is NULL or empty."""
    a = F.col(array) if isinstance(array, str) else array
    return F.when(F.coalesce(F.size(a), F.lit(0)) > 0, block)


def _link(title: Column, url: Column) -> Column:
    return F.concat(F.lit("["), text(title), F.lit("]("), text(url), F.lit(")"))


def _image(title: Column, url: Column) -> Column:
    return F.when(F.nullif(url, F.lit("")).isNotNull(), F.concat(F.lit("!"), _link(title, url)))


def _or_mark(url: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), F.lit("#"))


def _joined(array: str, line) -> Column:
    return F.array_join(F.transform(F.coalesce(F.col(array), F.array().cast("array<struct<title:string,url:string>>")) if array in ("news", "maker_items", "links") else F.col(array), line), "\n")


def body(layout: Layout = Layout()) -> Column:
    """The document's Markdown. Optional blocks are left out where their array is NULL, empty or missing."""

    def row(p: Column, i: Column) -> Column:
        cells = F.concat_ws(" | ", (i + 1).cast("string"), F.concat(F.substring(text(p["name"]), 1, 20), F.lit("...")), text(p["score"]), text(F.get(p["pros"], 0)), _link(F.lit("more"), p["link_a"]))
        return F.concat(F.lit("| "), cells, F.lit(" |"))

    def section(p: Column) -> Column:
        names = layout.shops
        shops = F.concat_ws(" / ", _link(F.lit(names[0]), p["link_a"]), _link(F.lit(names[1]), _or_mark(p["link_b"])), _link(F.lit(names[2]), _or_mark(p["link_c"])))
        return lines(
            F.concat(F.lit("### "), text(p["name"])),
            _image(p["name"], p["image"]),
            F.concat(F.lit(layout.price), text(p["price"]), F.when(p["is_cheapest"], layout.cheapest).otherwise("")),
            F.concat(F.lit(layout.score), text(p["score"]), F.lit("/5.0")),
            F.concat(F.lit("- "), shops),
            F.concat(F.lit(layout.pros), F.array_join(p["pros"], ", ")),
            F.concat(F.lit(layout.cons), F.array_join(p["cons"], ", ")),
            F.lit(layout.features),
            if_some(p["features"], F.array_join(F.transform(p["features"], lambda f: F.concat(F.lit("- "), text(f))), "\n")),
            F.lit("---"),
        )

    bullet = lambda x: F.concat(F.lit("- "), _link(x["title"], x["url"]))
    items = lambda name, head: if_some(name, lines(F.lit(head), _joined(name, bullet)))
    signal = F.when(F.nullif("signal_type", F.lit("")).isNotNull(), F.concat(F.lit(layout.signal), text("signal_type_label")))
    return lines(
        F.concat(F.lit("# "), text("title")),
        F.concat(F.lit(layout.disclosure), F.substring(text("date"), 1, 10)),
        text("lead"),
        signal,
        F.lit(layout.top),
        F.lit(layout.table),
        if_some("products", F.array_join(F.transform(F.slice("products", 1, 3), row), "\n")),
        F.lit(layout.details),
        if_some("products", F.array_join(F.transform("products", section), "\n")),
        if_some("videos", lines(F.lit(layout.videos), F.array_join(F.transform("videos", lambda v: lines(F.concat(F.lit("### "), text(v["title"])), text(v["embed"]))), "\n"))),
        if_some("books", lines(F.lit(layout.books), F.array_join(F.transform("books", lambda b: lines(F.concat(F.lit("### "), _link(b["title"], b["url"])), _image(b["title"], b["image"]), text(b["description"]))), "\n"))),
        items("maker_items", layout.maker),
        items("news", layout.news),
        items("links", layout.links),
        F.concat(F.lit(layout.comment), text("comment")),
        F.lit(layout.disclaimer),
    )


def quoted(c: Column) -> Column:
    """A text as a YAML scalar in double quotes."""
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(text(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))


def header(run_date: str, layout: Layout = Layout()) -> Column:
    """The front matter: date, draft, slug, tags and title, in that order."""
    tags = if_some("tags", F.concat(F.lit("tags:\n"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("- "), quoted(t))), "\n")))
    return lines(
        F.lit("---"), F.concat(F.lit("date: "), quoted(F.coalesce("date", F.lit(run_date)))), F.lit("draft: false"), F.concat(F.lit("slug: "), F.when(F.col("slug").isNotNull(), quoted(F.col("slug"))).otherwise("null")),
        F.coalesce(tags, F.lit("tags: []")), F.concat(F.lit("title: "), quoted(F.coalesce("title", F.lit(layout.no_title)))), F.lit("---"),
    )


def rendered(articles: DataFrame, run_date: str, name: Column | str = "slug", layout: Layout = Layout()) -> DataFrame:
    """``(name, content)`` of each article: cheapest items flagged, header and body."""
    marked = articles.withColumn("products", cheapest_nested("products"))
    return marked.select(F.col(name).alias("name") if isinstance(name, str) else name.alias("name"), F.concat(header(run_date, layout), F.lit("\n\n"), body(layout)).alias("content"))
