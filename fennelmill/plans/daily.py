"""The daily run in three entry points: detect signals, write an article, render articles.

Each reads its inputs, builds one plan for each output and writes; what is compared and what is kept for next time are
two plans over the same inputs, so a run that fails between them can be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fennelmill import schemas
from fennelmill.operators import articles, relational, render, signals, tasks
from fennelmill.sources import files, named

#: Where a feed's document lies in the raw folder, by logical name: its stem is the name.
FEED_ITEMS = {"trends": "top_queries"}


@dataclass(frozen=True)
class Layout:
    """The folders of a deployment."""

    raw: str
    state: str
    articles: str
    posts: str
    queue: str
    topics: str


def load_feed(spark: SparkSession, raw: str, name: str) -> DataFrame:
    """A feed's items with their positions; no rows where its document is missing or broken."""
    doc = files.read_json_or(spark, f"{raw}/{name}.json", schemas.FEEDS[name])
    return relational.unnest(doc, FEED_ITEMS.get(name, "items"))


def detect(spark: SparkSession, layout: Layout, run: str, run_at: datetime, fallback_title: str = "standard", keep_ranks: bool = False) -> DataFrame:
    """Entry point A: the top signal of a run, written as a document, and the next state, written as snapshots."""
    history, ranks = (files.Snapshots(spark, f"{layout.state}/{n}", s) for n, s in (("history", schemas.HISTORY), ("ranks", schemas.RANKS)))
    feed, known, last = load_feed(spark, layout.raw, "search_b"), history.read(), ranks.read()
    there = files.exists(spark, f"{layout.raw}/ranking_b.json")
    ranking = load_feed(spark, layout.raw, "ranking_b")
    found = signals.arrivals(feed, known).unionByName(signals.rank_jumps(ranking, last))
    top = signals.top_signal(found, fallback_title)
    files.write_documents(top.coalesce(1), f"{layout.raw}/top_signal")
    history.write(signals.next_history(known, feed, run_at), run, run_at)
    ranks.write(signals.next_ranks(ranking if there else None, last, keep_ranks), run, run_at)
    return spark.read.schema(schemas.SIGNAL).json(f"{layout.raw}/top_signal")


def next_topic(spark: SparkSession, layout: Layout, run: str, run_at: datetime, default_keyword: str = "toys") -> DataFrame:
    """The topic at the head of the queue, which loses it, or the default one."""
    queue = files.Snapshots(spark, layout.topics, schemas.TOPIC)
    head, rest = tasks.pop(queue.read(), tasks.default_topic(spark, default_keyword))
    taken = spark.createDataFrame(head.collect(), schemas.TOPIC)  # one row: the queue's snapshot may now be replaced
    queue.write(rest, run, run_at)
    return taken


def write_article(spark: SparkSession, layout: Layout, topic: DataFrame, links: DataFrame, run_at: datetime, wording: articles.Wording = articles.Wording()) -> DataFrame:
    """Entry point B: one article from all feeds, written under its date and slug; a second one of a day and slug replaces the first."""
    feed = lambda name: load_feed(spark, layout.raw, name)
    signal = relational.or_default(spark.read.schema(schemas.SIGNAL).json(f"{layout.raw}/top_signal") if files.exists(spark, f"{layout.raw}/top_signal") else files.empty(spark, schemas.SIGNAL), signals.standard_signal(spark, ""))
    day = f"{run_at:%Y-%m-%d}"
    with files.scratch_of():
        products = articles.enriched(feed("catalogue_a"), feed("search_b"), feed("hits_c"), wording)
        doc = articles.article(topic.select("mode", "keyword"), signal, products, feed("videos"), feed("books"), feed("news"), feed("maker"), links, run_at, wording)
        named.write_named(files.as_json(doc, F.concat(F.lit(f"{day}-"), "slug").alias("name")), layout.articles, ".json", content="json")
    return spark.read.schema(schemas.ARTICLE).option("pathGlobFilter", f"{day}-*.json").json(layout.articles)


def render_posts(spark: SparkSession, layout: Layout, run_at: datetime) -> DataFrame:
    """Entry point C: every article rendered; of those with one slug, the latest. Documents that can't be read are left out."""
    docs = spark.read.schema(schemas.ARTICLE).option("mode", "DROPMALFORMED").json(layout.articles)
    posts = render.rendered(articles.latest_by_slug(docs.where("slug is not null")), f"{run_at:%Y-%m-%d}")
    named.write_named(posts, layout.posts, ".md")
    return posts


def plan_task(spark: SparkSession, layout: Layout, products: str, run_at: datetime) -> DataFrame:
    """A task of the first trend and the first products, written under its id."""
    items = files.file_stems(spark, products).withColumnRenamed("stem", "item_id")
    task = tasks.task_from_trends(load_feed(spark, layout.raw, "trends"), items, f"{run_at:%Y-%m-%d}")
    named.write_named(files.as_json(task, "task_id"), layout.queue, ".json", name="task_id", content="json")
    return task
