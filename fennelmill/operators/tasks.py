"""Tasks made of trends, and the queue of topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fennelmill import schemas
from fennelmill.operators.matching import best_matches
from fennelmill.operators.relational import or_default


def task_from_trends(trends: DataFrame, products: DataFrame, run_date: str, theme: str = "{query}: compared", age: str = "all ages", tone: str = "plain", keywords: tuple[str, ...] = ("guide", "comparison"), most: int = 3) -> DataFrame:
    """One task from the first trend ``(pos, query)`` with the first product ids; no task without a trend."""
    first = trends.orderBy("pos").limit(1)
    ids = products.select("item_id").orderBy("item_id").limit(most).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    return _tasks(first.crossJoin(ids), run_date, theme, age, tone, keywords)


def tasks_for_trends(trends: DataFrame, products: DataFrame, run_date: str, theme: str = "{query}: compared", age: str = "all ages", tone: str = "plain", keywords: tuple[str, ...] = ("guide", "comparison"), most: int = 3, least: int = 2) -> DataFrame:
    """A task for each trend ``(pos, query)`` that products ``(item_id, title)`` match: with the ids of those that share most tokens, the best first."""
    found = best_matches(trends, products, "pos", "query", "item_id", "title", least=least, most=most)
    ids = found.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "match"))), lambda x: x["match"]).alias("item_ids"))
    return _tasks(trends.select("pos", "query").join(ids, "pos"), run_date, theme, age, tone, keywords, "pos")


def _tasks(rows: DataFrame, run_date: str, theme: str, age: str, tone: str, keywords: tuple[str, ...], *beside: str) -> DataFrame:
    head, tail = theme.split("{query}")
    return rows.select(
        *beside, F.concat(F.lit(f"{run_date}-"), F.replace("query", F.lit(" "), F.lit("-"))).alias("task_id"), F.lit("comparison").alias("post_type"), F.concat(F.lit(head), "query", F.lit(tail)).alias("theme"),
        F.lit(age).alias("target_age"), "item_ids", F.lit(tone).alias("tone"), F.lit(1500).alias("min_words"), F.lit(2500).alias("max_words"), F.array(F.col("query"), *map(F.lit, keywords)).alias("keywords"),
    )


def default_topic(spark: SparkSession, keyword: str = "toys", mode: str = "daily_random") -> DataFrame:
    """The topic of an empty queue."""
    return spark.createDataFrame([Row(seq=0, mode=mode, keyword=keyword, item_id="")], schemas.TOPIC)


def pop(queue: DataFrame, default: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queue's first topic, or the default one, and what is left."""
    head = queue.orderBy("seq").limit(1)
    rest = queue.join(head.select(F.col("seq").alias("__head")), F.col("seq") == F.col("__head"), "left_anti")
    return or_default(head, default), rest


def append(queue: DataFrame, keyword: str, mode: str = "daily_random", item_id: str = "") -> DataFrame:
    """The queue with a topic behind its last."""
    last = queue.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq"))
    return queue.unionByName(last.select("seq", F.lit(mode).alias("mode"), F.lit(keyword).alias("keyword"), F.lit(item_id).alias("item_id")))
