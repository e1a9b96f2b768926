"""What changed since the last run: new arrivals, announced items and jumps in rank, and the state behind them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fennelmill import schemas
from fennelmill.functions import scalars as S
from fennelmill.operators.relational import or_default, top_rows, upsert

#: What announces an item, and what marks a collaboration. Digits are those of any script.
ANNOUNCED = r"(予約|発売予定|新発売|\p{Nd}{4}年\p{Nd}{1,2}月発売|入荷予定)"
COLLABORATION = r"(コラボ|×|公式|ライセンス|記念|限定)"
#: Scores of an arrival, the rank of what was not ranked, and the rule of a jump.
NEW, ANNOUNCED_SCORE, COLLABORATION_SCORE = 3, 5, 4
UNRANKED, LEAST_JUMP, TOP_RANK = 101, 20, 30


def arrivals(feed: DataFrame, history: DataFrame, announced: str = ANNOUNCED, collaboration: str = COLLABORATION) -> DataFrame:
    """Signals of items that are new or announced, from ``(pos, item_code, title, url, image, price)``.

    An item is new if its code is neither in the history nor on an earlier row of the feed; rows without a code are
    always new. A NULL title matches nothing. First positions are a map-side minimum, known codes leave by an anti-join
    of one row a code, and the flag comes back by code *and* position: no code, and no lack of one, makes a hot group.
    """
    code = S.truthy("item_code")
    coded, uncoded = feed.where(code.isNotNull()), feed.where(code.isNull())
    known = history.select(F.col("item_code").alias("code")).where("code is not null").distinct()
    fresh = coded.groupBy(F.col("item_code").alias("code")).agg(F.min("pos").alias("first")).join(known, "code", "left_anti")
    flagged = coded.join(fresh, (F.col("item_code") == F.col("code")) & (F.col("pos") == F.col("first")), "left").withColumn("is_new", F.col("code").isNotNull())
    rows = flagged.select(*feed.columns, "is_new").unionByName(uncoded.withColumn("is_new", F.lit(True)))
    return arrival_signals(rows, announced, collaboration)


def arrival_signals(rows: DataFrame, announced: str = ANNOUNCED, collaboration: str = COLLABORATION) -> DataFrame:
    """Signals of rows that say whether they are new (``is_new``): those that are new or announced, row by row."""
    rows = rows.withColumn("is_announced", S.matches("title", announced)).withColumn("is_collaboration", S.matches("title", collaboration)).where("is_new or is_announced")
    score = F.col("is_new").cast("int") * NEW + F.col("is_announced").cast("int") * ANNOUNCED_SCORE + F.col("is_collaboration").cast("int") * COLLABORATION_SCORE
    kind = F.when(F.col("is_new"), "new_arrival").otherwise("preorder")
    return rows.select(kind.alias("type"), "item_code", "title", "url", "image", "price", F.lit(None).cast("int").alias("jump"), score.cast("double").alias("score"), F.lit(0).alias("branch"), F.col("pos").cast("long").alias("pos"))


def rank_jumps(ranking: DataFrame, last: DataFrame) -> DataFrame:
    """Signals of items that rose by more than the least jump since the last run, from ``(pos, rank, item_code, …)``.

    What was not ranked counts as just below the list. Rows without a rank are dropped.
    """
    before = last.where("item_code is not null").select(F.col("item_code").alias("last_code"), F.col("rank").alias("last_rank"))
    rows = ranking.where("rank is not null").join(before, F.col("item_code") == F.col("last_code"), "left")
    was = F.coalesce("last_rank", F.lit(UNRANKED))
    return jump_signals(rows.withColumn("was", was))


def jump_signals(rows: DataFrame) -> DataFrame:
    """Signals of ranked rows that say what rank they had before (``was``), row by row."""
    was, jump = F.col("was"), F.col("was") - F.col("rank")
    rows = rows.withColumn("jump", jump.cast("int")).where((jump > LEAST_JUMP) | ((was == UNRANKED) & (F.col("rank") <= TOP_RANK)))
    return rows.select(F.lit("sudden_jump").alias("type"), "item_code", "title", "url", "image", "price", "jump", (F.col("jump") * 0.5 + 5).alias("score"), F.lit(1).alias("branch"), F.col("pos").cast("long").alias("pos"))


def standard_signal(spark: SparkSession, title: str) -> DataFrame:
    """The signal of a day without any."""
    return spark.range(1).select(F.lit("standard").alias("type"), F.lit(title).alias("title"), F.lit(0.0).alias("score"))


def top_signal(signals: DataFrame, fallback_title: str = "standard") -> DataFrame:
    """The best signal, or the standard one where there is none. Ties keep feed order, arrivals before jumps."""
    best = top_rows(signals, 1, F.desc("score"), "branch", "pos")
    return or_default(best, standard_signal(signals.sparkSession, fallback_title))


def next_history(history: DataFrame, feed: DataFrame, run_at: datetime | Column) -> DataFrame:
    """The history with every code of the feed as last seen now; codes never leave it."""
    at = run_at if isinstance(run_at, Column) else F.lit(run_at)
    seen = feed.where(S.truthy("item_code").isNotNull()).select("item_code", at.cast("timestamp_ntz").alias("seen_at"), "title", "pos")
    return upsert(history, seen, ["item_code"], ["pos"])


def next_ranks(ranking: DataFrame | None, last: DataFrame, keep_when_missing: bool = False) -> DataFrame:
    """The ranks to compare with next time: those of this run, each code's last row. A missing feed empties them unless told to keep."""
    if ranking is None:
        return last if keep_when_missing else last.limit(0)
    return ranking.where("item_code is not null").groupBy("item_code").agg(F.max_by("rank", "pos").alias("rank"))


def empty_state(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """History and ranks before the first run."""
    return spark.createDataFrame([], schemas.HISTORY), spark.createDataFrame([], schemas.RANKS)
