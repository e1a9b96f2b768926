"""Streams bound to the tables: slices of a table arrive one after the other, and each restarts the query from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fennelmill.plans.registry import query, table
from fennelmill.sources import files
from fennelmill.streaming import state

_ANNOUNCED, _COLLABORATION = "(ECONOMY|PROMO)", "(ring|gear)"


def _streamed(rows: DataFrame, slices: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream writes of slices of ``rows``, each a condition in SQL, that arrive one after the other.

    State has as many partitions as the cluster has cores, if the session asks for more: it keeps them for good.
    """
    spark = rows.sparkSession
    where, name = files.scratch(spark, "stream"), "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), max(2, spark.sparkContext.defaultParallelism)))
    try:
        for some in slices:
            rows.where(some).write.mode("append").parquet(f"{where}/in")
            stream = make(spark.readStream.schema(rows.schema).parquet(f"{where}/in"))
            run = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
            run.awaitTermination()
            schema = stream.schema
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(schema).parquet(f"{where}/out")


@query(
    f"""WITH feed AS (SELECT l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_partkey % 50 > 0 THEN CAST(l_partkey AS VARCHAR) END AS item_code, concat_ws(' ', p_name, p_type) AS title, CAST(floor(l_extendedprice) AS BIGINT) AS price, l_linenumber FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
flagged AS (SELECT *, item_code IS NULL OR (CAST(item_code AS BIGINT) % 3 > 0 AND row_number() OVER (PARTITION BY item_code ORDER BY pos) = 1) AS is_new, regexp_matches(title, '{_ANNOUNCED}') AS is_ann, regexp_matches(title, '{_COLLABORATION}') AS is_col FROM feed)
SELECT CASE WHEN is_new THEN 'new_arrival' ELSE 'preorder' END AS type, item_code, title, price, CAST(3 * is_new::INT + 5 * is_ann::INT + 4 * is_col::INT AS DOUBLE) AS score, pos FROM flagged WHERE is_new OR is_ann"""
)
def d1_stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as a feed in three slices, with the codes that three divides as history; parts of each fiftieth have no code.

    Lines without a part have an empty title; lines without a position come in the last slice, behind the others.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    lines = table(spark, sf_dir, "lineitem")
    numbers = part.select("p_partkey").union(lines.select("l_partkey"))  # lines name parts that the table lacks
    history = numbers.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("item_code"))
    nothing = F.lit(None).cast("string")
    feed = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    feed = feed.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_partkey") % 50 > 0, F.col("l_partkey").cast("string")).alias("item_code"), F.concat_ws(" ", "p_name", "p_type").alias("title"), nothing.alias("url"), nothing.alias("image"), F.floor("l_extendedprice").alias("price"))
    most = feed.agg(F.max("pos")).first()[0] or 0
    slices = [f"pos <= {most // 3}", f"pos > {most // 3} and pos <= {most // 2}", f"pos > {most // 2} or pos is null"]
    found = _streamed(feed, slices, lambda s: state.stream_arrivals(s, history, _ANNOUNCED, _COLLABORATION))
    return found.select("type", "item_code", "title", "price", "score", "pos")


@query(
    """WITH counts AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS run, user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, CAST(1 + (user_id * 37 + run * 41) % 100 AS INTEGER) AS rank FROM counts)
SELECT CAST(c.user_id AS VARCHAR) AS item_code, c.run * 1000000 + c.user_id AS pos, coalesce(p.rank, 101) - c.rank AS jump, (coalesce(p.rank, 101) - c.rank) * 0.5::DOUBLE + 5 AS score FROM ranked c LEFT JOIN ranked p ON p.user_id = c.user_id AND p.run = c.run - 1 WHERE coalesce(p.rank, 101) - c.rank > 20"""
)
def d2_stream_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of each day as that day's ranking, all days in three slices."""
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    users = table(spark, sf_dir, "events").where("user_id is not null").select(day.alias("run"), "user_id").distinct()
    nothing = F.lit(None).cast("string")
    ranking = users.select("run", (F.col("run") * 1000000 + F.col("user_id")).alias("pos"), (1 + (F.col("user_id") * 37 + F.col("run") * 41) % 100).cast("int").alias("rank"), F.col("user_id").cast("string").alias("item_code"), nothing.alias("title"), nothing.alias("url"), nothing.alias("image"), F.lit(None).cast("long").alias("price"))
    nobody = files.empty(spark, "item_code STRING, rank INT")
    found = _streamed(ranking, ["run < 10", "run >= 10 and run < 20", "run >= 20"], lambda s: state.stream_jumps(s, nobody, -1))
    return found.select("item_code", "pos", "jump", "score")
