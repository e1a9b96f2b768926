"""Helpers: tables in enough pieces, places among sorted values."""

import bisect
import random

from pyspark.sql import functions as F

from fennelmill.llm import common


def test_a_table_in_one_piece_is_dealt_anew_and_others_stay(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    spark.range(100).repartition(6).write.option("maxRecordsPerFile", 5).parquet(str(tmp_path / "many.parquet"))
    one = common.table(spark, str(tmp_path), "one")
    assert "Exchange" in one._jdf.queryExecution().executedPlan().toString() and sorted(r.id for r in one.collect()) == list(range(100))
    wide = spark.read.option("maxPartitionBytes", 1).parquet(str(tmp_path / "many.parquet"))
    dealt = wide.repartition(5)
    assert common.spread(dealt) is dealt
    spark.createDataFrame([], "id int").write.parquet(str(tmp_path / "none.parquet"))
    assert common.table(spark, str(tmp_path), "none").count() == 0


def test_places_among_sorted_values(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 7, 8, 31):
        bounds = sorted(rng.sample(range(100), n))
        df = spark.createDataFrame([(k, bounds) for k in range(-1, 101)], "k int, bounds array<int>")
        for most in (n, n + 9):
            got = {r.k: r.at for r in df.select("k", common.place_in("bounds", F.col("k"), most).alias("at")).collect()}
            assert got == {k: bisect.bisect_right(bounds, k) for k in range(-1, 101)}


def test_rows_in_the_order_of_their_files(spark, tmp_path):
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    got = common.in_file_order(spark.read.parquet(str(tmp_path / "t")), "place").orderBy("place").collect()
    assert [r.id for r in got] == [r.place for r in got] == list(range(1000))
