"""Plans and operators whose work must not grow faster than their input."""

import os
import time

import pytest
from pyspark.sql import functions as F

from fennelmill.operators import articles, relational
from fennelmill.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_flags_of_a_long_document_take_linear_time(spark):
    n = 30_000
    docs = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(((i * 7919) % n).cast("long").alias("price"))).alias("products"))
    begun = time.monotonic()
    found = docs.select(F.explode(articles.cheapest_nested("products")).alias("p")).where("p.is_cheapest").select("p.price").collect()
    assert [r.price for r in found] == [1] and time.monotonic() - begun < 20


@tables
def test_pages_made_of_a_small_file_are_parsed_by_all_cores(spark):
    few = spark.range(100).coalesce(1)
    assert relational.spread(few).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
    assert relational.spread(few.repartition(40)).rdd.getNumPartitions() == 40
    assert QUERIES["s13_maker_items"].run(spark, DATA).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
