"""Sharding against a plain loop, and its edge cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fennelmill.llm import sharding

SCHEMA = "doc_id long, text string"


def plain(rows, shards):
    """The law as a loop: ``{(id, text, shard, slot)}`` as a sorted list."""
    keyed = sorted(((-1 if t is None else int(hashlib.md5(t.encode()).hexdigest()[:15], 16), i is not None, i or 0, i, t) for i, t in rows))
    size = lambda t: len((t or "").encode()) + 8
    total = sum(size(r[4]) for r in keyed)
    groups, upto, out, slots = {}, 0, [], {}
    for r in keyed:
        before, held = groups.get(r[0], (upto, 0))
        groups[r[0]] = before, held + size(r[4])
        upto += size(r[4])
    upto = 0
    for k, _, _, i, t in keyed:
        before, held = groups[k]
        middle = 2 * before + held if held * 20 * shards <= total else 2 * upto + size(t)
        upto += size(t)
        shard = middle * shards // (2 * total)
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i, t, shard, slots[shard]))
    return sorted(out, key=repr)


def got(spark, rows, shards, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    found = sharding.shard_rows(df, shards, **options).collect()
    for r in found:
        assert r.size == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode())
    return sorted(((r.doc_id, r.text, r.shard, r.slot) for r in found), key=repr)


def test_equal_to_a_loop_with_nulls_copies_and_long_texts(spark):
    rows = [(i, f"text {i * 7919 % 613} " + "é" * (i % 50)) for i in range(900)] + [(i, "copied often") for i in range(1000, 1400)] + [(2000 + i, None) for i in range(200)] + [(3000, "x" * 50_000), (None, "a"), (None, "a"), (None, None), (7, ""), (7, "")]
    assert got(spark, rows, 24) == plain(rows, 24)
    assert got(spark, rows, 24, most_rows=40) == plain(rows, 24)  # overfull ranges are divided
    assert got(spark, rows[::-1], 5) == plain(rows, 5)


def test_a_hot_text_fills_several_shards_and_others_stay_whole(spark):
    rows = [(i, "hot " * 20) for i in range(600)] + [(1000 + i, f"{i % 300} text of two copies") for i in range(600)]
    found = got(spark, rows, 8, most_rows=50)
    assert found == plain(rows, 8)
    of = {}
    for i, t, shard, _ in found:
        of.setdefault(t, set()).add(shard)
    assert len(of["hot " * 20]) > 1 and all(len(s) == 1 for t, s in of.items() if not t.startswith("hot"))


def test_repeated_rows_give_the_same_shards_under_any_partitioning(spark):
    rows = [(1, "same")] * 500 + [(i, f"t{i}") for i in range(300)]
    a = sharding.shard_rows(spark.createDataFrame(rows, SCHEMA).repartition(7), 6, most_rows=30)
    assert sorted((tuple(r[c] for c in ("doc_id", "text", "shard", "slot")) for r in a.collect()), key=repr) == plain(rows, 6)


@pytest.mark.parametrize("rows", [[], [(1, "only")], [(None, None)]])
def test_few_rows(spark, rows):
    assert got(spark, rows, 24) == plain(rows, 24)


def test_sizes_are_near_equal_and_slots_gapless(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), (F.col("id") % 40).cast("int")).alias("text"))
    sums = sharding.shard_rows(df, 24, carry=["doc_id"]).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    assert len(sums) == 24 and all(r.last == r.n - 1 and r.slots == r.n for r in sums)
    assert max(r.b for r in sums) < 1.01 * min(r.b for r in sums)


def test_clashing_names_and_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", "x", i, "a.b") for i in range(50)], "doc_id long, text string, k string, Size int, `a.b` string")
    out = sharding.shard_rows(df, 4)
    assert out.columns == ["doc_id", "text", "k", "a.b", "size", "text_crc32", "shard", "slot"] and out.select("k").distinct().count() == 1
    sharding.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 50 and (tmp_path / "shards" / "shard=3").is_dir()
