"""Sharding by sampled splitters, in DataFrame operations only. The law is ``bytes``: shards of nearly equal size.

Rows are ordered by a hash of their text, their id, and a number that is written with them, so equal texts lie side by side
and every run of rows can be cut anywhere. Samples of the keys, drawn in proportion to the rows' sizes, give quantile
boundaries; rows are range-partitioned by them, and a range that turns out to hold too many rows or bytes is divided again by
a sample of its own. Ranges only bound what one task sorts: a row's exact place follows from sums over the ranges
before it and the rows before it in its range, so the shard and slot of a row depend on neither samples nor partitions.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fennelmill.llm.common import discard, if_small, materialise, place_in

#: Ranges for each shard at least, rows of a range at most before it is divided, and samples for each range.
RANGES, ROWS, SAMPLES = 8, 1 << 20, 16
#: Bytes that a row counts besides its text: a fixed value.
ROW_BYTES = 8
#: Copies of a text stay in one shard if together they are at most this part of a shard.
WHOLE = 20


def _uniform(seed: int) -> Column:
    """A number in [0, 1) made of the row's key."""
    return (F.xxhash64("k", F.col("id").isNull(), "id", "at", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


def _boundaries(samples: DataFrame) -> DataFrame:
    """One row: the sorted keys at which a run of ``SAMPLES`` points ends, of ``(range, k, id, at, points)``."""
    upto = F.sum("points").over(Window.partitionBy("range").orderBy("k", "id", "at"))
    ends = samples.withColumn("upto", upto).where(f"upto div {SAMPLES} > (upto - points) div {SAMPLES}")
    return ends.agg(F.array_sort(F.collect_list(F.struct("k", "id", "at"))).alias("bounds"))


def _placed(rows: DataFrame, bounds: DataFrame, most: int) -> DataFrame:
    """The rows with their range. ``bounds`` is one row, whose length the number of ranges bounds."""
    return rows.crossJoin(F.broadcast(bounds)).withColumn("range", place_in("bounds", F.struct("k", "id", "at"), most)).drop("bounds")


def ranged(rows: DataFrame, shards: int, most_rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """``(rows with their range, sums of each range)`` of written ``(k, id, at, size, ...)``.

    The sums are ``(range, rows, bytes, low, high)`` with the smallest and largest ``k``. Ranges with more than four
    times their share of the bytes, or more than ``most_rows``, are divided until none is left that can be.
    """
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    wanted = max(RANGES * shards, ceil(n / most_rows))
    step = max(1.0, (total or 0) / (wanted * SAMPLES))
    points = F.floor(F.col("size") / F.lit(step) + _uniform(1)).cast("long")
    drawn = rows.select(F.lit(0).alias("range"), "k", "id", "at", points.alias("points")).where("points > 0")
    bounds = materialise(_boundaries(drawn), "bounds")
    most_bytes = max(1, ceil(4 * step * SAMPLES))
    for turn in range(2, 10):
        count = bounds.select(F.size("bounds")).first()[0]
        placed = _placed(rows, bounds, count)
        sums = materialise(placed.groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("k").alias("low"), F.max("k").alias("high")), "sums")
        over = sums.where(f"rows > 1 and (rows > {most_rows} or bytes > {most_bytes})")
        pieces = over.select("range", "rows", "bytes", F.ceil(F.greatest(F.col("rows") / most_rows, F.col("bytes") / most_bytes)).alias("pieces"))
        if turn == 9 or pieces.isEmpty():
            return placed, sums
        share = F.lit(float(SAMPLES)) * F.col("pieces") * (F.col("size") / F.col("bytes") + F.lit(1.0) / F.col("rows"))
        drawn = placed.join(if_small(pieces, "4"), "range").select("range", "k", "id", "at", F.floor(share + _uniform(turn)).cast("long").alias("points")).where("points > 0")
        both = _boundaries(drawn).withColumnRenamed("bounds", "more").crossJoin(bounds).select(F.array_sort(F.array_distinct(F.concat("bounds", "more"))).alias("bounds"))
        finer = materialise(both, "bounds")
        discard(bounds, sums)
        bounds = finer
    raise AssertionError("not reached")


def _crossing(placed: DataFrame, sums: DataFrame) -> DataFrame:
    """``(k, group_before, group_bytes)`` of the texts whose copies lie in several ranges; at most one a range."""
    follows = F.lead("low").over(Window.orderBy("range"))
    split = materialise(sums.withColumn("next", follows).where("next = high").select(F.col("high").alias("k")).distinct(), "split")
    inside = placed.join(if_small(split), "k", "left_semi").groupBy("k", "range").agg(F.sum("size").alias("held"))
    found = inside.join(_before(sums).select("range", "before", "bytes"), "range")
    first = F.min(F.struct("range", (F.col("before") + F.col("bytes") - F.col("held")).alias("upto")))["upto"]
    return found.groupBy("k").agg(first.alias("group_before"), F.sum("held").alias("group_bytes"))


def _before(sums: DataFrame) -> DataFrame:
    """The sums with the bytes and rows of all ranges before; one row a range, so one task orders few."""
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("bytes").over(upto), F.lit(0))).withColumn("rows_before", F.coalesce(F.sum("rows").over(upto), F.lit(0)))


def shard_rows(df: DataFrame, shards: int = 24, carry: list[str] | None = None, id_column: str = "doc_id", text_column: str = "text", most_rows: int = ROWS) -> DataFrame:
    """The columns ``carry`` of ``df`` (all by default), with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    A row's size is the UTF-8 bytes of its text plus 8. In the order of the keys shard ``i`` takes what lies between the
    shares ``i`` and ``i + 1`` of all bytes, a row at a border going to the side that holds its middle; copies of a text
    that are together at most a twentieth of a shard move as one, larger groups are cut between two copies. So a shard
    differs from its share by at most half a row, or a fortieth of a share, at either end. Slots count the rows of a shard in
    the order of the keys.

    Edge cases: a NULL text has no bytes, checksum 0, and a group of its own beside empty texts; NULL ids come first; rows
    of equal id and text are neighbours in any order; a single row larger than a share fills a shard alone, and some
    shards may then be empty, as with fewer rows than shards; columns of ``df`` that have an added name are replaced, all others stay,
    whatever their names; an empty table gives no rows.
    """
    added = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in added]
    text = F.col(f"`{text_column}`").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)
    k = F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(-1).cast("long"))
    named = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(f"`{id_column}`").alias("id"), k.alias("k"), size.alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"))
    rows = materialise(named.withColumn("at", F.monotonically_increasing_id()), "rows")
    placed, sums = ranged(rows, shards, most_rows)
    total = sums.agg(F.sum("bytes")).first()[0] or 1
    crossing = materialise(_crossing(placed, sums), "crossing")
    in_range, of_text = Window.partitionBy("range").orderBy("k", "id", "at"), Window.partitionBy("range", "k")
    ranks = placed.withColumn("rank", F.row_number().over(in_range).cast("long")).withColumn("upto", F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    ranks = ranks.withColumn("in_bytes", F.sum("size").over(of_text)).withColumn("in_before", F.min("upto").over(of_text))
    found = ranks.join(if_small(_before(sums).select("range", "before", "rows_before"), "3"), "range").join(if_small(crossing, "3"), "k", "left")
    group, ahead = F.coalesce("group_bytes", "in_bytes"), F.coalesce("group_before", F.col("before") + F.col("in_before"))
    middle = F.when(group * WHOLE * shards <= total, 2 * ahead + group).otherwise(2 * (F.col("before") + F.col("upto")) + F.col("size"))
    dealt = found.withColumn("middle", middle).select(*(f"c{i}" for i in range(len(kept))), "size", "crc", F.expr(f"cast((middle * {shards}) div {2 * total} as int)").alias("shard"), (F.col("rows_before") + F.col("rank")).alias("rank"))
    dealt = materialise(dealt, "dealt")
    firsts = materialise(dealt.groupBy(F.col("shard").alias("of_shard")).agg(F.min("rank").alias("first")), "firsts")
    discard(rows, sums, crossing)
    out = dealt.join(if_small(firsts, "2"), F.col("shard") == F.col("of_shard"))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("rank") - F.col("first")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the result of :func:`shard_rows` with a folder for each shard; files of a folder follow each other by slot."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def digests(sharded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Id, size, checksum, law, shard and slot of each row; NULL ids stay, an empty table gives no rows."""
    return sharded.select(id_column, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_bit(i: int) -> int:
    """What bit ``i`` of a byte adds to the usual 32-bit checksum: the checksum is linear in bits."""
    c = 1 << i
    for _ in range(8):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


_STEP = "c >> 8"
for _i in range(8):
    _STEP = f"xor({_STEP}, ((xor(c, b) >> {_i}) & 1) * {_crc_bit(_i)})"

ORACLE = f"""
WITH d AS (SELECT doc_id, text, CAST(8 + coalesce(strlen(text), 0) AS BIGINT) AS size, CASE WHEN text IS NULL THEN -1 ELSE CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) END AS k FROM documents),
o AS (SELECT *, CAST(sum(size) OVER () AS BIGINT) AS total, CAST(sum(size) OVER (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, row_number() OVER (ORDER BY k, doc_id NULLS FIRST) AS rank FROM d),
g AS (SELECT *, CAST(sum(size) OVER (PARTITION BY k) AS BIGINT) AS grp, CAST(max(upto) OVER (PARTITION BY k) AS BIGINT) AS ends FROM o),
s AS (SELECT *, CAST(((CASE WHEN grp * {WHOLE} * 24 <= total THEN 2 * ends - grp ELSE 2 * upto - size END) * 24) // (2 * total) AS INTEGER) AS shard FROM g)
SELECT doc_id, size, CASE WHEN size = 8 THEN 0 ELSE xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: {_STEP}, CAST(4294967295 AS BIGINT))) END AS text_crc32,
  'bytes' AS law, shard, rank - min(rank) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
