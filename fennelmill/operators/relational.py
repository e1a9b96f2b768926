"""Operators on rows of any table: unnesting, default rows, keep-first, top rows, lookups, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fennelmill.sources.files import written


def unnest(df: DataFrame, array: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each element of an array of structs, with ``pos`` and the element's fields; none for NULL or empty."""
    return df.select(*keep, F.posexplode(array).alias("pos", "item")).select(*keep, "pos", "item.*")


def spread(df: DataFrame, least: int = 3) -> DataFrame:
    """``df`` dealt anew if it comes in fewer than ``least`` pieces a core: a small file of narrow rows is few pieces, whatever is made of each row."""
    pieces = least * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(pieces) if df.rdd.getNumPartitions() < pieces else df


def or_default(df: DataFrame, default: DataFrame) -> DataFrame:
    """``df``, or the default rows where it has none. Only whether a first row exists is looked up."""
    some = df.limit(1).select(F.lit(1).alias("__some"))
    return df.unionByName(default.join(some, F.lit(True), "left_anti"), allowMissingColumns=True)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key. NULL keys are one key. A rank filter, so partitions drop later rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_by_id(targets: DataFrame, found: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Looked-up rows, all of them, then searched rows whose key is new among both; a NULL key is a key like others."""
    both = targets.withColumn("branch", F.lit(0)).unionByName(found.withColumn("branch", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("branch", pos)
    return both.withColumn("__n", F.row_number().over(w)).where("branch = 0 or __n = 1").drop("__n")


def top_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of a total order: a top-k per partition and a merge, never a full sort."""
    return df.orderBy(*order).limit(n)


def upsert(current: DataFrame, fresh: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Current rows replaced or joined by fresh ones of the same key; among fresh ones the last in order wins."""
    fields = [c for c in current.columns if c not in keys]
    rank = F.struct(F.col("__fresh"), *(F.col(f"__o{i}") for i in range(len(order))))
    old = current.select(*keys, *fields, F.lit(0).alias("__fresh"), *(F.lit(None).cast(fresh.schema[o].dataType).alias(f"__o{i}") for i, o in enumerate(order)))
    new = fresh.select(*keys, *fields, F.lit(1).alias("__fresh"), *(F.col(o).alias(f"__o{i}") for i, o in enumerate(order)))
    last = old.unionByName(new).groupBy(*keys).agg(F.max_by(F.struct(*fields), rank).alias("__v"))
    return last.select(*keys, *(F.col("__v")[f].alias(f) for f in fields))


def numbered(df: DataFrame, *order: Column | str, partition: Sequence[str] = (), name: str = "place") -> DataFrame:
    """Rows with their place, from 1, within each partition. Without one all rows are ordered in one task: for a bounded number, such as :func:`top_rows` gives."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def numbered_by_range(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """Rows with their place, from 1, in a table of any size.

    The rows are dealt by ranges of the order and written; each range counts its own, and only the counts of ranges are
    added up in one place. They are written since ranges are drawn from a sample: both uses have to see the same.
    """
    part, within, before = f"{name}__part", f"{name}__within", f"{name}__before"
    placed = written(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = placed.groupBy(part).agg(F.count("*").alias(before))
    upto = F.coalesce(F.sum(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = placed.withColumn(within, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return each.join(counts.withColumn(before, upto), part).withColumn(name, F.col(within) + F.col(before)).drop(part, within, before)


def lookup_in_order(posts: DataFrame, ids: str, items: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    """The items that each post lists, in the post's order."""
    listed = posts.select(*keep, F.posexplode(ids).alias("pos", key))
    return listed.join(items, key)


def collected(df: DataFrame, keys: Sequence[str], order: Sequence[Column], element: Column, name: str, most: int | None = None) -> DataFrame:
    """One array of elements for each key, in order; with ``most``, only the first of them, cut before they are gathered.

    Rows are dealt by their keys first, with the columns that order and element are made of: arrays of what a task happens
    to hold of a key would make no row less.
    """
    if most is not None:
        df = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= most)
        place: list[Column] = [F.col("__n").alias("o0")]
    else:
        df = df.repartition(*keys)
        place = [o.alias(f"o{i}") for i, o in enumerate(order)]
    rows = F.sort_array(F.collect_list(F.struct(*place, element.alias("element"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: r["element"]).alias(name))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of its row count, taken as it is written: no second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, change, before, after)``: what is ``inserted``, ``updated`` or ``removed`` between two states of a keyed table.

    ``before`` and ``after`` are structs of the other columns, NULL where there is no row. NULL keys are equal, and so are NULL
    values; a column that one state lacks is NULL there. Both states meet in one full outer join on the keys, and only keys whose values
    differ go on. A key stands for one row: where a state repeats it, the greatest row counts.
    """
    values = [c for c in dict.fromkeys([*before.columns, *after.columns]) if c not in keys]
    held = lambda df: F.struct(*((F.col(f"`{c}`") if c in df.columns else F.lit(None).cast((after if c in after.columns else before).schema[c].dataType)).alias(c) for c in values))

    def state(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*(F.col(f"`{k}`").alias(f"{name}_{i}") for i, k in enumerate(keys))).agg(F.max(held(df)).alias(name))

    same = [F.col(f"before_{i}").eqNullSafe(F.col(f"after_{i}")) for i in range(len(keys))]
    both = state(before, "before").join(state(after, "after"), same, "full")
    kind = F.when(F.col("before").isNull(), "inserted").when(F.col("after").isNull(), "removed").otherwise("updated")
    found = both.where(~F.col("before").eqNullSafe(F.col("after")))
    return found.select(*(F.coalesce(f"after_{i}", f"before_{i}").alias(k) for i, k in enumerate(keys)), kind.alias("change"), "before", "after")


def tag_counts(df: DataFrame, tags: str) -> DataFrame:
    """How many rows carry each tag (an extension of tag listings)."""
    return df.select(F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
