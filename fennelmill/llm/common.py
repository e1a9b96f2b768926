"""Helpers shared by the training-data operators: inputs, shared scratch tables and worker-side batching."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word separators of every contract in this package: the space and \t \n \v \f \r. Fixed values.
SEPARATORS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by whatever file system Spark resolves the folder with, in pieces enough for the cluster."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df``, a table read from files, dealt anew if its pieces keep less than a quarter of the cluster's cores at work.

    A table that lies in one file with one row group is read by one task, whatever its size; large tables come in many pieces
    and are left as they are. The pieces are counted without reading any column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = df.select(F.spark_partition_id().alias("piece")).distinct().count()
    return df.repartition(cores) if 4 * pieces <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests on one machine) a folder under the session's warehouse takes
    its place; a cluster has to name one, as its machines may share no warehouse.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return where.rstrip("/")


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    mark = "__"
    while any((mark + w).lower() in taken for w in wanted):
        mark += "_"
    return [mark + w for w in wanted]


_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Hand rows to this session's Python workers in batches that stay small even where texts are long.

    Spark's default of 10,000 rows makes batches of many megabytes, which both sides of the pipe hold several times. A
    session that sets another number keeps it.
    """
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, rows)


@contextmanager
def _few_files(spark: SparkSession) -> Iterator[None]:
    """While a table is written, let adaptive execution join small shuffle partitions up to its advisory size."""
    name = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_made: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for path, spark in _made.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended: what is left lies in the scratch folder
            return


atexit.register(_sweep)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The plan above starts from files that every executor can read, so losing an executor costs a re-read and never a
    recomputation of what lies below. The files go by :func:`discard`, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    small_batches(spark)
    with _few_files(spark):
        df.write.parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`materialise` that no plan reads any more; others are left alone."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path in _made:
            _delete(_made.pop(path), path)


@contextmanager
def scratch_of(*keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Delete, at the end, the tables that were made inside, but for those put into the list: for a step whose result is written."""
    before, kept = set(_made), list(keep)
    yield kept
    stays = {getattr(t, "_scratch_path", None) for t in kept}
    for path in [p for p in _made if p not in before and p not in stays]:
        _delete(_made.pop(path), path)


#: Bytes of ids, or of spans, that may be sent to every executor. More are shuffled instead.
MOST_BROADCAST = 48 << 20


def if_small(df: DataFrame, values: str = "1", most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, marked for broadcast if it is counted to hold no more than ``most`` bytes; a larger table is left to a shuffled join.

    ``values`` is SQL for how many values of fixed size, of 16 bytes each, a row holds; strings are counted by their lengths.
    """
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    held = df.agg(F.sum(sum(texts, F.expr(values) * 16))).first()[0] or 0
    return F.broadcast(df) if held <= most else df


@cache
def _trim():
    """The C library's call that returns free pages, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return memory that a Python worker has freed to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text_column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about ``most_bytes`` of text, or one row that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
        give_back()


def in_file_order(df: DataFrame, name: str) -> DataFrame:
    """``df``, a table read from files, with the place of each row in the order of its files and their rows, from 0.

    Files follow each other by the number of the task that wrote them. Only their sizes are added up, one row a file.
    """
    file, row, number, before, of = fresh_names(df, "file", "row", "number", "before", "of")
    named = df.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    sizes = named.groupBy(F.col(file).alias(of)).agg(F.count("*").alias(before)).withColumn(number, F.regexp_extract(of, r"part-(\d+)", 1))
    ahead = F.sum(before).over(Window.orderBy(F.length(number), number, of).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(of, F.coalesce(ahead, F.lit(0)).alias(before))
    return named.join(if_small(sizes), F.col(file) == F.col(of)).withColumn(name, F.col(before) + F.col(row)).drop(file, row, of, before)


def place_in(bounds: str, key: "F.Column", most: int) -> "F.Column":
    """How many of the sorted values in the array column ``bounds``, at most ``most``, are no larger than ``key``: a binary search."""
    steps = [1 << i for i in reversed(range(max(1, most).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(F.col(bounds), at + step - 1) <= key, at + step).otherwise(at))


def words_count(text) -> "F.Column":
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
