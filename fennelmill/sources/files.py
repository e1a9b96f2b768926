"""Reading and writing documents, tables and state."""

from __future__ import annotations

import atexit
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fennelmill.functions.scalars import stem
from fennelmill.schemas import struct

_BROKEN = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """No rows of a schema."""
    return spark.createDataFrame([], schema)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what a run writes and reads back: under ``spark.checkpoint.dir``, which the driver and all executors share.

    A local session without that setting uses its warehouse; on a cluster it has to be set, since a folder of one machine
    is no place for tables there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to a scratch folder and read back: what several parts of a plan read is made once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch_of() -> Iterator[None]:
    """Delete, at the end, the scratch folders that were made inside: for a step whose results are written elsewhere."""
    before = len(_made)
    try:
        yield
    finally:
        while len(_made) > before:
            _delete(*_made.pop())


@atexit.register
def _sweep() -> None:
    """Delete scratch folders when the driver's process ends."""
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended: what is left lies in the scratch folder
            return


@dataclass
class Scan:
    """Documents read, and those that could not be."""

    rows: DataFrame
    rejects: DataFrame


def scan_json(spark: SparkSession, folder: str, schema: str | T.StructType) -> Scan:
    """Every ``*.json`` of a folder as one row with its ``stem``; unreadable files go to the rejects; no folder, no rows."""
    schema = struct(schema)
    wide = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    rejects = "stem STRING, content STRING"
    if not exists(spark, folder):
        return Scan(empty(spark, T.StructType([T.StructField("stem", T.StringType()), *schema.fields])), empty(spark, T.StructType.fromDDL(rejects)))
    texts = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(stem(F.col("_metadata.file_name")).alias("stem"), F.col("value").alias("content"))
    parsed = texts.withColumn("doc", F.from_json("content", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}))
    broken = F.col("doc").isNull() | F.col(f"doc.{_BROKEN}").isNotNull()
    return Scan(parsed.where(~broken).select("stem", *(F.col(f"doc.`{f.name}`").alias(f.name) for f in schema.fields)), parsed.where(broken).select("stem", "content"))


def scan_drifting(spark: SparkSession, folder: str, schema: str | T.StructType, drifting: dict[str, tuple[tuple[str, ...], dict[str, tuple[str, ...]]]]) -> Scan:
    """Every ``*.json`` of a folder as one row of ``schema``, whichever shape its drifting arrays have; unreadable files go to the rejects.

    ``drifting`` says of an array of structs under which names it may stand (the first that is an array counts) and under which
    names its elements may hold each field. An element that is no object but a text is a struct of its last
    field. Documents are read as VARIANT and parsed once; ``shapes`` of :func:`shapes_of` shows what there is.
    """
    schema = struct(schema)
    texts = _variants(spark, folder)
    readable = F.col("doc").isNotNull() & F.schema_of_variant("doc").startswith("OBJECT")

    def array(name: str) -> Column:
        places, fields = drifting[name]
        held = F.coalesce(*(F.try_variant_get("doc", f"$.{p}", "array<variant>") for p in places))
        kinds = schema[name].dataType.elementType

        def element(v: Column) -> Column:
            text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
            field = lambda f: F.coalesce(*(F.try_variant_get(v, f"$.{n}", f.dataType.simpleString()) for n in fields[f.name]), *([text] if f.name == kinds.fieldNames()[-1] else []))
            return F.struct(*(field(f).alias(f.name) for f in kinds))

        return F.coalesce(F.transform(held, element), F.array().cast(schema[name].dataType))

    columns = [array(f.name).alias(f.name) if f.name in drifting else F.try_variant_get("doc", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema]
    return Scan(texts.where(readable).select("stem", *columns), texts.where(~readable | F.col("doc").isNull()).select("stem", "content"))


def _variants(spark: SparkSession, folder: str) -> DataFrame:
    """``(stem, content, doc)`` of a folder's JSON files; what can't be parsed is NULL, and no folder gives no rows."""
    if not exists(spark, folder):
        return empty(spark, "stem STRING, content STRING").withColumn("doc", F.try_parse_json("content"))
    texts = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(stem(F.col("_metadata.file_name")).alias("stem"), F.col("value").alias("content"))
    return texts.withColumn("doc", F.try_parse_json("content"))


def shapes_of(spark: SparkSession, folder: str, path: str = "$") -> DataFrame:
    """``(shape, documents)``: the types that a place of a folder's documents has, and how many have each; NULL where it is missing."""
    at = F.try_variant_get("doc", path, "variant")
    return _variants(spark, folder).where("doc is not null").groupBy(F.schema_of_variant(at).alias("shape")).agg(F.count("*").alias("documents"))


def common_shape(spark: SparkSession, folder: str) -> str:
    """The type that holds all documents of a folder, as one pass over them merges it."""
    return _variants(spark, folder).agg(F.schema_of_variant_agg("doc")).first()[0]


def read_json_or(spark: SparkSession, path: str, schema: str | T.StructType, default: DataFrame | None = None) -> DataFrame:
    """A JSON document by schema, or the default (no rows) where there is none or it can't be read."""
    schema = struct(schema)
    default = empty(spark, schema) if default is None else default
    if not exists(spark, path):
        return default
    wide = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", wide, {"columnNameOfCorruptRecord": _BROKEN}).alias("doc"))
    good = rows.where(F.col("doc").isNotNull() & F.col(f"doc.{_BROKEN}").isNull()).select(*(F.col(f"doc.`{f.name}`").alias(f.name) for f in schema.fields))
    from fennelmill.operators.relational import or_default

    return or_default(good, default)


def file_stems(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """The stems of a folder's files, in order; contents are not read."""
    if not exists(spark, folder):
        return empty(spark, T.StructType.fromDDL("stem STRING"))
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(stem("path").alias("stem")).orderBy("stem")


def read_state(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """A state document, or a folder of documents that share the state's keys among them, as two keyed tables: history and last rankings."""
    state = read_json_or(spark, path, schema)
    history = state.select(F.explode("history").alias("item_code", "v")).select("item_code", F.to_timestamp_ntz("v.seen_at").alias("seen_at"), "v.title")
    return history, state.select(F.explode("last_rankings").alias("item_code", "rank"))


def read_posts(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, front_matter, body)`` of Markdown files; the header is a map of texts, lists as JSON. A file without a header has NULL."""
    @F.pandas_udf("map<string,string>")
    def parsed(header: pd.Series) -> pd.Series:
        import yaml

        def one(h: str | None) -> dict | None:
            try:
                found = yaml.safe_load(h) if h else None
            except yaml.YAMLError:
                return None
            return {str(k): None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str) for k, v in found.items()} if isinstance(found, dict) else None

        return header.map(one)

    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    header = r"(?s)^\x{FEFF}?---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n(.*))?$"
    split = files.select(stem(F.col("_metadata.file_name")).alias("name"), F.when(F.col("value").rlike(header), F.regexp_extract("value", header, 1)).alias("h"), F.when(F.col("value").rlike(header), F.regexp_extract("value", header, 2)).otherwise(F.col("value")).alias("body"))
    return split.select("name", parsed("h").alias("front_matter"), "body")


# Sinks ------------------------------------------------------------------------------------------------------------


def write_documents(df: DataFrame, folder: str, *partitions: str) -> None:
    """Documents as JSON, replacing what a partition, or the folder, held."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false")
    (writer.partitionBy(*partitions) if partitions else writer).json(folder)


def as_json(df: DataFrame, *beside: Column | str) -> DataFrame:
    """Each row as one JSON text, beside columns of one's choice."""
    return df.select(*beside, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


class Snapshots:
    """A keyed table kept as one folder for each run, and a pointer to the one that holds.

    A run reads the current snapshot and writes a new folder, so no plan overwrites what it reads; the pointer moves
    when the new snapshot is complete, and a run that is repeated writes its folder again.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), struct(schema)

    def current(self) -> str | None:
        pointer = f"{self.root}/_current"
        if not exists(self.spark, pointer):
            return None
        rows = self.spark.read.schema("run STRING, at STRING").json(pointer).orderBy(F.desc("at")).limit(1).collect()
        return rows[0].run if rows else None

    def read(self) -> DataFrame:
        run = self.current()
        return empty(self.spark, self.schema) if run is None else self.spark.read.schema(self.schema).parquet(f"{self.root}/run_id={run}")

    def changed(self, run: str, keys: list[str]) -> DataFrame:
        """What a run changed, compared with the run before it (see :func:`relational.changes`); all of it is new in the first run."""
        from fennelmill.operators.relational import changes

        runs = [r.run for r in self.spark.read.schema("run STRING, at STRING").json(f"{self.root}/_current").groupBy("run").agg(F.max("at").alias("at")).orderBy("at").collect()]
        of = lambda r: self.spark.read.schema(self.schema).parquet(f"{self.root}/run_id={r}")
        at = runs.index(run)
        return changes(of(runs[at - 1]) if at else empty(self.spark, self.schema), of(run), keys)

    def write(self, df: DataFrame, run: str, at: datetime) -> None:
        df.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.root}/run_id={run}")
        moved = self.spark.createDataFrame([(run, at.isoformat())], "run STRING, at STRING")
        moved.coalesce(1).write.mode("append").json(f"{self.root}/_current")


def index_rows(posts: DataFrame, order: str, size: int = 10) -> DataFrame:
    """The site's index ``(title, permalink, summary, content)`` with the page each row stands on, the latest first."""
    from fennelmill.operators.relational import numbered_by_range

    placed = numbered_by_range(posts, F.desc(order), F.col("permalink"))
    return placed.select("title", "permalink", "summary", "content", (F.floor((F.col("place") - 1) / size) + 1).cast("int").alias("page"))
