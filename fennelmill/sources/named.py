"""A sink that writes each row as a file of its own name, from the executors.

Tasks write into a staging folder of their own beside the files; only when all tasks have ended does the driver move the
files to their names, so a reader sees none of a job that fails, a task that runs twice counts once, and an aborted job
leaves the folder as it was.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Files moved at the same time, and those whose moves are planned at a time.
_MOVERS, _PLANNED = 16, 4096
#: What the names of folders begin with, among which files are dealt.
FOLDER = "part-"


@dataclass
class Staged(WriterCommitMessage):
    """The folder in which a task has staged its files, and whether they lie in folders of it."""

    folder: str
    dealt: bool = False


class NamedFiles(DataSource):
    """``df.write.format("named_files").option("path", uri)`` of ``(name, content)``; option ``suffix`` ends every name.

    Mode ``append`` adds files and replaces those of the same names; ``overwrite`` also takes other files with the suffix away.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        made = NamedWriter(self.options["path"], self.options.get("suffix", ""), overwrite)
        made.prepare()
        return made


class NamedWriter(DataSourceArrowWriter):
    """Stages files in tasks, and moves them in the driver."""

    def __init__(self, path: str, suffix: str, overwrite: bool) -> None:
        self.path, self.suffix, self.overwrite, self.staging = path, suffix, overwrite, f"_staging-{uuid.uuid4().hex}"

    def _place(self) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.path)
        return system, root.rstrip("/")

    def prepare(self) -> None:
        """Make the staging folder. Tasks never do, so one that outlives an aborted job can't bring it back."""
        system, root = self._place()
        system.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, root = self._place()
        own, seen, made = f"{root}/{self.staging}/{uuid.uuid4().hex}", set(), set()
        dealt = False
        for batch in iterator:
            dealt = "folder" in batch.schema.names
            folders = batch.column("folder").to_pylist() if dealt else [None] * batch.num_rows
            for name, content, folder in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), folders):
                if not name or name[0] in "._" or "/" in name or "\0" in name:
                    raise ValueError(f"no name of a file: {name!r}")
                if name in seen:
                    raise ValueError(f"two rows have the name {name!r}")
                if not seen:
                    system.create_dir(own, recursive=False)
                    made.add(own)
                seen.add(name)
                at = own if folder is None else f"{own}/{FOLDER}{folder}"
                if at not in made:
                    system.create_dir(at, recursive=False)
                    made.add(at)
                with system.open_output_stream(f"{at}/{name}{self.suffix}") as out:
                    out.write(content or b"")
        return Staged(own if seen else "", dealt)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = self._place()
        dealt = [m for m in messages if m is not None and m.folder and m.dealt]
        if dealt:
            self._folders(system, root, dealt)
            return self.abort([])
        moves: dict[str, str] = {}
        for m in messages:
            for info in system.get_file_info(fs.FileSelector(m.folder)) if m is not None and m.folder else ():
                if info.base_name in moves:
                    raise ValueError(f"two rows have the name {info.base_name!r}")
                moves[info.base_name] = info.path
        if self.overwrite:
            old = [i.path for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and i.base_name.endswith(self.suffix) and i.base_name not in moves]
            self._each(system.delete_file, [(p,) for p in old])
        self._each(system.move, [(source, f"{root}/{name}") for name, source in moves.items()])
        self.abort([])

    def _folders(self, system: fs.FileSystem, root: str, staged: list[Staged]) -> None:
        """Move whole folders, each of which one task has made; only files of a folder that is there already are moved one by one."""
        there = {i.base_name: i.path for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and i.base_name.startswith(FOLDER)}
        if self.overwrite:
            self._each(system.delete_dir, [(p,) for p in there.values()])
            there = {}
        for m in staged:
            found = system.get_file_info(fs.FileSelector(m.folder))
            self._each(system.move, [(i.path, f"{root}/{i.base_name}") for i in found if i.base_name not in there])
            for i in found:
                if i.base_name in there:
                    self._each(system.move, [(f.path, f"{there[i.base_name]}/{f.base_name}") for f in system.get_file_info(fs.FileSelector(i.path))])

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = self._place()
        for left in range(5, -1, -1):
            try:
                if system.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
                    system.delete_dir(f"{root}/{self.staging}")
                return
            except OSError:  # a task that is being ended has just written there
                if not left:
                    raise
                time.sleep(0.2)

    @staticmethod
    def _each(action, arguments: list[tuple]) -> None:
        with ThreadPoolExecutor(_MOVERS) as pool:
            for k in range(0, len(arguments), _PLANNED):
                list(pool.map(lambda a: action(*a), arguments[k : k + _PLANNED]))


def qualified(spark: SparkSession, path: str) -> str:
    """A path as an address with its file system, as other libraries than Hadoop's read it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_named(df: DataFrame, folder: str, suffix: str, name: str = "name", content: str = "content", order: str | None = None, overwrite: bool = False, folders: int = 0) -> None:
    """Each row's text as a file of its name, written by the tasks that hold the rows.

    Where rows may share a name, ``order`` says which of them stays: the last. Without it two rows of a name are an error, as is a
    NULL or empty name, one with a slash, or one that a listing would hide; an error leaves nothing behind. A NULL text
    makes an empty file; no rows make an empty folder.

    With ``folders`` files are dealt by their names among so many folders, each made by one task: the driver then moves folders,
    not files, and :func:`read_named` lists them in tasks, so neither holds all names. The number has to stay when files are added.
    """
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"), *([F.col(order).alias("order")] if order else []))
    if order:
        rows = rows.groupBy("name").agg(F.max_by("content", "order").alias("content"))
    if folders:
        pieces = min(folders, 3 * df.sparkSession.sparkContext.defaultParallelism)
        rows = rows.withColumn("folder", F.lpad(F.pmod(F.xxhash64("name"), F.lit(folders)).cast("string"), 6, "0")).repartition(pieces, "folder")
    df.sparkSession.dataSource.register(NamedFiles)
    rows.write.format("named_files").mode("overwrite" if overwrite else "append").option("suffix", suffix).option("path", qualified(df.sparkSession, folder)).save()


def read_named(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """``(name, content)`` of the files of a folder, and of the folders among which they were dealt: tasks list and read them."""
    uri = qualified(spark, folder)
    system, root = fs.FileSystem.from_uri(uri)
    found = [i.base_name for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and i.base_name.startswith(FOLDER)]
    places = spark.createDataFrame([("",), *((n,) for n in found)], "place string").repartition(max(1, min(len(found), 3 * spark.sparkContext.defaultParallelism)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for place in batch.column("place").to_pylist():
                files = [i for i in system.get_file_info(fs.FileSelector(f"{root}/{place}".rstrip("/"))) if i.type == fs.FileType.File and i.base_name.endswith(suffix) and i.base_name[0] not in "._"]
                for k in range(0, len(files), 256):
                    some = files[k : k + 256]
                    texts = [system.open_input_file(i.path).read().decode("utf-8", "replace") for i in some]
                    yield pa.RecordBatch.from_arrays([pa.array([i.base_name.removesuffix(suffix) for i in some], pa.string()), pa.array(texts, pa.string())], ["name", "content"])

    return places.mapInArrow(read, "name string, content string")
