"""Files under a root as a data source: listings, lines and whole texts, unreadable entries as rows of their own.

`spark.read.format("tree").option("kind", ...).load(root)` after `register`.
Folders are the unit of parallel work: the planner descends until there are as
many folders as `tasks` asks for, and each becomes one partition.  Filters on
`top`, the first folder of a path, prune partitions before anything is listed
in them; a filter on the end of `path` keeps other files from being opened.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith

SCHEMAS = {
    "entries": "top string, path string, name string, size long, modified double, error string",
    "lines": "top string, path string, number int, value string, error string",
    "texts": "top string, path string, value string, error string",
}
#: Rows of an Arrow batch, and bytes of text in one.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


@dataclass(frozen=True)
class Entry:
    path: str
    folder: bool
    size: int | None = None
    modified: float | None = None
    error: str | None = None


class LocalStore:
    """A folder that every machine has mounted."""

    def __init__(self, root: str):
        self.root = root.removeprefix("file://").rstrip("/") or "/"

    def entries(self, folder: str) -> Iterator[Entry]:
        try:
            found = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)
        except OSError as error:
            yield Entry(folder, False, error=error.strerror or "unreadable")
            return
        for e in found:
            path = f"{folder}/{e.name}".lstrip("/")
            try:
                if e.is_dir(follow_symlinks=False):
                    yield Entry(path, True)
                else:
                    about = e.stat()
                    yield Entry(path, False, about.st_size, about.st_mtime)
            except OSError as error:
                yield Entry(path, False, error=error.strerror or "unreadable")

    def read(self, path: str) -> bytes:
        with open(os.path.join(self.root, path), "rb") as file:
            return file.read()


class RemoteStore:
    """A file system that Arrow reaches by its URI."""

    def __init__(self, root: str):
        from pyarrow.fs import FileSystem

        self.files, self.root = FileSystem.from_uri(root)

    def entries(self, folder: str) -> Iterator[Entry]:
        from pyarrow.fs import FileSelector, FileType

        try:
            found = sorted(self.files.get_file_info(FileSelector(f"{self.root}/{folder}".rstrip("/"))), key=lambda i: i.base_name)
        except OSError as error:
            yield Entry(folder, False, error=error.strerror or "unreadable")
            return
        for i in found:
            path = f"{folder}/{i.base_name}".lstrip("/")
            if i.type == FileType.Directory:
                yield Entry(path, True)
            elif i.type == FileType.File:
                yield Entry(path, False, i.size, i.mtime.timestamp() if i.mtime else None)
            else:
                yield Entry(path, False, error="unreadable")

    def read(self, path: str) -> bytes:
        with self.files.open_input_stream(f"{self.root}/{path}") as file:
            return file.read()


def store_of(root: str) -> LocalStore | RemoteStore:
    return LocalStore(root) if root.startswith(("/", "file://")) else RemoteStore(root)


@dataclass
class Folder(InputPartition):
    """A folder; `deep` if what lies below its own folders belongs to it too."""

    path: str
    deep: bool

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def top_of(path: str) -> str:
    return path.split("/", 1)[0] if "/" in path else ""


class TreeReader(DataSourceReader):
    def __init__(self, root: str, kind: str, tasks: int):
        self.root, self.kind, self.tasks = root, kind, tasks
        self.tops: set[str] | None = None
        self.endings: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Folders and endings asked for; Spark tests the rows again, so nothing is taken off its hands."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("top",):
                self.tops = {f.value} if self.tops is None else self.tops & {f.value}
            elif isinstance(f, In) and f.attribute == ("top",):
                self.tops = set(f.value) if self.tops is None else self.tops & set(f.value)
            elif isinstance(f, StringEndsWith) and f.attribute == ("path",):
                self.endings.append(f.value)
            yield f

    def partitions(self) -> list[Folder]:
        """Folders level by level, until there are enough of them or none is left to open."""
        store = store_of(self.root)
        asked = lambda e: e.folder and (self.tops is None or top_of(f"{e.path}/") in self.tops)
        out = [Folder("", False)] if self.tops is None or "" in self.tops else []
        level = [e.path for e in store.entries("") if asked(e)]
        while level and len(out) + len(level) < self.tasks:
            out += [Folder(p, False) for p in level]
            level = [e.path for p in level for e in store.entries(p) if e.folder]
        return (out + [Folder(p, True) for p in level]) or [Folder("", False)]

    def _files(self, store: LocalStore | RemoteStore, folder: str, deep: bool) -> Iterator[Entry]:
        for e in store.entries(folder):
            if not e.folder:
                yield e
            elif deep:
                yield from self._files(store, e.path, True)

    def _rows(self, partition: Folder) -> Iterator[tuple]:
        store = store_of(self.root)
        for e in self._files(store, partition.path, partition.deep):
            top = top_of(e.path)
            if self.kind == "entries":
                yield top, e.path, e.path.rsplit("/", 1)[-1], e.size, e.modified, e.error
                continue
            if not all(e.path.endswith(x) for x in self.endings):
                continue
            try:
                if e.error:
                    raise OSError(0, e.error)
                text = store.read(e.path).decode("utf-8")
            except OSError as error:
                yield (top, e.path, *[None] * (len(SCHEMAS[self.kind].split(",")) - 3), error.strerror or "unreadable")
            except UnicodeDecodeError:
                yield (top, e.path, *[None] * (len(SCHEMAS[self.kind].split(",")) - 3), "not UTF-8")
            else:
                if self.kind == "texts":
                    yield top, e.path, text, None
                else:
                    yield from ((top, e.path, k, line, None) for k, line in enumerate(text.splitlines(), 1))

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMAS[self.kind].split(", "))])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        waiting: list[tuple] = []
        size = 0
        for row in self._rows(partition):
            waiting.append(row)
            size += sum(len(x) for x in row if isinstance(x, str))
            if len(waiting) >= BATCH_ROWS or size > BATCH_BYTES:
                yield batch(waiting)
                waiting, size = [], 0
        if waiting:
            yield batch(waiting)


class Tree(DataSource):
    """Options: path (the root), kind (entries, lines or texts), tasks (folders that are read side by side)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "entries")]

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("kind", "entries"), int(self.options.get("tasks", "64")))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.dataSource.register(Tree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def tree(spark: SparkSession, root: str, kind: str = "entries", tasks: int = 64) -> DataFrame:
    """The files under a root as rows of `kind`; `error` says what kept an entry from being read, the other columns are null then."""
    register(spark)
    return spark.read.format("tree").option("kind", kind).option("tasks", tasks).load(root)


def readable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that were read, top, path and error of those that were not)."""
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("top", "path", "error")
