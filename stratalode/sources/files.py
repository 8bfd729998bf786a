"""Source files as a table.

Spark's own file readers leave out names that begin with ``_`` or ``.``, and with them
``__init__.py``; ``SourceTree`` is a data source that lists and reads folders in tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from stratalode.functions.constants import GENERATED_PATTERNS, SKIP_DIRS, SKIP_EXTS
from stratalode.functions.text import physical_loc
from stratalode.operators.scan import scan_filter

FILE_SCHEMA = "repo string, path string, ext string, size long, content string, loc int"
#: Folders that are listed before tasks take over, and bytes of contents that a task hands on at a time.
FOLDERS, AT_ONCE = 256, 4 << 20
_ROWS = pa.schema([("path", pa.string()), ("ext", pa.string()), ("size", pa.int64()), ("content", pa.string())])


@dataclass
class Folder(InputPartition):
    """A folder below the root, with or without all folders below itself."""

    path: str
    deep: bool


def _below(root: str, folder: str) -> Iterator[str]:
    """Folders right below one that a scan enters; links are not followed."""
    for e in sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name):
        if e.is_dir(follow_symlinks=False) and e.name.lower() not in SKIP_DIRS:
            yield os.path.join(folder, e.name)


def _own(root: str, folder: str) -> Iterator[str]:
    """Paths of a folder's own files that a scan may keep: no links, none hidden, of no skipped kind, not generated."""
    for e in sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name):
        path = os.path.join(folder, e.name).replace(os.sep, "/")
        hidden = e.name.startswith(".") and not e.name.endswith(".example")
        skipped = os.path.splitext(e.name)[1].lower() in SKIP_EXTS or any(p in path.lower() for p in GENERATED_PATTERNS)
        if e.is_file(follow_symlinks=False) and e.name.lower() not in SKIP_DIRS and not hidden and not skipped:
            yield path


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(folder)``: path, ext, size and content of the files of a checked-out
    repository that a scan may keep by their paths. ``folder`` is one that all machines see. Bytes that are no UTF-8
    are dropped; a file that can't be read has no row. With the option ``pushdown``, which asks for
    spark.sql.python.filterPushdown.enabled, filters on ext and path choose what is read. With the option ``chunk_bytes``
    a file comes as rows of about that many bytes, numbered by pos and cut where lines end."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, ext string, size long, content string" + ", pos int" * ("chunk_bytes" in self.options)

    def reader(self, schema: object) -> SourceTreeReader:
        kind = FilteringReader if self.options.get("pushdown") == "true" else SourceTreeReader
        return kind(self.options["path"].removeprefix("file://"), int(self.options.get("chunk_bytes", 0)))


class SourceTreeReader(DataSourceReader):
    """The first ``FOLDERS`` folders, level by level, are a partition each with their own files; those below
    the last of them are listed by the partition they lie in. Only folders come to the driver."""

    def __init__(self, root: str, chunk_bytes: int = 0) -> None:
        self.root, self.chunk_bytes = root, chunk_bytes
        self.exts: set[str] | None = None
        self.prefix = ""

    def partitions(self) -> list[Folder]:
        out, todo = [], [""]
        while todo and len(out) + len(todo) < FOLDERS:
            folder = todo.pop(0)
            out.append(Folder(folder, False))
            todo += _below(self.root, folder)
        return out + [Folder(f, True) for f in todo]

    def _paths(self, part: Folder) -> Iterator[str]:
        todo = [part.path]
        while todo:
            folder = todo.pop()
            yield from _own(self.root, folder)
            if part.deep:
                todo += _below(self.root, folder)

    def _pieces(self, path: str) -> Iterator[bytes]:
        """A file's bytes, whole or in pieces that end with a line."""
        with open(os.path.join(self.root, path), "rb") as f:
            if not self.chunk_bytes:
                yield f.read()
                return
            held, none = b"", True
            while data := f.read(self.chunk_bytes):
                held += data
                if end := held.rfind(b"\n") + 1:
                    yield held[:end]
                    held, none = held[end:], False
            if held or none:
                yield held

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        shape = _ROWS.append(pa.field("pos", pa.int32())) if self.chunk_bytes else _ROWS
        rows, held = [], 0
        for path in self._paths(partition):
            ext = os.path.splitext(path)[1].lower()
            if not path.startswith(self.prefix) or (self.exts is not None and ext not in self.exts):
                continue
            try:
                for pos, data in enumerate(self._pieces(path)):
                    text = data.decode(errors="ignore").replace("\r\n", "\n").replace("\r", "\n")
                    rows.append({"path": path, "ext": ext, "size": len(data), "content": text, "pos": pos})
                    held += len(data)
                    if held >= AT_ONCE:
                        yield pa.RecordBatch.from_pylist(rows, shape)
                        rows, held = [], 0
            except OSError:
                continue
        if rows:
            yield pa.RecordBatch.from_pylist(rows, shape)


class FilteringReader(SourceTreeReader):
    """Extensions and the beginning of paths choose files before they are read."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            match f:
                case EqualTo(attribute=("ext",), value=v) if self.exts is None:
                    self.exts = {v}
                case In(attribute=("ext",), value=v) if self.exts is None:
                    self.exts = set(v)
                case StringStartsWith(attribute=("path",), value=v) if not self.prefix:
                    self.prefix = v
                case _:
                    yield f


def from_directory(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """The files a scan of a checked-out repository keeps; ``root`` is a folder that all machines see."""
    spark.dataSource.register(SourceTree)
    found = spark.read.format("source_tree").load(os.path.abspath(root)).withColumn("repo", F.lit(repo))
    return scan_filter(found).withColumn("loc", physical_loc(F.col("content"))).select("repo", "path", "ext", "size", "content", "loc")


def from_table(df: DataFrame) -> DataFrame:
    """Rows with repo, path and content as a file table; nothing is filtered."""
    path = F.col("path")
    ext = F.lower(F.regexp_extract(path, "(?s)[^/](\\.[^./]+)$", 1))
    text = F.coalesce(F.col("content"), F.lit(""))
    return df.select("repo", "path", ext.alias("ext"), F.octet_length(text).cast("long").alias("size"), text.alias("content"), physical_loc(text).alias("loc"))
