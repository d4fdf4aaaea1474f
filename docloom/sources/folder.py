"""Document folders as a data source: ``spark.read.format("docfolder")`` and ``spark.readStream`` likewise.

Partitions are runs of files of about ``maxbytes`` together, so that many small files share a task and a large one has its
own; nothing is read before its task runs. As a stream, files come in order of (time of change, path); an offset is the last
one taken, so a query that begins again goes on after it.

Options: ``path`` (a folder, local or of any store that pyarrow knows by its URI), ``maxbytes``, ``exts`` (with commas; all by default).

Edge cases: an empty folder gives an empty result; one that is not there is an error; names that begin with a dot or an
underscore are left out, as are folders of such names; a file of no bytes has empty content; a file that goes between listing and reading
is a row whose content is null. A file must come with a later time than those already taken: write it elsewhere and move it in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from docloom.tables import ship

SCHEMA = "path string, name string, ext string, size bigint, content binary"
MAX_BYTES, OPEN_BYTES = 32 << 20, 64 << 10


@dataclass(frozen=True)
class File:
    path: str
    size: int
    changed: int


class Run(InputPartition):
    """Files that one task reads."""

    def __init__(self, files: list[File]):
        super().__init__(None)
        self.files = files


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, exts: set[str]) -> list[File]:
    """The folder's files in order of (time of change, path)."""
    store, root = opened(path)
    out = []
    for f in store.get_file_info(fs.FileSelector(root, recursive=True)):
        inner = f.path[len(root.rstrip("/")) :].strip("/").split("/")
        if f.type == fs.FileType.File and not any(p[:1] in "._" for p in inner) and (not exts or f.extension.lower() in exts):
            out.append(File(f.path, f.size or 0, f.mtime_ns or 0))
    return sorted(out, key=lambda f: (f.changed, f.path))


def runs(files: list[File], max_bytes: int) -> list[Run]:
    """Consecutive files of at most ``max_bytes`` together, opening costs included; a larger one alone."""
    out, held, size = [], [], 0
    for f in files:
        if held and size + f.size + OPEN_BYTES > max_bytes:
            out.append(Run(held))
            held, size = [], 0
        held.append(f)
        size += f.size + OPEN_BYTES
    return [*out, Run(held)] if held else out


class _Files:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.max_bytes = int(options.get("maxbytes", MAX_BYTES))
        self.exts = {e.strip().lower().lstrip(".") for e in options.get("exts", "").split(",") if e.strip()}

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        for f in partition.files:  # one file a batch: memory holds no more than one
            name = f.path.rsplit("/", 1)[-1]
            try:
                with store.open_input_stream(f.path) as s:
                    content = s.read()
            except FileNotFoundError:
                content = None
            row = ([f.path], [name], [name.rsplit(".", 1)[-1].lower() if "." in name else ""], [f.size], [content])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["path", "name", "ext", "size", "content"])


class Reader(_Files, DataSourceReader):
    def partitions(self) -> list[Run]:
        return runs(listed(self.path, self.exts), self.max_bytes) or [Run([])]


class StreamReader(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.path, self.exts)
        return {"changed": files[-1].changed, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Run]:
        low, high = (start["changed"], start["path"]), (end["changed"], end["path"])
        return runs([f for f in listed(self.path, self.exts) if low < (f.changed, f.path) <= high], self.max_bytes)

    def commit(self, end: dict) -> None:
        pass


class Folder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docfolder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``docfolder`` known to the session."""
    ship(spark)
    spark.dataSource.register(Folder)
