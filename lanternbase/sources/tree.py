"""Markdown files of a folder and below, listed and read by tasks, and a stream of the folder's changes."""

from __future__ import annotations

import hashlib
import os
from collections import namedtuple
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Bytes of contents that a task passes on together.
TOGETHER = 16 << 20
LISTED = "path string, mtime double, size long"
#: Names that the task which lists a folder passes on together.
NAMES = 4096
Found = namedtuple("Found", "path size mtime_ns")


def opened(uri: str) -> tuple[stores.FileSystem, str]:
    """The store of a folder's URI, and the folder's path there."""
    store, path = stores.FileSystem.from_uri(uri)
    return store, path.rstrip("/")


def listed(uri: str) -> Iterator[Found]:
    """All files named *.md below a folder, whatever their and their folders' names begin with. A missing folder has none.

    One folder is listed after the other; a local one comes entry by entry, of other stores Arrow gives a folder's entries at once.
    """
    store, path = opened(uri)
    todo = [path]
    while todo:
        folder = todo.pop()
        for entry in _local(folder) if isinstance(store, stores.LocalFileSystem) else store.get_file_info(stores.FileSelector(folder, allow_not_found=True)):
            if isinstance(entry, stores.FileInfo):
                if entry.type == stores.FileType.Directory:
                    todo.append(entry.path)
                elif entry.type == stores.FileType.File and entry.base_name.endswith(".md"):
                    yield Found(entry.path, entry.size, entry.mtime_ns)
            elif entry.is_dir():
                todo.append(f"{folder}/{entry.name}")
            elif entry.name.endswith(".md") and entry.is_file():
                known = entry.stat()
                yield Found(f"{folder}/{entry.name}", known.st_size, known.st_mtime_ns)


def _local(folder: str) -> Iterator[os.DirEntry]:
    try:
        with os.scandir(folder or "/") as entries:
            yield from entries
    except FileNotFoundError:
        return


def _list(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Found] = []

        def passed() -> pa.RecordBatch:
            columns = [pa.array([i.path for i in held], pa.string()), pa.array([i.mtime_ns / 1e9 for i in held], pa.float64()), pa.array([i.size for i in held], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["path", "mtime", "size"])

        for batch in batches:
            for _ in range(batch.num_rows):
                for info in listed(uri):
                    held.append(info)
                    if len(held) == NAMES:
                        yield passed()
        if held:
            yield passed()

    return run


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(uri)
        held: list[tuple] = []
        n_bytes = 0

        def passed() -> pa.RecordBatch:
            path, content, mtime, size = zip(*held, strict=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(path), pa.array(content, pa.binary()), pa.array(mtime), pa.array(size)], names=["path", "content", "mtime", "size"])

        for batch in batches:
            for path, mtime, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with store.open_input_stream(path) as file:
                    content = file.read()
                held.append((path, content, mtime, len(content)))
                n_bytes += len(content)
                if n_bytes >= TOGETHER or len(held) == NAMES:
                    yield passed()
                    n_bytes = 0
        if held:
            yield passed()

    return run


def names(spark: SparkSession, uri: str) -> DataFrame:
    """path (in the store), mtime (epoch seconds), size of every *.md file below a folder, listed by one task."""
    return spark.range(0, 1, 1, 1).mapInArrow(_list(uri), LISTED)


def files(spark: SparkSession, uri: str, tasks: int | None = None) -> DataFrame:
    """path (in the store), content (binary), mtime (epoch seconds), size of every *.md file below a folder.

    One task lists the folder, and the files are dealt over ``tasks`` others (by default four a core), which read them; the driver sees neither names nor contents.
    """
    dealt = names(spark, uri).repartition(tasks or 4 * spark.sparkContext.defaultParallelism, "path")
    return dealt.mapInArrow(_read(uri), "path string, content binary, mtime double, size long")


def _write(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(uri)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                where = f"{top}/{name.as_py()}"
                folder = where.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made = {*made, folder} if len(made) < NAMES else {folder}
                with store.open_output_stream(where) as file:
                    file.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return run


def write_files(rows: DataFrame, uri: str) -> int:
    """Writes each row of ``rows`` (path, content) as a file below a folder, by tasks; their number. A file that is there is replaced, so a task may run again."""
    content = rows.select("path", rows["content"].cast("binary").alias("content"))
    return content.mapInArrow(_write(uri), "n long").agg({"n": "sum"}).first()[0] or 0


class FolderChanges(DataSource):
    """A stream with a row for each change of a folder's listing that a look at it finds: new, edited, renamed and deleted files alike.

    Option ``path``: the folder's URI. The offset is a digest of names, sizes and times, so a restart goes on from the listing that was last seen.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "listing string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Changes(self.options["path"])


class _Changes(SimpleDataSourceStreamReader):
    def __init__(self, uri: str):
        self.uri = uri

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def read(self, start: dict):
        rows = sorted((i.path, i.size, i.mtime_ns) for i in listed(self.uri))
        now = hashlib.sha256(repr(rows).encode()).hexdigest()
        return (iter([]), start) if now == start["listing"] else (iter([(now,)]), {"listing": now})

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([] if start == end else [(end["listing"],)])

    def commit(self, end: dict) -> None:
        """Nothing is kept."""
