"""Files of a folder tree, listed and read in tasks.

`FolderSource` is a batch data source.  The driver lists the folders two levels below the root and no files; a partition is one share of one
of those folders: its task lists the folder and reads the files whose names fall into its share.  Paths never come
to the driver, and empty files are rows like all others.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FILES = "path string, relative string, length bigint, content binary"
BATCH_BYTES, BATCH_FILES = 8 << 20, 1000
#: Schemes that tasks can open without Spark's file systems.
SCHEMES = ("file", "hdfs", "s3", "gs", "abfss")


def uri(path: str) -> str:
    """A path with its scheme; Spark writes local ones as file:/folder too."""
    if "://" in path:
        return path
    return f"file://{path.removeprefix('file:')}"


@dataclass
class Share(InputPartition):
    folder: str  # below the root
    deep: bool  # with all that lies below it
    number: int
    of: int


class FolderSource(DataSource):
    """Options: path; content (false: null); shares of a folder, 2."""

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self.options)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = uri(options["path"].rstrip("/"))
        self.content = options.get("content", "true") == "true"
        self.shares = int(options.get("shares", 2))

    def _open(self) -> tuple[pafs.FileSystem, str]:
        fs, root = pafs.FileSystem.from_uri(self.root)
        return fs, root.rstrip("/")

    def partitions(self) -> list[Share]:
        fs, root = self._open()

        def below(folder: str) -> list[str]:
            here = f"{root}/{folder}".rstrip("/")
            if isinstance(fs, pafs.LocalFileSystem):
                with os.scandir(here) as entries:
                    names = [e.name for e in entries if e.is_dir()]
            else:
                names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(here)) if i.type == pafs.FileType.Directory]
            return sorted(f"{folder}/{n}".lstrip("/") for n in names)

        first = below("")
        second = [d for f in first for d in below(f)]
        places = [("", False), *((f, False) for f in first), *((d, True) for d in second)]
        return [Share(folder, deep, k, self.shares) for folder, deep in places for k in range(self.shares)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        fs, root = self._open()
        prefix = self.root.removesuffix(root) if self.root.endswith(root) else f"{self.root.split('://')[0]}://"
        rows, size = [], 0
        for path, length in _walk(fs, f"{root}/{share.folder}".rstrip("/"), share.deep):
            relative = path[len(root) + 1 :] if path.startswith(f"{root}/") else path
            if zlib.crc32(relative.encode()) % share.of != share.number:
                continue
            data = None
            if self.content:
                with fs.open_input_stream(path) as file:
                    data = file.read()
            length = length() if callable(length) else length
            rows.append((f"{prefix}{path}", relative, length, data))
            size += length if self.content else 0
            if len(rows) >= BATCH_FILES or size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _walk(fs: pafs.FileSystem, folder: str, deep: bool) -> Iterator[tuple[str, int | Callable[[], int]]]:
    """Files and their lengths, one after the other: a local folder's names are never held together, elsewhere those of one folder are."""
    left = [folder]
    while left:
        here = left.pop()
        if isinstance(fs, pafs.LocalFileSystem):
            with os.scandir(here) as entries:
                for entry in entries:
                    if entry.is_dir():
                        left += [entry.path] * deep
                    elif entry.is_file():
                        yield entry.path, lambda entry=entry: entry.stat().st_size
            continue
        for info in fs.get_file_info(pafs.FileSelector(here)):
            if info.type == pafs.FileType.Directory:
                left += [info.path] * deep
            elif info.type == pafs.FileType.File:
                yield info.path, info.size


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FILES.split(", ")])


def readable(root: str) -> bool:
    return uri(root).split("://")[0] in SCHEMES


def files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """Every file below a root: path, relative, length, content."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder_tree").option("content", str(content).lower()).load(root)


def write_files(rows: DataFrame, root: str) -> None:
    """Files of (relative, content) below a root, written by tasks: beside the target, then renamed, so none is ever seen half."""
    where = uri(root.rstrip("/"))

    def each(part: Iterator[Row]) -> None:
        fs, base = pafs.FileSystem.from_uri(where)
        made = set()
        for row in part:
            path = f"{base.rstrip('/')}/{row['relative']}"
            folder = path.rsplit("/", 1)[0]
            if folder not in made:
                fs.create_dir(folder)
                made.add(folder)
            hidden = f"{folder}/.{path.rsplit('/', 1)[1]}.partial"
            with fs.open_output_stream(hidden) as file:
                file.write(bytes(row["content"] or b""))
            fs.move(hidden, path)

    rows.select("relative", "content").foreachPartition(each)
