"""Files keyed by what they hold, and tables keyed by what they were made of.

Files and the members of archives are hashed where they lie, in tasks, block by block.  `Store` keeps each content once, under its digest, and
versions: a version is a manifest (name, digest), written aside and published by one rename, so a reader sees whole versions only and
an aborted write leaves nothing visible.  `cached` does the same for a table under the digest of its inputs, code and parameters.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.listing import files, uri

BLOCK = 1 << 20
MEMBERS = "path string, member string, name string, is_archive boolean, sha256 string, length bigint"
PROBLEMS = "name string, sha256 string, problem string"


def signature(**parts: object) -> str:
    """The digest of named parts: of input digests, code, parameters."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def _blocks(file) -> Iterator[bytes]:
    while block := file.read(BLOCK):
        yield block


def _digest(file) -> tuple[str, int]:
    found, size = hashlib.sha256(), 0
    for block in _blocks(file):
        found.update(block)
        size += len(block)
    return found.hexdigest(), size


def _archive(file) -> zipfile.ZipFile | None:
    """The archive that a file is; a short or broken one is a plain file."""
    if file.size() < 22:  # of an empty archive
        return None
    try:
        return zipfile.ZipFile(file)
    except (zipfile.BadZipFile, OSError):
        return None


def _hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in MEMBERS.split(", ")]
    kinds = [pa.string()] * 3 + [pa.bool_(), pa.string(), pa.int64()]
    for batch in batches:
        rows = []
        for path, relative in zip(batch["path"].to_pylist(), batch["relative"].to_pylist(), strict=True):
            fs, at = pafs.FileSystem.from_uri(uri(path))
            with fs.open_input_file(at) as file:
                if relative.lower().endswith(".zip") and (archive := _archive(file)):
                    with archive:
                        for info in archive.infolist():
                            if not info.is_dir():
                                with archive.open(info) as member:
                                    rows.append((path, info.filename, info.filename, True, *_digest(member)))
                    continue
                file.seek(0)
                rows.append((path, None, relative, False, *_digest(file)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def digests(spark: SparkSession, root: str) -> DataFrame:
    """MEMBERS of every file below a root; an archive's members stand for it."""
    return files(spark, root, content=False).select("path", "relative").mapInArrow(_hash_all, MEMBERS)


def copies(manifest: DataFrame, found: DataFrame, root_depth: int = 1) -> DataFrame:
    """name, sha256, path, member, problem of each manifest entry: the copy to take, folders before archives, then by path.

    manifest: name, sha256; found: MEMBERS, whose names below a dataset folder of `root_depth` parts are compared.
    """
    below = F.concat_ws("/", F.slice(F.split("name", "/"), root_depth + 1, 1 << 20))
    name = F.when(F.col("is_archive"), F.col("name")).otherwise(below)
    there = found.select(name.alias("_name"), F.col("sha256").alias("_sha256"), "path", "member", "is_archive")
    joined = manifest.select("name", "sha256").join(there, F.col("name") == F.col("_name"), "left")
    same = F.col("_sha256") == F.col("sha256")
    taken = joined.groupBy("name", "sha256").agg(
        F.min(F.when(same, F.struct("is_archive", "path", "member"))).alias("t"),
        F.when(F.count("_sha256") == 0, "missing").when(F.count_if(same) == 0, "changed").alias("problem"),
    )
    return taken.select("name", "sha256", "t.path", "t.member", "problem")


class Store:
    """Objects by digest and versions below a folder that all machines share."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _object(self, digest: str) -> str:
        return f"{self.path}/objects/{digest[:2]}/{digest}"

    def publish(self, taken: DataFrame, key: str) -> None:
        """The version `key` of (name, sha256, path, member) rows, if it isn't there; an entry with a problem is an error."""
        spark = taken.sparkSession
        if _exists(spark, f"{self.path}/versions/{key}"):
            return
        target = self._object

        def copy(part: Iterator[Row]) -> None:
            for row in part:
                if row["path"] is None:
                    raise ValueError(f"{row['name']} is missing or changed")
                _copy(row["path"], row["member"], target(row["sha256"]), row["sha256"])

        taken.select("name", "sha256", "path", "member").foreachPartition(copy)
        _published(taken.select("name", "sha256"), f"{self.path}/open", f"{self.path}/versions/{key}")

    def read(self, spark: SparkSession, key: str) -> DataFrame | None:
        """name, sha256 of a version; None if it was never published."""
        where = f"{self.path}/versions/{key}"
        return spark.read.parquet(where) if _exists(spark, where) else None

    def materialise(self, spark: SparkSession, key: str, root: str) -> None:
        """The version's files below a root, each hashed as it is written."""
        manifest, target = self.read(spark, key), self._object
        if manifest is None:
            raise FileNotFoundError(f"no version {key} in {self.path}")

        def copy(part: Iterator[Row]) -> None:
            for row in part:
                _copy(target(row["sha256"]), None, f"{root.rstrip('/')}/{row['name']}", row["sha256"])

        manifest.foreachPartition(copy)

    def check(self, spark: SparkSession, key: str, root: str) -> DataFrame:
        """name, sha256, problem (missing, changed, null) of a materialised version."""
        return copies(self.read(spark, key), digests(spark, root), root_depth=0).select("name", "sha256", "problem")


def cached(spark: SparkSession, path: str, key: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table made under that signature, and whether it was there."""
    where = f"{path.rstrip('/')}/tables/{key}"
    hit = _exists(spark, where)
    if not hit:
        _published(make(), f"{path.rstrip('/')}/open", where)
    return spark.read.parquet(where), hit


def _copy(source: str, member: str | None, target: str, digest: str) -> None:
    to, at = pafs.FileSystem.from_uri(uri(target))
    if to.get_file_info(at).type == pafs.FileType.File and "/objects/" in at:
        return  # an object's name says what it holds
    fs, path = pafs.FileSystem.from_uri(uri(source))
    to.create_dir(at.rsplit("/", 1)[0])
    part, found = f"{at}.{uuid.uuid4().hex}.partial", hashlib.sha256()
    with fs.open_input_file(path) as file:
        inner = zipfile.ZipFile(file).open(member) if member is not None else file
        with to.open_output_stream(part) as out:
            for block in _blocks(inner):
                found.update(block)
                out.write(block)
    if found.hexdigest() != digest:
        to.delete_file(part)
        raise ValueError(f"{source} has changed")
    to.move(part, at)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _published(rows: DataFrame, aside: str, path: str) -> None:
    """A table that appears whole under its path; whoever comes second finds it there and leaves it."""
    spark = rows.sparkSession
    part = f"{aside}/{uuid.uuid4().hex}"
    rows.write.parquet(part)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(Path(path).getParent())
    if not _exists(spark, path) and not fs.rename(Path(part), Path(path)) and not _exists(spark, path):
        raise RuntimeError(f"{path} was not published")
