"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that may be broadcast; above that a join shuffles both sides.
BROADCAST_ROWS = 1 << 22


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Only a local session, as in tests, gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def write_table(df: DataFrame, name: str) -> str:
    """Writes a table with whole, committed files there and returns its path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a written table: lineage ends there, lost executors cost a reread."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Staged tables of one job, which it drops when they have been read for the last time."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def add(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = write_table(df, name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, but: str | tuple[str, ...] = ()) -> None:
        """The named tables; without names all but those given."""
        keep = {but} if isinstance(but, str) else set(but)
        for name in names or [n for n in self.paths if n not in keep]:
            drop_table(self.spark, self.paths.pop(name))


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table, marked for broadcast if it has few rows; otherwise Spark joins it by shuffling."""
    return F.broadcast(table) if table.count() <= rows else table


def fresh(df: DataFrame, name: str) -> str:
    """The name, or the first of its lengthened forms that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
