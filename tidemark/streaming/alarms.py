"""An alarm is raised on its rising edge, and once, whatever happens to the query.

`edges` finds the rising edges of a flag, in batch or on a stream.  `AlarmLog` is the foreachBatch sink: a micro-batch's alarms
are written beside the log and join it by one rename, so readers see whole batches only.  A batch that Spark runs again after a failure
finds its folder (named by query and batch) committed and writes nothing; a query that lost its checkpoint and replays its input meets the keys (stream,
episode) of the log.  A delivery (a mail, a call) follows the commit and is marked afterwards; one that a crash cut off is
tried again with the same key, so a receiver can tell.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.streaming.ordered import Machine

EDGES = "episode long, ts_sec double"
KEYS = ["stream_id", "episode"]


def edges(flags: DataFrame, by: str, order: tuple[str, ...] = ("ts_sec",), flag: str = "flag") -> DataFrame:
    """by, episode (from 0), ts_sec of each rising edge; a null flag is down.  Rows without a time are left out."""
    window = Window.partitionBy(by).orderBy(*order)
    up = F.coalesce(F.col(flag), F.lit(False))
    before = F.lag(up, 1, False).over(window)
    risen = flags.where("ts_sec IS NOT NULL").withColumn("_up", up & ~before).where("_up")
    return risen.select(by, (F.row_number().over(window).cast("long") - 1).alias("episode"), "ts_sec")


def edge_machine(flag: str = "flag", idle_ms: int = 3_600_000) -> Machine:
    """The same over a stream: its state is the last flag and the number of episodes.

    A stream that was silent for idle_ms starts anew, its episodes at 0; let that be longer than any pause.
    """

    def step(state: dict, row: dict) -> list[dict]:
        up = bool(row[flag])
        risen = up and not state["up"]
        state["up"] = up
        if not risen:
            return []
        state["episodes"] += 1
        return [{"episode": state["episodes"] - 1, "ts_sec": row["ts_sec"]}]

    return Machine(lambda: {"up": False, "episodes": 0}, step, lambda state: [], EDGES, idle_ms)


def raised(alarms: DataFrame) -> DataFrame:
    """Of warning rows (T1), those in which an alarm goes up; its frame is the episode."""
    reason = F.get(F.filter("transitions", lambda t: t["reason"].isNotNull()), 0)["reason"]
    return alarms.select("stream_id", F.col("frame_index").alias("episode"), "ts_sec", reason.alias("reason")).where("reason IS NOT NULL")


class AlarmLog:
    """foreachBatch(AlarmLog(path)): rows need stream_id, episode and keep their other columns."""

    def __init__(self, path: str, deliver: Callable[[Row], None] | None = None):
        self.path, self.deliver = path.rstrip("/"), deliver

    def _files(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _has(self, spark: SparkSession, name: str) -> bool:
        files, path = self._files(spark)
        return bool(len(files.globStatus(path(f"{self.path}/{name}")) or []))

    def read(self, spark: SparkSession) -> DataFrame | None:
        """All committed alarms; None before the first commit."""
        return spark.read.option("basePath", f"{self.path}/log").parquet(f"{self.path}/log/batch=*") if self._has(spark, "log/batch=*") else None

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")  # the checkpoint's, so restarts keep it
        name = f"batch={query}-{batch_id}"
        if not self._has(spark, f"log/{name}"):
            self._commit(rows, name)
        else:
            rows.write.format("noop").mode("overwrite").save()  # the rows were written, but the query's state may not have been
        if self.deliver is not None and not self._has(spark, f"delivered/{name}"):
            self._deliver(spark, name)

    def _commit(self, rows: DataFrame, name: str) -> None:
        spark, there = rows.sparkSession, self.read(rows.sparkSession)
        new = rows.dropDuplicates(KEYS)
        if there is not None:
            new = new.join(there.select(*KEYS), KEYS, "left_anti")
        part = f"{self.path}/open/{uuid.uuid4().hex}"
        new.select(*rows.columns).write.parquet(part)
        files, path = self._files(spark)
        files.mkdirs(path(f"{self.path}/log"))
        if not files.rename(path(part), path(f"{self.path}/log/{name}")):
            raise RuntimeError(f"{name} of {self.path} was not committed")

    def _deliver(self, spark: SparkSession, name: str) -> None:
        deliver = self.deliver

        def each(part: Iterator[Row]) -> None:
            for row in part:
                deliver(row)

        spark.read.parquet(f"{self.path}/log/{name}").foreachPartition(each)
        files, path = self._files(spark)
        files.mkdirs(path(f"{self.path}/delivered/{name}"))
