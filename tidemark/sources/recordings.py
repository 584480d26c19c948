"""Recorded frames as a stream that admits a bounded number of frames a trigger and camera.

A recording is a folder with one subfolder a camera, whose Parquet files hold one row a frame, in order.  `FrameSource` is a
streaming data source over it: an offset is the number of frames of each camera so far; every trigger moves each camera on by
`frames_per_trigger` frames at most (16, as a detector takes).  With `calls_per_trigger` a trigger moves it on by that many calls of a
detector, and a column `call` numbers a camera's calls: rows of one call are 16 at most, and the triggers of a long recording are
fewer.  Frames are read in tasks, some cameras each, from the row groups that hold them, which are small.

The source keeps the last planned offset in the folder `log`, written before a batch runs, so after a restart it goes on where the query's
own checkpoint does: a batch that was planned and not committed is planned again by Spark with the same offsets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.sources.listing import uri

MOST_FRAMES = 16
GROUP_BYTES = 1 << 16  # of a row group, about; a trigger reads some frames of each camera
TASKS = 32
BOX = "struct<x1:double,y1:double,x2:double,y2:double,conf:double,cls:int>"
FRAME = f"stream_id string, frame_index bigint, ts_sec double, arrived_sec double, image_w int, image_h int, boxes array<{BOX}>"


def frames_of(boxes: DataFrame) -> DataFrame:
    """One row a frame of box rows (TRACKS columns, arrived_sec optional); boxes by coordinates."""
    arrived = F.col("arrived_sec") if "arrived_sec" in boxes.columns else F.col("ts_sec")
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "conf")], F.col("cls").cast("int").alias("cls"))
    return (
        boxes.withColumn("arrived_sec", arrived)
        .groupBy("stream_id", "frame_index")
        .agg(
            *[F.min(c).alias(c) for c in ("ts_sec", "arrived_sec", "image_w", "image_h")],
            F.sort_array(F.collect_list(F.when(F.col("x1").isNotNull(), box))).alias("boxes"),
        )
    )


def write_recording(frames: DataFrame, path: str, frames_per_file: int = 100_000) -> None:
    """A recording of FRAME rows; a camera's files follow each other by name."""
    rows = frames.select(*[f.name for f in StructType.fromDDL(FRAME).fields]).repartition("stream_id")
    rows = rows.sortWithinPartitions("stream_id", "frame_index")
    out = rows.write.partitionBy("stream_id").option("maxRecordsPerFile", frames_per_file)
    out.option("parquet.block.size", GROUP_BYTES).parquet(path)


def slots(captured: Column, arrived: Column, fps: float = 30.0) -> Column:
    """(slot, late): the frame's place at that rate, and how many whole slots had passed when it arrived."""
    slot = F.floor(captured * fps + 1e-6)
    return F.struct(slot.alias("slot"), F.greatest(F.lit(0).cast("long"), F.floor((arrived - slot / fps) * fps + 1e-6)).alias("late"))


@dataclass
class Span(InputPartition):
    """Some cameras' frames: (camera, file, first row, end row, the camera's frames before the file)."""

    parts: list[tuple[str, str, int, int, int]]


class FrameSource(DataSource):
    """Options: path; log (a folder of its own for each query); frames_per_trigger, 16 at most; calls_per_trigger adds `call`."""

    @classmethod
    def name(cls) -> str:
        return "recorded_frames"

    def schema(self) -> str:
        return f"{FRAME}, call bigint" if "calls_per_trigger" in self.options else FRAME

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FrameReader(self.options, schema)


class FrameReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.log = options["path"].rstrip("/"), options["log"].rstrip("/")
        self.most = int(options.get("frames_per_trigger", MOST_FRAMES))
        if not 0 < self.most <= MOST_FRAMES:
            raise ValueError(f"frames_per_trigger is 1 to {MOST_FRAMES}")
        self.calls = int(options.get("calls_per_trigger", 1))
        if self.calls < 1:
            raise ValueError("calls_per_trigger is 1 or more")
        self.schema = schema
        self.sizes: dict[str, int] = {}  # rows of each file seen
        self.at: dict[str, int] | None = None

    def _found(self) -> dict[str, list[tuple[str, int]]]:
        """(file, rows) of each camera; footers are read once."""
        fs, root = pafs.FileSystem.from_uri(uri(self.path))
        out: dict[str, list[tuple[str, int]]] = {}
        for info in sorted(fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)), key=lambda i: i.path):
            folder, name = info.path.split("/")[-2:]
            if info.type != pafs.FileType.File or name[0] in "._" or not folder.startswith("stream_id="):
                continue
            if info.path not in self.sizes:
                with fs.open_input_file(info.path) as file:
                    self.sizes[info.path] = pq.read_metadata(file).num_rows
            out.setdefault(folder.removeprefix("stream_id="), []).append((info.path, self.sizes[info.path]))
        return out

    def _planned(self) -> dict[str, int]:
        """Frames of each camera in the batches planned so far."""
        if self.at is None:
            fs, root = pafs.FileSystem.from_uri(uri(self.log))
            info = fs.get_file_info(f"{root}/planned.json")
            self.at = {}
            if info.type == pafs.FileType.File:
                with fs.open_input_stream(info.path) as file:
                    self.at = json.loads(file.read())
        return self.at

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        at = self._planned()
        there = {camera: sum(n for _, n in files) for camera, files in self._found().items()}
        return {camera: min(n, at.get(camera, 0) + self.most * self.calls) for camera, n in sorted(there.items())}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        if start == end:
            return []
        self._plan(end)
        parts = []
        for camera, files in sorted(self._found().items()):
            low, high, before = start.get(camera, 0), end.get(camera, 0), 0
            for path, n in files:
                a, b = max(low - before, 0), min(high - before, n)
                if a < b:
                    parts.append((camera, path, a, b, before))
                before += n
        size = max(1, -(-len(parts) // TASKS))
        return [Span(parts[i : i + size]) for i in range(0, len(parts), size)]

    def _plan(self, end: dict) -> None:
        self.at = dict(end)
        fs, root = pafs.FileSystem.from_uri(uri(self.log))
        fs.create_dir(root)
        with fs.open_output_stream(f"{root}/planned.tmp") as file:
            file.write(json.dumps(self.at).encode())
        fs.move(f"{root}/planned.tmp", f"{root}/planned.json")

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(self.schema)
        fs, _ = pafs.FileSystem.from_uri(uri(self.path))
        for camera, path, low, high, ahead in partition.parts:
            with fs.open_input_file(path) as source:
                file, before = pq.ParquetFile(source), 0
                for group in range(file.metadata.num_row_groups):
                    n = file.metadata.row_group(group).num_rows
                    a, b = max(low - before, 0), min(high - before, n)
                    if a < b:
                        rows = file.read_row_group(group).slice(a, b - a)
                        rows = rows.append_column("stream_id", pa.array([camera] * len(rows), pa.string()))
                        if "call" in kind.names:
                            numbers = range(ahead + before + a, ahead + before + b)
                            rows = rows.append_column("call", pa.array([i // self.most for i in numbers], pa.int64()))
                        yield from rows.select(kind.names).cast(kind).to_batches()
                    before += n


def read_recording(
    spark: SparkSession, path: str, log: str, frames_per_trigger: int = MOST_FRAMES, calls_per_trigger: int | None = None
) -> DataFrame:
    """The stream of a recording; run it with a trigger by time, since availableNow takes a single batch of such a source."""
    spark.dataSource.register(FrameSource)
    stream = spark.readStream.format("recorded_frames").option("path", path).option("log", log).option("frames_per_trigger", frames_per_trigger)
    if calls_per_trigger is not None:
        stream = stream.option("calls_per_trigger", calls_per_trigger)
    return stream.load()
