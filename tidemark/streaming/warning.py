"""The warning machines in Structured Streaming (T1, T2).  Alarms go to `alarms.AlarmLog` (T12), frames by the
bounded batch come from `sources.recordings` (T9).

State is one JSON value a stream.  Inside a micro-batch a stream's frames are sorted; a frame that is
not later than the last one gets a row with an error and changes nothing.  With `idle_ms` a stream without
frames for so long a processing time is forgotten (T7), so that the state holds live streams only; that is for
queries that run on, since such a timer keeps a query of trigger(availableNow=True) from ending.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import schemas
from tidemark.operators import warning


def read_tracks(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Track rows from a growing Parquet folder, a bounded number of files a trigger."""
    return spark.readStream.schema(schemas.TRACKS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _stateful(tracks: DataFrame, run: Callable, schema: str, idle_ms: int | None) -> DataFrame:
    def one(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else None
        after, rows = run(before, pd.concat(list(parts)))
        state.update((after,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield rows

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return tracks.groupBy("stream_id").applyInPandasWithState(one, schema, "state string", "append", timeout)


def warn(tracks: DataFrame, settings: warning.Settings = warning.Settings(), idle_ms: int | None = None) -> DataFrame:
    """One row a frame."""

    def run(before: str | None, pdf: pd.DataFrame) -> tuple[str, pd.DataFrame]:
        state, rows = warning.run_frames(warning.unpacked(before, warning.fresh), pdf, settings)
        return warning.packed(state), rows

    return _stateful(tracks, run, schemas.ALARMS, idle_ms)


def confirm(boxes: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """One row a frame."""

    def run(before: str | None, pdf: pd.DataFrame) -> tuple[str, pd.DataFrame]:
        state, rows = warning.run_centroids(warning.unpacked(before, warning.fresh_centroids), pdf)
        return warning.packed(state), rows

    return _stateful(boxes, run, warning.CENTROIDS, idle_ms)


def drain(frames: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a streaming frame to the end of what is there now, into Parquet."""
    frames.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(
        "append"
    ).trigger(availableNow=True).start().awaitTermination()
