"""Recorded frames in order: sorted rows in, one frame after the other out, whatever the size of a stream.

Rows of a stream are sorted within one partition and pass through a worker batch by batch; what is held is the
frame at hand and the machine's state, so a stream may be far longer than memory.  Streams are sequential by
nature and are what spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STREAM_TASKS = 192
#: What a row is: a followed box, a detector's box, a reviewed box.  A row without a kind is a track row.
TRACK, BOX, TRUTH = "track", "box", "truth"
ORDER = ["stream_id", "frame_index", "ts_sec", "kind", "track_id"]
COLUMNS = [
    "stream_id", "frame_index", "ts_sec", "image_w", "image_h", "x1", "y1", "x2", "y2", "track_id", "conf", "cls", "kind", "reset",
    "exact_time", "reviewed",
]


class Frame(NamedTuple):
    stream: str
    index: int
    t: float | None
    size: tuple[float, float]
    tracks: list[tuple]  # (x1, y1, x2, y2, track, conf, cls)
    boxes: list[tuple]  # (x1, y1, x2, y2, conf, cls)
    truth: list[tuple] | None  # (x1, y1, x2, y2, cls); none where the frame wasn't reviewed
    reset: bool  # T11: the state is cleared first
    exact_time: bool


def complete(rows: DataFrame) -> DataFrame:
    """The columns of a frame's row; optional ones are added: kind, reset, exact_time, reviewed."""
    given = set(rows.columns)
    defaults = {
        "kind": F.when(F.col("track_id").isNotNull(), TRACK), "reset": F.lit(False), "exact_time": F.lit(True),
        "reviewed": F.lit(False),
    }
    return rows.select(*[F.col(c) if c in given else defaults[c].alias(c) for c in COLUMNS])


def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[Frame]:
    """Frames of rows in ORDER; a frame may span batches.  Rows without a frame number are left out."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(_values(batch[c]) for c in COLUMNS), strict=True):
            if row[1] is None:
                continue
            if (row[0], row[1]) != key:
                if held:
                    yield _frame(held)
                key, held = (row[0], row[1]), []
            held.append(row)
    if held:
        yield _frame(held)


def _values(column: pa.Array) -> list:
    """to_pylist, by whole columns of numbers and once for each distinct text."""
    kind, n = column.type, len(column)
    if not n or column.null_count == n:
        return [None] * n
    if pa.types.is_string(kind):
        coded = column.dictionary_encode()
        texts = [*coded.dictionary.to_pylist(), None]
        return [texts[i] for i in coded.indices.fill_null(len(texts) - 1).to_numpy().tolist()]
    if not (pa.types.is_float64(kind) or pa.types.is_integer(kind) or pa.types.is_boolean(kind)):
        return column.to_pylist()
    values = column.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy(zero_copy_only=False).tolist()
    for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)) if column.null_count else ():
        values[i] = None
    return values


def _frame(rows: list[tuple]) -> Frame:
    stream, index, t, width, height = rows[0][:5]
    tracks = [(*r[5:9], r[9], r[10], r[11]) for r in rows if r[12] == TRACK]
    boxes = [(*r[5:9], r[10], r[11]) for r in rows if r[12] == BOX]
    truth = [(*r[5:9], r[11]) for r in rows if r[12] == TRUTH]
    reviewed = truth or any(r[15] for r in rows)
    return Frame(
        stream, index, t, (float(width or 0), float(height or 0)), tracks, boxes, truth if reviewed else None,
        any(r[13] for r in rows), all(r[14] is not False for r in rows),
    )


def replayed(rows: DataFrame, start: Callable[[], Any], on_frame: Callable[[Any, Frame], tuple[Any, list[dict]]], schema: str) -> DataFrame:
    """The rows that on_frame makes of a state and a frame, over whole streams; start makes a stream's first state.

    Streams are dealt over many partitions, whose number is given, since a few long streams that meet in one task would wait for each
    other, and partitions whose number isn't given are merged by their bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, stream, out = None, None, []
        first = True
        for frame in frames(batches):
            if first or frame.stream != stream:
                state, stream, first = start(), frame.stream, False
            state, made = on_frame(state, frame)
            out += made
            if len(out) >= 4096:
                yield batch_of(out, kinds)
                out = []
        if out:
            yield batch_of(out, kinds)

    kinds = arrow_schema(rows.sparkSession, schema)

    tasks = max(STREAM_TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = complete(rows).repartition(tasks, "stream_id").sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in ORDER])
    return ordered.mapInArrow(run, schema)


def arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def of_pandas(pdf: pd.DataFrame) -> Iterator[Frame]:
    """Frames of one stream's rows in a micro-batch."""
    pdf = pdf.copy()
    for name, value in (("kind", None), ("reset", False), ("exact_time", True), ("reviewed", False)):
        if name not in pdf:
            pdf[name] = value
    if pdf["kind"].isna().all():
        pdf["kind"] = pdf["track_id"].notna().map({True: TRACK, False: None})
    pdf = pdf.sort_values(ORDER, kind="stable", na_position="last")
    return frames(pa.Table.from_pandas(pdf[COLUMNS], preserve_index=False).to_batches())
