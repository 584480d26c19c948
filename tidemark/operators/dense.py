"""Keyframes with a dense window that reaches back over frames which were not selected.

A detector sees every stride-th frame and those around a known ignition.  Once it finds a candidate, all frames of the next seconds are
keyframes, including those that went by unselected while the detector's batch filled up.

Batch: window functions over a finished table.  Stream: a machine (streaming/ordered.py) that holds the frames of the open batch, at most
stride x batch of them, and gives its rows when `batch` frames are selected or the stream falls silent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.streaming.ordered import Machine

OUT = "frame_index long, ts_sec double, dense boolean, cadence double, batch long, call int"
COLUMNS = ["frame_index", "ts_sec", "is_candidate", "ignition"]


@dataclass(frozen=True)
class Settings:
    stride: int = 5
    around: float = 3.0
    before: float = 1.0
    batch: int = 8
    fps: float = 30.0

    def __post_init__(self):
        if not 0 < self.batch <= 16:
            raise ValueError("a detector's batch holds 1 to 16 frames")


def keyframes(frames: DataFrame, by: list[str], s: Settings = Settings()) -> DataFrame:
    """by, frame_index, ts_sec, dense, cadence.  frames: by, frame_index, ts_sec, is_candidate, ignition (-1 or null: none).

    The first candidate is the first one that the detector sees.  A frame without a time, or at the time of the frame before
    it, is left out.
    """
    order = Window.partitionBy(*by).orderBy("ts_sec", "frame_index")
    t, i = F.col("ts_sec"), F.col("ignition")
    kept = frames.where(t.isNotNull()).withColumn("_last", F.lag("ts_sec").over(order)).where("_last IS NULL OR _last < ts_sec")
    lit = F.coalesce((i >= 0) & t.between(i - s.before, i + s.around), F.lit(False))
    seen = (F.col("frame_index") % s.stride == 0) | lit
    first = F.min(F.when(seen & F.col("is_candidate"), t)).over(Window.partitionBy(*by))
    dense = F.coalesce(t.between(first, first + s.around), F.lit(False)) | lit
    marked = kept.withColumn("_seen", seen).withColumn("dense", dense).where("_seen OR dense")
    cadence = F.when(F.col("dense"), s.fps).otherwise(s.fps / s.stride)
    return marked.select(*by, "frame_index", "ts_sec", "dense", cadence.alias("cadence"))


def machine(s: Settings = Settings()) -> Machine:
    """The same over a stream; batch: number of the batch, call: of the detector's call in it, 16 frames or fewer each."""

    def fresh() -> dict:
        return {"first": None, "last": None, "batch": 0, "held": []}

    def lit(row: dict) -> bool:
        i = row["ignition"]
        return i is not None and i >= 0 and i - s.before <= row["ts_sec"] <= i + s.around

    def around(state: dict, t: float) -> bool:
        return state["first"] is not None and state["first"] <= t <= state["first"] + s.around

    def step(state: dict, row: dict) -> list[dict]:
        t = row["ts_sec"]
        if state["last"] is not None and t <= state["last"]:
            return []
        state["last"] = t
        selected = row["frame_index"] % s.stride == 0 or lit(row) or around(state, t)
        state["held"].append([row["frame_index"], t, bool(row["is_candidate"]), lit(row), selected])
        return flush(state) if sum(h[4] for h in state["held"]) >= s.batch else []

    def flush(state: dict) -> list[dict]:
        held, state["held"] = state["held"], []
        if state["first"] is None:
            state["first"] = next((t for _, t, found, _, selected in held if selected and found), None)
        taken = [(h, 0) for h in held if h[4]]
        extra = [h for h in held if not h[4] and around(state, h[1])]
        taken += [(h, 1 + k // s.batch) for k, h in enumerate(extra)]
        out = []
        for (index, t, _, near, _), call in sorted(taken):
            dense = near or around(state, t)
            cadence = s.fps if dense else s.fps / s.stride
            out.append({"frame_index": index, "ts_sec": t, "dense": dense, "cadence": cadence, "batch": state["batch"], "call": call})
        state["batch"] += bool(out)
        return out

    return Machine(fresh, step, flush, OUT, int(s.around * 1000))
