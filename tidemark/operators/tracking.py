"""T4, T5: class-separated tracking of detections, and the pipeline from detections to warnings.

A track's box moves with constant velocity: centre, aspect and height are four independent Kalman filters of place and speed.  In
each frame the sure detections go to tracks first, by the assignment with the greatest overlap in sum; tracks that are left take
unsure detections; a new track needs a second sighting before it is shown.  A track unseen for `buffer` frames
ends.  Each class has trackers of its own, so a track never changes class; ids count through both classes in order of appearance.

The state is JSON-like and a frame's step a plain function, so that batch replay (frames.replayed) and streams run the same code.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tidemark import schemas
from tidemark.operators import frames, warning
from tidemark.operators.match import ious

#: Spreads of place and speed in parts of the height, and of the aspect.
PLACE, SPEED, ASPECT_PLACE, ASPECT_SPEED, ASPECT_SEEN = 1 / 20, 1 / 160, 1e-2, 1e-5, 1e-1
TRACKED = "stream_id string, frame_index bigint, ts_sec double, x1 double, y1 double, x2 double, y2 double, track_id int, conf double, cls int, error string"
TIMED = f"{schemas.ALARMS}, tracks array<struct<x1:double,y1:double,x2:double,y2:double,track_id:int,conf:double,cls:int>>, tracking_ms double, warning_ms double"


@dataclass(frozen=True)
class Settings:
    """Confidences, and overlap distances (1 - IoU) below which boxes may meet."""

    high: float = 0.14
    low: float = 0.10
    new: float = 0.14
    buffer: int = 30
    meet: float = 0.8
    meet_unsure: float = 0.5
    meet_first: float = 0.7
    same: float = 0.15


def measured(boxes: np.ndarray) -> np.ndarray:
    """(centre x, centre y, aspect, height) of corner boxes."""
    w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    return np.stack([boxes[:, 0] + w / 2, boxes[:, 1] + h / 2, w / h, h], axis=1)


def corners(values: np.ndarray) -> np.ndarray:
    x, y, a, h = values.T
    return np.stack([x - a * h / 2, y - h / 2, x + a * h / 2, y + h / 2], axis=1)


class Filter:
    """n tracks: place, speed and their covariance in arrays (n, 4) each; the four numbers of a box are independent."""

    @staticmethod
    def spreads(h: np.ndarray, of_height: float, of_aspect: float) -> np.ndarray:
        out = np.repeat(np.abs(h)[:, None] * of_height, 4, axis=1)
        out[:, 2] = of_aspect
        return out**2

    @staticmethod
    def start(boxes: np.ndarray) -> np.ndarray:
        """(n, 5, 4): place, speed, variance of place, covariance, variance of speed."""
        z = measured(boxes)
        h = z[:, 3]
        nought = np.zeros_like(z)
        return np.stack([z, nought, Filter.spreads(h, 2 * PLACE, ASPECT_PLACE), nought, Filter.spreads(h, 10 * SPEED, ASPECT_SPEED)], axis=1)

    @staticmethod
    def ahead(s: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """One frame on; a track that wasn't seen keeps its height."""
        place, speed, pp, ps, ss = (s[:, i].copy() for i in range(5))
        speed[~seen, 3] = 0
        h = place[:, 3]
        pp += 2 * ps + ss + Filter.spreads(h, PLACE, ASPECT_PLACE)
        ps += ss
        return np.stack([place + speed, speed, pp, ps, ss + Filter.spreads(h, SPEED, ASPECT_SPEED)], axis=1)

    @staticmethod
    def seen(s: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        place, speed, pp, ps, ss = (s[:, i] for i in range(5))
        total = pp + Filter.spreads(place[:, 3], PLACE, ASPECT_SEEN)
        off, to_place, to_speed = measured(boxes) - place, pp / total, ps / total
        return np.stack([place + to_place * off, speed + to_speed * off, pp - to_place * pp, ps - to_place * ps, ss - to_speed * ps], axis=1)


def assign(distance: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Pairs (row, column) below `most` that make the sum of (most - distance) greatest.

    Rows and columns that have no choice are paired at once; the others go by shortest augmenting paths.
    """
    gain = np.where(distance < most, most - distance, 0.0)
    if not gain.size or not gain.any():
        return []
    if ((gain > 0).sum(axis=0) <= 1).all() and ((gain > 0).sum(axis=1) <= 1).all():
        return [(int(i), int(j)) for i, j in zip(*np.nonzero(gain), strict=True)]
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain)
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # row of each column; the last column is where a row begins
    for i in range(n):
        owner[m], column = i, m
        shortest, came, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, dtype=bool)
        while owner[column] >= 0:
            done[column] = True
            row = owner[column]
            reach = cost[row] - row_price[row] - column_price[:m]
            nearer = ~done[:m] & (reach < shortest)
            shortest[nearer], came[nearer] = reach[nearer], column
            open_ = np.flatnonzero(~done[:m])
            step = shortest[open_].min()
            following = int(open_[shortest[open_].argmin()])
            taken = np.flatnonzero(done)
            row_price[owner[taken]] += step
            column_price[taken] -= step
            shortest[open_] -= step
            column = following
        while column != m:
            owner[column] = owner[came[column]]
            column = int(came[column])
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((j, i) if turned else (i, j) for i, j in pairs if cost[i, j] < 0)


def fresh_class() -> dict:
    return {"frame": 0, "next": 1, "tracks": []}


def _track(number: int, filter_: np.ndarray, conf: float, frame: int, shown: bool) -> dict:
    return {"id": number, "filter": filter_.tolist(), "conf": conf, "since": frame, "at": frame, "shown": shown, "lost": False}


# A track's numbers one by one, as Filter has them in arrays: most frames hold a few boxes, for which an array costs more than its sums.

SMALL = 64  # pairs of boxes


def _square(v: float) -> float:
    return v * v


def _moved(f: list, seen: bool) -> list:
    """Filter.ahead of one track."""
    place, speed, pp, ps, ss = f
    if not seen:
        speed = [*speed[:3], 0.0]
    h = abs(place[3])
    by_place, by_speed = [_square(h * PLACE)] * 4, [_square(h * SPEED)] * 4
    by_place[2], by_speed[2] = _square(ASPECT_PLACE), _square(ASPECT_SPEED)
    four = range(4)
    return [
        [place[i] + speed[i] for i in four], speed, [pp[i] + (2 * ps[i] + ss[i] + by_place[i]) for i in four],
        [ps[i] + ss[i] for i in four], [ss[i] + by_speed[i] for i in four],
    ]


def _met(f: list, box: list) -> list:
    """Filter.seen of one track."""
    place, speed, pp, ps, ss = f
    w, h = box[2] - box[0], box[3] - box[1]
    z = (box[0] + w / 2, box[1] + h / 2, w / h, h)
    spread = [_square(abs(place[3]) * PLACE)] * 4
    spread[2] = _square(ASPECT_SEEN)
    out: list = [[], [], [], [], []]
    for i in range(4):
        total = pp[i] + spread[i]
        off, to_place, to_speed = z[i] - place[i], pp[i] / total, ps[i] / total
        values = place[i] + to_place * off, speed[i] + to_speed * off, pp[i] - to_place * pp[i], ps[i] - to_place * ps[i], ss[i] - to_speed * ps[i]
        for part, v in zip(out, values, strict=True):
            part.append(v)
    return out


def _corners(place: list) -> tuple:
    x, y, a, h = place
    return x - a * h / 2, y - h / 2, x + a * h / 2, y + h / 2


def _distances(a: list, b: list) -> list[list[float]]:
    """1 - IoU of two lists of corner boxes."""
    if len(a) * len(b) > SMALL:
        return (1 - ious(np.array(a), np.array(b))).tolist()
    areas = [max(q[2] - q[0], 0.0) * max(q[3] - q[1], 0.0) for q in b]
    out = []
    for p in a:
        own = max(p[2] - p[0], 0.0) * max(p[3] - p[1], 0.0)
        row = []
        for q, area in zip(b, areas, strict=True):
            both = max(min(p[2], q[2]) - max(p[0], q[0]), 0.0) * max(min(p[3], q[3]) - max(p[1], q[1]), 0.0)
            union = own + area - both
            row.append(1 - (both / union if union > 0 else 0.0))
        out.append(row)
    return out


def _pairs(distances: list[list[float]], most: float) -> list[tuple[int, int]]:
    """assign, without it where no row or column has a choice."""
    near = [(i, j) for i, row in enumerate(distances) for j, d in enumerate(row) if d < most]
    if len({i for i, _ in near}) == len(near) == len({j for _, j in near}):
        return near
    return assign(np.array(distances), most)


def follow(state: dict, boxes: list, conf: list, s: Settings) -> list[tuple[tuple, int, float]]:
    """One frame of one class: (box, id, confidence) of the tracks that it shows."""
    state["frame"] += 1
    now, tracks = state["frame"], state["tracks"]
    for t in tracks:
        if t["shown"]:  # a first sighting has no speed yet
            t["filter"] = _moved(t["filter"], not t["lost"])
    sure = [k for k, c in enumerate(conf) if c >= s.high]
    unsure = [k for k, c in enumerate(conf) if s.low <= c < s.high]

    def meet(some: list[dict], found: list[int], most: float) -> tuple[list[dict], list[int]]:
        """Sees what it can; the tracks and detections that are left."""
        if not some or not found:
            return some, found
        pairs = _pairs(_distances([_corners(t["filter"][0]) for t in some], [boxes[k] for k in found]), most)
        for i, j in pairs:
            t, k = some[i], found[j]
            t["filter"] = _met(t["filter"], boxes[k])
            t |= {"conf": float(conf[k]), "at": now, "shown": True, "lost": False}
        rows, columns = {i for i, _ in pairs}, {j for _, j in pairs}
        return [t for i, t in enumerate(some) if i not in rows], [k for j, k in enumerate(found) if j not in columns]

    shown, first = [t for t in tracks if t["shown"]], [t for t in tracks if not t["shown"]]
    left, sure = meet(shown, sure, s.meet)
    left, _ = meet([t for t in left if not t["lost"]], unsure, s.meet_unsure)
    gone, sure = meet(first, sure, s.meet_first)
    for t in shown:
        t["lost"] = t["at"] < now
    ended = {id(t) for t in gone} | {id(t) for t in shown if now - t["at"] > s.buffer}
    tracks = [t for t in tracks if id(t) not in ended]
    for k in sure:
        if conf[k] >= s.new:
            tracks.append(_track(state["next"], Filter.start(np.array([boxes[k]]))[0], float(conf[k]), now, now == 1))
            state["next"] += 1
    state["tracks"] = tracks = _distinct(tracks, s.same)
    return [(_corners(t["filter"][0]), t["id"], t["conf"]) for t in tracks if t["shown"] and not t["lost"]]


def _distinct(tracks: list[dict], same: float) -> list[dict]:
    """Without the shorter-lived of a seen and a lost track that lie on each other."""
    seen, lost = [t for t in tracks if t["shown"] and not t["lost"]], [t for t in tracks if t["lost"]]
    if not seen or not lost:
        return tracks
    distances = _distances(*([_corners(t["filter"][0]) for t in some] for some in (seen, lost)))
    drop = set()
    for i, row in enumerate(distances):
        for j, d in enumerate(row):
            if d < same:
                lives = [t["at"] - t["since"] for t in (seen[i], lost[j])]
                drop.add(id(lost[j] if lives[0] > lives[1] else seen[i]))
    return [t for t in tracks if id(t) not in drop]


def fresh() -> dict:
    return {"classes": [fresh_class(), fresh_class()], "ids": {}, "clock": None}


def track(state: dict, rows: list[tuple], size: tuple[float, float], s: Settings = Settings(), floors: warning.Settings = warning.Settings()) -> list[tuple]:
    """T4 for one frame: (x1, y1, x2, y2, track, conf, cls) of detections (x1, y1, x2, y2, conf, cls).

    Boxes below the floors of their size (F3) are left out; a bad box raises FrameError.
    """
    for row in rows:
        if any(v is None or not math.isfinite(v) for v in row) or not (row[0] < row[2] and row[1] < row[3] and row[5] in (0, 1)):
            raise warning.FrameError("box")
    kept = [r for r in rows if r[4] >= (floors.floor_small if warning.scaled_side(r[:4], size) <= 32 else floors.floor_other)]
    out = []
    for cls, own in enumerate(state["classes"]):
        data = [tuple(map(float, r)) for r in kept if r[5] == cls]
        for box, number, conf in follow(own, [r[:4] for r in data], [r[4] for r in data], s):
            key = f"{cls}/{number}"
            shown = state["ids"].setdefault(key, len(state["ids"]) + 1)
            out.append((*map(float, box), shown, conf, cls))
    return out


def _in_time(state: dict, frame: frames.Frame) -> None:
    if frame.t is None or not math.isfinite(frame.t) or state["clock"] is not None and frame.t <= state["clock"]:
        raise warning.FrameError("time goes back" if state["clock"] is not None else "time")


def tracked(state: dict, frame: frames.Frame, s: Settings = Settings()) -> tuple[dict, list[dict]]:
    """T4's rows of a frame; a refused frame gives one row with an error and leaves the state."""
    head = {"stream_id": frame.stream, "frame_index": frame.index, "ts_sec": frame.t}
    state = fresh() if frame.reset else state
    try:
        _in_time(state, frame)
        found = track(state, sorted(frame.boxes), frame.size, s)
    except warning.FrameError as refused:
        return state, [head | {"error": str(refused)}]
    state["clock"] = frame.t
    return state, [head | dict(zip(("x1", "y1", "x2", "y2", "track_id", "conf", "cls"), r, strict=True)) for r in found]


def fresh_pipeline() -> dict:
    return {"tracks": fresh(), "warning": warning.fresh()}


def piped(state: dict, frame: frames.Frame, s: Settings = Settings(), w: warning.Settings = warning.Settings()) -> tuple[dict, list[dict]]:
    """T5: detections are tracked and the tracks go to the warning machine; with the milliseconds that each took."""
    state = fresh_pipeline() if frame.reset else state
    began = time.perf_counter()
    try:
        _in_time(state["tracks"], frame)
        found = track(state["tracks"], sorted(frame.boxes), frame.size, s)
    except warning.FrameError as refused:
        row = {"stream_id": frame.stream, "frame_index": frame.index, "ts_sec": frame.t, "transitions": [], "confirmed_tracks": []}
        return state, [row | {"error": str(refused), "tracks": []}]
    state["tracks"]["clock"] = frame.t
    middle = time.perf_counter()
    state["warning"], rows = warning.warned(state["warning"], frame._replace(tracks=found, reset=False), w)
    took = {"tracking_ms": (middle - began) * 1e3, "warning_ms": (time.perf_counter() - middle) * 1e3}
    names = ("x1", "y1", "x2", "y2", "track_id", "conf", "cls")
    return state, [r | took | {"tracks": [dict(zip(names, t, strict=True)) for t in found]} for r in rows]


def tracks(boxes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """T4 over recorded streams; rows of kind 'box'."""
    return frames.replayed(boxes, fresh, lambda state, frame: tracked(state, frame, s), TRACKED)


def pipeline(boxes: DataFrame, s: Settings = Settings(), w: warning.Settings = warning.Settings()) -> DataFrame:
    """T5 over recorded streams: one row a frame."""
    return frames.replayed(boxes, fresh_pipeline, lambda state, frame: piped(state, frame, s, w), TIMED)
