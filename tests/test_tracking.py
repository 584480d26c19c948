"""T4, T5: assignment against all pairings; tracking against a plain version, box by box."""

import itertools
import math
import random

import numpy as np
import pytest

from tidemark.operators import frames, tracking, warning


def plain_assign(distance, most):
    """The greatest sum of (most - distance) over all pairings."""
    n, m = distance.shape
    best = 0.0
    for k in range(1, min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for columns in itertools.permutations(range(m), k):
                gains = [most - distance[i, j] for i, j in zip(rows, columns, strict=True)]
                if min(gains) > 0:
                    best = max(best, sum(gains))
    return best


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (3, 2), (4, 4), (5, 3), (0, 2), (2, 0)])
def test_assignment_against_all_pairings(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(40):
        distance = rng.random(shape)
        pairs = tracking.assign(distance, 0.8)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert all(distance[i, j] < 0.8 for i, j in pairs)
        assert sum(0.8 - distance[i, j] for i, j in pairs) == pytest.approx(plain_assign(distance, 0.8))


class PlainTrack:
    """One box as four pairs (place, speed) with 2 x 2 covariances in matrix form."""

    def __init__(self, box, conf, frame, number):
        z = self.measure(box)
        h = z[3]
        self.x = [np.array([v, 0.0]) for v in z]
        self.p = [np.diag([(0.01 if i == 2 else h / 10) ** 2, (1e-5 if i == 2 else h / 16) ** 2]) for i in range(4)]
        self.conf, self.since, self.at, self.number, self.shown, self.lost = conf, frame, frame, number, frame == 1, False

    @staticmethod
    def measure(b):
        w, h = b[2] - b[0], b[3] - b[1]
        return [b[0] + w / 2, b[1] + h / 2, w / h, h]

    def ahead(self):
        if self.lost:
            self.x[3][1] = 0
        h, f = self.x[3][0], np.array([[1.0, 1.0], [0.0, 1.0]])
        for i in range(4):
            q = np.diag([(0.01 if i == 2 else h / 20) ** 2, (1e-5 if i == 2 else h / 160) ** 2])
            self.x[i], self.p[i] = f @ self.x[i], f @ self.p[i] @ f.T + q

    def meet(self, box, conf, frame):
        z, h = self.measure(box), self.x[3][0]
        for i in range(4):
            total = self.p[i][0, 0] + (0.1 if i == 2 else h / 20) ** 2
            gain = self.p[i][:, 0] / total
            self.x[i], self.p[i] = self.x[i] + gain * (z[i] - self.x[i][0]), self.p[i] - np.outer(gain, gain) * total
        self.conf, self.at, self.shown, self.lost = conf, frame, True, False

    def box(self):
        x, y, a, h = (v[0] for v in self.x)
        return [x - a * h / 2, y - h / 2, x + a * h / 2, y + h / 2]


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def plain_meet(some, found, most, frame):
    """Every pairing is tried; for the few boxes of a test."""
    best, chosen = 0.0, []
    for k in range(1, min(len(some), len(found)) + 1):
        for rows in itertools.combinations(range(len(some)), k):
            for columns in itertools.permutations(range(len(found)), k):
                gains = [most - 1 + iou(some[i].box(), found[j][0]) for i, j in zip(rows, columns, strict=True)]
                if min(gains) > 0 and sum(gains) > best + 1e-12:
                    best, chosen = sum(gains), list(zip(rows, columns, strict=True))
    for i, j in chosen:
        some[i].meet(*found[j], frame)
    used_i, used_j = {i for i, _ in chosen}, {j for _, j in chosen}
    return [t for i, t in enumerate(some) if i not in used_i], [d for j, d in enumerate(found) if j not in used_j]


def plain(stream, s):
    tracks, number, out = [], 0, []
    for frame, found in enumerate(stream, 1):
        for t in tracks:
            if t.shown:
                t.ahead()
        sure, unsure = [d for d in found if d[1] >= s.high], [d for d in found if s.low <= d[1] < s.high]
        left, sure = plain_meet([t for t in tracks if t.shown], sure, s.meet, frame)
        plain_meet([t for t in left if not t.lost], unsure, s.meet_unsure, frame)
        gone, sure = plain_meet([t for t in tracks if not t.shown], sure, s.meet_first, frame)
        for t in tracks:
            t.lost = t.shown and t.at < frame
        tracks = [t for t in tracks if t not in gone and not (t.shown and frame - t.at > s.buffer)]
        for box, conf in sure:
            if conf >= s.new:
                number += 1
                tracks.append(PlainTrack(box, conf, frame, number))
        for a in [t for t in tracks if t.shown and not t.lost]:
            for b in [t for t in tracks if t.lost]:
                if 1 - iou(a.box(), b.box()) < s.same and a in tracks and b in tracks:
                    tracks.remove(b if a.at - a.since > b.at - b.since else a)
        out.append([(t.number, t.conf, t.box()) for t in tracks if t.shown and not t.lost])
    return out


def crossing(seed):
    """Up to four boxes that cross, vanish for some frames, and fade below the sure confidence."""
    rng = random.Random(seed)
    paths = [(rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(-6, 6), rng.uniform(-6, 6), rng.uniform(20, 60)) for _ in range(4)]
    away = [(rng.randint(5, 40), rng.randint(1, 20)) for _ in paths]
    out = []
    for i in range(80):
        found = []
        for (x, y, dx, dy, side), (low, n) in zip(paths, away, strict=True):
            if low <= i < low + n or rng.random() < 0.05:
                continue
            a, b = x + dx * i + rng.gauss(0, 1), y + dy * i + rng.gauss(0, 1)
            found.append(([a, b, a + side, b + side * 1.3], rng.choice([0.9, 0.5, 0.12, 0.3])))
        out.append(found)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_tracks_against_a_plain_version(seed):
    stream, s = crossing(seed), tracking.Settings(buffer=12)
    state, got = tracking.fresh_class(), []
    for found in stream:
        boxes, conf = np.array([b for b, _ in found]).reshape(-1, 4), np.array([c for _, c in found])
        got.append([(n, c, box) for box, n, c in tracking.follow(state, boxes, conf, s)])
    for mine, other in zip(got, plain(stream, s), strict=True):
        assert [(n, c) for n, c, _ in mine] == [(n, c) for n, c, _ in other]
        for (_, _, a), (_, _, b) in zip(mine, other, strict=True):
            assert np.allclose(a, b)


def boxes_of(spark, n=60):
    rows = []
    for s in range(3):
        for i in range(n):
            for cls, x in ((0, 100.0 + 2 * i), (1, 220.0 - 2 * i)):  # the two classes cross
                rows.append((f"c{s}", i, i / 30, 640, 640, x, 100.0, x + 40, 150.0, None, 0.6, cls, "box"))
        rows.append((f"c{s}", n, 0.5, 640, 640, 1.0, 1.0, 9.0, 9.0, None, 0.6, 0, "box"))  # goes back in time
        rows.append((f"c{s}", n + 1, 99.0, 640, 640, 9.0, 1.0, 9.0, 9.0, None, 0.6, 0, "box"))  # no width
    return spark.createDataFrame(rows, ", ".join([*_kinds(), "kind string"]))


def _kinds():
    from tidemark import schemas

    return schemas.TRACKS.split(", ")


def test_ids_never_change_class(spark):
    got = tracking.tracks(boxes_of(spark)).toPandas()
    shown = got[got.error.isna()]
    assert (shown.groupby(["stream_id", "track_id"]).cls.nunique() == 1).all()
    assert sorted(shown.track_id.unique()) == [1, 2] and len(shown) == 3 * 60 * 2
    assert sorted(got.error.dropna().unique()) == ["box", "time goes back"]


def test_pipeline_equals_tracking_then_warning(spark):
    boxes = boxes_of(spark)
    got = tracking.pipeline(boxes).toPandas().sort_values(["stream_id", "frame_index"])
    tracks = tracking.tracks(boxes).where("error IS NULL").drop("error")
    sized = tracks.selectExpr("*", "640 AS image_w", "640 AS image_h")
    want = warning.replay(sized).toPandas().sort_values(["stream_id", "frame_index"])
    fine = got[got.error.isna()]
    for column in ("stream_id", "frame_index", "stage", "alarm", "alert_reason", "hazard_score"):
        assert fine[column].tolist() == want[column].tolist()
    assert (fine.tracking_ms > 0).all() and (fine.warning_ms > 0).all() and got.error.notna().sum() == 6


def test_refused_frames_leave_the_state():
    state = tracking.fresh()
    frame = frames.Frame("a", 0, 0.0, (640.0, 640.0), [], [(1.0, 1.0, 50.0, 50.0, 0.9, 0)], None, False, True)
    state, _ = tracking.tracked(state, frame)
    before = str(state)
    for bad in (frame._replace(t=0.0), frame._replace(t=None), frame._replace(t=1.0, boxes=[(1.0, 1.0, math.nan, 5.0, 0.9, 0)])):
        state, rows = tracking.tracked(state, bad)
        assert rows[0]["error"] and str(state) == before


def test_few_long_streams_do_not_meet_in_a_task(spark):
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(
        F.concat(F.lit("s"), F.col("id") % 20).alias("stream_id"), F.floor(F.col("id") / 20).alias("frame_index"), F.col("id").cast("double").alias("ts_sec"),
        *[F.lit(640).alias(c) for c in ("image_w", "image_h")], *[F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "conf")],
        *[F.lit(None).cast("int").alias(c) for c in ("track_id", "cls")],
    )

    def count(state, frame):
        return state + 1, [{"stream_id": frame.stream, "n": state}]

    found = frames.replayed(rows, lambda: 0, count, "stream_id string, n long")
    tasks = found.select("stream_id", F.spark_partition_id().alias("task")).distinct().groupBy("task").count()
    assert found.count() == 4000 and tasks.count() >= 18


def test_values_of_columns():
    import pyarrow as pa

    for kind, values in ((pa.string(), ["a", None, "b", "a"]), (pa.int32(), [1, None, 3]), (pa.float64(), [0.5, None, float("inf")]), (pa.bool_(), [True, None, False])):
        column = pa.array(values, kind)
        for part in (column, column[1:], column[:1], column[:0], pa.nulls(2, kind)):
            got = frames._values(part)
            assert got == part.to_pylist() and [type(v) for v in got] == [type(v) for v in part.to_pylist()]


def test_one_track_moves_as_arrays_do():
    rng = np.random.default_rng(4)
    for _ in range(200):
        low = rng.uniform(0, 300, (2, 2))
        boxes = np.concatenate([low, low + rng.uniform(5, 60, (2, 2))], axis=1)
        one = tracking.Filter.start(boxes[:1])
        for seen in (True, False, True):
            moved = tracking._moved(one[0].tolist(), seen)
            one = tracking.Filter.ahead(one, np.array([seen]))
            assert moved == one[0].tolist() and list(tracking._corners(moved[0])) == tracking.corners(one[:, 0])[0].tolist()
            met = tracking._met(moved, boxes[1].tolist())
            one = tracking.Filter.seen(one, boxes[1:])
            assert met == one[0].tolist()
        want = 1 - tracking.ious(boxes, boxes[::-1])
        assert tracking._distances(boxes.tolist(), boxes[::-1].tolist()) == want.tolist()
        assert sorted(tracking._pairs(want.tolist(), 0.9)) == tracking.assign(want, 0.9)
