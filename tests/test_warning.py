import math
import os

import numpy as np
import pandas as pd
import pytest

from tidemark import schemas
from tidemark.operators import match, metrics, warning
from tidemark.operators.warning import Settings, step
from tidemark.streaming import alarms
from tidemark.streaming import warning as streaming


def row(x=100.0, side=14.0, track=1, conf=0.7, cls=0):
    return (x, 100.0, x + side, 100.0 + side, track, conf, cls)


def run(frames, settings=Settings(), fps=30, size=(640, 640)):
    state, out = warning.fresh(), []
    for i, rows in enumerate(frames):
        state, shown = step(state, rows, i / fps, size, settings)
        out.append(shown)
    return out


def test_glare_guard_blocks_the_fallback_only_when_on():
    still = [[row(conf=0.2)] for _ in range(7 * 30)]
    off = run(still)
    assert off[-1]["alarm"] and off[-1]["alert_reason"] == "five_second_persistence"
    on = run(still, Settings(glare_filter=True))
    assert not on[-1]["alarm"] and on[-1]["blocked"]


@pytest.mark.parametrize("conf,blocked", [(0.299, True), (0.30, False)])
def test_glare_boundary(conf, blocked):
    assert run([[row(conf=conf)] for _ in range(210)], Settings(glare_filter=True))[-1]["alarm"] is not blocked


def test_moving_boxes_are_no_glare():
    frames = [[row(conf=0.2, side=(14, 15)[i % 2])] for i in range(210)]
    assert run(frames, Settings(glare_filter=True))[-1]["alarm"]


def test_evidence_lost_then_closed():
    state = warning.fresh()
    for i in range(31):
        state, _ = step(state, [row()], i / 30, (640, 640), Settings())
    state, lost = step(state, [], 1.6, (640, 640), Settings())
    state, closed = step(state, [], 2.1, (640, 640), Settings())
    assert (lost["stage"], lost["disposition"]) == (4, "EVIDENCE_LOST_MONITORING")
    assert closed["stage"] == 1


def test_second_class_nearby_is_a_progression_and_scores():
    frames = [[row()] + ([row(x=110, track=2, cls=1)] if i >= 20 else []) for i in range(60)]
    assert run(frames)[-1]["stage"] == 3
    loud = run([[row(conf=0.9), row(x=110, track=2, conf=0.9, cls=1)] for _ in range(150)])
    assert loud[-1]["alert_reason"] == "hazard_score" and loud[-1]["hazard_score"] >= 65


def test_growth_is_a_progression():
    assert run([[row(side=14 if i < 40 else 20)] for i in range(110)])[-1]["stage"] == 3


@pytest.mark.parametrize("fps", [25, 30, 60])
def test_confirmation_scales_with_the_frame_rate(fps):
    shown = run([[row()] for _ in range(fps)], Settings(fps=fps), fps)
    assert 0.266 <= next(i for i, s in enumerate(shown) if s["confirmed_tracks"]) / fps <= 0.31


def test_intermittent_evidence_never_confirms():
    assert not any(s["confirmed_tracks"] for s in run([[row()] if i % 3 == 0 else [] for i in range(300)]))


@pytest.mark.parametrize(
    "rows", [[row(conf=math.nan)], [row(conf=1.1)], [row(cls=2)], [row(side=0)], [row(), row()], [row()[:6]]]
)
def test_bad_frames_are_refused_whole(rows):
    with pytest.raises(warning.FrameError):
        step(warning.fresh(), rows, 0.0, (640, 640), Settings())


def test_time_must_rise():
    state, _ = step(warning.fresh(), [], 1.0, (640, 640), Settings())
    for t in (1.0, 0.5, -1.0, math.nan):
        with pytest.raises(warning.FrameError):
            step(state, [], t, (640, 640), Settings())


def test_streaming_equals_replay(spark, tmp_path):
    rows = []
    for s in range(3):
        for i in range(210):
            seen = [None] * 7 if i % 50 == 49 else row(conf=0.3 + 0.1 * s)
            rows.append((f"s{s}", i, i / 30, 640, 640, *seen))
    rows.append(("s0", 210, 0.0, 640, 640, *row()))  # goes back in time
    table = spark.createDataFrame(rows, schemas.TRACKS)
    for low in (0, 70, 140):  # three files, three micro-batches
        part = table.where(f"frame_index >= {low} AND frame_index < {low + 70 + low // 140}").coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    source = streaming.read_tracks(spark, str(tmp_path / "in"), 1)
    streaming.drain(streaming.warn(source), str(tmp_path / "out"), str(tmp_path / "check"))
    order = ["stream_id", "frame_index"]
    flat = ["transitions", "confirmed_tracks"]
    got = spark.read.parquet(str(tmp_path / "out")).drop(*flat).orderBy(*order).toPandas()
    want = warning.replay(table).drop(*flat).orderBy(*order).toPandas()
    pd.testing.assert_frame_equal(got, want)
    assert got.error.notna().sum() == 1 and got.alarm.any()
    assert alarms.raised(spark.read.parquet(str(tmp_path / "out"))).count() == 3


def test_centroids():
    def shown(steps):
        state = warning.fresh_centroids()
        for t, seen in steps:
            state, out = warning.centroid_step(state, [[2, 2, 8, 8]] if seen else [], t, (10, 10))
        return out

    assert not shown([(0.0, 1), (1.0, 1)])["alarm"] and shown([(0.0, 1), (1.01, 1)])["alarm"]
    assert not shown([(0.0, 1), (0.9, 1), (0.95, 0), (1.0, 1), (1.5, 1)])["alarm"]
    gone = shown([(0.0, 1), (0.1, 0), (0.21, 0)])
    assert gone["removed"] == [1] and gone["n_tracks"] == 0
    kept = shown([(0.0, 1), (1.1, 1), (9.0, 0)])
    assert kept["alarm"] and kept["n_observed_confirmed"] == 0


CLIPS = "clip string, label boolean, ignition double, aftermath double"


def clip_rows(clip, n, conf, boxes=(), truth=(), extra=()):
    """n frames of one track; boxes and truth are (frame, conf) and frame numbers."""
    base = [(clip, i, i / 30, 640, 640, *row(conf=conf)[:4], 1, conf, 0, "track", True) for i in range(n)]
    base += [(clip, i, i / 30, 640, 640, *row()[:4], None, c, 0, "box", True) for i, c in boxes]
    return base + [(clip, i, i / 30, 640, 640, *row()[:4], None, 1.0, 0, "truth", True) for i in truth] + list(extra)


def evaluated(spark, rows, clips, **settings):
    kind = schemas.TRACKS + ", kind string, exact_time boolean"
    found = warning.evaluate(spark.createDataFrame(rows, kind).repartition(3), spark.createDataFrame(clips, CLIPS), **settings)
    return {(r.clip, r.variant): r for r in found.collect()}


def test_evaluation_of_clips(spark):
    hot = clip_rows("hot", 210, 0.7, [(i, 0.2 if i < 60 else 0.6) for i in range(20, 210)], [60, 61])
    quiet = clip_rows("quiet", 210, 0.2, [(10, 0.3), (20, 0.3), (51, 0.3)])
    late = clip_rows("late", 30, 0.7)
    bad = clip_rows("bad", 60, 0.7, extra=[("bad", 30, 1.0, 640, 640, *row()[:4], 2, 9.0, 0, "track", False)])
    clips = [("hot", True, 1.0, 3.0), ("quiet", False, -1.0, None), ("late", True, 5.0, None), ("bad", None, None, None)]
    got = evaluated(spark, hot + quiet + late + bad, clips)
    assert len(got) == 20
    for v in ("persistence", "full_off", "full_on"):
        r = got["hot", v]
        assert r.observable and r.detected and r.ttd_sec == pytest.approx(0) and r.preconfirmed and r.size_tag == "TINY"
        assert (r.reviewed_frames, r.box_tp, r.box_fp, r.box_fn) == (2, 2, 0, 0) and r.confirmations == 1
    assert got["hot", "raw_014"].ttd_sec == pytest.approx(0) and got["hot", "raw_025"].ttd_sec == pytest.approx(1.0)
    assert got["hot", "raw_025"].negative_frames == 30 and got["hot", "raw_014"].false_frames == 10
    assert got["hot", "raw_014"].incidents == 1  # frames 20 to 29 are one
    assert got["hot", "raw_025"].negative_sec == pytest.approx(1.0)
    assert got["quiet", "raw_025"].incidents == 2 and got["quiet", "raw_025"].detected is None
    assert got["quiet", "full_off"].incidents == 1 and got["quiet", "full_on"].incidents == 0
    assert got["quiet", "full_off"].false_frames == got["quiet", "full_on"].false_frames
    assert got["late", "full_off"].detected is None and got["late", "full_off"].reason == "onset_outside_observed_window"
    r = got["bad", "full_off"]
    assert r.refused_frames == 1 and r.frames == 60 and r.detected is None
    assert r.reason == "event_timestamp_missing;exact_timing_unavailable"
    assert got["bad", "raw_014"].refused_frames == 0
    assert got["hot", "full_off"].progression_delay_sec is None
    assert evaluated(spark, late, clips[2:3], partial=True)["late", "raw_014"].reason.startswith("partial_run")


def test_parts_of_the_machine():
    s = Settings()
    assert s.needed == 8 and warning.hazard(5, 2, True, 1.0) == 100 and warning.hazard(2.5, 1.0, False, 0.5) == 25
    assert warning.near((0, 0, 10, 10), (25, 0, 35, 10)) and not warning.near((0, 0, 10, 10), (25.1, 0, 35.1, 10))
    x = warning.Sighting(1, (0.0, 0.0, 10.0, 10.0), 0.5, 0, True)
    first = warning.sighted(None, x, 0.0, s)
    again = warning.sighted(dict(first, recent=list(first["recent"])), x._replace(conf=1.0), 0.2, s)
    assert again["ema"] == pytest.approx(0.5 + 0.5 * (1 - math.exp(-1))) and again["recent"] == [0.0, 0.2]
    assert warning.sighted(dict(again), x, 0.8, s)["since"] == 0.8  # a new life after the gap
    state = warning.fresh()
    assert warning.stage_of(state, [], 1.0, s) == (1, "MONITORING")
    assert warning.stage_of(state | {"seen": 0.7}, [], 1.0, s) == (2, "EVIDENCE_LOST_MONITORING")
    assert warning.stage_of(state | {"seen": 0.4}, [], 1.0, s) == (4, "EVIDENCE_LOST_MONITORING")
    assert warning.stage_of(state | {"alarm": {}}, [], 1.0, s)[0] == 1 and warning.stage_of(state | {"alarm": {"at": 0}}, [], 1.0, s)[0] == 4


def test_a_long_stream_passes_in_batches(spark):
    rows = [("s", i, i / 30, 640, 640, *row(conf=0.2)) for i in range(400)]
    table = spark.createDataFrame(rows, schemas.TRACKS)
    want = [r.stage for r in warning.replay(table).orderBy("frame_index").collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert [r.stage for r in warning.replay(table).orderBy("frame_index").collect()] == want and want[-1] == 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def boxes_of(rows):
    a = np.array(rows, float).reshape(-1, 6)
    return match.Boxes(a[:, :4], a[:, 5], a[:, 4], np.full(len(a), np.inf))


def test_matching_rules():
    one = boxes_of([(0, 0, 10, 10, 1, 0)])
    assert match.by_overlap(boxes_of([(0, 0, 10, 10, 0.9, 0)]), boxes_of([(0, 0, 10, 10, 1, 1)])) == (0, 1, 1)
    two = boxes_of([(0, 0, 10, 10, 0.5, 0), (1, 0, 11, 10, 0.9, 0)])
    assert match.by_confidence(two, one).tolist() == [-1, 0]
    assert match.by_overlap(two, one) == (1, 1, 0)
    half = boxes_of([(0, 0, 10, 10, 0.5, 0)])
    assert match.agree(two, two) and not match.agree(two, half) and not match.agree(half, two)
    assert match.nearest([(0, 0)], [(3, 4), (0, 1)], 5) == [(0, 1)]
    assert match.by_overlap(boxes_of([]), boxes_of([])) == (0, 0, 0)


def plain_by_confidence(p, t, least):
    out, used = [-1] * len(p), set()
    for i in sorted(range(len(p)), key=lambda i: (-p[i][4], i)):
        values = [(match.ious(np.array([p[i][:4]]), np.array([t[j][:4]]))[0, 0], -j) for j in range(len(t)) if j not in used]
        if values and max(values)[0] >= least:
            out[i] = -max(values)[1]
            used.add(out[i])
    return out


def test_stacks_of_images_against_plain(spark):
    """Images of many sizes, one of more boxes than are padded, go through the rules together."""
    rng = np.random.default_rng(3)

    def some(n):
        low = rng.integers(0, 12, (n, 2))
        return np.concatenate([low, low + rng.integers(5, 9, (n, 2)), rng.integers(1, 4, (n, 1)) / 4], axis=1).tolist()

    sizes = [(n, m) for n in range(6) for m in range(6)] + [(40, 33), (1, 20), (20, 1)]
    images = {i: (some(n), some(m)) for i, (n, m) in enumerate(sizes)}
    kind = "image long, ord int, x1 double, y1 double, x2 double, y2 double, conf double, cls int, side640 double"

    def rows(which):
        return spark.createDataFrame([(i, k, *map(float, b), 0, float(b[2] - b[0])) for i, x in images.items() for k, b in enumerate(x[which])], kind)

    got = sorted(map(tuple, match.scored_predictions(rows(0), rows(1), ["image"]).collect()))
    want = []
    for i, (p, t) in images.items():
        found = plain_by_confidence(p, t, 0.5)
        want += [(i, b[4], int(j >= 0), int(j >= 0 and t[j][2] - t[j][0] < 16), int(j >= 0)) for b, j in zip(p, found, strict=True)]
    assert got == sorted(want) and len({r[2] for r in got}) == 2
    counts = metrics.scored_detections(rows(0), rows(1), ["image"]).where("bin = 'all' AND iou = 0.5").agg({"tp": "sum", "n": "sum"}).first()
    assert (counts["sum(tp)"], counts["sum(n)"]) == (sum(r[2] for r in want), len(want))


def detections(spark, predictions):
    kind = "image string, ord int, x1 double, y1 double, x2 double, y2 double, cls int, conf double, side640 double"
    truth = [("a", i, 50.0 * i, 0.0, 50.0 * i + s, float(s), 0, 1.0, float(s)) for i, s in enumerate((8, 16, 32, 20, 100))]
    p, t = spark.createDataFrame(predictions(truth), kind), spark.createDataFrame(truth, kind)
    return {r.bin: r for r in metrics.average_precision(metrics.scored_detections(p, t, ["image"])).collect()}


def test_average_precision(spark):
    perfect = detections(spark, lambda t: t)
    assert {b: r.n_truth for b, r in perfect.items()} == {"all": 5, "tiny": 1, "small": 3, "16-32": 2, "medium": 1, "large": 1}
    assert all(r.ap == pytest.approx(1.0) and r.ar == 1.0 for r in perfect.values())
    assert all(r.ap == 0 for r in detections(spark, lambda t: []).values())
    false = detections(spark, lambda t: [*t, ("a", 9, 600.0, 600.0, 609.0, 609.0, 0, 2.0, 9.0)])
    assert false["tiny"].ap < 0.51 and false["large"].ap == pytest.approx(1.0)


def test_operating_point_without_any(spark):
    empty = spark.createDataFrame([], "conf double, tiny long, small long, fp long")
    sizes = spark.createDataFrame([(1, 1)], "images long, n_tiny long")
    assert tuple(metrics.operating_points(empty, sizes).first()) == (1.000001, 0, 0, 0, None)


def test_tracks_hold_every_shown_order_line(spark):
    from pyspark.sql import functions as F

    from tidemark.plans import tables

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    shown = lines.where("l_quantity > 2 and floor(l_orderkey / 20) % 300 > 20")
    got = tables.tracks(spark, sf)
    assert got.where("track_id is not null").count() == shown.count()
    assert got.agg(F.max("track_id")).first()[0] > 2
    assert got.groupBy("stream_id", "frame_index", "track_id").count().where("count > 1").count() == 0
