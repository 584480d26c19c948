"""Running sums, suffix maxima, quantiles and smoothing by pieces, against plain versions."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import metrics, prefix, segment


def levels():
    rng = random.Random(3)
    out = [("a", round(rng.random(), 4), rng.randint(0, 5), rng.randint(1, 9)) for _ in range(1500)]
    out += [(None, float(i), i % 3, 1) for i in range(40)] + [("b", 0.5, 7, 7)]
    return list({(g, c): (g, c, x, y) for g, c, x, y in out}.values())


@pytest.mark.parametrize("range_rows", [1 << 20, 60])
def test_running_sums_and_best_below(spark, range_rows):
    df = spark.createDataFrame(levels(), "g string, c double, x long, y long").repartition(3)
    cuts = prefix.cut(df, ["g"], "c", range_rows)
    got = prefix.best_below(prefix.running(cuts, ["g"], "c", ["x", "y"]), ["g"], "c", "x", "best")
    want = []
    for g in ("a", "b", None):
        rows, x, y = sorted((r for r in levels() if r[0] == g), key=lambda r: -r[1]), 0, 0
        sums = [(x := x + r[2], y := y + r[3]) for r in rows]
        want += [(g, r[1], *s, max(t[0] for t in sums[i:])) for i, (r, s) in enumerate(zip(rows, sums, strict=True))]
    assert sorted(map(tuple, got.select("g", "c", "x", "y", "best").collect()), key=str) == sorted(want, key=str)


def test_no_frame_begins_anew_at_every_row(spark):
    """A frame up to the end is summed anew for each row: quadratic in the rows of a range."""
    df = spark.createDataFrame(levels(), "g string, c double, x long, y long")
    found = prefix.best_below(prefix.cut(df, ["g"], "c", 60), ["g"], "c", "x", "best")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_ranges_of_one_group_are_bounded(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), (F.col("id") / 7).alias("c"))
    sizes = [r["count"] for r in prefix.cut(df, ["g"], "c", 1000).groupBy("_range").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 3000


def test_one_curve_is_the_same_in_pieces(spark):
    rng = random.Random(1)
    rows = [(k % 2, "all", iou, round(rng.random(), 3), int(rng.random() < 0.6), 1, 0) for k in range(400) for iou in metrics.THRESHOLDS]
    rows += [(c, "all", None, None, 0, 0, 170) for c in (0, 1, 2)]
    df = spark.createDataFrame(rows, "cls int, bin string, iou double, conf double, tp long, n long, n_truth long")
    whole, pieces = (sorted(map(tuple, metrics.average_precision(df, n).collect())) for n in (1 << 20, 50))
    assert np.allclose(np.array([r[2:] for r in whole], float), np.array([r[2:] for r in pieces], float))
    assert whole[2][2:] == (170, 0.0, 0.0, 0.0, 0.0)


def plain_precision(rows, n_truth):
    """(ap, recall) by threshold of (conf, hits, counted, n)."""
    out = []
    for k in range(len(metrics.THRESHOLDS)):
        tp, n, curve = 0, 0, []
        for conf in sorted({r[0] for r in rows if r[2] >> k & 1}, reverse=True):
            level = [r for r in rows if r[0] == conf and r[2] >> k & 1]
            tp, n = tp + sum(r[3] for r in level if r[1] >> k & 1), n + sum(r[3] for r in level)
            curve.append((tp / n_truth, tp / n))
        points = [max((p for r, p in curve if math.floor(r * 100 + 1e-9) >= x), default=0) for x in range(101)]
        out.append((sum(points) / 101, curve[-1][0] if curve else 0))
    return out


@pytest.mark.parametrize("range_rows", [1 << 20, 300, 20])
def test_precision_of_detections_against_a_plain_version(spark, range_rows):
    rng = random.Random(11)

    def some(count, conf):
        marks = [(rng.randrange(1024), rng.choice([1023, 1008, 31])) for _ in range(count)]
        return [(conf(), hits & counted, counted, rng.choice([1, 1, 3])) for hits, counted in marks]

    groups = {
        (0, "few"): some(4, rng.random), (1, None): some(300, lambda: round(rng.random(), 2)), (None, "all"): some(200, lambda: rng.choice([-math.inf, -1.0, 0.0, 2.5])),
        (1, "long"): some(1500, rng.random), (1, "one"): some(700, lambda: 0.5), (2, "none"): [],
    }
    rows = [(*g, *r) for g, found in groups.items() for r in found] + [(0, "few", c, 1023, 1023, 5) for c in (None, math.nan)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "cls int, bin string, conf double, hits int, counted int, n long").repartition(5)
    truth = spark.createDataFrame([(*g, 2 * sum(r[3] for r in found) + 7) for g, found in groups.items()] + [(3, "empty", 0)], "cls int, bin string, n_truth long")
    got = {(r.cls, r.bin): tuple(r)[2:] for r in metrics.precision_of(df, truth, range_rows).collect()}
    assert got.pop((3, "empty")) == (0, None, None, None, None) and set(got) == set(groups)
    for g, found in groups.items():
        n = 2 * sum(r[3] for r in found) + 7
        by = plain_precision(found, n)
        assert got[g] == (n, *(pytest.approx(x, abs=1e-12) for x in (np.mean([a for a, _ in by]), by[0][0], by[5][0], np.mean([r for _, r in by]))))


def test_ranges_from_bounds_keep_order(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 1999).cast("double").alias("c"))
    got = prefix.ranged(df, ["g"], "c", 1000).groupBy("g", "_range").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).orderBy("g", "_range").collect()
    assert len(got) >= 14 and max(r.n for r in got) <= 2500 and sum(r.n for r in got) == 20_000
    assert all(a.g != b.g or a.lo > b.hi for a, b in zip(got, got[1:]))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_e1_curve_writes_no_row_for_each_threshold(spark, monkeypatch):
    """A detection is one row for all thresholds: nothing as long as the table, or ten times that, is written beside it."""
    written = []

    def counted(rows, *args, own=prefix.kept):
        found = own(rows, *args)
        written.append(found.count())
        return found

    monkeypatch.setattr(prefix, "kept", counted)
    found = catalog.QUERIES["e1_curve"](spark, "/root/testdata/sf0.001")
    assert found.count() == 12 and max(written) < 3000


@pytest.mark.parametrize(("buckets", "few"), [(1024, 4096), (8, 2)])
def test_quantiles_against_sorted_values(spark, monkeypatch, buckets, few):
    monkeypatch.setattr(prefix, "BUCKETS", buckets)
    monkeypatch.setattr(prefix, "FEW", few)
    rng = random.Random(5)
    groups = {
        "even": [rng.random() for _ in range(500)],
        "spread": [math.exp(rng.uniform(-40, 40)) * rng.choice([-1, 1]) for _ in range(301)],
        "tied": [2.5] * 400 + [1.0, 9.0, 1e9],
        "one": [7.0],
        "two": [1.0, 2.0],
        None: [float(i) for i in range(100)] + [None, math.nan],
        "none": [None, None],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    found = {r.g: r for r in prefix.quantiles(df, "x", ["g"], {"median": 0.5, "p95": 0.95, "least": 0.0}).collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        kept = [v for v in values if v is not None and not math.isnan(v)]
        want = (len(kept), *([np.mean(kept), *np.quantile(kept, [0.5, 0.95, 0.0])] if kept else [None] * 4))
        got = tuple(found[g][c] for c in ("n", "mean", "median", "p95", "least"))
        assert got == (pytest.approx(want, rel=1e-12) if kept else want)


def test_quantiles_of_the_whole_table_and_of_none(spark):
    df = spark.range(10_001).select(F.col("id").cast("double").alias("x"))
    assert tuple(prefix.quantiles(df, "x", [], {"m": 0.5}).first()) == (10_001, 5000.0, 5000.0)
    assert tuple(prefix.quantiles(df.limit(0), "x", [], {"m": 0.5}).first()) == (0, None, None)


def plain_smoothing(points, tau):
    out, state, last = [], None, None
    for t, v in sorted(points):
        state = v if state is None else state + (1 - math.exp(-(t - last) / tau)) * (v - state)
        last = t
        out.append((t, v, state))
    return out


@pytest.mark.parametrize("chunks", [0.5, 3.0, 100.0])
def test_smoothing_by_chunks(spark, chunks):
    rng = random.Random(8)
    points = {g: [(round(rng.uniform(0, 400), 2), rng.uniform(-5, 5)) for _ in range(rng.randint(1, 200))] for g in ("a", "b", "c")}
    points["gaps"] = [(float(t), float(t % 7)) for t in (*range(10), *range(90_000, 90_010), 10**6)]
    points["ties"] = [(1.0, 5.0), (1.0, 3.0), (2.0, 1.0)]
    rows = [(g, t, v) for g, some in points.items() for t, v in some] + [("a", None, 1.0), ("a", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, t double, v double").repartition(3)
    tau = 2.0
    last = {r.g: r.smoothed for r in segment.smoothed(df, ["g"], "t", "v", tau, chunks).collect()}
    every = segment.smoothed_rows(df, ["g"], "t", "v", tau, max(chunks, 40.0)).collect()
    for g, some in points.items():
        want = plain_smoothing(some, tau)
        assert last[g] == pytest.approx(want[-1][2], rel=1e-9, abs=1e-12)
        got = sorted((r.t, r.v, r.smoothed) for r in every if r.g == g)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-9, abs=1e-12)
