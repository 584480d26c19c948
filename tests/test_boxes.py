import pytest
from pyspark.sql import functions as F

from tidemark.functions import boxes, hashing, text

CASES = [  # line, V1, V2, V3, V4, V5: the first broken rule
    ("0 0.5 0.5 0.25 0.25", None, None, None, None, None),
    ("7 0.5 0.5 0.25 0.25", "class", "class", "class", "class", "class"),
    ("0.0 .5 .5 .1 .1", "class", "class", None, "class", "class"),
    ("0 nan .5 .1 .1", "number", "number", "number", "number", "number"),
    ("0 inf .5 .1 .1", "number", "number", "number", "number", "number"),
    ("0 5d .5 .1 .1", "number", "number", "number", "number", "number"),
    ("1_0 .5 .5 .1 .1", "class", "class", "class", "class", "class"),
    ("0 .5 .5 0 .1", "degenerate", "degenerate", "degenerate", "degenerate", "degenerate"),
    ("0 .5 .5 .1 .1 .9", "tokens", "tokens", "tokens", "tokens", "tokens"),
    ("0 .05 .5 .2 .1", "extents", None, None, None, "extents"),
]


@pytest.mark.parametrize("line,v1,v2,v3,v4,v5", CASES)
def test_validators(spark, line, v1, v2, v3, v4, v5):
    rules = [boxes.V1, boxes.V2, boxes.V3, boxes.V4, boxes.V5]
    got = spark.createDataFrame([(line,)], "line string").select(
        *[boxes.validated_line(F.col("line"), r)["error"].alias(f"v{i}") for i, r in enumerate(rules)]
    )
    assert list(got.first()) == [v1, v2, v3, v4, v5]


def test_blank_line_is_null_and_v1_clamps(spark):
    rows = spark.createDataFrame([(" ",), ("0 1.00009 .5 .00001 .1",)], "line string")
    got = rows.select(boxes.validated_line(F.col("line"), boxes.V1).alias("v")).collect()
    assert got[0].v is None
    assert got[1].v.x_center == 1.0


def test_sizes_at_their_limits(spark):
    rows = spark.createDataFrame([(16.0,), (16.01,), (32.0,), (32.01,), (96.0,)], "side double")
    side = F.col("side")
    got = rows.select(
        boxes.size_tag(side).alias("t"), F.array_join(boxes.evaluation_bins(side), "+").alias("b"),
        boxes.pixel_scale(side * side).alias("p"), boxes.confidence_floor(side).alias("c"),
    ).collect()
    assert [r.t for r in got] == ["TINY", "SMALL", "SMALL", "MEDIUM_LARGE", "MEDIUM_LARGE"]
    assert [r.b for r in got] == ["small+16-32", "small+16-32", "medium", "medium", "large"]
    assert [r.p for r in got] == ["small", "small", "medium", "medium", "medium"]
    assert [r.c for r in got] == [0.14, 0.14, 0.14, 0.22, 0.22]


def test_names_and_clock(spark):
    names = ["bothFireAndSmoke_CV000000", "fire_CV000123", "clip1_0005", "sample", "007"]
    s = F.col("s")
    rows = spark.createDataFrame([(n,) for n in names], "s string").select(
        text.frame_prefix(s), text.frame_index(s), text.clean_prefix(text.frame_prefix(s)), text.category(s)
    )
    assert [tuple(r) for r in rows.collect()] == [
        ("bothFireAndSmoke_CV", 0, "bothFireAndSmoke", "bothFireAndSmoke"), ("fire_CV", 123, "fire", "fire"),
        ("clip1_", 5, "clip1", "clip1"), ("sample", -1, "sample", "sample"), ("", 7, "video", "007"),
    ]
    clock = spark.createDataFrame([(3661.234,), (0.0005,), (0.0015,), (None,), (360000.0,)], "t double")
    assert [r[0] for r in clock.select(text.clock_time(F.col("t"))).collect()] == [
        "01:01:01.234", "00:00:00.000", "00:00:00.002", None, "100:00:00.000",
    ]


def test_hashes(spark):
    rows = spark.createDataFrame(
        [(list(range(72)), -1, 0), (list(range(72, 0, -1)), 5, 4)], "p array<int>, a bigint, b bigint"
    )
    p = F.col("p")
    got = rows.select(
        hashing.gradient_hash(p), hashing.gradient_hash(p, rising=False), hashing.hamming(F.col("a"), F.col("b"))
    )
    assert [tuple(r) for r in got.collect()] == [(-1, 0, 64), (0, -1, 1)]


def test_guarded_cells_and_safe_floats(spark):
    rows = spark.createDataFrame([("=1+1",), ("+x",), ("ok",), (None,)], "c string")
    assert [r[0] for r in rows.select(text.guarded_cell(F.col("c"))).collect()] == ["'=1+1", "'+x", "ok", None]
    values = spark.createDataFrame([("NaN",), ("Infinity",), ("1.234567",), (None,)], "c string")
    got = values.select(text.safe_float(F.col("c"), 0.0, 5)).collect()
    assert [r[0] for r in got] == [0.0, 0.0, 1.23457, 0.0]
