"""The criteria in one pass against each criterion on its own."""

import random
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import boxes
from tidemark.operators import verify
from tidemark.sources import readers


def tables(spark, seed):
    rng = random.Random(seed)

    def maybe(v, p=0.1):
        return None if rng.random() < p * (seed % 3) else v

    frames = [
        (maybe(f"f{rng.randrange(40)}", 0.05), maybe(f"p{rng.randrange(60)}"), rng.choice(["fire", "smoke", "odd" if seed % 2 else "fire", None]), maybe(f"v{rng.randrange(6)}", 0.3),
         maybe(i % 6), maybe(rng.choice([5, 6])), maybe(640), rng.choice([480, 480, 360]), 0, 0, True)
        for i in range(rng.choice([0, 30]))
    ]
    if seed == 0:
        frames = [(f"f{i}", f"p{i}", "fire", f"v{i // 5}", i % 5, 5, 640, 480, 0, 0, True) for i in range(20)]
    images = [(rng.choice(["train", "val", "test", "other"]), maybe(f"p{rng.randrange(30 + 900 * (seed % 2))}"), maybe(f"v{rng.randrange(9)}"), maybe(f"h{rng.randrange(99)}", 0.5)) for _ in range(40)]
    disk = [(maybe(f"p{rng.randrange(70)}"),) for _ in range(30)]
    lines = [(f"p{i}", rng.choice(["0 .5 .5 .1 .1", "1 .5 .5 .1 .1", "9 .5 .5 .1 .1" if seed % 2 else "", ""])) for i in range(30)]
    checked = spark.createDataFrame(lines, "path string, line string")
    from tidemark.functions import boxes

    checked = checked.select("path", boxes.validated_line(F.col("line"), boxes.V1).alias("checked"))
    return (
        spark.createDataFrame(images, "split string, path string, video_id string, sha256 string"), spark.createDataFrame(frames, schemas.FRAMES),
        spark.createDataFrame(disk, "path string"), checked,
    )


def test_one_pass_equals_each_criterion(spark):
    seen = set()
    for seed in range(5):
        images, manifest, disk, lines = tables(spark, seed)
        parts = [
            verify.all_classified(disk, manifest), verify.contiguous_indices(manifest), verify.one_resolution(manifest),
            verify.strict_indices(manifest), verify.unique_and_typed(manifest), verify.disjoint_splits(images),
            verify.test_isolated(images), verify.valid_labels(lines), verify.test_isolated(images, "sha256", "AC10"),
        ]
        want = sorted(map(tuple, reduce(DataFrame.unionAll, parts).collect()))
        got = sorted(map(tuple, verify.verified(images, manifest, disk, lines).collect()))
        assert got == want
        seen |= {r[:2] for r in got}
    assert {s for _, s in seen} == {"PASS", "FAIL", "SKIPPED"}


def test_inputs_are_read_once(spark, tmp_path):
    names = ("images", "manifest", "disk", "lines")
    for name, table in zip(names, tables(spark, 1), strict=True):
        table.write.parquet(f"{tmp_path}/{name}")
    read = [spark.read.parquet(f"{tmp_path}/{n}") for n in names]
    plan = verify.verified(*read)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") == 4


def test_summary_judges_lines_by_path(spark):
    frames = spark.createDataFrame(
        [("a", "static", None), ("b", "video_frame", "v"), ("c", "static", None), (None, "static", None)], "path string, category string, video_id string"
    )
    lines = [("a", "0 .5 .5 .1 .1"), ("a", "9 .5 .5 .1 .1"), ("a", "9 .5 .5 .1 .1"), ("a", "0 2 .5 .1 .1"), ("b", " "), ("d", "x"), (None, "1 .5 .5 .1 .1"), (None, "7 .5 .5 .1 .1")]
    rows = spark.createDataFrame(lines, "path string, line string")
    criteria = spark.createDataFrame([("AC1", "PASS")], "id string, status string")
    checked = boxes.validated_lines(rows, "line", boxes.V1)
    assert checked.select("checked").exceptAll(rows.select(boxes.validated_line(F.col("line"), boxes.V1).alias("checked"))).count() == 0
    found = verify.verification_summary(frames, checked.select("path", "checked"), criteria)
    got = found.first().asDict()
    assert [got[n] for n in ("total_images", "negative_frames", "fire_boxes", "smoke_boxes", "invalid_boxes", "invalid_classes", "manual_review_items")] == [4, 3, 1, 1, 5, 3, 4]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(line") == 1  # lines are parsed once


def test_bundles_are_merged(spark):
    names = spark.createDataFrame([(i, "s") for i in range(3)], "name long, sha256 string")
    rows = spark.createDataFrame([("z/0", 0, True, "s"), ("b/0", 0, False, "s"), ("a/0", 0, False, "x"), ("a/1", 1, False, "x")], "path string, name long, is_archive boolean, sha256 string")
    found = readers.bundle(names, rows)
    assert sorted(tuple(r) for r in found.select("name", "path", "problem").collect()) == [(0, "b/0", None), (1, None, "changed"), (2, None, "missing")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()  # no table in each task's memory
