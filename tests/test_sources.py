import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import joins, merge, metrics, segment, verify
from tidemark.plans import audit
from tidemark.sources import listing
from tidemark.sources import readers, sinks


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"rest"


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x10" + b"J" * 14 + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"xxxx\xff\xd9"


def test_headers():
    assert readers.dimensions_of(png(32, 24)) == (32, 24)
    assert readers.dimensions_of(jpeg(640, 480)) == (640, 480)
    for bad in (None, b"", b"\xff\xd8", b"\x89PNG\r\n\x1a\n", b"text", jpeg(1, 1)[:22]):
        assert readers.dimensions_of(bad) == (0, 0)


def test_scan_of_a_split_folder(spark, tmp_path):
    root = tmp_path / "set"
    for split in ("train", "valid", "test"):
        (root / split / "images").mkdir(parents=True)
        (root / split / "labels").mkdir()
        (root / split / "images" / f"{split}_1.PNG").write_bytes(png(32, 24))
        (root / split / "labels" / f"{split}_1.txt").write_text("0 0.5 0.5 0.25 0.25\n")
    (root / "train" / "images" / "neg_2.jpg").write_bytes(jpeg(640, 480))
    (root / "train" / "labels" / "neg_2.txt").write_bytes(b"")
    (root / "train" / "images" / "bad_3.jpg").write_bytes(b"nothing")
    (root / "train" / "images" / "odd_4.jpg").write_bytes(jpeg(8, 8))
    (root / "train" / "labels" / "odd_4.txt").write_bytes("7 .5 .5 .1 .1 é".encode("latin-1"))
    got = {r.filename: r for r in readers.scan_dataset(spark, str(root)).collect()}
    assert len(got) == 6 and {r.layout for r in got.values()} == {"split"}
    assert got["valid_1.PNG"].split == "val" and got["valid_1.PNG"].sequence_id == "set_val_valid"
    assert (got["train_1.PNG"].width, got["train_1.PNG"].height) == (32, 24)
    assert [b.class_id for b in got["train_1.PNG"].boxes] == [0] and not got["train_1.PNG"].is_negative
    assert got["neg_2.jpg"].is_negative and not got["neg_2.jpg"].is_corrupt and got["neg_2.jpg"].label_path
    assert got["bad_3.jpg"].is_corrupt and got["odd_4.jpg"].is_corrupt
    sinks.save_reports(readers.scan_dataset(spark, str(root)), str(tmp_path / "out"))
    found = json.loads((tmp_path / "out/audit.json").read_text())
    assert found["total"]["total"] == 6 and found["total"]["corrupt"] == 2
    assert "| set | 6 |" in (tmp_path / "out/audit.md").read_text()


def test_manifests_round_trip(spark, tmp_path):
    rows = [("a.jpg", "i/a.jpg", "fire", "v1", 0, 1, 640, 480, 2, 0, False), ("b.jpg", "i/b.jpg", "smoke", None, None, None, 8, 8, 0, 0, True)]
    frames = spark.createDataFrame(rows, schemas.FRAMES)
    sinks.write_manifest_csv(frames, str(tmp_path / "csv"))
    assert sorted(map(tuple, readers.read_manifest_csv(spark, str(tmp_path / "csv")).collect())) == sorted(rows)
    nested = {"frames": [r.asDict(recursive=True) for r in sinks.nested(frames).collect()]}
    (tmp_path / "m.json").write_text(json.dumps(nested, indent=1))
    assert sorted(map(tuple, readers.read_manifest_json(spark, str(tmp_path / "m.json")).collect())) == sorted(rows)
    assert readers.read_cells(spark, str(tmp_path / "absent.csv")).count() == 0
    (tmp_path / "bom.csv").write_bytes("﻿a,b\n1,x\n".encode())
    assert readers.read_cells(spark, str(tmp_path / "bom.csv")).columns == ["a", "b"]


def test_lists_frames_and_files(spark, tmp_path):
    for s, lines in (("train", "# note\ni\\a.jpg\n\n"), ("val", "i/b.jpg\n")):
        (tmp_path / f"{s}.txt").write_text(lines)
    paths = {s: str(tmp_path / f"{s}.txt") for s in ("train", "val")}
    assert {(r.split, r.path) for r in readers.read_splits(spark, paths).collect()} == {("train", "i/a.jpg"), ("val", "i/b.jpg")}
    with pytest.raises(ValueError):
        readers.read_splits(spark, {"train": paths["train"], "val": paths["train"]})
    record = {"frame_index": 0, "timestamp_sec": 0.0, "image_size": [640, 480], "boxes": [], "tracks": [[1, 2, 3, 4, 7, 0.5, 1]]}
    with gzip.open(tmp_path / "cam.jsonl.gz", "wt") as f:
        f.write(json.dumps(record) + "\n" + json.dumps({**record, "frame_index": 1, "timestamp_sec": 0.1, "tracks": []}) + "\n")
    got = readers.read_frames(spark, str(tmp_path / "cam.jsonl.gz")).orderBy("frame_index").collect()
    assert [(r.stream_id, r.track_id, r.image_w) for r in got] == [("cam", 7, 640), ("cam", None, 640)]
    sinks.write_dataset(readers.read_splits(spark, paths), str(tmp_path / "d"), {0: "fire", 1: "smoke"})
    config = readers.load_config(str(tmp_path / "d/data.yaml"))
    assert verify.config_problems(config) == [] and verify.config_problems({"nc": 3, "names": ["x"]})
    sinks.write_csv(str(tmp_path / "f.csv"), [{"a": "=1"}, {"b": "x"}], guarded=True)
    assert (tmp_path / "f.csv").read_bytes() == "﻿a,b\r\n'=1,\r\n,x\r\n".encode()
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.write_absent(rows.where("k = 1"), str(tmp_path / "t"), ["k"])
    sinks.write_absent(rows, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_summaries_need_the_expected_runs(spark, tmp_path):
    for model, seed in (("plain", 2026), ("adaptive", 42)):
        value = {"model": model, "seed": seed, "tiny_fire_AP": 0.25, "small_fire_AP": 0.5, "small_smoke_AP": 0.1, "normal": {"overall": {"AP": 0.4, "AP50": 0.8}}}
        (tmp_path / f"{model}.json").write_text(json.dumps(value))
    rows = readers.run_summaries(spark, str(tmp_path), [("adaptive", 42), ("plain", 2026)])
    table = metrics.comparison_rows(rows).collect()
    assert [(r.model, r.tiny_fire_AP, r.overall_AP50) for r in table] == [("plain", 25.0, 80.0), ("adaptive", 25.0, 80.0)]
    with pytest.raises(ValueError):
        readers.run_summaries(spark, str(tmp_path), [("plain", 2026)])


def test_audit_plan(spark):
    rows = [(f"clip_CV{i:06d}.jpg", 640, 480, i % 3, f"h{i}") for i in range(12)]
    rows += [(f"still{k}_x.jpg", 640, 480, 0, f"s{k}") for k in range(6)] + [("broken_1.jpg", 0, 0, 0, "b")]
    images = spark.createDataFrame(rows, "filename string, width int, height int, dhash bigint, sha256 string")
    images = images.withColumn("path", F.concat(F.lit("i/"), "filename")).withColumn("is_corrupt", F.lit(False))
    holdout = images.where("filename LIKE 'still%'")
    got = audit.prepare(holdout, images.where("filename NOT LIKE 'still%'"), 0.8).toPandas()
    assert len(got) == 19 and (got[got.filename.str.startswith("still")].split == "test").all()
    assert got[got.filename == "broken_1.jpg"].split.tolist() == ["quarantine"]
    clip = got[got.filename.str.startswith("clip")]
    assert clip.video_id.nunique() == 1 and sorted(clip.frame_index) == list(range(12)) and clip.split.nunique() == 1


def test_criteria_catch_what_they_should(spark):
    frames = spark.createDataFrame(
        [("a", "p/a", "fire", "v", 0, 2, 640, 480, 0, 0, True), ("b", "p/b", "odd", "v", 2, 2, 320, 480, 0, 0, True), ("b", "p/c", "fire", None, 5, None, 1, 1, 0, 0, True)],
        schemas.FRAMES,
    )
    images = spark.createDataFrame(
        [("train", "p/a", "v", None), ("val", "p/b", "v", None), ("test", "p/a", None, None)], "split string, path string, video_id string, sha256 string"
    )
    disk = spark.createDataFrame([("p/a",), ("p/z",)], "path string")
    lines = spark.createDataFrame([("p/a", "0 .5 .5 .1 .1"), ("p/b", "9 .5 .5 .1 .1")], "path string, line string")
    from tidemark.functions import boxes

    checked = lines.select("path", boxes.validated_line(F.col("line"), boxes.V1).alias("checked"))
    got = {r.id: r.status for r in verify.verified(images, frames, disk, checked).collect()}
    assert got == {f"AC{i}": "FAIL" for i in range(1, 9)} | {"AC10": "SKIPPED"}


def test_guards_and_partitions(spark):
    rows = spark.createDataFrame([("a/Fire/pos/x.mp4", "firesense"), ("x", "firesense"), ("a/fire/pos/x.mp4", "other")], "p string, s string")
    got = [r[0] for r in rows.select(segment.folder_partition(F.col("p"), F.col("s"))).collect()]
    assert tuple(got[0]) == ("fire", "pos") and got[1:] == [None, None]
    with pytest.raises(Exception, match="not a development row"):
        segment.development_only(spark.createDataFrame([("test",)], "split string")).collect()
    counts = spark.createDataFrame([("c", "flag", None), ("c", "annotation", True), ("c", "annotation", False)], "clip string, kind string, reviewed boolean")
    assert tuple(merge.review_status(counts).first()) == ("c", 1, 1)
    first = joins.first_match(rows, rows.withColumn("o", F.length("s")).withColumnRenamed("s", "t"), "p", "o")
    assert first.count() == 3


def test_local_folders_are_listed_name_by_name(tmp_path, monkeypatch):
    for name in ("a/b/c/1.txt", "a/b/2.txt", "a/3.txt", "4.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    reader = listing.FolderReader({"path": str(tmp_path)})
    shares = reader.partitions()

    def whole(*args, **named):
        raise AssertionError("a folder's files were held together")

    monkeypatch.setattr(listing.pafs, "FileSelector", whole)
    rows = [r for s in shares for batch in reader.read(s) for r in batch.to_pylist()]
    assert sorted((r["relative"], r["length"], r["content"].decode()) for r in rows) == sorted((n, len(n), n) for n in ("a/b/c/1.txt", "a/b/2.txt", "a/3.txt", "4.txt"))


def test_other_stores_are_walked_folder_by_folder(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/1").write_text("x")
    (tmp_path / "2").write_text("yz")
    other = listing.pafs.SubTreeFileSystem(str(tmp_path), listing.pafs.LocalFileSystem())
    assert sorted((p.strip("/"), n) for p, n in listing._walk(other, "", True)) == [("2", 2), ("a/b/1", 1)]
