"""Acceptance criteria and audits (AC1-AC10, QA-QD); each criterion is a query of id, status, details."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import dedup, joins, segment

#: Fixed values.
CATEGORIES = ("bothFireAndSmoke", "fire", "smoke", "neitherFireNorSmoke")
NAMES = {0: "fire", 1: "smoke"}


def _criterion(name: str, counts: DataFrame, failures: list[str], skipped: Column | None = None) -> DataFrame:
    """counts: one row; a criterion passes when all named counts are 0."""
    bad = reduce(lambda a, b: a | b, [F.col(f) > 0 for f in failures])
    status = F.when(bad, "FAIL").otherwise("PASS")
    if skipped is not None:
        status = F.when(skipped, "SKIPPED").otherwise(status)
    details = F.to_json(F.struct(*[F.col(c).cast("bigint").alias(c) for c in counts.columns]))
    return counts.select(F.lit(name).alias("id"), status.alias("status"), details.alias("details"))


def _count(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count("*").alias(name))


def _together(*counts: DataFrame) -> DataFrame:
    """One row of one-row tables."""
    return reduce(lambda a, b: a.crossJoin(b), counts)


def all_classified(disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """AC1: every file is in the manifest, under a known category.  disk: path; manifest: path, category."""
    known = F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False))
    counts = _together(
        _count(joins.unmatched(disk, manifest, "path"), "unlisted"), _count(manifest.where(~known), "unclassified")
    )
    return _criterion("AC1", counts, ["unlisted", "unclassified"])


def contiguous_indices(manifest: DataFrame) -> DataFrame:
    """AC2: indices of each video run from 0 without a gap; nulls are left out."""
    rows = manifest.where("video_id IS NOT NULL AND frame_index IS NOT NULL")
    return _criterion("AC2", _count(segment.contiguous(rows, "frame_index", "video_id").where("NOT contiguous"), "broken"), ["broken"])


def one_resolution(manifest: DataFrame) -> DataFrame:
    """AC3."""
    mixed = manifest.where("video_id IS NOT NULL").groupBy("video_id").agg(F.count_distinct("width", "height").alias("n"))
    return _criterion("AC3", _count(mixed.where("n > 1"), "mixed"), ["mixed"])


def strict_indices(manifest: DataFrame) -> DataFrame:
    """AC4: as AC2, and null indices fail, and the stated length is the number of frames."""
    rows = manifest.where("video_id IS NOT NULL")
    judged = segment.contiguous(rows, "frame_index", "video_id")
    lengths = rows.groupBy("video_id").agg(
        F.count("*").alias("n"), F.min("sequence_length").alias("least"), F.max("sequence_length").alias("most")
    )
    stated = (F.col("least") == F.col("n")) & (F.col("most") == F.col("n"))
    counts = _together(
        _count(judged.where("NOT contiguous"), "broken"), _count(judged.where("n_null > 0"), "unnumbered"),
        _count(lengths.where(~F.coalesce(stated, F.lit(False))), "wrong_length"),
    )
    return _criterion("AC4", counts, ["broken", "unnumbered", "wrong_length"])


def unique_and_typed(manifest: DataFrame) -> DataFrame:
    """AC5: names are unique; a frame has both video and index, a still image neither."""
    half = F.col("video_id").isNull() != F.col("frame_index").isNull()
    names = manifest.groupBy("filename").count().where("count > 1")
    return _criterion(
        "AC5", _together(_count(names, "repeated"), _count(manifest.where(half), "half_typed")), ["repeated", "half_typed"]
    )


def disjoint_splits(images: DataFrame) -> DataFrame:
    """AC6: no path in two splits, no video in train and val."""

    def shared(a: str, b: str, key: str, name: str) -> DataFrame:
        rows = images.where(F.col(key).isNotNull())
        return _count(dedup.overlap(rows.where(F.col("split") == a), rows.where(F.col("split") == b), key), name)

    counts = _together(
        shared("train", "val", "path", "train_val"), shared("train", "test", "path", "train_test"),
        shared("val", "test", "path", "val_test"), shared("train", "val", "video_id", "videos"),
    )
    return _criterion("AC6", counts, counts.columns)


def test_isolated(images: DataFrame, key: str = "path", name: str = "AC7") -> DataFrame:
    """AC7 by path, AC10 by digest: test shares nothing with train and val; without digests AC10 is skipped."""
    rows = images.where(F.col(key).isNotNull())
    test, rest = rows.where("split = 'test'"), rows.where("split IN ('train', 'val')")
    counts = _together(_count(rows, "known"), _count(dedup.overlap(test, rest, key), "shared"))
    return _criterion(name, counts, ["shared"], F.col("known") == 0)


def valid_labels(lines: DataFrame) -> DataFrame:
    """AC8: counts of negatives, classes and broken lines; lines: path, checked (a validated line, null: blank)."""
    c = F.col("checked")
    counts = lines.agg(
        F.count_if(c.isNull()).alias("blank"),
        F.count_if(c["class_id"] == 0).alias("fire"),
        F.count_if(c["class_id"] == 1).alias("smoke"),
        F.count_if(c["error"].isNotNull()).alias("invalid"),
    )
    return _criterion("AC8", counts, ["invalid"])


def config_problems(config: dict) -> list[str]:
    """AC9: what a data.yaml lacks; files are checked by J5."""
    out = [f"no {k}" for k in ("train", "val", "test", "nc", "names") if k not in config]
    names = config.get("names")
    if isinstance(names, list):
        names = dict(enumerate(names))
    elif isinstance(names, dict):
        try:
            names = {int(k): v for k, v in names.items()}
        except ValueError:
            names = {int(v): k for k, v in names.items()}
    if config.get("nc") not in (None, len(NAMES)):
        out.append("nc")
    if names is not None and names != NAMES:
        out.append("names")
    return out


#: What a row says, and about which key; see `_facts`.
FACT = (
    "kind string, key string, i long, size struct<w:int,h:int>, length int, listed int, on_disk int, unclassified int, half_typed int, "
    "splits int, blank int, fire int, smoke int, invalid int"
)


def _facts(rows: DataFrame, *facts: tuple[str, Column | None, dict[str, Column], Column | None]) -> DataFrame:
    """Facts of (kind, key, values, condition) of each row, in one pass over the table."""
    fields = [(f.split(" ", 1)[0], f.split(" ", 1)[1]) for f in FACT.replace("<w:int,h:int>", "<w:int;h:int>").split(", ")]
    made = []
    for kind, key, values, where in facts:
        given = {"kind": F.lit(kind), "key": F.lit(None) if key is None else key} | values
        fact = F.struct(*[given.get(n, F.lit(None)).cast(k.replace(";", ",")).alias(n) for n, k in fields])
        made.append(fact if where is None else F.when(where, fact))
    return rows.select(F.explode(F.array(*made)).alias("f")).where("f IS NOT NULL").select("f.*")


def verified(images: DataFrame, manifest: DataFrame, disk: DataFrame, lines: DataFrame) -> DataFrame:
    """AC1-AC8 and AC10 in one table, each input read once.

    Every row becomes some facts about a path, a name, a video or a digest; they are added up by key and index, then by key, then to
    one row of counts, from which all criteria follow.  Keys of any frequency are met by partial sums.
    """
    c, one = F.col("checked"), F.lit(1)
    known = F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False))
    half = F.col("video_id").isNull() != F.col("frame_index").isNull()
    size = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.struct(F.col("width").alias("w"), F.col("height").alias("h")))
    split = F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 2).when(F.col("split") == "test", 4).otherwise(0)
    facts = [
        _facts(
            manifest, ("path", F.col("path"), {"listed": one}, None), ("name", F.col("filename"), {}, None),
            ("video", F.col("video_id"), {"i": F.col("frame_index"), "size": size, "length": F.col("sequence_length")}, F.col("video_id").isNotNull()),
            ("row", None, {"unclassified": (~known).cast("int"), "half_typed": half.cast("int")}, None),
        ),
        _facts(disk, ("path", F.col("path"), {"on_disk": one}, None)),
        _facts(images, *[(f"image_{k}", F.col(k), {"splits": split}, F.col(k).isNotNull()) for k in ("path", "video_id", "sha256")]),
        _facts(lines, ("line", None, {
            "blank": c.isNull().cast("int"), "fire": (c["class_id"] == 0).cast("int"), "smoke": (c["class_id"] == 1).cast("int"),
            "invalid": c["error"].isNotNull().cast("int"),
        }, None)),
    ]
    sums = ("listed", "on_disk", "unclassified", "half_typed", "blank", "fire", "smoke", "invalid")
    by_index = reduce(DataFrame.unionByName, facts).groupBy("kind", "key", "i").agg(
        F.count("*").alias("n"), F.min("size").alias("small"), F.max("size").alias("large"), F.min("length").alias("least"), F.max("length").alias("most"),
        F.bit_or("splits").alias("splits"), *[F.sum(x).alias(x) for x in sums],
    )
    numbered = F.when(F.col("i").isNotNull(), F.col("n"))
    by_key = by_index.groupBy("kind", "key").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(numbered), F.lit(0)).alias("numbered"), F.count("i").alias("indices"), F.min("i").alias("first"), F.max("i").alias("last"),
        F.min("small").alias("small"), F.max("large").alias("large"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.bit_or("splits").alias("splits"), *[F.sum(x).alias(x) for x in sums],
    )
    total = by_key.agg(*[x.alias(n) for n, x in _findings().items()])
    return total.select(F.inline(F.array(*[_judged(name, failing, skipped, shown) for name, failing, skipped, shown in CRITERIA])))


def _findings() -> dict[str, Column]:
    """Counts over keys, by name."""

    def of(kind: str, condition: Column) -> Column:
        return F.count_if((F.col("kind") == kind) & condition)

    def added(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    def full(n: Column) -> Column:
        return F.coalesce((F.col("first") == 0) & (F.col("last") == n - 1) & (F.col("indices") == n), F.lit(False))

    def both(a: int, b: int) -> Column:
        return (F.col("splits").bitwiseAND(a) > 0) & (F.col("splits").bitwiseAND(b) > 0)

    n, numbered = F.col("n"), F.col("numbered")
    stated = F.coalesce((F.col("least") == n) & (F.col("most") == n), F.lit(False))
    lone = (F.col("kind") == "path") & (F.col("key").isNull() | F.col("listed").isNull())
    return {
        "unlisted": F.coalesce(F.sum(F.when(lone, F.col("on_disk"))), F.lit(0)), "unclassified": added("unclassified"),
        "gaps": of("video", (numbered > 0) & ~full(numbered)), "mixed": of("video", F.coalesce(F.col("small") != F.col("large"), F.lit(False))),
        "broken": of("video", ~full(n)), "unnumbered": of("video", numbered < n), "wrong_length": of("video", ~stated),
        "repeated": of("name", n > 1), "half_typed": added("half_typed"),
        "train_val": of("image_path", both(1, 2)), "train_test": of("image_path", both(1, 4)), "val_test": of("image_path", both(2, 4)),
        "videos": of("image_video_id", both(1, 2)),
        "known_paths": F.coalesce(F.sum(F.when(F.col("kind") == "image_path", n)), F.lit(0)), "shared_paths": of("image_path", both(4, 3)),
        "blank": added("blank"), "fire": added("fire"), "smoke": added("smoke"), "invalid": added("invalid"),
        "known_digests": F.coalesce(F.sum(F.when(F.col("kind") == "image_sha256", n)), F.lit(0)), "shared_digests": of("image_sha256", both(4, 3)),
    }


#: id, counts that must be 0, count without which it is skipped, details by name.
CRITERIA = (
    ("AC1", ("unlisted", "unclassified"), None, {}),
    ("AC2", ("gaps",), None, {"broken": "gaps"}),
    ("AC3", ("mixed",), None, {}),
    ("AC4", ("broken", "unnumbered", "wrong_length"), None, {}),
    ("AC5", ("repeated", "half_typed"), None, {}),
    ("AC6", ("train_val", "train_test", "val_test", "videos"), None, {}),
    ("AC7", ("shared_paths",), "known_paths", {"known": "known_paths", "shared": "shared_paths"}),
    ("AC8", ("invalid",), None, {"blank": "blank", "fire": "fire", "smoke": "smoke", "invalid": "invalid"}),
    ("AC10", ("shared_digests",), "known_digests", {"known": "known_digests", "shared": "shared_digests"}),
)


def _judged(name: str, failing: tuple[str, ...], skipped: str | None, shown: dict[str, str]) -> Column:
    status = F.when(reduce(lambda a, b: a | b, [F.col(f) > 0 for f in failing]), "FAIL").otherwise("PASS")
    if skipped is not None:
        status = F.when(F.col(skipped) == 0, "SKIPPED").otherwise(status)
    details = F.to_json(F.struct(*[F.col(c).cast("bigint").alias(k) for k, c in (shown or {f: f for f in failing}).items()]))
    return F.struct(F.lit(name).alias("id"), status.alias("status"), details.alias("details"))


def replay_invariants(frames: DataFrame) -> DataFrame:
    """QA: raw, filtered and confirmed boxes form a chain of subsets; confirmed ids only grow.

    frames: stream_id, frame_index, raw, filtered, confirmed (arrays), ids (confirmed so far).
    """
    from pyspark.sql.window import Window

    before = F.lag("ids").over(Window.partitionBy("stream_id").orderBy("frame_index"))
    checked = frames.select(
        "stream_id",
        (F.size(F.array_except("filtered", "raw")) > 0).alias("invented"),
        (F.size(F.array_except("confirmed", "filtered")) > 0).alias("unfiltered"),
        F.coalesce(F.size(F.array_except(before, F.col("ids"))) > 0, F.lit(False)).alias("shrunk"),
    )
    return checked.groupBy("stream_id").agg(
        F.count("*").alias("frames"), *[F.count_if(c).alias(c) for c in ("invented", "unfiltered", "shrunk")]
    )


def completion_audit(frame_map: DataFrame, labels: DataFrame, content: DataFrame) -> DataFrame:
    """QB: mapped frames without a label, repeated images, and files that are no whole JPEG."""
    whole = (F.substring("content", 1, 2) == F.lit(b"\xff\xd8")) & (
        F.substring("content", -2, 2) == F.lit(b"\xff\xd9")
    )
    counts = _together(
        _count(joins.unmatched(frame_map, labels, "image"), "unlabelled"),
        _count(frame_map.groupBy("image").count().where("count > 1"), "repeated"),
        _count(content.where(~F.coalesce(whole, F.lit(False))), "broken_files"),
    )
    return _criterion("QB", counts, counts.columns)


def detection_verification(images: DataFrame, labels: DataFrame) -> DataFrame:
    """QD, J3, J5: by split: images, without label (an error), labels without image.

    images: split, stem; labels: split, stem.
    """
    keys = ["split", "stem"]
    no_label = images.join(labels, keys, "left_anti").groupBy("split").agg(F.count("*").alias("missing_labels"))
    orphans = labels.join(images, keys, "left_anti").groupBy("split").agg(F.count("*").alias("orphans"))
    base = images.groupBy("split").agg(F.count("*").alias("images"))
    rows = base.join(no_label, "split", "left").join(orphans, "split", "left").na.fill(0)
    return rows.withColumn("status", F.when(F.col("missing_labels") > 0, "FAIL").otherwise("PASS"))


def verification_summary(frames: DataFrame, labels: DataFrame, criteria: DataFrame) -> DataFrame:
    """One row of counts over a verified dataset.

    frames: path, category, video_id; labels: path, checked (a validated line, null: blank; files without lines
    have no row); criteria: id, status.
    """
    c, framed = F.col("checked"), F.col("category") == "video_frame"
    images = frames.agg(
        F.count("*").alias("total_images"), F.count_if(framed).alias("video_frames"), F.count_if(~framed).alias("static_images"),
        F.count_distinct(F.when(framed, F.col("video_id"))).alias("video_sequences"),
    )
    # lines are judged once, by path; a null path meets no other
    lines = labels.groupBy("path").agg(
        F.count(c).alias("filled"), F.count_if(c["class_id"] == 0).alias("fire"), F.count_if(c["class_id"] == 1).alias("smoke"),
        F.count_if(c["error"].isNotNull()).alias("invalid"), F.count_if(c["error"] == "class").alias("classes"),
    )
    paths = frames.groupBy("path").agg(F.count("*").alias("frames")).join(lines, "path", "full")
    # K9's items: a path's lines of a bad class are one, its other bad lines another
    items = (F.col("classes") > 0).cast("int") + (F.col("invalid") > F.col("classes")).cast("int")
    sums = {
        "negative_frames": F.when(F.coalesce("filled", F.lit(0)) == 0, F.col("frames")), "fire_boxes": F.col("fire"), "smoke_boxes": F.col("smoke"),
        "invalid_boxes": F.col("invalid"), "invalid_classes": F.col("classes"), "manual_review_items": items,
    }
    boxes = paths.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in sums.items()])
    judged = criteria.agg(
        *[F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("FAIL", "failed"), ("SKIPPED", "skipped"))]
    )
    found = _together(images, boxes, judged)
    return found.select(*[n for n in found.columns if n != "manual_review_items"], "manual_review_items")


def review_items(labels: DataFrame) -> DataFrame:
    """K9: what a person should look at: path, reason, severity and how many lines; labels: path, checked."""
    error = F.col("checked.error")
    reason = F.when(error == "class", "invalid_class_id").otherwise("out_of_bounds_bbox")
    rows = labels.where(error.isNotNull()).groupBy("path", reason.alias("reason")).agg(F.count("*").alias("lines"))
    return rows.withColumn("severity", F.when(F.col("reason") == "invalid_class_id", "high").otherwise("medium"))


def merged_review(items: DataFrame, before: DataFrame) -> DataFrame:
    """K9, M3: earlier items and new ones; a new one replaces that of its path and reason."""
    rows = before.withColumn("_o", F.lit(0)).unionByName(items.withColumn("_o", F.lit(1)))
    return dedup.keep_last(rows, ["path", "reason"], "_o").drop("_o")


def annotation_totals(videos: DataFrame) -> DataFrame:
    """By subset and over all, videos, frames, keyframes and label files, and whether all are complete.

    videos: subset, frames, keyframes, images, label_files.
    """
    whole = (F.col("keyframes") == F.col("images")) & (F.col("keyframes") == F.col("label_files"))
    return videos.rollup("subset").agg(
        F.count("*").alias("videos"), *[F.sum(c).alias(c) for c in ("frames", "keyframes", "label_files")],
        F.count_if(~whole).alias("incomplete"),
    )


def flag_report(clips: DataFrame) -> DataFrame:
    """One row: negative clips, those with predictions, frames and boxes predicted, new flags.

    clips: clip, is_negative, prediction_frames, predicted_boxes, new_flags.
    """
    negative = F.col("is_negative")
    sums = [F.coalesce(F.sum(F.when(negative, F.col(c))), F.lit(0)).alias(c) for c in ("prediction_frames", "predicted_boxes", "new_flags")]
    return clips.agg(
        F.count_if(negative).alias("negative_clips"),
        F.count_if(negative & (F.col("predicted_boxes") > 0)).alias("negative_clips_with_predictions"), *sums,
        F.count_if(~negative).alias("remaining_positive_clips"),
    )
