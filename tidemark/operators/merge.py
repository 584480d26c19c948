"""Upserts, reviews and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dedup import keep_last

#: Worksheet fields that a suggestion may overwrite besides those that start with auto_.
SUGGESTED = (
    "fps", "duration_sec", "annotation_status", "label_id", "images_dir", "labels_dir", "inference_sampling",
    "model_confidence",
)
HUMAN = ("t_ignition_start_sec", "t_aftermath_start_sec", "should_alert_human")
ISSUES = ("false_positive", "missed", "wrong_class", "bad_box", "other")


def merge_worksheet(existing: DataFrame, suggestions: DataFrame, key: str = "video_path") -> DataFrame:
    """Suggestions fill new rows and may change metadata of old ones, never what people entered.

    A changed source hash asks for a new review.  The union of both tables' columns; blanks for absent
    human cells.  One row a key on either side; order is not kept (O9 wants a column for it).
    """
    columns = list(dict.fromkeys([*existing.columns, *suggestions.columns, *HUMAN, "source_sha256", "review_status"]))
    old, new = existing.alias("o"), suggestions.alias("n")
    has_old, has_new = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")

    def side(name: str, alias: str, table: DataFrame) -> Column:
        return F.col(f"{alias}.{name}") if name in table.columns else F.lit(None).cast("string")

    out = []
    for name in columns:
        mine, theirs = side(name, "o", existing), side(name, "n", suggestions)
        open_ = name in suggestions.columns and (name.startswith("auto_") or name in SUGGESTED)
        value = F.when(has_old & (has_new if open_ else F.lit(False)), theirs).when(has_old, mine).otherwise(theirs)
        if name in HUMAN:
            value = F.coalesce(value, F.lit(""))
        if name == "source_sha256":
            value = F.coalesce(F.nullif(value, F.lit("")), side("auto_source_sha256", "n", suggestions))
        if name == "review_status":
            was = F.nullif(side("source_sha256", "o", existing), F.lit(""))
            changed = has_new & (was != side("auto_source_sha256", "n", suggestions))
            value = F.when(F.coalesce(changed, F.lit(False)), "source_changed_review_needed").otherwise(value)
        out.append(value.alias(name))
    return joined.select(*out)


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """M2, M3, M8: rows of both tables, the new one's winning by key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, "_new").drop("_new")


def save_reviews(store: DataFrame, saves: DataFrame, key: str = "clip_id") -> DataFrame:
    """M4: clip, revision after, outcome; a save applies only to the revision that it was made from.

    store: key, revision; saves: key, base_revision.
    """
    joined = saves.alias("s").join(store.alias("t"), key, "left")
    now = F.coalesce("t.revision", F.lit(0))
    fits = F.col("s.base_revision") == now
    return joined.select(
        key, F.when(fits, now + 1).otherwise(now).alias("revision"), F.when(fits, "saved").otherwise("conflict").alias("outcome")
    )


def valid_annotation(frame_count: Column, frame_index: Column, n_boxes: Column, issue: Column) -> Column:
    """M5: the first broken rule of a review entry, null without any."""
    return (
        F.when(frame_index.isNull() | (frame_index < 0) | (frame_index >= frame_count), "frame_index")
        .when(n_boxes > 500, "too many boxes")
        .when(issue.isNotNull() & ~issue.isin(*ISSUES), "issue")
    )


def batch_flags(frames: DataFrame, existing: DataFrame) -> DataFrame:
    """M6: a false-positive flag for every box of a negative clip, except those that are there.

    frames: clip, frame_index, boxes (array); existing: clip, id.
    """
    flags = frames.select("clip", "frame_index", F.posexplode("boxes").alias("box_index", "box")).select(
        "clip", F.concat_ws(":", "frame_index", "box_index", F.lit("false_positive")).alias("id"), "frame_index", "box_index"
    )
    return flags.join(existing.select("clip", "id"), ["clip", "id"], "left_anti")


def changed_artifacts(before: DataFrame, after: DataFrame) -> DataFrame:
    """M7: rows of one snapshot only, with the side that has them."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionAll(
        after.exceptAll(before).withColumn("side", F.lit("after"))
    )


def pending(rows: DataFrame, done: DataFrame, signature: list[str]) -> DataFrame:
    """Rows whose signature has no finished result; nulls compare equal."""
    a, b = rows.alias("a"), done.select(*signature).distinct().alias("b")
    on = F.lit(True)
    for c in signature:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, on, "left_anti")


def review_status(reviews: DataFrame) -> DataFrame:
    """By clip, flags and reviewed frames; reviews: clip, kind, reviewed."""
    return reviews.groupBy("clip").agg(
        F.count_if(F.col("kind") == "flag").alias("flags"),
        F.count_if((F.col("kind") == "annotation") & F.col("reviewed")).alias("reviewed_frames"),
    )
