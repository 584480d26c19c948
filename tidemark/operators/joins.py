"""Joins of images, labels, manifests and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_first_label(images: DataFrame, labels: DataFrame, key: str, priority: str) -> DataFrame:
    """Each image with the label of the best (lowest) priority, null without any.

    labels: key, priority and further columns; the best label is chosen before the join, so images
    never multiply.
    """
    rest = [c for c in labels.columns if c != key]
    best = labels.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*[priority, *[c for c in rest if c != priority]])).alias("_l"))
    return images.join(best, key, "left").select(*images.columns, *[F.col(f"_l.{c}").alias(c) for c in rest])


def with_defaults(left: DataFrame, right: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join where absent values get defaults."""
    return left.join(right, key, "left").na.fill(defaults)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of the left table without a partner."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def groups_of(members: DataFrame, manifest: DataFrame, key: str, group: str) -> DataFrame:
    """Distinct groups of the members."""
    return manifest.join(members.select(key), key, "left_semi").select(group).where(F.col(group).isNotNull()).distinct()


def completed(frames: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The join, and whether each frame has its label."""
    marked = labels.withColumn("_has", F.lit(True))
    return frames.join(marked, key, "left").withColumn("complete", F.coalesce("_has", F.lit(False))).drop("_has")


def authoritative(annotations: DataFrame, frame_map: DataFrame, key: str, time: str) -> DataFrame:
    """Annotations of known frames with the map's time in place of their own."""
    return annotations.drop(time).join(frame_map.select(key, time), key)


def positional(predictions: DataFrame, frames: DataFrame, key: str, time: str, tolerance: float = 1e-4) -> DataFrame:
    """Partners by position, and whether their times agree."""
    own = frames.select(key, F.col(time).alias("_t"))
    joined = predictions.join(own, key)
    return joined.withColumn("in_time", F.abs(F.col(time) - F.col("_t")) <= tolerance).drop("_t")


def close_of_other_class(boxes: DataFrame, by: list[str], sides: float = 2.5) -> DataFrame:
    """Boxes with one of another class nearby in their frame: adds together.

    A frame's boxes are gathered first (a frame holds few), then each looks among them.
    boxes: by..., cls, x, y, side.
    """
    w = Window.partitionBy(*by)
    others = F.collect_list(F.struct("cls", "x", "y", "side")).over(w)
    near = F.exists(
        "_o",
        lambda o: (o["cls"] != F.col("cls"))
        & (F.hypot(o["x"] - F.col("x"), o["y"] - F.col("y")) <= sides * F.greatest(o["side"], F.col("side"))),
    )
    return boxes.withColumn("_o", others).withColumn("together", near).drop("_o")


def paired(rows: DataFrame, model: str, a: str, b: str, keys: list[str], measures: list[str]) -> DataFrame:
    """Differences of model b from model a by key."""
    x = rows.where(F.col(model) == a).select(*keys, *[F.col(m).alias(f"_{m}") for m in measures])
    y = rows.where(F.col(model) == b).select(*keys, *measures)
    return x.join(y, keys).select(*keys, *[(F.col(m) - F.col(f"_{m}")).alias(m) for m in measures])


def first_match(rows: DataFrame, lookup: DataFrame, key: str, order: str) -> DataFrame:
    """The first lookup row of each key."""
    rest = [c for c in lookup.columns if c not in (key, order)]
    first = lookup.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in rest])
    return rows.join(first, key, "left")


def evidence(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """J18, QC: manifest: path, sha256; files: path, actual.  Adds problem, null where all is well."""
    w = Window.partitionBy("path")
    rows = manifest.withColumn("_n", F.count("*").over(w)).join(files, "path", "left")
    problem = (
        F.when(F.col("path").rlike(r"(^/)|(^|/)\.\.(/|$)|\\|//|(^|/)\.(/|$)"), "path")
        .when(F.col("_n") > 1, "repeated")
        .when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest")
        .when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") != F.col("sha256"), "changed")
    )
    return rows.withColumn("problem", problem).drop("_n")
