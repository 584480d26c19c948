"""Profiles of annotated-image datasets and of metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import boxes
from tidemark.operators import prefix

SCALES = ("small", "medium", "large")
#: Aspect buckets in order of precedence.
ASPECTS = (("16:9", 16 / 9), ("4:3", 4 / 3), ("1:1", 1.0), ("3:2", 3 / 2), ("9:16", 9 / 16))
ASPECT_TOLERANCE = 0.05


def unusable(width: Column, height: Column, is_corrupt: Column) -> Column:
    """no dimensions, or corrupt; nulls count as unusable."""
    return F.coalesce((width <= 0) | (height <= 0) | is_corrupt, F.lit(True))


def dataset_profile(images: DataFrame) -> DataFrame:
    """A1: one row a dataset; corrupt rows count in total and corrupt alone."""
    sound = ~F.coalesce(F.col("is_corrupt"), F.lit(False))
    n = F.coalesce(F.size("boxes"), F.lit(0))
    return images.groupBy("dataset").agg(
        F.count("*").alias("total"),
        F.count_if(sound).alias("valid"),
        F.count_if(sound & (n > 0)).alias("annotated"),
        F.count_if(sound & (n == 0)).alias("empty"),
        F.count_if(~sound).alias("corrupt"),
        F.sum(F.when(sound, n).otherwise(0)).alias("boxes"),
    )


def resolution_histogram(images: DataFrame, *by: str) -> DataFrame:
    """A2, O1: WxH counts, most frequent first, ties by name."""
    named = images.where((F.col("width") > 0) & (F.col("height") > 0)).withColumn(
        "resolution", F.concat_ws("x", "width", "height")
    )
    return named.groupBy(*by, "resolution").agg(F.count("*").alias("n")).orderBy(*by, F.desc("n"), "resolution")


def top_resolutions(images: DataFrame, k: int = 10) -> DataFrame:
    """O2."""
    return resolution_histogram(images).limit(k)


def aspect_bucket(width: Column, height: Column) -> Column:
    """A3: the first bucket within the tolerance, else the ratio with two decimals."""
    ratio = width / height
    out = F.concat(F.format_string("%.2f", ratio), F.lit(":1"))
    for name, value in reversed(ASPECTS):
        out = F.when(F.abs(ratio - value) < ASPECT_TOLERANCE, F.lit(name)).otherwise(out)
    return F.when((width > 0) & (height > 0), out)


def aspect_histogram(images: DataFrame) -> DataFrame:
    bucketed = images.withColumn("aspect", aspect_bucket(F.col("width"), F.col("height")))
    return bucketed.where("aspect is not null").groupBy("aspect").agg(F.count("*").alias("n"))


def co_occurrence(images: DataFrame) -> DataFrame:
    """A4: images with class 0 only, class 1 only, both, neither; no label counts as neither."""
    fire = F.coalesce(F.exists("boxes", lambda b: b["class_id"] == 0), F.lit(False))
    smoke = F.coalesce(F.exists("boxes", lambda b: b["class_id"] == 1), F.lit(False))
    kind = F.when(fire & smoke, "both").when(fire, "fire_only").when(smoke, "smoke_only").otherwise("neither")
    return images.withColumn("kind", kind).groupBy("dataset", "kind").agg(F.count("*").alias("n"))


def class_distribution(images: DataFrame) -> DataFrame:
    """A5."""
    exploded = images.select("dataset", F.explode("boxes").alias("b"))
    return exploded.groupBy("dataset", F.col("b.class_id").alias("class_id")).agg(F.count("*").alias("n"))


def scale_histogram(images: DataFrame) -> DataFrame:
    """Every scale of every dataset, zeros included; boxes without image dimensions are left out."""
    sized = images.where((F.col("width") > 0) & (F.col("height") > 0)).select(
        "dataset", "width", "height", F.explode("boxes").alias("b")
    )
    scale = boxes.pixel_scale(F.col("b.width") * F.col("width") * F.col("b.height") * F.col("height"))
    counts = [F.count_if(scale == s).alias(s) for s in SCALES]
    wide = images.select("dataset").distinct().join(sized.groupBy("dataset").agg(*counts), "dataset", "left")
    return wide.select(
        "dataset",
        F.explode(F.array(*[F.struct(F.lit(s).alias("scale"), F.coalesce(s, F.lit(0)).alias("n")) for s in SCALES])).alias("x"),
    ).select("dataset", "x.scale", "x.n")


def rolled_up(counts: DataFrame, key: str, *measures: str) -> DataFrame:
    """Sums by key and their grand total under a null key."""
    return counts.groupingSets([[F.col(key)], []], F.col(key)).agg(*[F.sum(m).alias(m) for m in measures])


def split_counts(rows: DataFrame, split: str, category: str, categories: list[str]) -> DataFrame:
    """One row a split, one column a category."""
    return rows.groupBy(split).pivot(category, categories).count().na.fill(0)


def occurrence_times(frames: DataFrame) -> DataFrame:
    """By clip, first and last time of each class, positive and sampled frames.

    frames: clip, ts_sec, n_fire, n_smoke.
    """
    fire, smoke = F.col("n_fire") > 0, F.col("n_smoke") > 0
    return frames.groupBy("clip").agg(
        F.min(F.when(fire, F.col("ts_sec"))).alias("first_fire"),
        F.max(F.when(fire, F.col("ts_sec"))).alias("last_fire"),
        F.min(F.when(smoke, F.col("ts_sec"))).alias("first_smoke"),
        F.max(F.when(smoke, F.col("ts_sec"))).alias("last_smoke"),
        F.count_if(fire | smoke).alias("positive_frames"),
        F.count("*").alias("sampled_frames"),
    )


def label_statistics(images: DataFrame) -> DataFrame:
    """By split, images, labels, boxes, boxes of each class, empty labels, resolutions."""
    n = F.coalesce(F.size("boxes"), F.lit(0))

    def of(k: int) -> Column:
        return F.sum(F.coalesce(F.size(F.filter("boxes", lambda b: b["class_id"] == k)), F.lit(0)))

    return images.groupBy("split").agg(
        F.count("*").alias("images"),
        F.count("boxes").alias("labels"),
        F.sum(n).alias("boxes"),
        of(0).alias("fire_boxes"),
        of(1).alias("smoke_boxes"),
        F.count_if(F.col("boxes").isNotNull() & (n == 0)).alias("empty"),
        F.count_distinct("width", "height").alias("resolutions"),
    )


def statistics(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, median and 95th percentile (interpolated), null when empty; exact, by refined histograms."""
    return prefix.quantiles(rows, value, list(by), {"median": 0.5, "p95": 0.95})


def rigidity(history: DataFrame, *by: str) -> DataFrame:
    """By track, population variation of area, deviation of aspect, growth and span."""
    first = F.min_by("area", "ts_sec")
    return history.groupBy(*by).agg(
        (F.stddev_pop("area") / F.nullif(F.avg("area"), F.lit(0.0))).alias("area_cv"),
        F.stddev_pop("aspect").alias("aspect_std"),
        (F.max_by("area", "ts_sec") / F.nullif(first, F.lit(0.0))).alias("growth"),
        (F.max("ts_sec") - F.min("ts_sec")).alias("span"),
    )


def complete_mean(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """The mean, but null unless every row has a value."""
    full = F.count(value) == F.count("*")
    return rows.groupBy(*by).agg(F.when(full, F.avg(value)).alias("mean"))


def pair_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of unordered pairs."""
    return (
        pairs.select(F.array_sort(F.array(a, b)).alias("p"))
        .groupBy(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
        .agg(F.count("*").alias("n"))
    )


def prediction_audit(predictions: DataFrame) -> DataFrame:
    """Boxes, inverted and degenerate ones; x1, y1, x2, y2."""
    inverted = (F.col("x2") < F.col("x1")) | (F.col("y2") < F.col("y1"))
    flat = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    return predictions.agg(
        F.count("*").alias("total"), F.count_if(inverted).alias("inverted"), F.count_if(flat).alias("degenerate")
    )


def first_confirmation(frames: DataFrame, *by: str) -> DataFrame:
    """Frames and events by state, and when a confirmed one first appears."""
    confirmed = F.col("n_confirmed") > 0
    return frames.groupBy(*by).agg(
        F.count("*").alias("frames"),
        F.count_if(F.col("n_raw") > 0).alias("raw_frames"),
        F.count_if(confirmed).alias("confirmed_frames"),
        F.min(F.when(confirmed, F.col("ts_sec"))).alias("first_confirmed"),
    )


def systematic_sample(rows: DataFrame, by: list[str], order: list[str], parts: int = 16) -> DataFrame:
    """Of each group every max(1, n // parts)-th row in order."""
    from pyspark.sql.window import Window

    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).withColumn(
        "_n", F.count("*").over(Window.partitionBy(*by))
    )
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / parts))
    return ranked.where(F.col("_i") % step == 0).drop("_i", "_n")


def clip_summary(clips: DataFrame) -> DataFrame:
    """By variant, event metrics of per-clip rows; null where a denominator is 0.

    clips: variant, label (true: an event), detected, ttd_sec, false_frames, negative_frames,
    incidents, negative_sec.
    """
    event, hit = F.col("label"), F.coalesce(F.col("detected"), F.lit(False))
    tp, fn = F.count_if(event & hit), F.count_if(event & ~hit)
    fp, tn = F.count_if(~event & hit), F.count_if(~event & ~hit)
    rows = clips.groupBy("variant").agg(
        tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), tn.alias("tn"),
        F.avg(F.when(event, F.col("ttd_sec"))).alias("mean_ttd"),
        F.median(F.when(event, F.col("ttd_sec"))).alias("median_ttd"),
        F.count_if(event & (F.col("ttd_sec") <= 1)).alias("within_1s"),
        F.count_if(event & (F.col("ttd_sec") <= 3)).alias("within_3s"),
        F.sum("false_frames").alias("false_frames"), F.sum("negative_frames").alias("negative_frames"),
        F.sum("incidents").alias("incidents"), F.sum("negative_sec").alias("negative_sec"),
    )
    c = F.col
    return rows.select(
        "variant", "tp", "fn", "fp", "tn", "mean_ttd", "median_ttd", "within_1s", "within_3s",
        F.try_divide(c("tp"), c("tp") + c("fn")).alias("recall"),
        F.try_divide(c("tn"), c("tn") + c("fp")).alias("specificity"),
        F.try_divide(c("tp"), c("tp") + c("fp")).alias("precision"),
        F.try_divide(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        F.try_divide(100 * c("false_frames"), c("negative_frames")).alias("false_percent"),
        F.try_divide(3600 * c("incidents"), c("negative_sec")).alias("alarms_per_hour"),
    )


def best_per_frame(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """The row of each frame with the greatest value; the first in order on ties."""
    first = F.min_by(F.struct(*rows.columns), F.struct((-F.col(value)).alias("v"), *order))
    return rows.groupBy(*by).agg(first.alias("_x")).select("_x.*")


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in order, where that is asked for."""
    return rows.orderBy(*order).limit(n)


def iou_rows(metrics: DataFrame) -> DataFrame:
    """P5: box counts of the clips and variants that have reviewed frames, with precision and recall."""
    tp = F.col("box_tp")
    return metrics.where("reviewed_frames > 0").select(
        "clip", "variant", "reviewed_frames", "box_tp", "box_fp", "box_fn",
        (tp / F.nullif(tp + F.col("box_fp"), F.lit(0))).alias("precision"), (tp / F.nullif(tp + F.col("box_fn"), F.lit(0))).alias("recall"),
    )

