"""Box geometry, size classes and label-line validation as column expressions.

Corner boxes are structs with x1, y1, x2, y2; centre boxes have x_center, y_center, width, height.
Three size scales are kept apart: by pixel area, by the side after a fit to 640, and by evaluation bins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text

#: Limits of the size scales and of the hazard score.
SMALL_AREA, MEDIUM_AREA = 1024, 9216
FIT_SIDE, TINY_SIDE, SMALL_SIDE = 640, 16, 32
BIN_SIDES = (16, 32, 96)


def corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corners of a centre box."""
    return F.struct(
        (x - w / 2).alias("x1"), (y - h / 2).alias("y1"), (x + w / 2).alias("x2"), (y + h / 2).alias("y2")
    )


def centre(box: Column) -> Column:
    return F.struct(
        ((box["x1"] + box["x2"]) / 2).alias("x_center"), ((box["y1"] + box["y2"]) / 2).alias("y_center"),
        (box["x2"] - box["x1"]).alias("width"), (box["y2"] - box["y1"]).alias("height"),
    )


def clipped(box: Column, width: Column, height: Column) -> Column:
    """The part of a box inside the image."""

    def within(v: Column, most: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(v, most.cast("double")))

    return F.struct(
        within(box["x1"], width).alias("x1"), within(box["y1"], height).alias("y1"),
        within(box["x2"], width).alias("x2"), within(box["y2"], height).alias("y2"),
    )


def area(box: Column) -> Column:
    return F.greatest(box["x2"] - box["x1"], F.lit(0.0)) * F.greatest(box["y2"] - box["y1"], F.lit(0.0))


def _overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """0 where the union is empty."""
    both = _overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def iou_floored(a: Column, b: Column) -> Column:
    """The union is at least 1e-12."""
    both = _overlap(a, b)
    return both / F.greatest(area(a) + area(b) - both, F.lit(1e-12))


def pixel_scale(pixels: Column) -> Column:
    """By area; null without one."""
    return (
        F.when(pixels < SMALL_AREA, "small").when(pixels <= MEDIUM_AREA, "medium").when(pixels > MEDIUM_AREA, "large")
    )


def scaled_side(w: Column, h: Column, image_w: Column, image_h: Column) -> Column:
    """Side of the square of equal area after the image is fitted to 640."""
    return F.sqrt(w * h) * FIT_SIDE / F.greatest(image_w, image_h)


def size_tag(side: Column) -> Column:
    """Upper limits included."""
    return F.when(side <= TINY_SIDE, "TINY").when(side <= SMALL_SIDE, "SMALL").otherwise("MEDIUM_LARGE")


def evaluation_bins(side: Column) -> Column:
    """The bins a side belongs to; upper limits excluded, bins overlap."""
    tiny, small, large = BIN_SIDES
    bins = F.array(
        F.when(side < tiny, F.lit("tiny")), F.when(side < small, F.lit("small")),
        F.when((side >= tiny) & (side < small), F.lit("16-32")),
        F.when((side >= small) & (side < large), F.lit("medium")), F.when(side >= large, F.lit("large")),
    )
    return F.filter(bins, lambda b: b.isNotNull())


def xywh(box: Column, factor: Column | float = 1.0) -> Column:
    """Corner and extents; inverted edges have no extent."""
    k = factor if isinstance(factor, Column) else F.lit(factor)
    return F.array(
        box["x1"] * k, box["y1"] * k,
        F.greatest(box["x2"] - box["x1"], F.lit(0.0)) * k, F.greatest(box["y2"] - box["y1"], F.lit(0.0)) * k,
    )


def confidence_floor(side: Column, small: float = 0.14, other: float = 0.22) -> Column:
    """small boxes may be less certain."""
    return F.when(side <= SMALL_SIDE, small).otherwise(other)


def gaussian_distance(a: Column, b: Column) -> Column:
    """Wasserstein distance of the boxes' Gaussians (centres, half extents)."""
    p, q = centre(a), centre(b)
    return F.sqrt(
        F.pow(p["x_center"] - q["x_center"], 2) + F.pow(p["y_center"] - q["y_center"], 2)
        + (F.pow(p["width"] - q["width"], 2) + F.pow(p["height"] - q["height"], 2)) / 4
    )


def gaussian_similarity(a: Column, b: Column, constant: float = 12.8) -> Column:
    """X20."""
    return F.exp(-gaussian_distance(a, b) / constant)


def wise_iou(a: Column, b: Column, mean_loss: float = 1.0, alpha: float = 1.9, delta: float = 3.0) -> Column:
    """Distance-weighted IoU with a focusing factor; the running mean is a constant here."""
    p, q = centre(a), centre(b)
    enclosing = F.pow(F.greatest(a["x2"], b["x2"]) - F.least(a["x1"], b["x1"]), 2) + F.pow(
        F.greatest(a["y2"], b["y2"]) - F.least(a["y1"], b["y1"]), 2
    )
    apart = F.pow(p["x_center"] - q["x_center"], 2) + F.pow(p["y_center"] - q["y_center"], 2)
    value = iou(a, b)
    beta = (1 - value) / mean_loss
    focus = beta / (delta * F.pow(F.lit(alpha), beta - delta))
    return F.exp(apart / F.greatest(enclosing, F.lit(1e-12))) * value * focus


def hazard_score(duration: Column, growth: Column, together: Column, ema: Column) -> Column:
    """30 for duration, 25 for growth, 25 for co-occurrence, 20 for confidence; within 0 and 100."""
    score = (
        30 * F.least(F.lit(1.0), duration / 5)
        + 25 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), growth - 1))
        + 25 * together.cast("double")
        + 20 * ema
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def near(a: Column, b: Column, sides: float = 2.5) -> Column:
    """Centres within a multiple of the longest side."""
    p, q = centre(a), centre(b)
    longest = F.greatest(p["width"], p["height"], q["width"], q["height"])
    return F.hypot(p["x_center"] - q["x_center"], p["y_center"] - q["y_center"]) <= sides * longest


@dataclass(frozen=True)
class LineRule:
    """How a validator judges a label line; the five presets disagree on purpose."""

    tolerance: float
    classes: int = 2
    extents: bool = False
    clamp: bool = False
    whole_floats: bool = False  # a class written as 0.0 counts


V1 = LineRule(1e-4, extents=True, clamp=True)
V2 = LineRule(1e-4)
V3 = LineRule(0.0, whole_floats=True)
V4 = LineRule(0.0)
V5 = LineRule(1e-7, extents=True)


def validated_line(line: Column, rule: LineRule) -> Column:
    """struct<error, class_id, x_center, y_center, width, height>; error names the first broken rule.

    Not-a-number and infinite values are always rejected; a blank line is null.
    """
    tokens = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")

    def parsed(t: Column) -> Column:
        kind = text.number(F.get(t, F.lit(0))) if rule.whole_floats else text.integer(F.get(t, F.lit(0)))
        numbers = [text.number(F.get(t, F.lit(i))).alias(n) for i, n in enumerate("xywh", 1)]
        return F.struct(F.size(t).alias("n"), kind.cast("double").alias("kind"), *numbers)

    # lambdas over one-element arrays name what would otherwise be repeated in every rule
    judged = F.transform(F.transform(F.array(tokens), parsed), lambda v: _judged(v, rule))
    return F.when(F.trim(line) != "", F.get(judged, F.lit(0)))


def validated_lines(rows: DataFrame, line: str, rule: LineRule, name: str = "checked") -> DataFrame:
    """The rows with `validated_line` of one preset; numbers are parsed once, in columns of their own."""
    return _parsed(rows, line).withColumn(name, F.when(F.trim(line) != "", _judged(_numbers(rule), rule))).drop(*_PARSED)


def line_errors(rows: DataFrame, line: str, rules: dict[str, LineRule]) -> DataFrame:
    """The first rule that each preset finds broken, as a column a preset; null for sound and blank lines.

    A line is split and its numbers are parsed once, in columns of their own, whatever the number of presets.
    """
    found = {name: F.when(F.trim(line) != "", _judged(_numbers(rule), rule)["error"]) for name, rule in rules.items()}
    return _parsed(rows, line).withColumns(found).drop(*_PARSED)


_PARSED = ["_t", "_whole", *[f"_{c}" for c in "kxywh"]]


def _parsed(rows: DataFrame, line: str) -> DataFrame:
    split = rows.withColumn("_t", F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "))
    split = split.withColumns({f"_{n}": text.number(F.get("_t", F.lit(i))) for i, n in enumerate("kxywh")})
    return split.withColumn("_whole", F.get("_t", F.lit(0)).rlike(text.INTEGER))


def _numbers(rule: LineRule) -> Column:
    kind = F.col("_k") if rule.whole_floats else F.when(F.col("_whole"), F.col("_k"))
    return F.struct(F.size("_t").alias("n"), kind.alias("kind"), *[F.col(f"_{c}").alias(c) for c in "xywh"])


def _judged(v: Column, rule: LineRule) -> Column:
    kind, x, y, w, h = v["kind"], v["x"], v["y"], v["w"], v["h"]
    low, high = -rule.tolerance, 1 + rule.tolerance
    broken = [
        (v["n"] != 5, "tokens"),
        (kind.isNull() | (kind != F.floor(kind)) | ~kind.between(0, rule.classes - 1), "class"),
        (x.isNull() | y.isNull() | w.isNull() | h.isNull(), "number"),
        ((w <= 0) | (h <= 0), "degenerate"),
        ((w > high) | (h > high), "size"),
        (~x.between(low, high) | ~y.between(low, high), "centre"),
    ]
    if rule.extents:
        outside = (x - w / 2 < low) | (x + w / 2 > high) | (y - h / 2 < low) | (y + h / 2 > high)
        broken.append((outside, "extents"))
    first = F.coalesce(*[F.when(test, F.lit(name)) for test, name in broken])
    fine = F.coalesce(*[F.when(test, F.lit(False)) for test, _ in broken], F.lit(True))

    def kept(value: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) if rule.clamp else value

    named = ((x, "x_center"), (y, "y_center"), (w, "width"), (h, "height"))
    return F.struct(
        first.alias("error"), F.when(fine, kind.cast("int")).alias("class_id"),
        *[F.when(fine, kept(value)).alias(name) for value, name in named],
    )
