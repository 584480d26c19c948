"""Queries over images and boxes: profiles, geometry, validators, matching, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import boxes as bx
from tidemark.functions import text as tx
from tidemark.operators import match, metrics, profile, segment
from tidemark.plans import tables as t


def a1_dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dataset_profile(t.images(spark, sf_dir))


def a2_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.resolution_histogram(t.images(spark, sf_dir), "dataset")


def o2_top_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_resolutions(t.images(spark, sf_dir), 10)


def a3_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.aspect_histogram(t.images(spark, sf_dir))


def a4_co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.co_occurrence(t.images(spark, sf_dir))


def a5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.class_distribution(t.images(spark, sf_dir))


def a6_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.scale_histogram(t.images(spark, sf_dir))


def a7_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rolled_up(a1_dataset_profile(spark, sf_dir), "dataset", "total", "valid", "boxes")


def a8_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.split_counts(t.images(spark, sf_dir), "split", "dataset", ["de", "en", "es", "fr"])


def a10_label_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.label_statistics(t.images(spark, sf_dir))


def a22_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.images(spark, sf_dir).groupBy("dataset").agg(F.count_distinct("split", "width").alias("n"))


def a24_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.boxes(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("n"), F.count_distinct("image").alias("images"))


def a26_prediction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = t.boxes(spark, sf_dir).withColumn("x1", F.col("x1") + F.when(F.col("ord") == 3, 70).otherwise(0))
    return profile.prediction_audit(shifted)


def f1_unusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = profile.unusable(F.col("width"), F.col("height"), F.col("is_corrupt"))
    return t.images(spark, sf_dir).where(bad).select("path", "width", "height")


def f4_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.boxes(spark, sf_dir).where((F.col("conf") >= 0.22) & (F.col("cls") == 0))
    box = bx.clipped(F.struct("x1", "y1", "x2", "y2"), F.lit(400), F.lit(150))
    cut = rows.select("image", "ord", box.alias("b")).where("b.x2 > b.x1 AND b.y2 > b.y1")
    return cut.select("image", "ord", *[F.round(f"b.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


def x14_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's box against the next line's of its order."""
    a = t.boxes(spark, sf_dir)
    b = a.select("image", (F.col("ord") - 1).alias("ord"), *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")])
    p = F.struct("x1", "y1", "x2", "y2")
    q = F.struct(*[F.col(f"o_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    side = bx.scaled_side(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(640), F.lit(480))
    return a.join(b, ["image", "ord"]).select(
        "image", "ord", F.round(bx.iou(p, q), 6).alias("iou"), F.round(bx.iou_floored(p, q), 6).alias("iou_floored"),
        F.round(bx.gaussian_similarity(p, q), 6).alias("similarity"), bx.near(p, q).alias("near"),
        F.round(side, 6).alias("side"), bx.size_tag(side).alias("tag"), bx.pixel_scale(bx.area(p)).alias("scale"),
        F.array_join(bx.evaluation_bins(side), "+").alias("bins"), bx.confidence_floor(side).alias("least"),
    )


def x21_wise_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.boxes(spark, sf_dir)
    p = F.struct("x1", "y1", "x2", "y2")
    q = F.struct(*[(F.col(c) + 3).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return rows.select("image", "ord", F.round(bx.wise_iou(p, q), 6).alias("value"))


def x22_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.boxes(spark, sf_dir)
    score = bx.hazard_score(F.col("ord").cast("double"), F.col("x1") / 200, F.col("cls") == 1, F.col("conf"))
    return rows.select("image", "ord", F.round(score, 6).alias("score"))


def x10_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each preset says of each line."""
    lines = t.mapped(spark, sf_dir, t.LINES)
    rules = {"v1": bx.V1, "v2": bx.V2, "v3": bx.V3, "v4": bx.V4, "v5": bx.V5}
    return bx.line_errors(lines, "line", rules).select("l_orderkey", "l_linenumber", *rules)


def line_errors(tolerance: str, extents: bool, floats: bool) -> str:
    whole = "" if floats else "WHEN NOT regexp_matches(k, '^[+-]?[0-9]+$') THEN 'class'"
    wide = f"""WHEN x - w / 2 < -{tolerance} OR x + w / 2 > 1 + {tolerance} OR y - h / 2 < -{tolerance}
         OR y + h / 2 > 1 + {tolerance} THEN 'extents'""" if extents else ""
    return f"""CASE WHEN n <> 5 THEN 'tokens' {whole} WHEN CAST(k AS DOUBLE) NOT IN (0, 1) THEN 'class'
         WHEN x IS NULL THEN 'number' WHEN w <= 0 OR h <= 0 THEN 'degenerate'
         WHEN w > 1 + {tolerance} OR h > 1 + {tolerance} THEN 'size'
         WHEN x < -{tolerance} OR x > 1 + {tolerance} THEN 'centre' {wide} END"""


def x1_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1-X7, X27, X28, W12 on image names."""
    rows = t.images(spark, sf_dir)
    stem = tx.stem(F.col("filename"))
    prefix, number = tx.frame_prefix(stem), tx.frame_index(stem)
    return rows.select(
        "doc_id", stem.alias("stem"), prefix.alias("prefix"), number.alias("number"), tx.clean_prefix(prefix).alias("clean"),
        tx.category(F.col("filename")).alias("category"), tx.clip_id(F.col("path")).alias("clip_id"),
        tx.block_id(tx.clean_prefix(prefix), number, 50).alias("block50"), tx.block_id(tx.clean_prefix(prefix), number, 20).alias("block20"),
        tx.aspect_text(F.col("width"), F.col("height")).alias("aspect"),
    )


def x12_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "lineitem")
    cell = F.when(F.col("l_linenumber") == 1, " ").when(F.col("l_linenumber") == 2, "5d").otherwise(
        (F.col("l_quantity") - 12).cast("int").cast("string")
    )
    flag, time = tx.accepted_number("should_alert_human", cell), tx.accepted_number("t_start", cell)
    return rows.select(
        "l_orderkey", "l_linenumber", flag["ok"].alias("flag_ok"), time["ok"].alias("time_ok"), time["value"].alias("value")
    )


def ma_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_counts(t.moved(spark, sf_dir), t.boxes(spark, sf_dir), ["image"])


def mb_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = t.boxes(spark, sf_dir).where("cls = 0").withColumn("side640", _side())
    return match.scored_predictions(t.moved(spark, sf_dir).where("cls = 0"), truth, ["image"])


def mc_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = match.scored_predictions(t.moved(spark, sf_dir), t.boxes(spark, sf_dir), ["image"], coordinates=True)
    return scored.groupBy("image").agg(F.sum("tp").alias("matched"), F.count("*").alias("predictions"))


def md_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.parity(t.boxes(spark, sf_dir), t.moved(spark, sf_dir), ["image"])


def _side() -> Column:
    return bx.scaled_side(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(640), F.lit(480))


def e1_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions, truth = (x.withColumn("side640", _side()) for x in (t.moved(spark, sf_dir), t.boxes(spark, sf_dir)))
    found = metrics.average_precision(metrics.scored_detections(predictions, truth, ["image"]))
    return found.select("cls", "bin", "n_truth", *[F.round(c, 6).alias(c) for c in ("ap", "ap50", "ap75", "ar")])


def e2_operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = t.boxes(spark, sf_dir).where("cls = 0").withColumn("side640", _side())
    scored = mb_scored(spark, sf_dir).withColumn("fp", 1 - F.col("tp"))
    curve = segment.operating_curve(scored, "conf", ["tiny", "small", "fp"], [])
    sizes = truth.agg(F.count_distinct("image").alias("images"), F.count_if(F.col("side640") < 16).alias("n_tiny"))
    return metrics.operating_points(curve, sizes)


def e1_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, average precision alone: order lines as judged detections of four bins."""
    rows = t.table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 2).cast("int").alias("cls"), F.concat("l_returnflag", "l_linestatus").alias("bin"), F.col("l_extendedprice").alias("conf"), "l_discount"
    )
    hits = sum((F.when(F.col("l_discount") > F.lit(x) / 10 - 0.0025, 1 << k).otherwise(0) for k, x in enumerate(metrics.THRESHOLDS)), F.lit(0))
    judged = rows.select("cls", "bin", "conf", hits.alias("hits"), F.lit((1 << len(metrics.THRESHOLDS)) - 1).alias("counted"), F.lit(1).cast("long").alias("n"))
    found = metrics.precision_of(judged, rows.groupBy("cls", "bin").agg(F.count("*").alias("n_truth")))
    return found.select("cls", "bin", "n_truth", *[F.round(c, 6).alias(c) for c in ("ap", "ap50", "ap75", "ar")])


def e2_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2, W13 over one global curve: order lines by price."""
    rows = t.table(spark, sf_dir, "lineitem")
    scored = rows.select(
        F.col("l_extendedprice").alias("conf"), (F.col("l_quantity") < 10).cast("long").alias("tiny"), (F.col("l_quantity") < 30).cast("long").alias("small"),
        (F.col("l_discount") > 0.045).cast("long").alias("fp"),
    )
    sizes = rows.agg(F.count_distinct("l_orderkey").alias("images"), F.count_if(F.col("l_quantity") < 10).alias("n_tiny"))
    return metrics.operating_points(segment.operating_curve(scored, "conf", ["tiny", "small", "fp"], []), sizes)


def e8_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a1_dataset_profile(spark, sf_dir)
    other = rows.withColumn("boxes", F.col("boxes") + F.when(F.col("dataset") == "en", 1).otherwise(0))
    return metrics.compared(rows, other, ["dataset"])


def p4_safe_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_linenumber") == 1, "NaN").when(F.col("l_linenumber") == 2, "x").otherwise(F.col("l_tax").cast("string"))
    return rows.select("l_orderkey", "l_linenumber", tx.safe_float(value, 0.0, 5).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        a1_dataset_profile, a2_resolutions, o2_top_resolutions, a3_aspects, a4_co_occurrence, a5_classes, a6_scales, a7_roll_up,
        a8_split_counts, a10_label_statistics, a22_distinct, a24_detections, a26_prediction_audit, f1_unusable, f4_clipped,
        x14_geometry, x21_wise_iou, x22_hazard, x10_validators, x1_names, x12_accepted, ma_match_counts, mb_scored,
        mc_match_count, md_parity, e1_average_precision, e1_curve, e2_operating_points, e2_points, e8_compared, p4_safe_floats,
    )
}

_IMG = f"WITH {t.IMAGE_BOXES}"
_BOX = f"WITH b AS ({t.BOXES})"
_PROFILE = """SELECT dataset, count(*) AS total, count(*) FILTER (NOT is_corrupt) AS valid,
       count(*) FILTER (NOT is_corrupt AND n % 4 > 0) AS annotated, count(*) FILTER (NOT is_corrupt AND n % 4 = 0) AS empty,
       count(*) FILTER (is_corrupt) AS corrupt, CAST(sum(CASE WHEN is_corrupt THEN 0 ELSE n % 4 END) AS BIGINT) AS boxes
FROM img GROUP BY dataset"""

ORACLE_SQL = {
    "e1_curve": """WITH r AS (SELECT l_linenumber % 2 AS cls, concat(l_returnflag, l_linestatus) AS bin, l_extendedprice AS conf, l_discount FROM lineitem),
        tr AS (SELECT cls, bin, count(*) AS n_truth FROM r GROUP BY ALL), th AS (SELECT (50 + 5 * range) / 100 AS iou FROM range(10)),
        lv AS (SELECT cls, bin, iou, conf, sum(CASE WHEN l_discount > iou / 10 - 0.0025 THEN 1 ELSE 0 END) AS tp, count(*) AS n FROM r, th GROUP BY ALL),
        cu AS (SELECT cls, bin, iou, conf, sum(tp) OVER w AS tp, sum(n) OVER w AS n FROM lv WINDOW w AS (PARTITION BY cls, bin, iou ORDER BY conf DESC)),
        be AS (SELECT cls, bin, iou, conf, tp / n_truth AS recall, max(tp / n) OVER (PARTITION BY cls, bin, iou ORDER BY conf) AS best,
                 floor(tp / n_truth * 100 + 1e-9) AS steps FROM cu JOIN tr USING (cls, bin)),
        ar AS (SELECT *, steps - coalesce(lag(steps) OVER (PARTITION BY cls, bin, iou ORDER BY conf DESC), -1) AS points FROM be),
        ap AS (SELECT cls, bin, iou, sum(points * best) / 101 AS ap, max(recall) AS ar FROM ar GROUP BY ALL)
        SELECT CAST(cls AS INT) AS cls, bin, n_truth, round(avg(ap), 6) AS ap, round(max(ap) FILTER (iou = 0.5), 6) AS ap50, round(max(ap) FILTER (iou = 0.75), 6) AS ap75,
          round(avg(ar), 6) AS ar FROM ap JOIN tr USING (cls, bin) GROUP BY cls, bin, n_truth""",
    "e2_points": """WITH c AS (SELECT DISTINCT l_extendedprice AS conf, count(*) FILTER (l_quantity < 10) OVER w AS tiny, count(*) FILTER (l_quantity < 30) OVER w AS small,
          count(*) FILTER (l_discount > 0.045) OVER w AS fp FROM lineitem WINDOW w AS (ORDER BY l_extendedprice DESC)),
        z AS (SELECT count(DISTINCT l_orderkey) AS images, count(*) FILTER (l_quantity < 10) AS n_tiny FROM lineitem),
        b AS (SELECT conf, tiny, small, fp FROM c, z WHERE fp <= 0.3::DOUBLE * images ORDER BY tiny DESC, small DESC, fp, conf DESC LIMIT 1)
        SELECT coalesce(b.conf, 1.000001) AS conf, coalesce(b.tiny, 0) AS tiny, coalesce(b.small, 0) AS small, coalesce(b.fp, 0) AS fp,
          (SELECT max(conf) FROM c, z WHERE tiny >= 0.9::DOUBLE * n_tiny) AS conf_at_recall FROM z LEFT JOIN b ON true""",
    "a1_dataset_profile": f"{_IMG} {_PROFILE}",
    "a2_resolutions": f"{_IMG} SELECT dataset, concat(width, 'x', height) AS resolution, count(*) AS n FROM img GROUP BY ALL",
    "o2_top_resolutions": f"""{_IMG} SELECT concat(width, 'x', height) AS resolution, count(*) AS n FROM img
        GROUP BY ALL ORDER BY n DESC, resolution LIMIT 10""",
    "a3_aspects": f"""{_IMG} SELECT CASE WHEN abs(width / height - 16 / 9) < 0.05 THEN '16:9'
        WHEN abs(width / height - 4 / 3) < 0.05 THEN '4:3' WHEN abs(width / height - 1) < 0.05 THEN '1:1'
        WHEN abs(width / height - 3 / 2) < 0.05 THEN '3:2' WHEN abs(width / height - 9 / 16) < 0.05 THEN '9:16'
        ELSE format('{{:.2f}}:1', width / height) END AS aspect, count(*) AS n FROM img GROUP BY ALL""",
    "a4_co_occurrence": f"""{_IMG}, k AS (SELECT path, bool_or(class_id = 0) AS f, bool_or(class_id = 1) AS s FROM box GROUP BY path)
        SELECT dataset, CASE WHEN f AND s THEN 'both' WHEN f THEN 'fire_only' WHEN s THEN 'smoke_only' ELSE 'neither' END AS kind,
        count(*) AS n FROM img LEFT JOIN k USING (path) GROUP BY ALL""",
    "a5_classes": f"{_IMG} SELECT dataset, CAST(class_id AS INT) AS class_id, count(*) AS n FROM box GROUP BY ALL",
    "a6_scales": f"""{_IMG}, s AS (SELECT dataset, CASE WHEN w * width * h * height < 1024 THEN 'small'
        WHEN w * width * h * height <= 9216 THEN 'medium' ELSE 'large' END AS scale FROM box)
        SELECT d.dataset, x.scale, count(s.scale) AS n FROM (SELECT DISTINCT dataset FROM img) d
        CROSS JOIN (VALUES ('small'), ('medium'), ('large')) x(scale) LEFT JOIN s ON s.dataset = d.dataset AND s.scale = x.scale
        GROUP BY ALL""",
    "a7_roll_up": f"""{_IMG}, p AS ({_PROFILE}) SELECT dataset, CAST(sum(total) AS BIGINT) AS total, CAST(sum(valid) AS BIGINT) AS valid,
        CAST(sum(boxes) AS BIGINT) AS boxes FROM p GROUP BY GROUPING SETS ((dataset), ())""",
    "a8_split_counts": f"""{_IMG} SELECT split, count(*) FILTER (dataset = 'de') AS de, count(*) FILTER (dataset = 'en') AS en,
        count(*) FILTER (dataset = 'es') AS es, count(*) FILTER (dataset = 'fr') AS fr FROM img GROUP BY split""",
    "a10_label_statistics": f"""{_IMG}, c AS (SELECT split, count(*) FILTER (class_id = 0) AS f, count(*) FILTER (class_id = 1) AS s FROM box GROUP BY split)
        SELECT split, count(*) AS images, count(*) AS labels, CAST(sum(n % 4) AS BIGINT) AS boxes, any_value(f) AS fire_boxes,
        any_value(s) AS smoke_boxes, count(*) FILTER (n % 4 = 0) AS empty, count(DISTINCT (width, height)) AS resolutions
        FROM img JOIN c USING (split) GROUP BY split""",
    "a22_distinct": f"{_IMG} SELECT dataset, count(DISTINCT (split, width)) AS n FROM img GROUP BY dataset",
    "a24_detections": f"{_BOX} SELECT cls, count(*) AS n, count(DISTINCT image) AS images FROM b GROUP BY cls",
    "a26_prediction_audit": f"""{_BOX}, s AS (SELECT x1 + CASE WHEN ord = 3 THEN 70 ELSE 0 END AS x1, y1, x2, y2 FROM b)
        SELECT count(*) AS total, count(*) FILTER (x2 < x1 OR y2 < y1) AS inverted,
        count(*) FILTER (x2 <= x1 OR y2 <= y1) AS degenerate FROM s""",
    "f1_unusable": f"{_IMG} SELECT path, width, height FROM img WHERE width <= 0 OR height <= 0 OR is_corrupt",
    "f4_clipped": f"""{_BOX}, c AS (SELECT image, ord, greatest(0, least(x1, 400)) AS x1, greatest(0, least(y1, 150)) AS y1,
        greatest(0, least(x2, 400)) AS x2, greatest(0, least(y2, 150)) AS y2 FROM b WHERE conf >= 0.22 AND cls = 0)
        SELECT image, ord, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM c WHERE x2 > x1 AND y2 > y1""",
    "x14_geometry": f"""{_BOX}, p AS (SELECT a.*, o.x1 AS u1, o.y1 AS v1, o.x2 AS u2, o.y2 AS v2,
          greatest(least(a.x2, o.x2) - greatest(a.x1, o.x1), 0) * greatest(least(a.y2, o.y2) - greatest(a.y1, o.y1), 0) AS i,
          (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (o.x2 - o.x1) * (o.y2 - o.y1) AS ao FROM b a JOIN b o ON o.image = a.image AND o.ord = a.ord + 1),
        q AS (SELECT *, sqrt(aa) * 640 / 640 AS side, sqrt(pow((x1 + x2) / 2 - (u1 + u2) / 2, 2) + pow((y1 + y2) / 2 - (v1 + v2) / 2, 2)) AS d FROM p)
        SELECT image, ord, round(i / (aa + ao - i), 6) AS iou, round(i / greatest(aa + ao - i, 1e-12), 6) AS iou_floored,
          round(exp(-sqrt(d * d + (pow(x2 - x1 - u2 + u1, 2) + pow(y2 - y1 - v2 + v1, 2)) / 4) / 12.8), 6) AS similarity,
          d <= 2.5 * greatest(x2 - x1, y2 - y1, u2 - u1, v2 - v1) AS near, round(side, 6) AS side,
          CASE WHEN side <= 16 THEN 'TINY' WHEN side <= 32 THEN 'SMALL' ELSE 'MEDIUM_LARGE' END AS tag,
          CASE WHEN aa < 1024 THEN 'small' WHEN aa <= 9216 THEN 'medium' ELSE 'large' END AS scale,
          array_to_string(list_filter([CASE WHEN side < 16 THEN 'tiny' END, CASE WHEN side < 32 THEN 'small' END,
            CASE WHEN side >= 16 AND side < 32 THEN '16-32' END, CASE WHEN side >= 32 AND side < 96 THEN 'medium' END,
            CASE WHEN side >= 96 THEN 'large' END], lambda x: x IS NOT NULL), '+') AS bins,
          CAST(CASE WHEN side <= 32 THEN 0.14 ELSE 0.22 END AS DOUBLE) AS least FROM q""",
    "x21_wise_iou": f"""{_BOX}, p AS (SELECT image, ord, greatest(x2 - x1 - 3, 0) * greatest(y2 - y1 - 3, 0) AS i, (x2 - x1) * (y2 - y1) AS a,
          18 / (pow(x2 - x1 + 3, 2) + pow(y2 - y1 + 3, 2)) AS r FROM b), q AS (SELECT *, i / (2 * a - i) AS u FROM p)
        SELECT image, ord, round(exp(r) * u * (1 - u) / (3 * pow(1.9, 1 - u - 3)), 6) AS value FROM q""",
    "x22_hazard": f"""{_BOX} SELECT image, ord, round(greatest(0, least(100, 30 * least(1, ord / 5) + 25 * least(1, greatest(0, x1 / 200 - 1))
        + 25 * cls + 20 * conf)), 6) AS score FROM b""",
    "x10_validators": f"""WITH l AS ({t.duck(t.LINES)}), s AS (SELECT *, string_split(line, ' ') AS p FROM l),
        v AS (SELECT l_orderkey, l_linenumber, len(p) AS n, p[1] AS k, CASE WHEN p[2] <> 'nan' THEN CAST(p[2] AS DOUBLE) END AS x,
          CAST(p[3] AS DOUBLE) AS y, CAST(p[4] AS DOUBLE) AS w, CAST(p[5] AS DOUBLE) AS h FROM s)
        SELECT l_orderkey, l_linenumber, {line_errors("1e-4", True, False)} AS v1, {line_errors("1e-4", False, False)} AS v2,
          {line_errors("0.0", False, True)} AS v3, {line_errors("0.0", False, False)} AS v4, {line_errors("1e-7", True, False)} AS v5 FROM v""",
    "x1_names": f"""{_IMG}, s AS (SELECT *, regexp_replace(filename, '\\.[^.]*$', '') AS stem FROM img),
        p AS (SELECT *, regexp_replace(stem, '[0-9]+$', '') AS prefix, CAST(regexp_extract(stem, '([0-9]+)$', 1) AS BIGINT) AS number FROM s),
        c AS (SELECT *, regexp_replace(regexp_replace(prefix, '_CV$', ''), '[_-]+$', '') AS clean FROM p)
        SELECT doc_id, stem, prefix, number, clean, split_part(filename, '_', 1) AS category,
          concat(regexp_extract(path, 'img/(.*)\\.jpg', 1), '-', substr(sha256(path), 1, 10)) AS clip_id,
          concat(clean, '_', CASE WHEN number // 50 > 9999 THEN CAST(number // 50 AS VARCHAR) ELSE lpad(CAST(number // 50 AS VARCHAR), 4, '0') END) AS block50,
          concat(clean, '_', CASE WHEN number // 20 > 9999 THEN CAST(number // 20 AS VARCHAR) ELSE lpad(CAST(number // 20 AS VARCHAR), 4, '0') END) AS block20,
          format('{{:.3f}}', width / height) AS aspect FROM c""",
    "x12_accepted": """WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 2 THEN CAST(l_quantity - 12 AS INT) END AS v FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_linenumber = 1 OR coalesce(v IN (0, 1), false) AS flag_ok,
          l_linenumber = 1 OR coalesce(v >= 0 OR v = -1, false) AS time_ok, CAST(v AS DOUBLE) AS value FROM c""",
    "e8_compared": f"""{_IMG}, p AS ({_PROFILE}) SELECT dataset, field, NOT (dataset = 'en' AND field = 'boxes') AS ok FROM p
        CROSS JOIN (VALUES ('total'), ('valid'), ('annotated'), ('empty'), ('corrupt'), ('boxes')) f(field)""",
    "p4_safe_floats": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN 0.0::DOUBLE ELSE round(l_tax, 5) END AS value FROM lineitem""",
}
