"""Reports, manifests, split lists and metric files.

Tables are written by Spark.  Reports are small aggregates: they come to the driver and are written
whole, through a file beside the target that is then renamed.
"""

from __future__ import annotations

import csv
import io
import json
import os
from collections.abc import Callable, Iterable

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import text
from tidemark.operators import profile
from tidemark.sources.listing import uri


def _whole(path: str, write: Callable, encoding: str = "utf-8") -> None:
    """Writes a file beside its target in the target's store and renames it, so that it is never seen half."""
    fs, at = pafs.FileSystem.from_uri(uri(path if ":" in path else os.path.abspath(path)))
    made = io.StringIO(newline="")
    write(made)
    fs.create_dir(os.path.dirname(at))
    with fs.open_output_stream(f"{at}.partial") as file:
        file.write(made.getvalue().encode(encoding))
    fs.move(f"{at}.partial", at)


def write_json(path: str, value: object) -> None:
    """K10."""
    _whole(path, lambda f: f.write(json.dumps(value, indent=2, allow_nan=False) + "\n"))


def write_csv(path: str, rows: Iterable[dict], fields: list[str] | None = None, guarded: bool = False) -> None:
    """The header is the union of the rows' keys unless given; K21: guarded, with a byte-order mark."""
    rows = list(rows)
    names = fields or list(dict.fromkeys(k for r in rows for k in r))

    def cell(v: object) -> object:
        return "'" + v if guarded and isinstance(v, str) and v[:1] in tuple("=+-@\t\r") else v

    def write(file) -> None:
        out = csv.DictWriter(file, names, extrasaction="ignore")
        out.writeheader()
        out.writerows({k: cell(v) for k, v in r.items()} for r in rows)

    _whole(path, write, "utf-8-sig" if guarded else "utf-8")


def report(images: DataFrame) -> dict:
    """K1: the profile of every dataset and their sum."""
    datasets = {r["dataset"]: r.asDict() for r in profile.dataset_profile(images).collect()}

    def long(rows: DataFrame, key: str) -> None:
        for r in rows.collect():
            datasets[r["dataset"]].setdefault(key, {})[str(r[1])] = r["n"]

    long(profile.class_distribution(images), "class_distribution")
    long(profile.co_occurrence(images), "co_occurrence")
    long(profile.scale_histogram(images), "box_scales")
    top = {r["resolution"]: r["n"] for r in profile.top_resolutions(images).collect()}
    numbers = ("total", "valid", "annotated", "empty", "corrupt", "boxes")
    return {
        "datasets": datasets, "top_resolutions": top,
        "total": {k: sum(d[k] for d in datasets.values()) for k in numbers},
    }


def markdown(found: dict) -> str:
    """K2."""
    lines = ["# Dataset audit", "", "| dataset | images | annotated | empty | corrupt | boxes |", "|---|---|---|---|---|---|"]
    for name, d in sorted(found["datasets"].items()):
        share = f"{100 * d['annotated'] / d['total']:.1f} %" if d["total"] else "-"
        lines.append(f"| {name} | {d['total']} | {d['annotated']} ({share}) | {d['empty']} | {d['corrupt']} | {d['boxes']} |")
    lines += ["", "## Resolutions", "", *(f"- {k}: {n}" for k, n in found["top_resolutions"].items()), ""]
    return "\n".join(lines)


def save_reports(images: DataFrame, folder: str) -> None:
    """K3."""
    found = report(images)
    write_json(f"{folder}/audit.json", found)
    _whole(f"{folder}/audit.md", lambda f: f.write(markdown(found)))


def write_split(rows: DataFrame, path: str) -> None:
    """K4: sorted POSIX paths, one a line, as one text file in a folder."""
    rows.select(text.posix(F.col("path")).alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def write_data_yaml(path: str, splits: dict[str, str], names: dict[int, str]) -> None:
    """K5."""
    import yaml

    config = {**splits, "nc": len(names), "names": {int(k): v for k, v in sorted(names.items())}}
    _whole(path, lambda f: yaml.safe_dump(config, f, sort_keys=False))


def write_dataset(rows: DataFrame, folder: str, names: dict[int, str]) -> None:
    """K6: three split lists, data.yaml and a summary."""
    splits = {s: f"{folder}/{s}" for s in ("train", "val", "test")}
    for s, path in splits.items():
        write_split(rows.where(F.col("split") == s), path)
    write_data_yaml(f"{folder}/data.yaml", splits, names)
    write_json(f"{folder}/summary.json", {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()})


def nested(frames: DataFrame) -> DataFrame:
    """FRAMES with resolution and boxes structs."""
    return frames.select(
        "filename", "path", "category", "video_id", "frame_index", "sequence_length",
        F.struct("width", "height").alias("resolution"),
        F.struct(F.col("fire_boxes").alias("fire"), F.col("smoke_boxes").alias("smoke")).alias("boxes"), "is_negative",
    )


def manifest_summary(frames: DataFrame) -> dict:
    """K7: numbers of images, frames of sequences, single images and sequences."""
    framed = F.col("category") == "video_frame"
    row = frames.agg(
        F.count("*").alias("n"), F.count_if(framed).alias("framed"),
        F.count_distinct(F.when(framed, F.nullif("video_id", F.lit("")))).alias("sequences"),
    ).first()
    summary = {"video_frames": row["framed"], "static_images": row["n"] - row["framed"], "total_video_sequences": row["sequences"]}
    return {"total_images": row["n"], "summary": summary}


def write_manifest_json(frames: DataFrame, path: str, dataset: str = "") -> None:
    """K7: a folder of JSON lines, the summary first and then one frame a line; read_manifest_json takes it.

    One nested value would be one line of one task, so the frames are values of their own.
    """
    head = frames.sparkSession.createDataFrame([(json.dumps({"dataset": dataset, **manifest_summary(frames)}),)], "value string")
    rows = nested(frames).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    head.coalesce(1).unionAll(rows).write.mode("overwrite").text(path)  # one job: there is no summary without its frames


def write_manifest_csv(frames: DataFrame, path: str) -> None:
    """K8: eleven columns."""
    frames.select(*[f.split()[0] for f in schemas.FRAMES.split(", ")]).write.mode("overwrite").option(
        "header", "true"
    ).csv(path)


def metric_rows(metrics: dict[str, dict]) -> list[dict]:
    """Split to {class: {metric: value}} as one row a split and class."""
    return [{"split": s, "class": c, **values} for s, classes in metrics.items() for c, values in classes.items()]


def write_once(rows: DataFrame, path: str) -> None:
    """An existing target is an error."""
    rows.write.mode("errorifexists").option("header", "true").csv(path)


def write_absent(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys are not there yet; one row of each key."""
    from pyspark.errors import AnalysisException

    rows = rows.dropDuplicates(keys)
    try:
        there = rows.sparkSession.read.parquet(path)
        rows = rows.join(there.select(*keys), keys, "left_anti")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    rows.write.mode("append").parquet(path)


def write_evaluation(clips: DataFrame, path: str) -> None:
    """The tables of an evaluation: every clip and variant as JSON, variants summed up, and box counts of reviewed clips.

    clips: clip_summary's columns and clip, reviewed_frames, box_tp, box_fp, box_fn.
    """
    clips.write.mode("errorifexists").json(f"{path}/per_clip")
    for name, rows in (("summary", profile.clip_summary(clips)), ("iou", profile.iou_rows(clips))):
        rows.write.mode("errorifexists").option("header", "true").csv(f"{path}/{name}")


def write_split_audit(pairs: DataFrame, path: str, most: int = 8) -> None:
    """Adjacent frames of different splits, those that look alike, and counts of both by pair of splits.

    pairs: image_a, split_a, image_b, split_b, dhash_distance.
    """
    near = F.col("dhash_distance") <= most
    splits = F.array_join(F.array_sort(F.array("split_a", "split_b")), "+")
    counts = pairs.groupBy(splits.alias("splits")).agg(F.count("*").alias("adjacent"), F.count_if(near).alias("near"))
    for name, rows in (("adjacent", pairs), ("near", pairs.where(near)), ("counts", counts)):
        rows.write.mode("errorifexists").option("header", "true").csv(f"{path}/{name}")


def reviewed_frames(frame_map: DataFrame, annotations: DataFrame) -> DataFrame:
    """The reviewed frames of each clip, with their images."""
    return frame_map.join(annotations.where("reviewed"), ["clip", "frame_index"])


def script_json(value: Column) -> Column:
    """JSON text that may stand inside a script element."""
    for sign, code in (("&", "\\\\u0026"), ("<", "\\\\u003c"), (">", "\\\\u003e")):
        value = F.replace(value, F.lit(sign), F.lit(code.replace("\\\\", "\\")))
    return value


def html_text(value: Column) -> Column:
    """Text that may stand in an element or a quoted attribute."""
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(sign), F.lit(code))
    return value


def stamped(rows: DataFrame, name: str = "written_utc") -> DataFrame:
    """The job's time in ISO 8601, for provenance; leave it out of compared columns."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return rows.withColumn(name, F.concat(now, F.lit("+00:00")))


def detection_index(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of positive frames with the clock, one summary row a clip).

    frames: clip, frame_index, ts_sec, image, n_fire, n_smoke.
    """
    positive = frames.where("n_fire > 0 OR n_smoke > 0")
    index = positive.select("clip", "frame_index", text.clock_time(F.col("ts_sec")).alias("clock"), "image", "n_fire", "n_smoke")
    return index, profile.occurrence_times(frames)


def prediction_lines(predictions: DataFrame) -> DataFrame:
    """By image, its predictions as lines of class, centre, size and confidence, and their number.

    predictions: image, ord, cls, x_center, y_center, width, height, conf.
    """
    cells = [F.format_string("%.6f", F.col(c)) for c in ("x_center", "y_center", "width", "height", "conf")]
    line = F.concat_ws(" ", F.col("cls").cast("string"), *cells)
    ordered = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return predictions.groupBy("image").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("lines"), F.count("*").alias("n")
    )
