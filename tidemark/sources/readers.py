"""Readers of image folders, label texts, manifests, frame records and run summaries.

Files are listed and read by Spark (`binaryFile`, text, JSON, CSV), so folders may lie in any store
that Spark reads.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions import boxes, text
from tidemark.operators.dedup import keep_last
from tidemark.sources import listing

#: File endings of images in the two layouts, label folders in order of precedence.
AUDIT_ENDINGS = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
DETECTION_ENDINGS = (*AUDIT_ENDINGS, ".tif", ".tiff")
LABEL_FOLDERS = ("labels", "annotations/YOLO_CV", "annotations", "Labels")
SPLITS = ("train", "val", "valid", "test")
DIMENSIONS = "struct<width:int,height:int>"


def is_image(path: Column, endings: tuple[str, ...] = AUDIT_ENDINGS) -> Column:
    """By ending, whatever its case."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)).isin(*endings)


def layout(paths: DataFrame) -> str:
    """Flat, split or recursive, from the paths below a root (column `relative`)."""
    found = paths.agg(
        F.max(F.col("relative").startswith("annotations/YOLO_CV/")).alias("yolo"),
        F.max(F.col("relative").rlike(rf"^({'|'.join(SPLITS)})/images/")).alias("split"),
        F.max(F.col("relative").startswith("images/")).alias("images"),
    ).first()
    if found["yolo"]:
        return "flat"
    return "split" if found["split"] else "flat" if found["images"] else "recursive"


def files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """Every file below a root: path, relative, length, content.

    Listed and read in tasks where those can open the store.  Elsewhere by Spark's file source, which leaves empty files out, so
    those are taken from its own listing, on the driver.
    """
    if listing.readable(root):
        return listing.files(spark, root, content)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split(":", 1)[-1].replace("//", "/").rstrip("/")

    def named(rows: DataFrame) -> DataFrame:
        inside = F.regexp_replace(F.regexp_extract("path", r"^[A-Za-z0-9+.-]+:/*(/.*)$", 1), "%20", " ")
        return rows.withColumn("relative", F.substring(inside, F.length(F.lit(base)) + 2, F.length(inside)))

    filled = named(read.select("path", "length", "content"))
    listed = named(spark.createDataFrame([(p,) for p in read.inputFiles()], "path string"))
    empty = listed.join(filled.select("relative"), "relative", "left_anti").select(
        "path", F.lit(0).cast("bigint").alias("length"), F.lit(b"").alias("content"), "relative"
    )
    return filled.unionByName(empty)


def dimensions_of(data: bytes | None) -> tuple[int, int]:
    """Width and height from a JPEG, PNG, BMP or GIF header; (0, 0) when there is none."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:3] == b"GIF":
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    at += 1
                    continue
                marker = data[at + 1]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                if marker in (0x01, 0xFF, *range(0xD0, 0xDA)):
                    at += 1 if marker == 0xFF else 2
                else:
                    at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    except (TypeError, struct.error, IndexError):
        pass
    return 0, 0


def image_dimensions(content: str) -> Column:
    """struct<width, height> of a binary column, by batches."""

    def probe(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dimensions_of(c) for c in batch], columns=["width", "height"])

    probe.__annotations__ = {"batch": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(probe, DIMENSIONS)(content)


def label_text(content: Column) -> Column:
    """UTF-8, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def label_boxes(lines: DataFrame, rule: boxes.LineRule = boxes.V1) -> DataFrame:
    """Path and text to path, n_lines, n_invalid, boxes; a blank text is a valid negative.

    A file with a broken line has none of its boxes counted as valid.
    """
    checked = F.filter(
        F.transform(F.split("text", r"\r?\n"), lambda line: boxes.validated_line(line, rule)), lambda x: x.isNotNull()
    )
    rows = lines.select("path", checked.alias("c"))
    good = F.transform("c", lambda x: F.struct(*[x[n] for n in ("class_id", "x_center", "y_center", "width", "height")]))
    invalid = F.size(F.filter("c", lambda x: x["error"].isNotNull()))
    return rows.select(
        "path", F.size("c").alias("n_lines"), invalid.alias("n_invalid"),
        F.when(invalid == 0, good).otherwise(F.array().cast(f"array<{schemas.BOX}>")).alias("boxes"),
    )


def scan_dataset(spark: SparkSession, root: str, name: str | None = None, rule: boxes.LineRule = boxes.V1) -> DataFrame:
    """The images below a root with their labels, whatever the layout.

    All four split names count (`valid` becomes val).  Of several labels the first folder in order wins.
    """
    name = name or os.path.basename(root.rstrip("/"))
    listed = files(spark, root)
    kind = layout(files(spark, root, content=False).select("relative"))
    split = F.regexp_extract("relative", rf"^({'|'.join(SPLITS)})/", 1)
    images = listed.where(is_image(F.col("relative"))).select(
        "path", "relative", F.element_at(F.split("relative", "/"), -1).alias("filename"),
        text.stem(F.col("relative")).alias("stem"),
        F.when(split == "valid", "val").when(split == "", "all").otherwise(split).alias("split"),
        image_dimensions("content").alias("size"), F.sha2("content", 256).alias("sha256"),
    )
    parent = F.regexp_replace("relative", r"/?[^/]*$", "")
    place = F.lit(len(LABEL_FOLDERS))
    for i, folder in reversed(list(enumerate(LABEL_FOLDERS))):
        place = F.when((parent == folder) | parent.endswith("/" + folder), i).otherwise(place)
    found = listed.where(F.lower("relative").endswith(".txt")).select(
        F.col("path").alias("label_path"), text.stem(F.col("relative")).alias("stem"),
        F.when(split == "valid", "val").when(split == "", "all").otherwise(split).alias("split"),
        place.alias("place"), label_text(F.col("content")).alias("text"),
    )
    best = found.groupBy("split", "stem").agg(F.min_by(F.struct("label_path", "text"), F.struct("place", "label_path")).alias("l"))
    best = best.select("split", "stem", "l.label_path", "l.text")
    judged = label_boxes(best.select(F.col("label_path").alias("path"), "text"), rule).withColumnRenamed("path", "label_path")
    labels = best.drop("text").join(judged, "label_path")
    bad_size = (F.col("size.width") <= 0) | (F.col("size.height") <= 0)
    return (
        images.join(labels, ["split", "stem"], "left")
        .select(
            F.lit(name).alias("dataset"), F.lit(kind).alias("layout"), "split", "path", "filename", "label_path",
            F.col("size.width").alias("width"), F.col("size.height").alias("height"),
            (bad_size | (F.coalesce("n_invalid", F.lit(0)) > 0)).alias("is_corrupt"),
            (F.coalesce(F.size("boxes"), F.lit(0)) <= 0).alias("is_negative"), "boxes", "sha256",
            F.concat_ws("_", F.lit(name), "split", F.substring_index("stem", "_", 1)).alias("sequence_id"),
        )
    )


def load_config(path: str) -> dict:
    """A YAML file; environment variables in its values are filled in."""
    import yaml

    with open(path, encoding="utf-8") as file:
        found = yaml.safe_load(os.path.expandvars(file.read()))
    if not isinstance(found, dict):
        raise ValueError(f"{path} is no mapping")
    return found


def split_list(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a text list, without blank lines and # comments."""
    line = F.trim("value")
    return spark.read.text(path).select(text.posix(line).alias("path")).where((line != "") & ~line.startswith("#"))


def split_paths(spark: SparkSession, given: str | list[str], base: str = "") -> DataFrame:
    """Images of a split that is given as a folder, a text list or a literal list of those, below base."""
    if isinstance(given, list):
        parts = [split_paths(spark, g, base) for g in given]
        return reduce(DataFrame.unionAll, parts).distinct() if parts else spark.createDataFrame([], "path string")
    if given.lower().endswith(AUDIT_ENDINGS):
        return spark.createDataFrame([(given,)], "path string")
    where = resolved(given, base)
    if given.endswith(".txt"):
        return split_list(spark, where)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where).select("path")
    return found.where(is_image(F.col("path"), DETECTION_ENDINGS)).select(text.posix(F.col("path")).alias("path"))


def dataset_roots(folders: DataFrame) -> DataFrame:
    """Dataset folders in order: those with splits, then flat ones, then the rest, each by name.

    folders: root, path of its folders; the first is the hold-out set, the second is partitioned.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    above = F.lower(F.try_element_at(F.split("path", "/"), F.lit(-2)))
    split = (name == "images") & above.isin(*SPLITS)
    kinds = folders.where(~F.lower(F.element_at(F.split("root", "/"), -1)).isin("manifests", "splits")).groupBy("root").agg(
        F.min(F.when(split, 0).when(name == "images", 1).otherwise(2)).alias("kind")
    )
    before = Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)  # over three rows
    ahead = kinds.groupBy("kind").count().select("kind", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("kind").orderBy("root"))
    return kinds.join(F.broadcast(ahead), "kind").select("root", "kind", place.cast("int").alias("place"))


def read_splits(spark: SparkSession, paths: dict[str, str], present: DataFrame | None = None) -> DataFrame:
    """Supplied splits in order of name; a filename in two places is an error, and so is one not present.

    present: filename of the images that are there.
    """
    parts = [split_list(spark, paths[s]).withColumn("split", F.lit(s)) for s in sorted(paths)]
    rows = reduce(DataFrame.unionAll, parts)
    rows = rows.withColumn("filename", F.element_at(F.split("path", "/"), -1))
    again = rows.groupBy("filename").count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{again[0]['filename']} occurs more than once")
    if present is not None:
        gone = rows.join(present.select("filename"), "filename", "left_anti").limit(1).collect()
        if gone:
            raise ValueError(f"{gone[0]['filename']} is missing")
    return rows


def read_manifest_json(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a nested value with `frames`, or one frame a line; nested sizes win over flat ones.

    The first line tells: a whole value on it that is a frame or a summary is followed by others, one a line.
    """
    box = "struct<fire:int,smoke:int>"
    fields = ", ".join(f.replace(" ", ":", 1) for f in schemas.FRAMES.split(", "))
    frame = f"struct<{fields},resolution:{DIMENSIONS},boxes:{box}>"
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).select(
        F.from_json("value", "struct<frames:array<string>,filename:string,summary:string>").alias("v"), F.rlike("value", F.lit(r"\}\s*$")).alias("closed")
    ).first()
    if first is not None and first["closed"] and first["v"] is not None and first["v"]["frames"] is None:
        lines = spark.read.text(path).select(F.from_json("value", frame).alias("f")).where("f.filename IS NOT NULL")
        return normalised(lines.select("f.*"))
    whole = spark.read.text(path, wholetext=True)
    one = whole.select(F.explode(F.from_json("value", f"struct<frames:array<{frame}>>")["frames"]).alias("f"))
    return normalised(one.select("f.*"))


def normalised(frames: DataFrame) -> DataFrame:
    """FRAMES from rows that may also carry resolution and boxes structs."""
    return frames.select(
        "filename", "path", "category", "video_id", "frame_index", "sequence_length",
        F.coalesce("resolution.width", "width").alias("width"), F.coalesce("resolution.height", "height").alias("height"),
        F.coalesce("boxes.fire", "fire_boxes", F.lit(0)).alias("fire_boxes"),
        F.coalesce("boxes.smoke", "smoke_boxes", F.lit(0)).alias("smoke_boxes"),
        F.coalesce(
            "is_negative",
            (F.coalesce("boxes.fire", "fire_boxes", F.lit(0)) == 0) & (F.coalesce("boxes.smoke", "smoke_boxes", F.lit(0)) == 0),
        ).alias("is_negative"),
    )


def read_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """Blank is null; true and 1 are true."""
    names = [f.split() for f in schemas.FRAMES.split(", ")]
    raw = read_cells(spark, path)
    out = []
    for name, kind in names:
        cell = F.nullif(F.trim(name), F.lit("")) if name in raw.columns else F.lit(None).cast("string")
        value = F.lower(cell).isin("true", "1") if kind == "boolean" else text.integer(cell).cast("int") if kind == "int" else cell
        out.append(value.alias(name))
    return raw.select(*out)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A CSV as text columns, without a byte-order mark; a missing file has no rows."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.option("header", "true").option("quote", '"').option("escape", '"').option(
            "multiLine", "true"
        ).csv(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], T.StructType([]))
    return raw.toDF(*[c.lstrip("﻿") for c in raw.columns])


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Recorded frames, one JSON value a line, gzip or plain.

    TRACKS rows and more: kind ('track', 'box', or null for a frame without either), exact_time (false where a
    presentation time was estimated), in_order (whether the frame's time is later than the one before it).
    """
    kind = (
        "stream_id string, frame_index bigint, timestamp_sec double, image_size array<int>, timestamp_quality string, "
        "boxes array<array<double>>, tracks array<array<double>>"
    )
    f = spark.read.schema(kind).json(path)
    name = F.coalesce("stream_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.jsonl?)?(\.gz)?$", 1))
    order = Window.partitionBy("stream_id").orderBy("frame_index")
    f = f.withColumn("stream_id", name).withColumn("_before", F.lag("timestamp_sec").over(order))

    def of(column: str, kind: str):
        rows = F.coalesce(F.col(column), F.array().cast("array<array<double>>"))
        return F.transform(rows, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))

    f = f.withColumn("t", F.explode_outer(F.concat(of("tracks", "track"), of("boxes", "box"))))
    v, track = F.col("t.v"), F.col("t.kind") == "track"
    quality = F.coalesce("timestamp_quality", F.lit("presentation_timestamp"))
    return f.select(
        "stream_id", "frame_index", F.col("timestamp_sec").alias("ts_sec"), F.col("image_size")[0].alias("image_w"),
        F.col("image_size")[1].alias("image_h"), *[F.get(v, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
        F.when(track, F.get(v, F.lit(4))).cast("int").alias("track_id"),
        F.when(track, F.get(v, F.lit(5))).otherwise(F.get(v, F.lit(4))).alias("conf"),
        F.when(track, F.get(v, F.lit(6))).otherwise(F.get(v, F.lit(5))).cast("int").alias("cls"), F.col("t.kind").alias("kind"),
        (quality == "presentation_timestamp").alias("exact_time"),
        F.coalesce(F.col("timestamp_sec") > F.col("_before"), F.lit(True)).alias("in_order"),
    )


def discover_videos(found: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Video files and manifest rows; the last row of a path wins.  Both have path."""
    rows = found.withColumn("_o", F.lit(0))
    if manifest is not None:
        rows = rows.unionByName(manifest.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    return keep_last(rows, ["path"], "_o").drop("_o")


def run_summaries(spark: SparkSession, path: str, expected: list[tuple[str, int]]) -> DataFrame:
    """Summaries of exactly the expected (model, seed) runs."""
    rows = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    found = sorted((r[0], r[1]) for r in rows.select("model", "seed").collect())
    if found != sorted(expected):
        raise ValueError(f"runs are {found}")
    return rows


def located(rows: DataFrame, digest: str) -> DataFrame:
    """The copy of a file with that SHA-256; folders come before archives, then by path.

    rows: path, is_archive, sha256.
    """
    return rows.where(F.col("sha256") == digest).orderBy("is_archive", "path").limit(1)


def bundle(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Every file of a bundle with the copy to take and whether one is missing or changed.

    manifest: name, sha256; rows: path, name, is_archive, sha256 of the copies that there are.
    """
    fits = rows.select(F.col("name").alias("_name"), F.col("sha256").alias("_digest"), "path", "is_archive")
    # merged: a copied table in each task's memory would grow with the bundle
    joined = manifest.join(fits.hint("merge"), F.col("name") == F.col("_name"), "left")
    same = F.col("_digest") == F.col("sha256")
    return joined.groupBy("name", "sha256").agg(
        F.min(F.when(same, F.struct("is_archive", "path")))["path"].alias("path"),
        F.when(F.count("_digest") == 0, "missing").when(F.count_if(same) == 0, "changed").alias("problem"),
    )


def complete_epochs(rows: DataFrame, n: int = 60) -> DataFrame:
    """One row: whether epochs are exactly 1 to n."""
    return rows.agg(
        ((F.count("*") == n) & (F.count_distinct("epoch") == n) & (F.min("epoch") == 1) & (F.max("epoch") == n)).alias("complete")
    )


def resolved(path: str, root: str) -> str:
    """A path of a configuration, below its root unless it is absolute."""
    return path if os.path.isabs(path) else os.path.normpath(os.path.join(root, path))


def embedded(pages: DataFrame, element: str, schema: str) -> DataFrame:
    """A page's JSON element, parsed; null where there is none."""
    return pages.withColumn("data", F.from_json(text.embedded_json(F.col("html"), element), schema))


def json_lines(items: Iterator[dict]) -> Iterator[str]:
    for item in items:
        yield json.dumps(item, allow_nan=False, sort_keys=True)
