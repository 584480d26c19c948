"""The audit from images to a verified dataset: scan, segment, split, verify (section 3.1 of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import segment, split, verify


def segmented(images: DataFrame) -> DataFrame:
    """Images with video_id, frame_index and sequence_length where they form a sequence.

    Short runs and excluded prefixes go before any hash is compared.  images: path, filename, width,
    height, dhash and further columns.
    """
    named = text.stem(F.col("filename"))
    entries = images.where("width > 0 AND height > 0").select(
        text.frame_prefix(named).alias("prefix"), text.frame_index(named).alias("idx"), named.alias("name"),
        "path", "width", "height", "dhash",
    )
    runs = segment.contiguous_runs(entries)
    wanted = segment.video_candidates(runs).select("prefix", "run_id")
    found = segment.coherent_segments(runs.join(wanted, ["prefix", "run_id"]))
    frames = found.select("path", "video_id", "frame_index", "sequence_length")
    return images.join(frames, "path", "left").withColumn("category", text.category(F.col("filename")))


def prepare(holdout: DataFrame, images: DataFrame, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Segmented once, then split; the hold-out set is the test split."""
    return split.prepared(segmented(holdout), segmented(images), ratio, seed)


def audit(holdout: DataFrame, images: DataFrame, lines: DataFrame, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """The criteria over what prepare() makes; lines: path, checked."""
    rows = prepare(holdout, images, ratio, seed)
    usable = rows.where("split <> 'quarantine'")
    return verify.verified(usable, usable, rows.select("path"), lines)
