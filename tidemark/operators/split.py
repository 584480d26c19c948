"""Group-atomic and stratified splits."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.profile import unusable

BUCKETS = 1024


def cutoff(n: int, ratio: float) -> int:
    """Of n groups those that train: both sides get one when there are two or more."""
    if n <= 1:
        return int(n == 1 and ratio >= 0.5)
    return min(max(int(n * ratio), 1), n - 1)


def exact_split(ids: list[str], ratio: float, seed: int, rng: random.Random | None = None) -> dict[str, str]:
    """Sorted, shuffled with a seeded generator, cut; for lists that fit the driver."""
    rng = rng or random.Random(seed)
    order = sorted(ids)
    rng.shuffle(order)
    n = cutoff(len(order), ratio)
    return {x: "train" if i < n else "val" for i, x in enumerate(order)}


def exact_stratified(groups: list[str], strata: dict[str, list[str]], ratio: float, seed: int) -> dict[str, str]:
    """Groups first, then each stratum in order of name, with one generator throughout."""
    rng = random.Random(seed)
    out = exact_split(groups, ratio, seed, rng)
    for name in sorted(strata):
        out |= exact_split(strata[name], ratio, seed, rng)
    return out


def _train(n: Column, ratio: float) -> Column:
    return F.when(n == 1, F.lit(1 if ratio >= 0.5 else 0)).otherwise(
        F.greatest(F.lit(1), F.least(n - 1, F.floor(n * F.lit(ratio))))
    )


def ranked_split(rows: DataFrame, group: str, ratio: float, seed: int = 42, strata: str | None = None) -> DataFrame:
    """G1-G3 without the driver: adds split; all rows of a group, in each stratum, fall on one side.

    Groups are ordered by a seeded hash.  Their exact ranks come from counts of hash buckets and ranks
    within a bucket, so that no task holds all groups.
    """
    by = [strata] if strata else []
    keys = rows.select(*by, group).where(F.col(group).isNotNull()).distinct()
    hashed = keys.withColumn("_h", F.xxhash64(F.lit(seed), group)).withColumn(
        "_b", F.pmod(F.shiftrightunsigned("_h", 54), F.lit(BUCKETS)).cast("int")
    )
    counts = hashed.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn(
        "_n", F.sum("_c").over(Window.partitionBy(*by))
    )  # BUCKETS rows a stratum
    rank = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", group))
    # the low 54 bits order a bucket, its number the buckets
    placed = hashed.join(counts, [*by, "_b"]).withColumn("_rank", F.col("_before") + rank)
    sides = placed.select(
        *by, group, F.when(F.col("_rank") <= _train(F.col("_n"), ratio), "train").otherwise("val").alias("split")
    )
    return rows.join(sides, [*by, group], "left")


def partition(images: DataFrame, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Videos by group, single images by category, unusable rows to quarantine: adds split.

    images: filename, category, video_id, width, height, is_corrupt.  Errors are raised, never swallowed.
    """
    bad = unusable(F.col("width"), F.col("height"), F.col("is_corrupt"))
    marked = images.drop("split").withColumn("_bad", bad)
    good = marked.where(~F.col("_bad")).drop("_bad")
    videos = ranked_split(good.where("video_id is not null"), "video_id", ratio, seed)
    singles = ranked_split(good.where("video_id is null"), "filename", ratio, seed, strata="category")
    rest = marked.where("_bad").drop("_bad").withColumn("split", F.lit("quarantine"))
    return videos.unionByName(singles).unionByName(rest)


def isolate(images: DataFrame) -> DataFrame:
    """A hold-out set: usable rows are test."""
    bad = unusable(F.col("width"), F.col("height"), F.col("is_corrupt"))
    return images.drop("split").withColumn("split", F.when(bad, "quarantine").otherwise("test"))


def prepared(holdout: DataFrame, rest: DataFrame, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """The isolated hold-out set and the partitioned rest, one table."""
    return isolate(holdout).unionByName(partition(rest, ratio, seed), allowMissingColumns=True)
