"""Exact and near duplicates across splits, adjacent frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.hashing import hamming

BITS = 64
BANDED_UP_TO = 8  # bits; beyond it bands get so narrow that they hold most pairs
BLOCK_ROWS, TILE = 1 << 15, 1 << 21  # values of a block, pairs that are compared at once


def adjacent_pairs(frames: DataFrame) -> DataFrame:
    """Frames n and n + 1 of one prefix that lie in different splits; prefix, number, name, split."""
    a, b = frames.alias("a"), frames.alias("b")
    on = (F.col("a.prefix") == F.col("b.prefix")) & (F.col("a.number") + 1 == F.col("b.number"))
    return a.join(b, on & (F.col("a.split") != F.col("b.split"))).select(
        F.col("a.name").alias("image_a"), F.col("a.split").alias("split_a"),
        F.col("b.name").alias("image_b"), F.col("b.split").alias("split_b"),
    )


def adjacent_distances(frames: DataFrame) -> DataFrame:
    """Adjacent pairs with the bits between their hashes; frames: prefix, number, name, split, dhash."""
    pairs = adjacent_pairs(frames)
    for side in ("a", "b"):
        own = frames.select(F.col("name").alias(f"image_{side}"), F.col("split").alias(f"split_{side}"), F.col("dhash").alias(f"_{side}"))
        pairs = pairs.join(own, [f"image_{side}", f"split_{side}"])
    distance = hamming(F.col("_a"), F.col("_b")).cast("int")
    return pairs.select("image_a", "split_a", "image_b", "split_b", distance.alias("dhash_distance"))


def exact_duplicates(rows: DataFrame, digest: str, split: str) -> DataFrame:
    """Digests that occur in more than one split, with copies and splits."""
    return (
        rows.groupBy(digest)
        .agg(F.count("*").alias("copies"), F.array_sort(F.collect_set(split)).alias("splits"))
        .where(F.size("splits") > 1)
    )


def bands(value: Column, k: int) -> Column:
    """K + 1 bands of a 64-bit value; two values within k bits agree in one of them."""
    n = k + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    masks = [(1 << (b - a)) - 1 for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    masks = [m if m < 1 << 63 else -1 for m in masks]  # a single band is the whole value
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("band"),
                F.shiftrightunsigned(value, cuts[i]).bitwiseAND(F.lit(masks[i])).alias("bits"),
            )
            for i in range(n)
        ]
    )


def near_pairs(left: DataFrame, right: DataFrame, key: str, value: str, k: int, one_sided: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs within k bits: a, b, distance; exact.

    Up to 8 bits an equi-join over bands proposes the pairs.  A pair is taken in the first band that it
    shares, so no distinct is needed.  For more bits no index of 64-bit values leaves much out (within 18 bits, bands with all
    their flips propose every tenth pair of random values), so blocks of values meet as packed arrays, a task for each pair of
    blocks, and only near pairs become rows.  one_sided: both tables are one, and each pair appears once, a < b.
    """
    a = left.select(F.col(key).alias("a"), F.col(value).alias("va"))
    b = right.select(F.col(key).alias("b"), F.col(value).alias("vb"))
    if k > BANDED_UP_TO:
        pairs = _by_blocks(a, b, k, one_sided, block_rows)
        return pairs.where(F.col("a") < F.col("b")) if one_sided else pairs
    order = (F.col("a") < F.col("b")) if one_sided else F.lit(True)
    near = hamming(F.col("va"), F.col("vb")) <= k
    x = a.withColumn("x", F.explode(bands(F.col("va"), k))).select("a", "va", "x.band", "x.bits")
    y = b.withColumn("x", F.explode(bands(F.col("vb"), k))).select("b", "vb", "x.band", "x.bits")
    both = x.join(y, ["band", "bits"]).where(order & near)
    shared = F.zip_with(bands(F.col("va"), k), bands(F.col("vb"), k), lambda p, q: p["bits"] == q["bits"])
    pairs = both.where(F.array_position(shared, True) == F.col("band") + 1)
    return pairs.select("a", "b", hamming(F.col("va"), F.col("vb")).cast("int").alias("distance"))


def _by_blocks(a: DataFrame, b: DataFrame, k: int, one_sided: bool, block_rows: int) -> DataFrame:
    """Blocks by a hash of the key; each meets the others as one row of two arrays.  one_sided: block i meets j >= i, in both orders."""

    def packed(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, int]:
        rows = rows.where(F.col(f"v{key}").isNotNull())
        blocks = max(1, -(-rows.count() // block_rows))
        block = F.pmod(F.xxhash64(key), F.lit(blocks)).alias(name)
        return rows.groupBy(block).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(f"v{key}").alias("v"))).alias(key)), blocks

    (x, _), (y, others) = packed(a, "a", "i"), packed(b, "b", "j")
    first = F.col("i") if one_sided else F.lit(0).cast("long")
    x = x.withColumn("j", F.explode(F.sequence(first, F.lit(others - 1).cast("long"))))
    kind = a.schema["a"].dataType.simpleString()
    other = b.schema["b"].dataType.simpleString()
    swap = F.lit(one_sided) & (F.col("i") != F.col("j"))
    return x.join(y, "j").select("a", "b", swap.alias("swap")).mapInArrow(_near(k), f"a {kind}, b {other}, distance int")


def _near(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, swap in zip(batch["a"], batch["b"], batch["swap"], strict=True):
                p, q = left.values, right.values
                u, v = (x.field("v").to_numpy().astype(np.int64).view(np.uint64) for x in (p, q))
                step = max(1, TILE // max(len(v), 1))
                for low in range(0, len(u), step):
                    apart = np.bitwise_count(u[low : low + step, None] ^ v[None])
                    i, j = np.nonzero(apart <= k)
                    x, y = p.field("id").take(pa.array(i + low)), q.field("id").take(pa.array(j))
                    found = pa.array(apart[i, j].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([x, y, found], names=["a", "b", "distance"])
                    if swap.as_py():
                        yield pa.RecordBatch.from_arrays([y, x, found], names=["a", "b", "distance"])

    return run


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both tables, once each."""
    return a.select(key).intersect(b.select(key))


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one table only, with the side that has them."""
    return a.select(key).subtract(b.select(key)).withColumn("side", F.lit("left")).unionAll(
        b.select(key).subtract(a.select(key)).withColumn("side", F.lit("right"))
    )


def is_subset(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """U8: one row: missing, subset."""
    missing = a.select(key).join(b.select(key), key, "left_anti")
    return missing.agg(F.count("*").alias("missing")).withColumn("subset", F.col("missing") == 0)


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with one key the last in order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def repeats(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Second and later rows of a key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")
