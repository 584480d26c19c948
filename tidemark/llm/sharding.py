"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions.

Every shard owns `vnodes` points of a ring of 64-bit positions; a key belongs to the arc that ends at
the next point clockwise.  Loads are bounded at their tightest: capacities differ by one row and add up
to the number of rows, so all shards end full.  A shard that fills up passes its arcs' remaining keys
clockwise to the next points with room.  Because a row's place depends only on its arc, its rank within
the arc and the arcs' counts, the ring is settled on those counts (shards x vnodes of them, whatever
the number of rows) and the rows follow with one window over arcs; the settled ring is a constant of the
plan, since a join on a computed key made Catalyst infer a wrong filter.

Nulls: a null key has one fixed position; a null text has size 16 and checksum 0.  Repeated rows are
separate rows with adjacent ranks.  Extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS = 40
VNODES = 64
SEGMENTS = "array<array<struct<low:long,high:long,shard:int,slot:long>>>"


def ring(shards: int = SHARDS, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order."""
    return sorted(
        (int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big", signed=True), shard)
        for shard in range(shards)
        for v in range(vnodes)
    )


def arc_of(position: Column, points: list[int]) -> Column:
    """Index of the first point at or after a position, clockwise: a binary search over the points."""
    table = F.array(*[F.lit(p) for p in points])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(points).bit_length()))])
    below = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(points)) & (F.get(table, at + step - 1) < position), at + step
        ).otherwise(at),
    )
    return (below % len(points)).cast("int")


def settle(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Rows of each arc by rank: (arc, low, high, shard, slot of rank low); high is exclusive."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    out = []
    over: deque[tuple[int, int, int]] = deque()

    def put(arc: int, low: int, high: int, shard: int) -> int:
        n = min(high - low, room[shard])
        if n:
            out.append((arc, low, low + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return low + n

    for arc, shard in enumerate(owners):  # keys of a shard's own arcs come first
        n = counts.get(arc, 0)
        if (low := put(arc, 0, n, shard)) < n:
            over.append((arc, low, n))
    for arc, low, high in over:  # the rest continues clockwise from its arc
        at = arc
        while low < high:
            at = (at + 1) % len(owners)
            low = put(arc, low, high, owners[at])
    return out


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row; shards' row counts differ by one at most."""
    nodes = ring(shards, vnodes)
    arc = arc_of(F.xxhash64(F.col(key)), [p for p, _ in nodes])
    counts = {r[0]: r[1] for r in df.select(arc.alias("arc")).groupBy("arc").count().collect()}
    by_arc: list[list[dict]] = [[] for _ in nodes]
    for at, low, high, owner, slot in settle(counts, [s for _, s in nodes], shards):
        by_arc[at].append({"low": low, "high": high, "shard": owner, "slot": slot})
    settled = F.from_json(F.lit(json.dumps(by_arc)), SEGMENTS)  # a constant: shards x vnodes short lists
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key),
        (F.octet_length(whole) + 16).cast("long").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        arc.alias("arc"),
    )
    order = Window.partitionBy("arc").orderBy(F.xxhash64(F.col(key)), key, "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    own = F.filter(F.get(settled, F.col("arc")), lambda x: (F.col("rank") >= x["low"]) & (F.col("rank") < x["high"]))
    placed = ranked.withColumn("own", F.get(own, F.lit(0)))
    slot = F.col("own.slot") + F.col("rank") - F.col("own.low")
    return placed.select(key, "size", "text_crc32", F.col("own.shard").alias("shard"), slot.alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
