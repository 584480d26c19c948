"""Connected components of an edge table: local union-find, then alternating large and small stars.

The edges never leave the executors.  Each round is two aggregations and two joins over the edges that
are left; a round's result is a written table, so a lost executor costs no more than that round.  A hub
that holds a large share of the edges is met by partial aggregation and by Spark's skewed-join splitting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.staging import drop_table, write_table

EDGES = "a long, b long"


def roots(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Union-find with path halving; the smallest member is its set's root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = roots(batch["a"].to_numpy(), batch["b"].to_numpy())
        pairs = [(x, r) for x, r in found.items() if x != r]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"]
        )


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def _round(edges: DataFrame) -> DataFrame:
    """edges: a > b.  Large star: larger neighbours go to a node's lowest; small star: lower ones do."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    large = (
        both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b")
    )
    large = large.distinct()
    low = _lowest(large)
    small = large.join(low, "a")
    moved = small.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b")
    return moved.unionAll(low.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node that has an edge; component: the smallest node reachable.

    edges: a, b long.  Loops and repeats are harmless; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    first = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    path = write_table(first.mapInArrow(_contract, EDGES).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        now = spark.read.schema(EDGES).parquet(path)
        state = tuple(
            now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )  # two numbers, whatever the number of edges
        if state == seen or not state[0]:
            break
        seen = state
        new = write_table(_round(now), "edges")
        drop_table(spark, path)
        path = new
    else:
        raise RuntimeError("the components have not settled")
    stars = spark.read.schema(EDGES).parquet(path)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
