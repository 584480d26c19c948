"""Recorded lines that can be checked one by one, in parallel.

`seal` gives each line of a stream the digest of the digest before it and of the line itself, and each stream its number of lines and last
digest.  `problems` looks at segments of lines on their own: within one, every line is compared with the digest stored by the line
before it; a segment's first line takes that from the end of the segment before.  So a changed, missing or swapped line is named with
its place, and no stream is one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEGMENT = 10_000
SEALED = "stream_id string, n long, line string, digest string"


def _seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stream, last, n = None, "", 0
    first = True
    for batch in batches:
        numbers, found = [], []
        for own, line in zip(batch["stream_id"].to_pylist(), batch["line"].to_pylist(), strict=True):
            if first or own != stream:
                stream, last, n, first = own, "", 0, False
            last = hashlib.sha256(f"{last}{line or ''}".encode()).hexdigest()
            numbers.append(n)
            found.append(last)
            n += 1
        yield pa.RecordBatch.from_arrays(
            [batch["stream_id"], pa.array(numbers, pa.int64()), batch["line"], pa.array(found, pa.string())], names=["stream_id", "n", "line", "digest"]
        )


def seal(rows: DataFrame, order: list[str]) -> DataFrame:
    """SEALED lines of (stream_id, line, order); a null line counts as an empty one.  Lines pass a worker one after the other."""
    kept = rows.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("line").cast("string").alias("line"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    ordered = kept.repartition("stream_id").sortWithinPartitions("stream_id", *[f"_{i}" for i in range(len(order))])
    return ordered.select("stream_id", "line").mapInArrow(_seal, SEALED)


def summary(sealed: DataFrame) -> DataFrame:
    """stream_id, lines, last: what to keep elsewhere."""
    return sealed.groupBy("stream_id").agg(F.count("*").alias("lines"), F.max_by("digest", "n").alias("last"))


def problems(rows: DataFrame, kept: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """stream_id, n, problem: 'missing' (lines before this one are), 'repeated', 'changed' (the line or the digest before it), and with the
    kept summary 'cut' (n lines are left of more, or of others).
    """
    part = F.floor(F.col("n") / segment)
    dealt = rows.select("stream_id", "n", "line", "digest", part.alias("_part"))
    ends = dealt.groupBy("stream_id", "_part").agg(F.max("n").alias("_end"), F.max_by("digest", "n").alias("_last"))
    by_stream = Window.partitionBy("stream_id").orderBy("_part")  # one row a segment
    ends = ends.select("stream_id", "_part", F.lag("_end").over(by_stream).alias("_end"), F.lag("_last").over(by_stream).alias("_last"))
    joined = dealt.join(ends.select(F.col("stream_id").alias("_own"), F.col("_part").alias("_p"), "_end", "_last"), (F.col("stream_id").eqNullSafe(F.col("_own"))) & (F.col("_part") == F.col("_p")))
    within = Window.partitionBy("stream_id", "_part").orderBy("n", "digest")
    first = F.row_number().over(within) == 1
    before_n = F.when(first, F.coalesce("_end", F.lit(-1))).otherwise(F.lag("n").over(within))
    before = F.when(first, F.coalesce("_last", F.lit(""))).otherwise(F.lag("digest").over(within))
    judged = joined.select("stream_id", "n", "line", "digest", before_n.alias("_n"), before.alias("_before"))
    right = F.sha2(F.concat("_before", F.coalesce("line", F.lit(""))), 256)
    found = judged.select(
        "stream_id", "n",
        F.when(F.col("n") == F.col("_n"), "repeated").when(F.col("n") != F.col("_n") + 1, "missing")
        .when(~right.eqNullSafe(F.col("digest")), "changed").alias("problem"),
    ).where("problem IS NOT NULL")
    if kept is None:
        return found
    now = summary(rows).select(F.col("stream_id").alias("_own"), F.col("lines").alias("_lines"), F.col("last").alias("_last"))
    both = kept.join(now, F.col("stream_id").eqNullSafe(F.col("_own")), "left")
    short = both.where(~((F.col("lines").eqNullSafe(F.col("_lines"))) & (F.col("last").eqNullSafe(F.col("_last")))))
    return found.unionByName(short.select("stream_id", F.coalesce("_lines", F.lit(0)).cast("long").alias("n"), F.lit("cut").alias("problem")))
