"""Running sums, suffix maxima and quantiles of long ordered tables, without one task that sees them whole.

`cut` deals rows into ranges of their order (a written table, so that every later step sees the same ranges).  A range's totals are one row; a
window over those gives each range what lies before it, and windows within the ranges do the rest.  A group of any size is as many
tasks' work as it has ranges.

`ranged` names the ranges without writing the rows: its bounds come from a sample, and any later step finds a row's range from them.

`quantiles` finds order statistics by histograms: counts by bucket of each group's values, then the same for the bucket that holds the
wanted rank, until that is one value or a few; nothing is sorted and no group's values come together.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.folders import scratch

RANGE_ROWS = 1 << 20  # rows of a range, about
RANGE_SAMPLES = 60  # rows of a sample for each range
BUCKETS, FEW, MOST_ROUNDS = 1024, 4096, 400
RANGE = "_range"
LARGEST = sys.float_info.max


def cut(rows: DataFrame, by: list[str], order: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with _range, which rises as `order` falls; a group's ranges are consecutive.  Equal rows of (by, order) share a range."""
    spark = rows.sparkSession
    whole = kept(rows, "ranges")
    ranges = max(1, -(-whole.count() // range_rows))  # from the files' footers
    if ranges == 1:
        return whole.withColumn(RANGE, F.lit(0))
    dealt = whole.repartitionByRange(ranges, *by, F.desc(order)).withColumn(RANGE, F.spark_partition_id())
    path = scratch(spark, "ranges")
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def ranged(rows: DataFrame, by: list[str], order: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with _range as `cut` has it, a group's from 0 on; rows: cheap to read twice, `order` known.

    Only the bounds are written: some rows of a sample of each group, in falling order.  A row's range is the number of bounds above it.
    """
    some = min(RANGE_SAMPLES, range_rows)
    drawn = rows.sample(some / range_rows, seed=1).groupBy(*by).agg(F.sort_array(F.collect_list(order), asc=False).alias("_drawn"))
    every = F.array_distinct(F.filter("_drawn", lambda _, i: i % some == some - 1))
    bounds = kept(drawn.select(*by, every.alias("_bounds")).where(F.size("_bounds") > 0), "bounds")
    most = bounds.agg(F.max(F.size("_bounds"))).first()[0]
    if not most:
        return rows.withColumn(RANGE, F.lit(0))
    found = joined(rows, F.broadcast(bounds), by).withColumn(RANGE, F.lit(0))
    for step in (1 << k for k in reversed(range(most.bit_length()))):
        above = F.get("_bounds", F.col(RANGE) + F.lit(step - 1)) > F.col(order)
        found = found.withColumn(RANGE, F.col(RANGE) + F.when(above, step).otherwise(0))
    return found.drop("_bounds")


def running(cuts: DataFrame, by: list[str], order: str, sums: list[str]) -> DataFrame:
    """Cumulative sums from the highest `order` down, in place of the columns; cuts: from `cut`, one row for each (by, order)."""
    totals = cuts.groupBy(*by, RANGE).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    ahead = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, RANGE, *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_{c}") for c in sums])
    within = Window.partitionBy(*by, RANGE).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = _joined(cuts, before, by)
    return joined.withColumns({c: F.col(f"_{c}") + F.sum(c).over(within) for c in sums}).drop(*[f"_{c}" for c in sums])


def best_below(cuts: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """cuts with the greatest value at this `order` or a lower one."""
    most = cuts.groupBy(*by, RANGE).agg(F.max(value).alias("_most"))
    # from the far end on: a frame that grows is one pass, one that shrinks begins anew at every row
    after = Window.partitionBy(*by).orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    later = most.select(*by, RANGE, F.max("_most").over(after).alias("_later"))
    within = Window.partitionBy(*by, RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return _joined(cuts, later, by).withColumn(name, F.greatest(F.max(value).over(within), "_later")).drop("_later")


def _joined(cuts: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """By group and range, nulls of a group being equal."""
    own = ranges.select(*[F.col(c).alias(f"_own_{c}") for c in [*by, RANGE]], *[c for c in ranges.columns if c not in (*by, RANGE)])
    on = F.lit(True)
    for c in [*by, RANGE]:
        on = on & F.col(c).eqNullSafe(F.col(f"_own_{c}"))
    return cuts.join(own, on).drop(*[f"_own_{c}" for c in [*by, RANGE]])


def quantiles(rows: DataFrame, value: str, by: list[str], at: dict[str, float]) -> DataFrame:
    """by, n, mean and the interpolated quantiles that `at` names; values that are null or not a number are left out.

    Infinite values count as the largest numbers.
    A round reads the rows once; after the first, only rows in the buckets of wanted ranks count.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    values = rows.select(*by, F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(LARGEST)), F.lit(-LARGEST))).alias("v"))
    ends = values.groupBy(*by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = kept(ends)
    place = [F.lit(q) * (F.col("n") - 1) for q in at.values()]
    ranks = F.array_distinct(F.concat(*[F.array(F.floor(p), F.ceil(p)) for p in place]))
    asked = ends.where("n > 0").select(*by, "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("held"), F.explode(ranks).alias("rank"))
    few = (F.col("lo") == F.col("hi")) | (F.col("held") <= FEW)
    for _ in range(MOST_ROUNDS):
        if asked.where(~few).isEmpty():
            break
        asked = kept(_narrowed(values, asked.where(~few), by).unionByName(asked.where(few)))
    else:
        raise RuntimeError("the ranks have not settled")
    found = _answered(values, asked, by)
    known = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two ranks a quantile
    out = joined(ends.select(*by, "n", "mean"), known, by)

    def between(q: float):
        p = F.lit(q) * (F.col("n") - 1)
        low, high = (F.try_element_at("at", f(p)) for f in (F.floor, F.ceil))
        return low + (high - low) * (p - F.floor(p))

    return out.select(*by, "n", "mean", *[between(q).alias(name) for name, q in at.items()])


def kept(rows: DataFrame, name: str = "round") -> DataFrame:
    """The rows, written, so that they aren't computed again by each later step."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """By group, nulls of a group being equal."""
    own = right.select(*[F.col(c).alias(f"_own_{c}") for c in by], *[c for c in right.columns if c not in by])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_own_{c}"))
    return left.join(own, on, how).drop(*[f"_own_{c}" for c in by])


def _narrowed(values: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """asked (by, rank, lo, hi, below, held) with the bucket that holds the rank in place of the whole span."""
    spans = asked.select(*by, "lo", "hi", "below").distinct()
    inside = joined(values, spans, by, "inner").where("v BETWEEN lo AND hi")
    bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS))
    counts = inside.groupBy(*by, F.col("lo").alias("from"), F.col("below").alias("under"), bucket.alias("bucket")).agg(
        F.count("*").alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    upto = Window.partitionBy(*by, "from", "under").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("below", F.col("under") + F.coalesce(F.sum("held").over(upto), F.lit(0)))
    wanted = asked.select(*by, "rank", F.col("lo").alias("_lo"), F.col("below").alias("_below"))
    both = joined(wanted, placed, by, "inner").where("_lo = from AND _below = under AND rank >= below AND rank < below + held")
    return both.select(*by, "lo", "hi", "below", "held", "rank")


def _answered(values: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """by, rank, v of ranks whose span is one value or holds a few."""
    one = asked.where("lo = hi").select(*by, "rank", F.col("lo").alias("v"))
    several = asked.where("lo < hi")
    inside = joined(values, several.select(*by, "lo", "hi", "below").distinct(), by, "inner").where("v BETWEEN lo AND hi")
    lists = inside.groupBy(*by, F.col("lo").alias("from"), F.col("below").alias("under")).agg(F.sort_array(F.collect_list("v")).alias("vs"))
    wanted = several.select(*by, "rank", F.col("lo").alias("_lo"), F.col("below").alias("_below"))
    both = joined(wanted, lists, by, "inner").where("_lo = from AND _below = under")
    return one.unionByName(both.select(*by, "rank", F.get("vs", (F.col("rank") - F.col("under")).cast("int")).alias("v")))
