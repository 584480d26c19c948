"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a share of the corpus by weight, at most `repeats` times its own size.  Its whole
copies are `target // size`; what is left of the target is a budget of words for a subset of its
documents.  Documents are counted by exact length; most of the budget is taken proportionally from all
lengths, and a bounded-knapsack dynamic programme over the remaining counts settles the rest exactly
(or as near as sums of lengths come).  Which documents of a length are taken follows a seeded hash.

A length of a source with more than `SALT_ROWS` rows is dealt into hash classes of about that many, so that
neither a hot source nor a hot length puts more rows into one window; the programme of a source sees one
count a distinct length however many rows it has.  Sources are ordered by range, and their targets settle
in rounds that bring two numbers to the driver; tables of one row a source are broadcast only if small.

Nulls: a null text has no words and is never taken; a null source is a source of its own, last in
order; a null doc_id hashes as a value of its own.  Repeated rows are separate documents.  Extra
columns stay, but for those that have the name of a new one, which are replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.staging import Tables, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
REPEATS = 3
SALT_ROWS = 1 << 20
STRIDE = 32  # steps of the programme between the sums that are kept
SEED = 42
NAMES = {c: c for c in ("size", "source_size", "target", "copies")}


def shared(sources: DataFrame, repeats: int) -> DataFrame:
    """sources (_weight, _total and more) with _target: by weight, adding up to all totals, none above repeats x its own.

    The targets are the least of the bound and level x weight; a round finds the level that the sources below
    their bounds share, until no further source reaches its bound.
    """
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("_weight") * level > F.col("_total") * repeats
        row = sources.where("_total > 0").agg(
            F.sum("_total").alias("all"),
            F.sum(F.when(full, F.col("_total") * repeats)).alias("held"),
            F.sum(F.when(~full, F.col("_weight"))).alias("weight"),
        ).first()  # three numbers, whatever the number of sources
        new = ((row["all"] or 0) - (row["held"] or 0)) / row["weight"] if row["weight"] else level or 0.0
        if level is not None and new <= level:
            break
        level = float(new)
    target = F.least(F.col("_total") * float(repeats), F.col("_weight") * level)
    return sources.withColumn("_target", F.when(F.col("_total") > 0, target).otherwise(0.0))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths add up to near the budget.

    lengths: distinct and positive.  A proportional part of all lengths, then the longest ones, bring
    the budget down to a few times the longest; the programme does the rest, exactly where the
    counts that are left allow it.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    reach = 4 * int(lengths.max())
    bulk = max(0, budget - reach)
    taken = np.array([int(c) * bulk // total for c in counts], dtype=np.int64)
    left = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths):
        if left <= reach:
            break
        n = min(int(counts[i] - taken[i]), (left - reach) // int(lengths[i]) + 1)
        taken[i] += n
        left -= n * int(lengths[i])
    sums, steps = 1, []
    limit = (1 << (left + int(lengths.max()) + 1)) - 1  # sums past the budget by one document at most
    kept = {0: sums}  # what the sums were before every STRIDE-th step; those between are made again
    for i in np.argsort(lengths):
        spare, block = int(counts[i] - taken[i]), 1
        while spare > 0 and not sums >> left & 1:
            n = min(block, spare)
            steps.append((i, n))
            sums |= sums << n * int(lengths[i]) & limit
            if len(steps) % STRIDE == 0:
                kept[len(steps)] = sums
            spare -= n
            block *= 2
        if sums >> left & 1:
            break
    below = (sums & (1 << (left + 1)) - 1).bit_length() - 1
    above = sums >> left + 1
    above = left + (above & -above).bit_length() if above else None
    at = below if above is None or left - below <= above - left else above
    for low in reversed(range(0, len(steps), STRIDE)):
        part, before = steps[low : low + STRIDE], [kept[low]]
        for i, n in part[:-1]:
            before.append(before[-1] | before[-1] << n * int(lengths[i]) & limit)
        for (i, n), sums in zip(reversed(part), reversed(before), strict=True):
            if not sums >> at & 1:
                taken[i] += n
                at -= n * int(lengths[i])
    return taken


def _quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    """_quota of each length of one source."""
    taken = fit(pdf["_size"].to_numpy(), pdf["n"].to_numpy(dtype=np.int64), int(pdf["_budget"].iloc[0]))
    return pdf.assign(_quota=taken)[["_source", "_size", "_quota"]]


def _weighted(sources: DataFrame, weights: tuple[float, ...], tables: Tables) -> DataFrame:
    """sources with _weight by rank: sorted by range, ranks follow from the number of rows of each range."""
    ordered = sources.repartitionByRange(F.col("_source") == "", "_source").sortWithinPartitions(F.col("_source") == "", "_source")
    ordered = ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id() % F.lit(1 << 33)})
    ordered = tables.add(ordered, "mixing-sources")
    before, total = {}, 0
    for part, n in sorted(map(tuple, ordered.groupBy("_part").count().collect())):  # one row a range
        before[part], total = total, total + n
    if not before:
        return ordered.withColumn("_weight", F.lit(0.0))
    first = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_part"))
    place = F.pmod(first + F.col("_at"), F.lit(len(weights)))
    return ordered.withColumn("_weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int")))


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    repeats: int = REPEATS,
    seed: int = SEED,
    names: dict[str, str] = NAMES,
) -> DataFrame:
    """The given columns and size, source_size, target, copies (how often the mix takes each document).

    names: other names for the new columns.
    """
    tables = Tables(df.sparkSession)
    new = {n.lower() for n in names.values()}
    own = [F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(df.columns) if c.lower() not in new]
    back = [F.col(f"_own_{i}").alias(c) for i, c in enumerate(df.columns) if c.lower() not in new]
    # a null source gets a key of its own, so that one exchange serves the ranks and the join with quotas
    sized = df.select(
        *own,
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.col(key).alias("_id"),
        F.xxhash64(text).alias("_hash"),
    ).withColumn("_order", F.xxhash64(F.lit(seed), "_id", "_size"))
    histogram = tables.add(sized.groupBy("_source", "_size").agg(F.count("*").alias("n")), "mixing-lengths")
    totals = histogram.groupBy("_source").agg(F.sum(F.col("_size") * F.col("n")).alias("_total"))
    plans = shared(_weighted(totals, weights, tables), repeats)
    full = F.least(F.lit(repeats), F.floor(F.col("_target") / F.col("_total")))
    plans = plans.withColumn("_full", F.when(F.col("_total") > 0, full).otherwise(0).cast("long"))
    plans = plans.withColumn("_budget", F.round(F.col("_target") - F.col("_full") * F.col("_total")).cast("long"))
    plans = tables.add(plans.select("_source", "_total", "_target", "_full", "_budget"), "mixing-plans")
    quotas = tables.add(
        histogram.where("_size > 0")
        .join(small(plans.where("_budget > 0").select("_source", "_budget")), "_source")
        .groupBy("_source")
        .applyInPandas(_quotas, "_source string, _size long, _quota long")
        .where("_quota > 0"),
        "mixing-quotas",
    )
    # hash classes of hot lengths; their quotas are filled in order of the classes
    hot = histogram.where(F.col("n") > SALT_ROWS).select("_source", "_size", F.ceil(F.col("n") / SALT_ROWS).alias("_salts"))
    hot = tables.add(hot, "mixing-hot")
    salted = sized.withColumn("_salt", F.lit(0).cast("long"))
    if not hot.isEmpty():
        salted = sized.join(small(hot), ["_source", "_size"], "left").withColumn(
            "_salt", F.coalesce(F.pmod(F.xxhash64(F.lit("salt"), "_order", "_hash"), F.col("_salts")), F.lit(0))
        )
        classes = salted.where("_salts is not null").groupBy("_source", "_size", "_salt").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("_source", "_size").orderBy("_salt")) - F.col("n")
        parts = tables.add(classes.withColumn("_before", before), "mixing-classes")
        quotas = quotas.join(parts, ["_source", "_size"], "left").select(
            "_source",
            "_size",
            F.coalesce("_salt", F.lit(0).cast("long")).alias("_salt"),
            F.when(F.col("_salt").isNull(), F.col("_quota"))
            .otherwise(F.greatest(F.lit(0), F.least("n", F.col("_quota") - F.col("_before"))))
            .alias("_quota"),
        )
    else:
        quotas = quotas.withColumn("_salt", F.lit(0).cast("long"))
    keys = ["_source", "_size", "_salt"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_order", "_id", "_hash"))
    copies = F.col("_full") + (F.col("_rank") <= F.coalesce(F.col("_quota"), F.lit(0))).cast("long")
    return (
        salted.withColumn("_rank", rank)
        .join(quotas, keys, "left")
        .join(small(plans), "_source")
        .select(
            *back,
            F.col("_size").alias(names["size"]),
            F.col("_total").alias(names["source_size"]),
            F.col("_target").alias(names["target"]),
            F.when(F.col("_size") == 0, 0).otherwise(copies).cast("long").alias(names["copies"]),
        )
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sized = mix(documents)
    return sized.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
