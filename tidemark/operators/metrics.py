"""Detection metrics and comparisons."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import prefix
from tidemark.operators.match import STACK, Stack, by_bucket, stacks

THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
RECALL_POINTS = 101
#: Evaluation bins by side (least included, most excluded).
BINS = {"all": (0, np.inf), "tiny": (0, 16), "small": (0, 32), "16-32": (16, 32), "medium": (32, 96), "large": (96, np.inf)}


def _outcomes(s: Stack, order: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(n, ranks, bins, thresholds) of the predictions in `order` (n, ranks): 1 found a box of the bin, 2 found none and counts, 0 doesn't count."""
    values, least = s.ious(), np.array(THRESHOLDS)[:, None]
    inside = (s.t.side[:, None, :] >= low) & (s.t.side[:, None, :] < high)  # (n, bins, boxes)
    own = np.take_along_axis(s.p.side, order, 1)[:, :, None]
    own_size = (own >= low[:, 0]) & (own < high[:, 0]) & np.take_along_axis(s.p_there, order, 1)[:, :, None]
    free = np.ones((len(s.at), len(low), len(THRESHOLDS), s.t_there.shape[1]), dtype=bool)
    out = np.repeat(np.where(own_size, 2, 0).astype(np.int8)[..., None], len(THRESHOLDS), axis=3)
    if not s.t_there.shape[1]:
        return out
    for rank, i in enumerate(order.T):
        value = values[np.arange(len(s.at)), i]
        some = np.flatnonzero((value.max(axis=1) >= THRESHOLDS[0]) & s.p_there[np.arange(len(s.at)), i])
        if not len(some):
            continue
        # boxes of the bin come before the others, the best of them first
        v = value[some][:, None, None, :]
        left = np.where(free[some] & (v >= least), v + inside[some][:, :, None, :], -1.0)
        j = left.argmax(axis=3)
        n, b, k = np.nonzero(np.take_along_axis(left, j[..., None], 3)[..., 0] > 0)
        j, n = j[n, b, k], some[n]
        out[n, rank, b, k] = inside[n, b, j]
        free[n, b, k, j] = False
    return out


def scored_detections(predictions: DataFrame, truth: DataFrame, keys: list[str], most: int = 300) -> DataFrame:
    """E1, M-F: counts of predictions by class, bin, IoU threshold and confidence, and of the boxes to find.

    Boxes outside a bin are neither found nor missed: a prediction on one is left out, and so is an
    unmatched prediction of another size.  Rows without conf carry n_truth.  Counts are added up in
    every bucket before they are shuffled.
    """
    names = list(BINS)
    low, high = (np.array([BINS[n][i] for n in names])[:, None] for i in (0, 1))

    def run(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        found, conf, kind, sizes, own = [], [], [], [], []
        every, some = stacks(p, t, [*keys, "cls"])
        classes = every["cls"].to_numpy()
        for s in some:
            order = s.certain_first()[:, :most]
            step = max(1, STACK // (len(names) * len(THRESHOLDS) * max(1, order.shape[1], s.t_there.shape[1])))
            for at in range(0, len(s.at), step):
                part = Stack(s.at[at : at + step], *(b.rows(slice(at, at + step)) for b in (s.p, s.t)), *(x[at : at + step] for x in (s.p_there, s.t_there)))
                some_order = order[at : at + step]
                there = np.take_along_axis(part.p_there, some_order, 1)
                found.append(_outcomes(part, some_order, low, high)[there])
                conf.append(np.take_along_axis(part.p.conf, some_order, 1)[there])
                kind.append(np.repeat(classes[part.at], there.sum(axis=1)))
                sizes.append(part.t.side[part.t_there])
                own.append(np.repeat(classes[part.at], part.t_there.sum(axis=1)))
        parts = []
        if found:
            flags, conf, kind = np.concatenate(found), np.concatenate(conf), np.concatenate(kind)
            order = np.flatnonzero(~np.isnan(conf))
            order = order[np.lexsort((conf[order], kind[order]))]
            flags, conf, kind_of = flags[order], conf[order], kind[order]
            first = np.flatnonzero(np.concatenate([[True], (conf[1:] != conf[:-1]) | (kind_of[1:] != kind_of[:-1])])) if len(conf) else np.empty(0, int)
            if len(first):
                n, tp = (np.add.reduceat(x, first, axis=0, dtype=np.int64) for x in (flags > 0, flags == 1))
                i, b, k = np.nonzero(n)
                parts.append(pd.DataFrame({
                    "cls": kind_of[first][i], "bin": np.array(names, dtype=object)[b], "iou": np.array(THRESHOLDS)[k],
                    "conf": conf[first][i], "tp": tp[i, b, k], "n": n[i, b, k], "n_truth": 0,
                }))
            side, owner = np.concatenate(sizes), np.concatenate(own)
            classes = np.unique(np.concatenate([owner, kind]))
            parts.append(pd.DataFrame(
                [(int(c), n, np.nan, np.nan, 0, 0, int(((side >= BINS[n][0]) & (side < BINS[n][1]) & (owner == c)).sum())) for c in classes for n in names],
                columns=["cls", "bin", "iou", "conf", "tp", "n", "n_truth"],
            ))
        parts = [p for p in parts if len(p)]
        return pd.concat(parts) if parts else pd.DataFrame(columns=["cls", "bin", "iou", "conf", "tp", "n", "n_truth"])

    schema = "cls int, bin string, iou double, conf double, tp long, n long, n_truth long"
    return by_bucket(predictions, truth, [*keys, "cls"], run, schema)


def average_precision(scored: DataFrame, range_rows: int = prefix.RANGE_ROWS) -> DataFrame:
    """By class and bin: ap (mean over thresholds), ap50, ap75, ar; null without boxes to find.

    scored: from `scored_detections`; it is written once.
    """
    scored = prefix.kept(scored, "scored")
    truth = scored.groupBy("cls", "bin").agg(F.sum("n_truth").alias("n_truth"))
    bit = F.lit(0)
    for k, t in enumerate(THRESHOLDS):
        bit = F.when(F.col("iou") == t, 1 << k).otherwise(bit)
    found, missed = F.struct(bit.alias("hits"), F.col("tp").alias("n")), F.struct(F.lit(0).alias("hits"), (F.col("n") - F.col("tp")).alias("n"))
    detections = scored.select("cls", "bin", "conf", bit.alias("counted"), F.explode(F.array(found, missed)).alias("x"))
    return precision_of(detections.select("cls", "bin", "conf", "x.hits", "counted", "x.n").where("n > 0 AND counted > 0"), truth, range_rows)


def precision_of(detections: DataFrame, truth: DataFrame, range_rows: int = prefix.RANGE_ROWS) -> DataFrame:
    """E1, the same of detections that stand once for all thresholds: cls, bin, conf, hits, counted, n; truth: cls, bin, n_truth.

    Bit k of hits and counted is threshold k's.  Precision at 101 recalls: the best precision at that recall or a higher one.  Equal confidences
    enter together.  A range of confidences learns from the totals of those before it where its sums begin, and gives its best precisions and
    the few levels that reach a recall point.  So no curve is one task, and a detection is one short row, shuffled once, or twice where equal
    confidences are so many that they are counted first.
    """
    by, place = ["cls", "bin"], ["cls", "bin", prefix.RANGE]
    known = detections.withColumn("conf", F.nanvl(F.col("conf").cast("double"), F.lit(None))).where("conf IS NOT NULL")
    rows = prefix.ranged(known, by, "conf", range_rows)
    masks = prefix.kept(rows.groupBy(*place, "hits", "counted").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "masks")
    most = masks.groupBy(*place).agg(F.sum("rows").alias("rows")).agg(F.max("rows")).first()[0] or 0
    # only a confidence of very many rows makes a range long
    levels = rows if most <= 2 * range_rows else rows.groupBy(*place, "conf", "hits", "counted").agg(F.sum("n").alias("n"))
    masks = masks.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(len(THRESHOLDS))])))

    def total(mask: str) -> Column:
        return F.sum(F.when(F.expr(f"shiftright({mask}, k) & 1") == 1, F.col("n")).otherwise(0))

    ahead = Window.partitionBy(*by, "k").orderBy(prefix.RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = masks.groupBy(*place, "k").agg(total("hits").alias("tp"), total("counted").alias("n"))
    before = before.select(*place, "k", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("tp", "n")])
    before = prefix.joined(before, truth, by).toDF("own_cls", "own_bin", "own_range", "k", "tp", "n", "n_truth")
    found = levels.groupBy(*place).cogroup(before.groupBy("own_cls", "own_bin", "own_range")).applyInArrow(_reached, f"cls int, bin string, {prefix.RANGE} int, k int, points double, best double, recall double")
    # places rise as confidence falls
    lower = Window.partitionBy(*by, "k").orderBy(-F.col(prefix.RANGE)).rangeBetween(Window.unboundedPreceding, -1)
    area = F.col("points") * F.greatest("best", F.max("best").over(lower))
    areas = found.withColumn("area", area).groupBy(*by, "k").agg((F.sum("area") / RECALL_POINTS).alias("ap"), F.max("recall").alias("ar"))
    every = truth.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(len(THRESHOLDS))])))
    every = prefix.joined(every, areas, [*by, "k"])

    def known_of(c: str) -> Column:
        return F.when(F.col("n_truth") > 0, F.coalesce(c, F.lit(0.0)))

    return every.groupBy("cls", "bin").agg(
        F.max("n_truth").alias("n_truth"),
        F.avg(known_of("ap")).alias("ap"),
        F.max(F.when(F.col("k") == THRESHOLDS.index(0.5), known_of("ap"))).alias("ap50"),
        F.max(F.when(F.col("k") == THRESHOLDS.index(0.75), known_of("ap"))).alias("ap75"),
        F.avg(known_of("ar")).alias("ar"),
    )


def _reached(levels: pa.Table, before: pa.Table) -> pa.Table:
    """One range by threshold: levels that reach recall points, with the best precision from them on within the range, and a row without points for the whole range."""
    conf, hits, counted, n = (levels[c].to_numpy() for c in ("conf", "hits", "counted", "n"))
    order = np.argsort(-conf, kind="stable")
    conf, hits, counted, n = conf[order], hits[order], counted[order], n[order]
    ends = np.append(np.flatnonzero(conf[1:] != conf[:-1]), len(conf) - 1)
    parts = []
    for r in before.to_pylist():
        if not r["n_truth"] or r["n_truth"] < 0:
            continue
        tp, all_n = (np.cumsum(n * (x >> r["k"] & 1))[ends] + r[c] for x, c in ((hits, "tp"), (counted, "n")))
        there = np.diff(all_n, prepend=r["n"]) > 0  # a level of this threshold
        tp, all_n = tp[there], all_n[there]
        if not len(tp):
            continue
        recall = tp / r["n_truth"]
        best = np.maximum.accumulate((tp / all_n)[::-1])[::-1]
        steps = np.floor(recall * (RECALL_POINTS - 1) + 1e-9)
        # a level reaches the recall points above the level before it
        first = np.floor(r["tp"] / r["n_truth"] * (RECALL_POINTS - 1) + 1e-9) if r["n"] else -1.0
        points = np.diff(steps, prepend=first)
        at = np.flatnonzero(points)
        parts.append((r, np.append(points[at], 0.0), np.append(best[at], best[0]), np.append(recall[at], recall[-1])))
    sizes = [len(p[1]) for p in parts]
    kinds = {"own_cls": pa.int32(), "own_bin": pa.string(), "own_range": pa.int32(), "k": pa.int32()}
    same = {c: [r[c] for (r, *_), size in zip(parts, sizes, strict=True) for _ in range(size)] for c in kinds}
    numbers = [np.concatenate([p[i] for p in parts] or [np.empty(0)]) for i in (1, 2, 3)]
    named = pa.table({c: pa.array(same[c], kind) for c, kind in kinds.items()} | dict(zip(("points", "best", "recall"), numbers, strict=True)))
    return named.rename_columns(["cls", "bin", prefix.RANGE, "k", "points", "best", "recall"])


def operating_points(curve: DataFrame, sizes: DataFrame, false_rate: float = 0.3, recall: float = 0.9) -> DataFrame:
    """One row: the best threshold under the false-box rate, and the first of the wanted tiny recall.

    curve: conf, tiny, small, fp, cumulative; sizes: one row of images and n_tiny.  Without a threshold under the rate nothing is found at
    1.000001.
    """
    order = F.struct("tiny", "small", (-F.col("fp")).alias("less"), "conf")
    found = curve.join(F.broadcast(sizes.select("images", "n_tiny"))).agg(
        F.max(F.when(F.col("fp") <= false_rate * F.col("images"), order)).alias("b"),
        F.max(F.when(F.col("tiny") >= recall * F.col("n_tiny"), F.col("conf"))).alias("conf_at_recall"),
    )
    return found.select(
        F.coalesce("b.conf", F.lit(1.000001)).alias("conf"),
        F.coalesce("b.tiny", F.lit(0)).alias("tiny"),
        F.coalesce("b.small", F.lit(0)).alias("small"),
        F.coalesce(-F.col("b.less"), F.lit(0)).alias("fp"),
        "conf_at_recall",
    )


def bounds(units: DataFrame, value: str, *by: str) -> DataFrame:
    """E5: least and most matches over the alignments of a unit."""
    return units.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"))


def compared(rows: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, field, ok: numbers within 1e-12 relative or 1e-10 absolute, other text equal.

    Both tables hold text; rows of one side only are not ok.
    """
    fields = [c for c in rows.columns if c not in keys]

    def long(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in fields])
        return df.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.field", f"x.{name}")

    both = long(rows, "a").join(long(reference, "b"), [*keys, "field"], "full_outer")
    a, b = F.col("a").try_cast("double"), F.col("b").try_cast("double")
    close = F.abs(a - b) <= F.greatest(1e-12 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-10))
    ok = F.coalesce(close, F.col("a").eqNullSafe(F.col("b")))
    return both.select(*keys, "field", ok.alias("ok"))


#: Models of the comparison table in order.
MODELS = ("plain", "adaptive", "dense")


def comparison_rows(summaries: DataFrame) -> DataFrame:
    """One row a run, fractions as percentages, models in their order and then by seed.

    summaries: model, seed, struct normal.overall and the bins' AP columns.
    """
    points = [
        F.round(100 * F.col(c), 6).alias(c) for c in ("tiny_fire_AP", "small_fire_AP", "small_smoke_AP")
    ]
    overall = [F.round(100 * F.col(f"normal.overall.{c}"), 6).alias(f"overall_{c}") for c in ("AP", "AP50")]
    rest = [c for c in ("training_hours", "parameters") if c in summaries.columns]
    order = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))
    return summaries.select("model", "seed", *points, *overall, *rest).orderBy(order, "seed")
