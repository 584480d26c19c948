"""Runs, coherence and sessions over ordered frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text
from tidemark.functions.hashing import hamming
from tidemark.operators import prefix

#: Thresholds of the coherence test.
HASH_THRESHOLD, LOOKAHEAD, LEAST_LENGTH, SMOOTH_RATIO = 18, 2, 5, 0.60
TASK_ROWS, CHUNKS, FEW_CHUNKS = 1 << 19, 64, 1 << 20  # rows of a task, its chunks about, chunks that may be broadcast
EXCLUDED_PREFIX = "neitherFireNorSmoke"


def contiguous_runs(entries: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Adds run_id within prefix: a run breaks at a gap, without an index, or where the size changes.

    entries: prefix, idx, name, width, height.  They are written once, and a long prefix is cut into chunks of its indices, so that a task
    has about task_rows rows however many there are: a chunk learns from those before it their last entry and how many runs they start.
    """
    place = F.greatest("idx", F.lit(0))
    kept = prefix.kept(entries)
    sizes = kept.groupBy("prefix").agg(F.count("*").alias("n"), F.max(place).alias("last"))
    prefixes, rows, most, last = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.max("n"), F.max("last")).first()
    tasks, chunks = max(1, -(-rows // task_rows)), max(1, -(-(most or 0) * CHUNKS // task_rows))
    if tasks == 1 or chunks == 1:
        order = Window.partitionBy("prefix").orderBy(place, "name")
        found = kept if tasks == 1 else kept.repartition(tasks, "prefix")
        start = _breaks(_entry(), F.lag(_entry()).over(order))
        return found.withColumn("_start", start).withColumn("run_id", F.sum("_start").over(order)).drop("_start")
    by = ["prefix", "_chunk"]
    ties = ["name", "idx", "width", "height"]
    order = Window.partitionBy(*by).orderBy(place, *ties)
    cut = kept.withColumn("_chunk", F.floor(place / F.lit((last + 1) / chunks))).repartition(tasks, *by)
    cut = cut.withColumn("_before", F.lag(_entry()).over(order))
    inside = F.when(F.col("_before").isNotNull(), _breaks(_entry(), F.col("_before"))).otherwise(0)
    key = F.struct(place, *ties)
    totals = cut.groupBy(*by).agg(F.sum(inside).alias("_inside"), F.min_by(_entry(), key).alias("_first"), F.max_by(_entry(), key).alias("_last"))
    along = Window.partitionBy("prefix").orderBy("_chunk")
    totals = totals.withColumn("_earlier", F.lag("_last").over(along))
    starts = F.col("_inside") + _breaks(F.col("_first"), F.col("_earlier"))
    ahead = F.coalesce(F.sum(starts).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = totals.select(*by, "_earlier", ahead.alias("_ahead"))
    if prefixes + rows * CHUNKS // task_rows <= FEW_CHUNKS:
        ahead = F.broadcast(ahead)
    found = prefix.joined(cut, ahead, by)
    found = found.withColumn("_start", _breaks(_entry(), F.coalesce("_before", "_earlier")))
    return found.select(*entries.columns, (F.col("_ahead") + F.sum("_start").over(order)).alias("run_id"))


def _entry() -> Column:
    return F.struct("idx", "width", "height")


def _breaks(here: Column, before: Column) -> Column:
    """1 where an entry doesn't go on with the run of the one before it, null: none."""
    same = (
        (here["idx"] >= 0)
        & (here["idx"] == before["idx"] + 1)
        & (here["width"] > 0)
        & (here["height"] > 0)
        & (here["width"] == before["width"])
        & (here["height"] == before["height"])
    )
    return (~F.coalesce(same, F.lit(False))).cast("int")


def video_candidates(runs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """runs long enough, of prefixes that can be videos: prefix, run_id, n, first_idx, last_idx."""
    return (
        runs.groupBy("prefix", "run_id")
        .agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
        .where((F.col("n") >= least) & ~F.col("prefix").startswith(EXCLUDED_PREFIX))
    )


def contiguous(rows: DataFrame, index: str, *by: str) -> DataFrame:
    """W2, AC2, AC4: whether each group's indices are exactly 0 to n - 1; nulls are counted apart."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(index).isNull()).alias("n_null"),
        F.coalesce(
            (F.min(index) == 0) & (F.max(index) == F.count("*") - 1) & (F.count_distinct(index) == F.count("*")),
            F.lit(False),
        ).alias("contiguous"),
    )


def smooth_flags(frames: DataFrame, by: list[str], order: list[str], threshold: int = HASH_THRESHOLD) -> DataFrame:
    """Distance to the next frame, and whether the transition is smooth.

    A transition i to i + 1 is smooth if the two are close, or a flicker is bridged: i is close to
    i + 2 or i + 3, or i - 1 or i - 2 is close to i + 1.  Null at the last frame.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    here, after = F.col("dhash"), {k: F.lead("dhash", k).over(w) for k in range(1, LOOKAHEAD + 2)}
    back = {k: F.lag("dhash", k).over(w) for k in range(1, LOOKAHEAD + 1)}
    close = [hamming(here, after[k]) <= threshold for k in after]
    close += [hamming(back[k], after[1]) <= threshold for k in back]
    flag = F.lit(False)
    for c in close:
        flag = flag | F.coalesce(c, F.lit(False))
    return frames.withColumn("distance", hamming(here, after[1])).withColumn(
        "smooth", F.when(after[1].isNotNull(), flag)
    )


def coherence(flagged: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """By run, n, median distance, smooth ratio, longest smooth streak, coherent."""
    w = Window.partitionBy(*by).orderBy(*order)
    breaks = F.sum(F.when(F.col("smooth"), 0).otherwise(1)).over(w)
    streaks = flagged.withColumn("_b", breaks)
    lengths = streaks.groupBy(*by, "_b").agg(
        F.count_if("smooth").alias("_streak"),
        F.count("*").alias("_n"),
        F.count("smooth").alias("_t"),
    )
    rows = lengths.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        F.max("_streak").alias("longest"),
        F.try_divide(F.sum("_streak"), F.sum("_t")).alias("smooth_ratio"),
    )
    medians = flagged.groupBy(*by).agg(F.median("distance").alias("median_distance"))
    enough = F.least(F.lit(LEAST_LENGTH - 1), F.col("n") - 1)
    test = (
        (F.col("n") >= LEAST_LENGTH)
        & ((F.col("median_distance") <= HASH_THRESHOLD) | (F.col("smooth_ratio") >= SMOOTH_RATIO))
        & (F.col("longest") >= enough)
    )
    return rows.join(medians, by).withColumn("coherent", F.coalesce(test, F.lit(False)))


def coherent_segments(runs: DataFrame) -> DataFrame:
    """Frames of accepted segments with segment, frame_index, sequence_length and video_id.

    A coherent run is one segment; another run is cut at its rough transitions and its pieces are
    judged again by flags of their own.  runs: prefix, run_id, idx, name, dhash.
    """
    order, run = ["idx", "name"], ["prefix", "run_id"]
    flagged = smooth_flags(runs, run, order)
    whole = coherence(flagged, run, order).select(*run, F.col("coherent").alias("whole"))
    w = Window.partitionBy(*run).orderBy(*order)
    rough = F.coalesce(F.lag("smooth").over(w) == F.lit(False), F.lit(False)).cast("int")
    cut = flagged.withColumn("_r", rough).withColumn("piece", F.sum("_r").over(w)).join(whole, run)
    cut = cut.withColumn("piece", F.when(F.col("whole"), 0).otherwise(F.col("piece"))).drop("smooth", "distance", "_r")
    piece = [*run, "piece"]
    judged = coherence(smooth_flags(cut, piece, order), piece, order).where("coherent").select(*piece, "n")
    # segments are numbered before they meet their frames again
    judged = judged.withColumn("_clean", text.clean_prefix(F.col("prefix")))
    judged = judged.withColumn("_number", F.row_number().over(Window.partitionBy("_clean").orderBy(*piece)))
    return cut.join(judged, piece).select(
        *runs.columns,
        "piece",
        (F.row_number().over(Window.partitionBy(*piece).orderBy(*order)) - 1).alias("frame_index"),
        F.col("n").alias("sequence_length"),
        F.concat(F.col("_clean"), F.lit("_video_"), F.format_string("%04d", "_number")).alias("video_id"),
    )


def gaps(frames: DataFrame, by: list[str], time: str = "ts_sec", flag: str = "flag") -> DataFrame:
    """Presence and missing runs; a frame lasts until the next one, the last has no length."""
    w = Window.partitionBy(*by).orderBy(time)
    held = frames.withColumn("_len", F.coalesce(F.lead(time).over(w) - F.col(time), F.lit(0.0))).withColumn(
        "_change", F.coalesce((F.lag(flag).over(w) != F.col(flag)), F.lit(True)).cast("int")
    )
    held = held.withColumn("_run", F.sum("_change").over(w))
    islands = held.groupBy(*by, "_run").agg(F.first(flag).alias("_on"), F.sum("_len").alias("_len"))
    first_on = F.min(F.when(F.col("_on"), F.col("_run"))).over(Window.partitionBy(*by))
    last_on = F.max(F.when(F.col("_on"), F.col("_run"))).over(Window.partitionBy(*by))
    missing = ~F.col("_on")
    inner = missing & (F.col("_run") > F.col("_first")) & (F.col("_run") < F.col("_last"))
    return (
        islands.withColumn("_first", first_on)
        .withColumn("_last", last_on)
        .groupBy(*by)
        .agg(
            F.sum("_len").alias("duration"),
            F.try_divide(F.sum(F.when(F.col("_on"), F.col("_len")).otherwise(0.0)), F.sum("_len")).alias("presence"),
            F.count_if(missing).alias("missing_runs"),
            F.coalesce(F.max(F.when(missing, F.col("_len"))), F.lit(0.0)).alias("longest_missing"),
            F.count_if(inner).alias("internal_gaps"),
            F.sum(F.when(inner, F.col("_len")).otherwise(0.0)).alias("internal_missing"),
        )
    )


def incidents(alarms: DataFrame, by: list[str], time: str, gap: float) -> DataFrame:
    """Adds incident number; a new one begins when the last alarm is at least `gap` back."""
    w = Window.partitionBy(*by).orderBy(time)
    new = F.coalesce(F.col(time) - F.lag(time).over(w) >= gap, F.lit(True)).cast("int")
    return alarms.withColumn("_new", new).withColumn("incident", F.sum("_new").over(w)).drop("_new")


def negative_exposure(ts: Column, frame_sec: Column, ignition: Column, dt: Column) -> Column:
    """Seconds of a frame before ignition; all of dt where there is none (-1)."""
    before = F.greatest(F.lit(0.0), F.least(ts + frame_sec, ignition) - ts)
    return F.when(ignition == -1, dt).otherwise(before)


def operating_curve(rows: DataFrame, confidence: str, counts: list[str], by: list[str], range_rows: int = prefix.RANGE_ROWS) -> DataFrame:
    """Cumulative counts at each distinct confidence; ties enter together.

    Counts are first added up by confidence; the sums run over ranges of confidences, so a curve of any length is many tasks' work.
    """
    level = rows.groupBy(*by, confidence).agg(*[F.sum(c).alias(c) for c in counts])
    curve = prefix.running(prefix.cut(level, by, confidence, range_rows), by, confidence, counts)
    return curve.select(*by, confidence, *counts)


def time_windows(rows: DataFrame, by: list[str], micros: str) -> DataFrame:
    """Presence counts the rows in (t - 0.4 s, t], history those in [t - 3 s, t]; micros: bigint."""
    w = Window.partitionBy(*by).orderBy(micros)
    return rows.withColumn("presence", F.count("*").over(w.rangeBetween(-399_999, 0))).withColumn(
        "history", F.count("*").over(w.rangeBetween(-3_000_000, 0))
    )


def _steps(rows: DataFrame, by: list[str], time: str, value: str, tau: float, chunk_sec: float) -> DataFrame:
    """by, t, v, _chunk, and what the value adds: (1 - exp(-dt / tau)) v, the whole first value; null until `_entered` for a chunk's first row."""
    points = rows.select(*by, F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v")).where("t IS NOT NULL AND v IS NOT NULL")
    points = points.withColumn("_chunk", F.floor(F.col("t") / chunk_sec))
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*by, "_chunk").orderBy("t", "v"))
    return points.withColumn("_adds", (1 - F.exp(-gap / tau)) * F.col("v"))


def _chunks(steps: DataFrame, by: list[str], tau: float) -> DataFrame:
    """A row a chunk: its ends, what its first value adds after the chunk before it, and the chunk's own sum at its end."""
    ends = Window.partitionBy(*by, "_chunk")
    last = F.max("t").over(ends)
    some = steps.withColumn("_rest", F.col("_adds") * F.exp((F.col("t") - last) / tau)).groupBy(*by, "_chunk").agg(
        F.min("t").alias("_low"), F.max("t").alias("_high"), F.min_by("v", F.struct("t", "v")).alias("_first"), F.coalesce(F.sum("_rest"), F.lit(0.0)).alias("_rest")
    )
    before = F.lag("_high").over(Window.partitionBy(*by).orderBy("_chunk"))
    enters = F.col("_first") * F.when(before.isNull(), 1.0).otherwise(1 - F.exp((before - F.col("_low")) / tau))
    some = some.withColumn("_enters", enters)
    return some.withColumn("_sum", F.col("_rest") + F.col("_enters") * F.exp((F.col("_low") - F.col("_high")) / tau))


def smoothed(rows: DataFrame, by: list[str], time: str, value: str, tau: float, chunks: float = 500.0) -> DataFrame:
    """Exponential smoothing with weight 1 - exp(-dt / tau); one row a group, the last state.

    A step is an affine map of the state, and maps compose: a chunk of `chunks` time constants is one map, found by a window within the chunk
    and a sum; the state is the sum of what the chunks have left of them at the end.  So a group is as many tasks' work as it has
    chunks.  Equal times go by value, of which the first counts; rows without time or value are left out.
    """
    found = _chunks(_steps(rows, by, time, value, tau, chunks * tau), by, tau)
    end = F.max("_high").over(Window.partitionBy(*by))
    left = F.col("_sum") * F.exp((F.col("_high") - end) / tau)
    return found.withColumn("_left", left).groupBy(*by).agg(F.sum("_left").alias("smoothed"))


def smoothed_rows(rows: DataFrame, by: list[str], time: str, value: str, tau: float, chunks: float = 100.0) -> DataFrame:
    """By, t, v and the state after each row.

    The second pass: a chunk starts from the state that the chunks before it leave, and within it a running sum of what the rows add, scaled to
    the chunk's start, gives every state.  Chunks are of 40 time constants or more: what is older than the two before it is then nothing.
    """
    if chunks < 40:
        raise ValueError("a chunk is 40 time constants or longer")
    steps = _steps(rows, by, time, value, tau, chunks * tau)
    some = _chunks(steps, by, tau)
    order = Window.partitionBy(*by).orderBy("_chunk")
    state = F.aggregate(
        F.collect_list(F.struct(F.col("_high").alias("h"), F.col("_sum").alias("s"))).over(order.rowsBetween(-2, -1)),
        F.lit(0.0), lambda a, x: a + x["s"] * F.exp((x["h"] - F.col("_low")) / tau),
    )
    some = some.withColumn("_state", state).select(*[F.col(c).alias(f"_own_{c}") for c in [*by, "_chunk"]], "_low", "_enters", "_state")
    on = F.lit(True)
    for c in [*by, "_chunk"]:
        on = on & F.col(c).eqNullSafe(F.col(f"_own_{c}"))
    joined = steps.join(some, on)
    grown = F.coalesce(F.col("_adds"), F.col("_enters")) * F.exp((F.col("t") - F.col("_low")) / tau)
    upto = Window.partitionBy(*by, "_chunk").orderBy("t", "v").rowsBetween(Window.unboundedPreceding, 0)
    at = (F.col("_state") + F.sum(grown).over(upto)) * F.exp((F.col("_low") - F.col("t")) / tau)
    return joined.select(*by, "t", "v", at.alias("smoothed"))


def keyframes(frames: DataFrame, by: list[str], stride: int, around: float = 3.0, before: float = 1.0) -> DataFrame:
    """Every stride-th frame, those within 3 s of the first candidate, and those around ignition.

    frames: frame_index, ts_sec, is_candidate, ignition (-1 or null: none).
    """
    first = F.min(F.when(F.col("is_candidate"), F.col("ts_sec"))).over(Window.partitionBy(*by))
    t, i = F.col("ts_sec"), F.col("ignition")
    near = (i >= 0) & t.between(i - before, i + around)
    wanted = (F.col("frame_index") % stride == 0) | F.coalesce(t.between(first, first + around), F.lit(False))
    marked = frames.withColumn("_k", wanted | F.coalesce(near, F.lit(False)))
    return marked.where("_k").drop("_k")


def folder_partition(path: Column, subset: Column) -> Column:
    """(class, sign) from the two folders above a file of the firesense subset, else null."""
    parts = F.split(text.posix(path), "/")
    kind, sign = F.lower(F.try_element_at(parts, F.lit(-3))), F.lower(F.try_element_at(parts, F.lit(-2)))
    known = (subset == "firesense") & kind.isin("fire", "smoke") & sign.isin("pos", "neg")
    return F.when(known, F.struct(kind.alias("kind"), sign.alias("sign")))


def above(boxes: Column, least: float) -> Column:
    """boxes at or above a raw confidence threshold."""
    return F.filter(boxes, lambda b: b["conf"] >= least)


def development_only(rows: DataFrame, split: str = "split") -> DataFrame:
    """the rows, or an error where one belongs to another split."""
    wrong = F.raise_error(F.concat(F.lit("not a development row: "), F.coalesce(F.col(split), F.lit("null"))))
    return rows.withColumn(split, F.when(F.col(split) == "development", F.col(split)).otherwise(wrong.cast("string")))
