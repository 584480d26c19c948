import random
from statistics import median

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import dedup, profile, segment, split


def plain_flags(h, threshold=18):
    def d(i, j):
        return bin((h[i] ^ h[j]) & (2**64 - 1)).count("1")

    out = []
    for i in range(len(h) - 1):
        pairs = [(i, i + 1), (i, i + 2), (i, i + 3), (i - 1, i + 1), (i - 2, i + 1)]
        out.append(any(0 <= a and b < len(h) and d(a, b) <= threshold for a, b in pairs))
    return out


def plain_coherent(h):
    n = len(h)
    if n < 5:
        return False
    flags = plain_flags(h)
    d = [bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(h, h[1:])]
    streak = best = 0
    for f in flags:
        streak = streak + 1 if f else 0
        best = max(best, streak)
    return (median(d) <= 18 or sum(flags) / len(flags) >= 0.6) and best >= min(4, n - 1)


def plain_segments(h):
    if plain_coherent(h):
        return [list(range(len(h)))]
    pieces, now = [], [0]
    for i, f in enumerate(plain_flags(h)):
        if not f:
            pieces.append(now)
            now = []
        now.append(i + 1)
    pieces.append(now)
    return [p for p in pieces if plain_coherent([h[i] for i in p])]


def test_coherent_segments_against_a_plain_version(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for clip in range(30):
        h, now = [], rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            if rng.random() < 0.2:
                now = rng.getrandbits(64)
            now ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 12)))
            h.append(now)
        name = f"clip{clip:02d}_"
        rows += [(name, 1, i, f"{i:03d}", v - 2**64 if v >= 2**63 else v) for i, v in enumerate(h)]
        expected[name] = plain_segments(h)
    df = spark.createDataFrame(rows, "prefix string, run_id int, idx bigint, name string, dhash bigint")
    got = {}
    for r in segment.coherent_segments(df).orderBy("prefix", "piece", "idx").collect():
        got.setdefault(r.prefix, {}).setdefault(r.piece, []).append(r)
    for name, pieces in expected.items():
        assert [[r.idx for r in p] for p in got.get(name, {}).values()] == pieces
        for p in got.get(name, {}).values():
            assert [r.frame_index for r in p] == list(range(len(p)))
            assert {r.sequence_length for r in p} == {len(p)} and len({r.video_id for r in p}) == 1


def test_runs_break_at_gaps_sizes_and_names_without_index(spark):
    rows = [("a_", i, f"a{i}", 640, 480) for i in (0, 1, 2, 4, 5)] + [("a_", 6, "a6", 320, 480), ("a_", 7, "a7", 0, 0)]
    rows += [("b", -1, "b", 640, 480), ("b", -1, "c", 640, 480)]
    df = spark.createDataFrame(rows, "prefix string, idx bigint, name string, width int, height int")
    got = {(r.prefix, r.name): r.run_id for r in segment.contiguous_runs(df).collect()}
    assert [got["a_", f"a{i}"] for i in (0, 1, 2, 4, 5, 6, 7)] == [1, 1, 1, 2, 2, 3, 4]
    assert got["b", "b"] != got["b", "c"]


def test_gap_statistics(spark):
    rows = [("v", float(i), f) for i, f in enumerate([False, True, False, True, False, False])]
    got = segment.gaps(spark.createDataFrame(rows, "clip string, ts_sec double, flag boolean"), ["clip"]).first()
    assert (got.missing_runs, got.longest_missing, got.internal_gaps) == (3, 1.0, 1)
    assert got.presence == pytest.approx(0.4)


def test_keyframes(spark):
    def run(candidates):
        rows = [("c", i, i / 10, candidates, -1.0) for i in range(40)]
        kind = "clip string, frame_index int, ts_sec double, is_candidate boolean, ignition double"
        return sorted(r.frame_index for r in segment.keyframes(spark.createDataFrame(rows, kind), ["clip"], 5).collect())

    assert run(True) == [*range(31), 35]
    assert run(False) == list(range(0, 40, 5))


def test_incident_gap_of_exactly_one_second_is_new(spark):
    df = spark.createDataFrame([("c", t) for t in (0.0, 0.5, 1.5, 2.4)], "clip string, t double")
    assert [r.incident for r in segment.incidents(df, ["clip"], "t", 1.0).orderBy("t").collect()] == [1, 1, 2, 2]


@pytest.mark.parametrize("k", [0, 4, 8, 12])
def test_near_pairs_against_all_pairs(spark, k):
    rng = random.Random(k)
    base = [rng.getrandbits(64) for _ in range(40)]
    base += [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 10))) for b in base]
    signed = [b - 2**64 if b >= 2**63 else b for b in base]
    df = spark.createDataFrame(list(enumerate(signed)), "id bigint, h bigint")
    got = sorted((r.a, r.b, r.distance) for r in dedup.near_pairs(df, df, "id", "h", k, one_sided=True).collect())
    want = [(i, j, (base[i] ^ base[j]).bit_count()) for i in range(80) for j in range(i + 1, 80)]
    assert got == [w for w in want if w[2] <= k]
    if k > dedup.BANDED_UP_TO:  # in blocks, and of two tables
        blocks = dedup.near_pairs(df, df, "id", "h", k, one_sided=True, block_rows=7)
        assert sorted(map(tuple, blocks.collect())) == got
        both = sorted(map(tuple, dedup.near_pairs(df, df, "id", "h", k, block_rows=9).collect()))
        assert both == sorted([*got, *((b, a, d) for a, b, d in got), *((i, i, 0) for i in range(80))])


def test_wide_limits_at_many_values(spark):
    """Rows that leave the comparison are near pairs, not candidates; 4.5 x 10^8 pairs are compared as arrays."""
    df = spark.range(30_000).select("id", F.xxhash64("id").alias("h"))
    turned = df.where("id % 300 = 0").select((F.col("id") + 1_000_000).alias("id"), F.col("h").bitwiseXOR(F.lit(0b1011011)).alias("h"))
    rows = df.unionAll(turned)
    got = dedup.near_pairs(rows, rows, "id", "h", 9, one_sided=True)
    planted = got.where("b = a + 1000000 AND distance = 5").count()
    assert planted == 100 and got.count() < 1000


def test_splits_keep_groups_whole_and_counts_exact(spark):
    rows = [(f"v{i % 37}", f"f{i}", ["fire", "smoke"][i % 2], 640, 480, i % 50 == 0) for i in range(500)]
    kind = "video_id string, filename string, category string, width int, height int, is_corrupt boolean"
    df = spark.createDataFrame(rows, kind)
    df = df.withColumn("video_id", F.when(F.col("filename").endswith("3"), None).otherwise(F.col("video_id")))
    got = split.partition(df, 0.8).toPandas()
    assert len(got) == 500 and (got.loc[got.is_corrupt, "split"] == "quarantine").all()
    good = got[~got.is_corrupt]
    videos = good.dropna(subset=["video_id"]).groupby("video_id")["split"].agg(["nunique", "first"])
    assert (videos["nunique"] == 1).all()
    assert (videos["first"] == "train").sum() == split.cutoff(len(videos), 0.8)
    for _, part in good[good.video_id.isna()].groupby("category"):
        assert (part["split"] == "train").sum() == split.cutoff(len(part), 0.8)


def test_exact_splits():
    ids = [f"v{i}" for i in range(10)]
    assert split.exact_split(ids, 0.8, 42) == split.exact_split(ids[::-1], 0.8, 42)
    assert sorted(split.exact_split(ids, 0.8, 42).values()).count("train") == 8
    assert split.exact_split(["x"], 0.5, 1) == {"x": "train"} and split.exact_split(["x"], 0.4, 1) == {"x": "val"}
    assert [split.cutoff(n, 0.99) for n in (0, 1, 2, 5)] == [0, 1, 1, 4]
    assert len(split.exact_stratified(ids, {"b": ["s1", "s2"], "a": ["t1", "t2", "t3"]}, 0.5, 7)) == 15


def test_summary_has_nulls_for_empty_denominators(spark):
    df = spark.createDataFrame(
        [("v", None, None, None, 0, 0, 0, 0.0)],
        "variant string, label boolean, detected boolean, ttd_sec double, false_frames int, negative_frames int, "
        "incidents int, negative_sec double",
    )
    got = profile.clip_summary(df).first()
    assert got.recall is None and got.f1 is None and got.alarms_per_hour is None


def test_rough_frames_are_rough_whatever_their_vectors(spark):
    """Nearness by chance made clips longer than their SQL has them."""
    from pyspark.sql import functions as F

    from tidemark.functions.hashing import hamming
    from tidemark.plans import queries_events

    frames = spark.range(25).select(F.col("id").alias("idx"), F.lit(2).cast("bigint").alias("dhash"))  # as near as can be
    hashes = frames.select("idx", queries_events._rough().alias("h"), F.expr("shiftleft(1L, CAST(idx AS INT)) | 2L").alias("smooth"))
    a, b = hashes.alias("a"), hashes.alias("b")
    pairs = a.join(b, F.expr("a.idx < b.idx AND b.idx <= a.idx + 3")).select(hamming(F.col("a.h"), F.col("b.h")).alias("d"))
    cross = a.join(b, F.lit(True)).select(hamming(F.col("a.h"), F.col("b.smooth")).alias("d"))
    assert pairs.unionAll(cross).agg(F.min("d")).first()[0] > queries_events.segment.HASH_THRESHOLD


def test_a_long_prefix_is_cut_into_chunks(spark):
    """a prefix's entries don't come together in one task, and their runs are those of one pass."""
    rows = [("a", i, f"a{i}", 640 if i % 350 < 300 else 320, 480) for i in range(3000) if i % 97]
    rows += [("a", i, f"x{k}", 640, 480) for k, i in enumerate([None, None, -3, 0, 5, 5])] + [(None, i, f"n{i}", 640, 480) for i in range(50)]
    rows += [("b", i * i, f"b{i}", 640, 480) for i in range(100)] + [("c", 7, "c", 0, 480), ("c", 8, "d", 0, 480), ("c", 9, "e", None, None)]
    df = spark.createDataFrame(rows, "prefix string, idx long, name string, width int, height int")
    want, before, runs = [], {}, {}
    for p, i, name, w, h in sorted(rows, key=lambda r: (str(r[0]), max(r[1] or 0, 0), r[2])):
        b = before.get(p)
        goes_on = b is not None and i is not None and b[0] is not None and i >= 0 and i == b[0] + 1 and (w or 0) > 0 and (w, h) == b[1:]
        runs[p] = runs.get(p, 0) + (not goes_on)
        before[p] = (i, w, h)
        want.append((p, name, runs[p]))
    found = segment.contiguous_runs(df, task_rows=200)
    assert found.columns == [*df.columns, "run_id"]
    assert sorted(((r.prefix, r.name, r.run_id) for r in found.collect()), key=str) == sorted(want, key=str)
    sizes = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 800  # of 3,124 rows


@pytest.mark.parametrize("vectors", [6, 31, 33, 35, 81, 85, 110])
def test_clips_that_vectors_end_within(spark, tmp_path, vectors):
    """The last clip has 6 to 10 frames: 31 to 35 vectors end in one smooth for seven frames, the others in one smooth throughout or rough."""
    rng = random.Random(vectors)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)], 0) for i in range(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["w6_segments"](spark, str(tmp_path)).select("prefix", "video_id", "n", "first", "last", "length").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE_SQL["w6_segments"]).select("prefix, video_id, n, first, last, length").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
