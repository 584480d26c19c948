"""Streams against their batch versions: shuffled arrival, bounded state, restarts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dense
from tidemark.sources import recordings
from tidemark.streaming import alarms
from tidemark.streaming.ordered import run_ordered, state_store

FRAMES = "stream_id string, frame_index long, ts_sec double, is_candidate boolean, ignition double"


def frame_rows():
    rng = random.Random(2)
    rows = []
    for s in range(6):
        start = rng.randint(100, 250)
        for i in range(400):
            if rng.random() < 0.1:
                continue
            rows.append((f"s{s}", i, i / 30, s != 5 and i >= start and rng.random() < 0.3, [None, -1.0, 8.0][s % 3]))
        rows.append((f"s{s}", 400, 399 / 30 if s == 1 else 13.4, False, None))
    return rows


def arrive(spark, rows, schema, path, batches, shuffle_seed=None):
    """One file a micro-batch; a last row of another stream moves the watermark past all others."""
    rows = sorted(rows, key=lambda r: r[2] if len(r) > 3 else r[1])
    if shuffle_seed is not None:
        random.Random(shuffle_seed).shuffle(rows)
    size = -(-len(rows) // batches)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(path)
    end = {"stream_id": "~", "ts_sec": 1e7}
    last = [tuple(end.get(f.split()[0]) for f in schema.split(", "))]
    spark.createDataFrame(last, schema).coalesce(1).write.mode("append").parquet(path)


def drain(stream, folder, name):
    with state_store(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-check")
        query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}").where("stream_id <> '~'")


@pytest.mark.parametrize("shuffled", [None, 4])
def test_dense_keyframes_in_any_order_of_arrival(spark, tmp_path, shuffled):
    settings = dense.Settings(stride=5, batch=8)
    arrive(spark, frame_rows(), FRAMES, f"{tmp_path}/in", 4, shuffled)
    source = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = run_ordered(source, "stream_id", dense.machine(settings), dense.COLUMNS, delay="20 seconds" if shuffled else "1 second")
    got = drain(stream, tmp_path, "out")
    want = dense.keyframes(spark.createDataFrame(frame_rows(), FRAMES), ["stream_id"], settings)
    columns = ["stream_id", "frame_index", "ts_sec", "dense", "cadence"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    calls = got.groupBy("stream_id", "batch", "call").count()
    assert calls.agg(F.max("count")).first()[0] <= 16
    assert got.where("call > 0").count() > 0  # frames that were brought back


def test_the_open_batch_is_bounded():
    settings = dense.Settings(stride=5, batch=8)
    machine, state, most = dense.machine(settings), None, 0
    state = machine.fresh()
    for i in range(20_000):
        machine.step(state, {"frame_index": i, "ts_sec": i / 30, "is_candidate": i == 9_001, "ignition": None})
        most = max(most, len(json.dumps(state["held"])))
        assert len(state["held"]) <= settings.stride * settings.batch
    assert most < 4_000
    with pytest.raises(ValueError, match="16"):
        dense.Settings(batch=17)


def test_a_candidate_that_the_detector_does_not_see_opens_nothing(spark):
    rows = [("a", i, i / 30, i == 3, None) for i in range(60)]
    assert dense.keyframes(spark.createDataFrame(rows, FRAMES), ["stream_id"]).count() == 12


FLAGS = "stream_id string, ts_sec double, flag boolean"


def flag_rows():
    rng = random.Random(6)
    return [(f"s{i % 5}", float(i), rng.choice([True, True, False, None])) for i in range(300)]


def plain_edges():
    out, up, n = [], {}, {}
    for s, t, flag in flag_rows():
        if flag and not up.get(s):
            out.append((s, n.get(s, 0), t))
            n[s] = n.get(s, 0) + 1
        up[s] = bool(flag)
    return sorted(out)


def test_edges_against_plain(spark):
    assert sorted(map(tuple, alarms.edges(spark.createDataFrame(flag_rows(), FLAGS), "stream_id").collect())) == plain_edges()


def test_each_alarm_once_over_kills_and_restarts(spark, tmp_path):
    """The sink fails before and after its commit, then the query loses its checkpoint."""
    arrive(spark, flag_rows(), FLAGS, f"{tmp_path}/in", 5)
    sent, fail = f"{tmp_path}/sent", {"before": 2, "after": 3}

    def deliver(row):
        with open(f"{sent}-{row.stream_id}-{row.episode}", "a") as file:
            file.write("x")

    log = alarms.AlarmLog(f"{tmp_path}/alarms", deliver)

    def sink(rows, batch_id):
        if fail.get("before") == batch_id:
            del fail["before"]
            raise RuntimeError("killed before")
        log(rows.where("stream_id <> '~'"), batch_id)
        if fail.get("after") == batch_id:
            del fail["after"]
            raise RuntimeError("killed after")

    def run(check):
        source = spark.readStream.schema(FLAGS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream = run_ordered(source, "stream_id", alarms.edge_machine(), ["ts_sec", "flag"], delay="1 second")
        with state_store(spark):
            writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/{check}")
            query = writer.trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as error:
            assert "killed" in str(error)
            return False
        return True

    runs = 1
    while not run("check"):
        runs += 1
    assert runs == 3
    columns = ["stream_id", "episode", "ts_sec"]
    assert sorted(map(tuple, log.read(spark).select(columns).collect())) == plain_edges()
    assert run("another-check")  # everything is replayed
    assert sorted(map(tuple, log.read(spark).select(columns).collect())) == plain_edges()
    files = list(tmp_path.glob("sent-*"))
    assert len(files) == len(plain_edges()) and all(f.read_text() == "x" for f in files)


def test_a_silent_stream_is_forgotten(spark, tmp_path):
    """Three seconds of event time without a row; what comes later starts anew."""
    rows = [("a", t, True) for t in (1.0, 1.5)] + [("b", t, t % 2 == 0) for t in (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0)] + [("a", 9.0, True), ("a", 9.5, False)]
    arrive(spark, rows, FLAGS, f"{tmp_path}/in", 6)
    source = spark.readStream.schema(FLAGS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = run_ordered(source, "stream_id", alarms.edge_machine(idle_ms=3000), ["ts_sec", "flag"], delay="0 seconds")
    got = sorted((r.stream_id, r.episode, r.ts_sec) for r in drain(stream, tmp_path, "out").collect())
    assert got == [("a", 0, 1.0), ("a", 0, 9.0), *(("b", i, 2.0 * i + 2) for i in range(4))]


def test_state_keys_do_not_grow_with_the_streams(spark, tmp_path):
    """streams share buckets; each keeps its own order, episodes and end, one without a name too."""
    rows = [(f"s{i % 150}", 1.0 + i, i % 4 < 2) for i in range(600)] + [(None, 2.5, True), ("null", 3.5, True), (None, 4.5, None), (None, 5.5, True)]
    arrive(spark, rows, FLAGS, f"{tmp_path}/in", 3)
    source = spark.readStream.schema(FLAGS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = run_ordered(source, "stream_id", alarms.edge_machine(), ["ts_sec", "flag"], delay="1 second", buckets=2)
    with state_store(spark):
        writer = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").where("stream_id <> '~' OR stream_id IS NULL")
    want = alarms.edges(spark.createDataFrame(rows, FLAGS), "stream_id")
    assert sorted(map(repr, got.select("stream_id", "episode", "ts_sec").collect())) == sorted(map(repr, want.collect()))
    assert max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators) < 20  # of 151 streams


def recording(spark, path):
    rows = [(f"c{s}", i, i / 30, i / 30 + 0.01 * (i % 9), 640, 480, [(1.0 * i, 2.0, 30.0 + i, 40.0, 0.5, 0)] * (i % 3)) for s in range(4) for i in range(20 + 25 * s)]
    frames = spark.createDataFrame(rows, recordings.FRAME)
    recordings.write_recording(frames, path, frames_per_file=13)
    return rows


def test_bounded_batches_and_a_restart_that_repeats_nothing(spark, tmp_path):
    rows = recording(spark, f"{tmp_path}/in")
    fail = {3}

    def sink(batch, number):
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        if number in fail:
            fail.discard(number)
            raise RuntimeError("killed")

    def run():
        stream = recordings.read_recording(spark, f"{tmp_path}/in", f"{tmp_path}/log")
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/check").start()
        try:
            query.processAllAvailable()
            return True
        except Exception as error:
            assert "killed" in str(error)
            return False
        finally:
            query.stop()

    assert not run() and run() and run()  # the third finds nothing new
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.groupBy("stream_id", "number").count().agg(F.max("count")).first()[0] == 16
    want = spark.createDataFrame(rows, recordings.FRAME)
    assert got.count() == len(rows) and got.drop("number", "batch").exceptAll(want).count() == 0
    assert all(r.number == r.frame_index // 16 for r in got.select("number", "frame_index").collect())
    more = spark.createDataFrame([("c9", i, i / 30, i / 30, 640, 480, []) for i in range(5)], recordings.FRAME)
    more.write.partitionBy("stream_id").mode("append").parquet(f"{tmp_path}/in")
    assert run() and spark.read.parquet(f"{tmp_path}/out").count() == len(rows) + 5


def test_calls_of_a_trigger_are_bounded_and_numbered(spark, tmp_path):
    """Triggers of several calls: as few as the recording needs, each call of 16 frames at most."""
    rows, sizes = recording(spark, f"{tmp_path}/in"), []
    stream = recordings.read_recording(spark, f"{tmp_path}/in", f"{tmp_path}/log", calls_per_trigger=3)

    def sink(batch, number):
        sizes.append(number)
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{number}")

    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/check").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.read.parquet(f"{tmp_path}/out/*")
    assert got.count() == len(rows) and all(r.call == r.frame_index // 16 for r in got.select("call", "frame_index").collect())
    assert len(sizes) == 2  # 95 frames of the longest camera, 48 a trigger


def test_row_groups_of_a_recording_are_small(spark, tmp_path):
    """A trigger reads some frames of a long file, not all of it."""
    import pyarrow.parquet as pq

    frames = spark.range(20_000).select(
        F.lit("c").alias("stream_id"), F.col("id").alias("frame_index"), (F.col("id") / 30).alias("ts_sec"), (F.col("id") / 30).alias("arrived_sec"),
        F.lit(640).alias("image_w"), F.lit(480).alias("image_h"), F.array().cast(f"array<{recordings.BOX}>").alias("boxes"),
    )
    recordings.write_recording(frames, f"{tmp_path}/in")
    found = [pq.ParquetFile(f).metadata for f in tmp_path.glob("in/*/*.parquet")]
    assert max(m.row_group(i).num_rows for m in found for i in range(m.num_row_groups)) <= 8000


def test_late_slots(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.02), (1.0, 1.04), (2.0, 2.5)], "t double, a double")
    got = [tuple(r.s) for r in df.select(recordings.slots(F.col("t"), F.col("a")).alias("s")).collect()]
    assert got == [(0, 0), (30, 0), (30, 1), (60, 15)]


def test_frames_of_box_rows(spark):
    rows = [("a", 1, 0.1, 640, 480, 5.0, 1.0, 9.0, 4.0, None, 0.5, 1), ("a", 1, 0.1, 640, 480, 2.0, 1.0, 9.0, 4.0, None, 0.5, 0), ("a", 2, 0.2, 640, 480, None, None, None, None, None, None, None)]
    from tidemark import schemas

    got = recordings.frames_of(spark.createDataFrame(rows, schemas.TRACKS)).orderBy("frame_index").collect()
    assert [[b.x1 for b in r.boxes] for r in got] == [[2.0, 5.0], []] and got[0].arrived_sec == 0.1
