"""Sequential machines on streams whose rows come in any order: event-time order from list state and timers.

Streams are dealt into buckets by a hash.  Rows of a bucket wait in list state until the watermark has passed their time; a timer then hands them to the machine in
order, so the result doesn't depend on how the rows were dealt into micro-batches.  Rows that come later than the watermark
allows are dropped by Spark, which counts them.  When a stream has been silent for the machine's `idle_ms`, a timer lets it
finish what it holds and forgets the stream (T7).

A machine is a plain state that JSON can hold and a step from one row to the next.  What is kept of a stream is that state and the
rows within the watermark's delay.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS, PER_CORE = "spark.sql.shuffle.partitions", 3
BUCKETS = 1024  # of streams
FIRST_MS = 1 << 40  # of time 0: Spark's watermark begins at the epoch, and what isn't later than that counts as late
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine(NamedTuple):
    fresh: Callable[[], dict]
    step: Callable[[dict, dict], list[dict]]  # changes the state, gives output rows
    idle: Callable[[dict], list[dict]]  # what a silent stream still gives
    schema: str  # of output rows, without the key
    idle_ms: int = 3000


class InOrder(StatefulProcessor):
    """Runs a machine over the rows of each stream in order of `event_ms`, then of the other columns as they stand.

    A state key is a bucket of streams: what a key costs in each micro-batch doesn't grow with the streams.  Rows wait as the Arrow
    batches they came in, and a bucket has one timer, for the next row or silence of any of its streams.
    """

    def __init__(self, machine: Machine, key: str, columns: list[str], kinds: pa.Schema):
        self.machine, self.key, self.columns, self.kinds = machine, key, columns, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.streams = handle.getValueState("streams", "json string")  # [stream, state, last_ms] of each
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [pa.RecordBatch.from_pandas(part, self.kinds, preserve_index=False) for part in rows]
        if parts := [part for part in parts if part.num_rows]:
            self.waiting.appendList([(_packed(part),) for part in parts])
            self._wake(min(pc.min(part["event_ms"]).as_py() for part in parts))
        return iter([])

    def _wake(self, ms: int) -> None:
        """Lets the bucket's timer go off then, or before."""
        held = self.timer.get() if self.timer.exists() else None
        if held is not None and held[0] <= ms:
            return
        if held is not None:
            self.handle.deleteTimer(int(held[0]))
        self.handle.registerTimer(int(ms))
        self.timer.update((int(ms),))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        due, later = {}, []
        for (held,) in self.waiting.get() if self.waiting.exists() else []:
            part = pa.ipc.open_stream(held).read_next_batch()
            now = pc.less_equal(part["event_ms"], passed)
            columns = [part.filter(now)[c].to_pylist() for c in (self.key, *self.columns)]
            for stream, *row in zip(*columns, strict=True):
                due.setdefault(stream, []).append(row)
            if (rest := part.filter(pc.invert(now))).num_rows:
                later.append(rest)
        if due and later:
            self.waiting.put([(_packed(part),) for part in later])
        elif due:
            self.waiting.clear()
        awaited = {stream for part in later for stream in pc.unique(part[self.key]).to_pylist()}
        states = {stream: (state, last) for stream, state, last in json.loads(self.streams.get()[0] if self.streams.exists() else "[]")}
        out, kept = [], []
        for stream in [*states, *(s for s in due if s not in states)]:
            state, last = states.get(stream) or (self.machine.fresh(), None)
            found = []
            for row in sorted(due.get(stream, []), key=lambda r: tuple((v is None, v) for v in r)):
                found += self.machine.step(state, dict(zip(self.columns, row, strict=True)))
                last = row[0]
            if last + self.machine.idle_ms <= passed and stream not in awaited:
                found += self.machine.idle(state)
            else:
                kept.append([stream, state, last])
            out += [(stream, r) for r in found]
        if kept:
            self.streams.update((json.dumps(kept),))
        else:
            self.streams.clear()
        following = [pc.min(part["event_ms"]).as_py() for part in later]
        # while rows of a stream wait it isn't silent: their own times come first
        following += [max(last + self.machine.idle_ms, passed + 1) for _, _, last in kept]
        if following:
            self._wake(min(following))
        if out:
            names = [f.split()[0] for f in _fields(self.machine.schema)]
            yield pd.DataFrame({self.key: [stream for stream, _ in out], **{n: [r[n] for _, r in out] for n in names}})

    def close(self) -> None:
        pass


def _packed(part: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, part.schema) as writer:
        writer.write_batch(part)
    return out.getvalue().to_pybytes()


def _fields(schema: str) -> list[str]:
    """The columns of a DDL schema, whose types may hold commas."""
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def run_ordered(
    rows: DataFrame, key: str, machine: Machine, columns: list[str], delay: str = "5 seconds", time: str = "ts_sec", buckets: int = BUCKETS
) -> DataFrame:
    """The machine's rows of every stream; columns: what a step sees, beside `event_ms`.

    Rows without a time have no place in the order and are left out.
    """
    ms = F.floor(F.col(time) * 1000) + FIRST_MS
    timed = rows.where(F.col(time).isNotNull()).select(F.col(key).cast("string").alias(key), ms.alias("event_ms"), *columns)
    kinds = to_arrow_schema(timed.schema)
    timed = timed.withColumn("event_at", F.timestamp_millis("event_ms")).withWatermark("event_at", delay)
    timed = timed.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    processor = InOrder(machine, key, ["event_ms", *columns], kinds)
    return timed.groupBy("_bucket").transformWithStateInPandas(processor, f"{key} string, {machine.schema}", "append", "EventTime")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start within it keep their state in RocksDB, which list state and timers need.

    Each state partition is opened and committed in each micro-batch, so there are some for each core, not more.
    """
    partitions = min(int(spark.conf.get(PARTITIONS)), PER_CORE * spark.sparkContext.defaultParallelism)
    own = {PROVIDER: ROCKSDB, PARTITIONS: str(partitions)}
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)
