"""Best-fit packing, planned on counts by length instead of on documents.

1. Each document becomes token ids and one end id; documents longer than the window are cut into windows, the last one
   shorter.  The pieces are a written table of numbers.
2. Their counts by length (at most `window` numbers, whatever the size of the table) go to the driver, which runs best-fit decreasing
   on them: sequences with equal contents are one group, and a length fills groups from the fullest that has room.  A
   length leaves at most four more groups, so groups and the plan's rows are bounded by the window alone.
3. Pieces are numbered within their length: (length, class) windows, where a length gets a class for every `CLASS_ROWS`
   pieces, and the classes' counts give each its first number.  So a length that a third of all documents share is
   many tasks' work.
4. A piece's number within its length finds its row of the plan, its sequence and its place there.

Numbers follow a hash of doc_id, then doc_id, piece and checksum; pieces equal in those are interchangeable.  The result doesn't depend on
the layout of the files.  Null and empty texts are the end id alone; rows that repeat a doc_id are documents of their own;
a null doc_id stays null; extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import wordhash
from tidemark.llm.memory import tidy_batches
from tidemark.llm.packing import WordTokenizer, ranges, shared_tokenizer
from tidemark.llm.staging import Tables

WINDOW, CLASS_ROWS, BATCH_BYTES = 4096, 1 << 18, 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids array<int>"


@dataclass
class Plan:
    """Rows by (length, low): the pieces of a length from number `low` on go to sequences from `sequence` on.

    `each` of them go into a sequence, one after the other, the first at place `offset` of it.
    """

    length: np.ndarray
    low: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by their length and their number within it."""
        if not len(length):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        found, first = np.unique(length[order], return_index=True)
        for n, own in zip(found.tolist(), np.split(order, first[1:]), strict=True):
            at, to = np.searchsorted(self.length, [n, n + 1])
            row = at + np.searchsorted(self.low[at:to], number[own], side="right") - 1
            step = number[own] - self.low[row]
            sequence[own] = self.sequence[row] + step // self.each[row]
            offset[own] = self.offset[row] + step % self.each[row] * n
        return sequence, offset


def plan(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """Best-fit decreasing over counts by length; lengths are from 1 to the window."""
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many) with just that room
    rooms: list[int] = []
    rows: list[tuple[int, int, int, int, int]] = []
    made = 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        low, left = 0, counts[length]

        def put(room: int, first: int, n: int, each: int, taken: int) -> int:
            rows.append((length, taken, first, each, window - room))
            add(room - each * length, first, n)
            return taken + each * n

        while left > low:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # nothing has room: new sequences, as many as the rest fills
                room, first = window, made
                n = -(-(left - low) // (window // length))
                made += n
            else:
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            each = room // length  # best fit goes on with the sequence it has begun
            full = min(n, (left - low) // each)
            if full:
                low = put(room, first, full, each, low)
            if full < n:
                if rest := min(each, left - low):
                    low = put(room, first + full, 1, rest, low)
                    full += 1
                add(room, first + full, n - full)
    columns = np.array(rows, np.int64).reshape(-1, 5)
    columns = columns[np.lexsort((columns[:, 1], columns[:, 0]))]
    return Plan(*columns.T, sequences=made)


def _cut(path: str, window: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared_tokenizer(path)
        for batch in batches:
            texts = batch["text"].cast(pa.large_string())
            for low, high in wordhash.chunks(texts, BATCH_BYTES):
                yield _pieces(tokenizer, batch["doc_id"].slice(low, high - low), texts.slice(low, high - low), window, with_ids)

    return run


def _pieces(tokenizer: WordTokenizer, keys: pa.Array, texts: pa.Array, window: int, with_ids: bool) -> pa.RecordBatch:
    found = tokenizer.encode(texts)
    sizes = np.diff(found.offsets)
    times = -(-sizes // window)  # each text has an id at least
    doc = np.repeat(np.arange(len(sizes)), times)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
    start = piece * window
    length = np.minimum(window, sizes[doc] - start)
    begin = found.offsets[doc] + start
    data = memoryview(np.ascontiguousarray(found.ids, dtype="<u4")).cast("B")
    crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
    if with_ids:
        cuts = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
        own = pa.ListArray.from_arrays(cuts, pa.array(found.ids[ranges(begin, length)].view(np.int32)))
    else:
        own = pa.nulls(len(doc), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), own],
        names=[f.split()[0] for f in PIECES.split(", ")],
    )


def numbered(pieces: DataFrame, counts: dict[int, int], class_rows: int = CLASS_ROWS) -> DataFrame:
    """pieces with number: from 0 within their length."""
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    classes = F.get(F.lit([-(-counts.get(n, 1) // class_rows) for n in range(max(counts, default=0) + 1)]), F.col("length").cast("int"))
    dealt = pieces.withColumn("class", F.pmod(order, classes.cast("long")))
    size = dealt.groupBy("length", "class").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    first = size.select("length", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "class").orderBy(order, "doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(own).cast("long") - 1)
    return ranked.join(first, ["length", "class"]).withColumn("number", F.col("first") + F.col("rank")).drop("class", "first", "rank")


def _placed(made: Plan) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = made.place(batch["length"].to_numpy(), batch["number"].to_numpy())
            columns = [batch[f.split()[0]] for f in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [*columns[:5], pa.array(sequence), pa.array(offset), columns[5]], names=[f.split()[0] for f in PLACED.split(", ")]
            )

    return run


def pack(
    df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = True,
    class_rows: int = CLASS_ROWS,
) -> DataFrame:
    """The pieces of all sequences; tokenizer: path of a tokenizer file that every machine has."""
    tables = Tables(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    pieces = tables.add(rows.mapInArrow(tidy_batches(_cut(tokenizer, window, with_ids)), PIECES), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    return numbered(pieces, counts, class_rows).mapInArrow(tidy_batches(_placed(plan(counts, window))), PLACED)


def op13_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(documents, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")
