"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes rolls over a text's UTF-8 bytes.  Chunks end where it meets a mask:
a strict one up to the normal size, a loose one after it, so that sizes gather around the normal one.
A boundary depends on the bytes near it alone, so an insertion shifts boundaries but doesn't change
most chunks.  The fingerprint is the set of chunk digests with their lengths; the likeness of one text
to another is the share of its set's length that the other's set contains.

For the edited texts, documents are dealt into ranges of ascending (doc_id, hash of the text), a task each, of
about equal bytes by a bounded sample (`SAMPLE_ROWS`).  The first document of each range is also needed by the range
before it: every scan task sends its own first document of a range there, so each document's text crosses the
network once, and a text a range and scan task once more.

Null texts count as empty; an empty text has the empty fingerprint, which is fully contained in an
empty one and not at all in others.  A null key comes before all others; rows that repeat a key follow
by a hash of their texts, so that no key's rows are one range (rows that repeat the text too are).  A single row is its own successor.  Extra columns
don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import wordhash

LEAST, NORMAL, MOST = 32, 64, 255
STRICT, LOOSE = np.uint32(0xFF << 24), np.uint32(0xF << 28)
RANGE_BYTES = 64 << 20  # of text a range, about
LEAST_RANGES = 24  # of a text table of some size, so that small clusters are busy
SAMPLE_ROWS = 1 << 20  # at most, from which range bounds come
LEAST_ID = np.iinfo(np.int64).min
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)

_GEAR = (wordhash.mix(np.arange(1001, 1257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_TABLE = wordhash.mix(np.arange(2001, 2257, dtype=np.uint64))


def gear(data: np.ndarray) -> np.ndarray:
    """Sum of gear[byte i - j] << j over the last 32 bytes; doubling makes it five array passes."""
    h = _GEAR[data]
    span = 1
    while span < 32:
        if len(h) > span:
            h[span:] = h[span:] + (h[:-span] << np.uint32(span))  # the right side is a copy
        span *= 2
    return h


def cuts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, chunk starts, number of chunks of each text) of some texts laid end to end."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = gear(data)
    strict = np.flatnonzero((h & STRICT) == 0).tolist()
    loose = np.flatnonzero((h & LOOSE) == 0).tolist()
    starts, counts = [], []
    at = a = b = 0
    for text in texts:
        end, before = at + len(text), len(starts)
        while at < end:
            starts.append(at)
            if end - at <= LEAST:  # the rolling hash of a text's first 31 bytes is never looked at
                at = end
                break
            stop = min(at + MOST, end)
            a = bisect_left(strict, at + LEAST, a)
            if a < len(strict) and strict[a] < min(at + NORMAL, end):
                at = strict[a] + 1
                continue
            b = bisect_left(loose, at + NORMAL, b)
            at = loose[b] + 1 if b < len(loose) and loose[b] < stop else stop
        at = end
        counts.append(len(starts) - before)
    return data, np.array(starts, dtype=np.int64), np.array(counts, dtype=np.int64)


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's set of (digest << 8 | length) values, in order; digests have 32 bits."""
    data, starts, counts = cuts(texts)
    if not len(starts):
        return [np.empty(0, np.uint64)] * len(texts)
    lengths = np.diff(np.append(starts, len(data)))
    inside = np.arange(len(data)) - np.repeat(starts, lengths)
    digests = wordhash.mix(np.add.reduceat(_TABLE[data] * wordhash.powers(MOST + 1)[inside], starts))
    values = (digests >> np.uint64(32)) << np.uint64(8) | lengths.astype(np.uint64)
    return [np.unique(part) for part in np.split(values, np.cumsum(counts)[:-1])]


def written(values: np.ndarray) -> str:
    """Ten hexadecimal digits a chunk: eight of its digest, two of its length."""
    if not len(values):
        return ""
    whole = values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    return whole.tobytes().hex()


def likeness(own: np.ndarray, other: np.ndarray) -> float:
    """The share of the first set's length that the second contains."""
    if not len(own):
        return 1.0 if not len(other) else 0.0
    shared = np.intersect1d(own, other, assume_unique=True)
    return float((shared & np.uint64(255)).sum()) / float((own & np.uint64(255)).sum())


def _order(ids: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two integers a row by which rows are in order; null ids come before the least one."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    tie = (hashes >> 1) & np.int64((1 << 62) - 1)
    return ids.fill_null(LEAST_ID).to_numpy(), np.where(null, tie - np.int64(1 << 62), tie)


def _range_of(bounds: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Number of bounds at or before each row; bounds: (n, 2), ascending."""
    low = np.searchsorted(bounds[:, 0], ids, side="left")
    high = np.searchsorted(bounds[:, 0], ids, side="right")
    for i in np.unique(ids[high > low]):  # ids that are bounds: their ties decide
        rows = np.flatnonzero(ids == i)
        a, b = low[rows[0]], high[rows[0]]
        low[rows] = a + np.searchsorted(bounds[a:b, 1], ties[rows], side="right")
    return low


def _deal(bounds: np.ndarray) -> Callable:
    """Rows by range; a task's first row of each range goes to the range before it too, and that of the first to the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, tuple] = {}
        for batch in batches:
            ids, ties = _order(batch["doc_id"], batch["tie"].to_numpy())
            part = _range_of(bounds, ids, ties)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(np.zeros(len(part), np.int32)), batch["doc_id"], pa.array(ties), batch["text"]],
                names=_DEALT,
            )
            order = np.lexsort((ties, ids, part))
            for row in order[np.append(True, part[order][1:] != part[order][:-1])[: len(order)]].tolist():
                text = batch["text"][row]
                key = (int(ids[row]), int(ties[row]), text.as_py().encode())
                if (k := int(part[row])) not in heads or key < heads[k][0]:
                    heads[k] = (key, batch["doc_id"][row].as_py())
        found = [((k - 1) % (len(bounds) + 1), doc, key) for k, (key, doc) in heads.items()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f[0] for f in found], pa.int32()), pa.array([1] * len(found), pa.int32()),
                pa.array([f[1] for f in found], pa.int64()), pa.array([f[2][1] for f in found], pa.int64()),
                pa.array([f[2][2].decode() for f in found], pa.string()),
            ],
            names=_DEALT,
        )

    return run


_DEALT = ["part", "extra", "doc_id", "tie", "text"]


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order, then the lowest of the added ones; each own row meets the next row."""
    pending: list[tuple] = []  # (doc_id, text)
    size, ended = 0, False

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        edited = [_edited(a[1], b[1]).encode() for a, b in zip(rows, rows[1:])]
        prints = fingerprints([r[1].encode() for r in rows] + edited)
        out = []
        for k, (doc, text) in enumerate(rows[:-1]):
            own, changed = prints[k], prints[len(rows) + k]
            out.append(
                (
                    doc,
                    len(text),
                    hashlib.sha256(edited[k]).hexdigest(),
                    written(own),
                    written(changed),
                    likeness(own, changed),
                    likeness(own, prints[k + 1]),
                )
            )
        return pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in out], t) for c, t in enumerate(_TYPES)], names=_NAMES
        )

    for batch in batches:
        if ended:
            continue
        for extra, doc, text in zip(*(batch[c].to_pylist() for c in ("extra", "doc_id", "text")), strict=True):
            pending.append((doc, text))
            size += len(text)
            if extra:
                ended = True
                break
            if size > 1 << 19 and len(pending) > 1:
                yield flush(pending)
                pending, size = pending[-1:], len(text)
    if len(pending) > 1:
        yield flush(pending)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def compare(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and likenesses to that and to the next text."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    count, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    bounds = _bounds(rows, count, size or 0)
    schema = "part int, extra int, doc_id long, tie long, text string"
    dealt = rows.mapInArrow(_deal(bounds), schema).repartitionById(len(bounds) + 1, "part")
    return dealt.sortWithinPartitions("extra", F.col("doc_id").asc_nulls_first(), "tie", "text").mapInArrow(_compare, RESULT)


def _bounds(rows: DataFrame, count: int, size: int) -> np.ndarray:
    """Up to one bound for each range but the first: (doc_id, tie) of sampled rows; each starts a range."""
    ranges = min(max(-(-size // RANGE_BYTES), min(LEAST_RANGES, size >> 20)), SAMPLE_ROWS // 64)
    if ranges < 2:
        return np.empty((0, 2), np.int64)
    # rows of the smallest hashes of key and text; equal rows come as one
    wanted = min(count, SAMPLE_ROWS // 2, 256 * ranges)
    sample = F.pmod(F.xxhash64(F.lit(4), "doc_id", "tie"), F.lit(1 << 40)) <= int((1 << 40) * wanted / count)
    found = rows.where(sample).groupBy("doc_id", "tie").agg(F.sum(F.octet_length("text") + 64).alias("size")).limit(SAMPLE_ROWS).toArrow()
    ids, ties = _order(found["doc_id"].combine_chunks(), found["tie"].combine_chunks().to_numpy())
    order = np.lexsort((ties, ids))
    filled = np.cumsum(found["size"].to_numpy()[order])
    if not len(filled):
        return np.empty((0, 2), np.int64)
    at = np.unique(np.searchsorted(filled, filled[-1] / ranges * np.arange(1, ranges)))
    at = at[at > 0]  # rows before the first bound are a range too
    return np.stack([ids[order][at], ties[order][at]], axis=1)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))
