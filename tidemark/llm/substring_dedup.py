"""Substring dedup with difference-cover anchors.

A window is `LENGTH` consecutive words of one document.  All words of a window go whose word sequence
also starts earlier (smaller doc_id, or the same document further to the front).

1. Documents are dealt by hash into shards of bounded size; a shard's texts travel as one compressed
   block.  Anchors of `ANCHOR` words are hashed only where the position modulo `PERIOD` lies in a
   difference cover: for any two positions some shift below the period brings both onto the cover, and
   the anchor there still lies within the window, so every long match shares an aligned anchor.
2. Anchors that occur twice are found by hash bucket; a shard sends each anchor once, however often it
   occurs, so a passage that a third of all documents share weighs no more than one row a shard.
3. Around a repeated anchor the match is extended: windows that contain one are hashed in full (96 bits),
   and the hash bucket finds each window's first document.
4. Back at the shard, windows that are not the first of their sequence mark their words.

What a worker holds at once is a shard; what is exchanged is packed by `GROUP` shards and by buckets of as many
bytes, so a row of an exchange stays some kilobytes long up to thousands of groups.

Nulls: a null text has no words; a null doc_id counts as smaller than all others.  Rows that repeat a
doc_id are separate documents in order of a hash of their texts; equal rows remove the later one's windows.
Extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import wordhash
from tidemark.llm.staging import Tables

LENGTH = 20
PERIOD, COVER, ANCHOR = 13, (0, 1, 3, 9), 8  # every residue is a difference of two cover members
SHARD_BYTES, GROUP = 4 << 20, 8
SENT_BYTES = 32 << 20  # of packed entries that a task gathers
LEAST_ID = np.iinfo(np.int64).min
BLOCKS = "team int, shard int, ids binary, ties binary, sizes binary, texts binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _spans(first: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(begin, end) of the runs that begin at `first` among n places."""
    return list(zip(first.tolist(), np.append(first[1:], n).tolist()[: len(first)], strict=True))


def _ties(ids: pa.Array, hashes: np.ndarray) -> np.ndarray:
    """32 bits by which rows of one id are in order; null ids stand for the least one, before it."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(LEAST_ID).to_numpy()
    ties = hashes.astype(np.uint32)
    ties[ids == LEAST_ID] >>= np.uint32(1)
    ties[(ids == LEAST_ID) & ~null] |= np.uint32(1 << 31)
    return ties


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by shard, each shard's texts compressed together."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        shard = batch["shard"].to_numpy()
        order = np.argsort(shard, kind="stable")
        batch = batch.take(pa.array(order))
        data, offsets = wordhash.utf8(batch["text"])
        ties = _ties(batch["doc_id"], batch["tie"].to_numpy())
        ids = batch["doc_id"].fill_null(LEAST_ID).to_numpy()
        shards, first = np.unique(shard[order], return_index=True)
        spans = _spans(first, len(ids))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(shards // GROUP, pa.int32()),
                pa.array(shards, pa.int32()),
                pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([ties[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([np.diff(offsets[a : b + 1]).tobytes() for a, b in spans], pa.binary()),
                pa.array([squeeze.compress(data[offsets[a] : offsets[b]].tobytes()) for a, b in spans], pa.binary()),
            ],
            names=_BLOCK,
        )


_BLOCK = ["team", "shard", "ids", "ties", "sizes", "texts"]


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Consecutive rows with one key, across batches."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now:
                if rows:
                    yield now, rows
                now, rows = row[key], []
            rows.append(row)
    if rows:
        yield now, rows


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block a shard, documents in order of (doc_id, tie, text)."""
    squeeze, open_ = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    for shard, rows in runs(batches, "shard"):
        found = []
        for r in rows:
            data, at = open_.decompress(r["texts"]), 0
            columns = (np.frombuffer(r[c], t).tolist() for c, t in (("ids", np.int64), ("ties", np.uint32), ("sizes", np.int64)))
            for i, tie, n in zip(*columns, strict=True):
                found.append((i, tie, data[at : at + n]))
                at += n
        found.sort()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard // GROUP], pa.int32()),
                pa.array([shard], pa.int32()),
                pa.array([np.array([x for x, _, _ in found], np.int64).tobytes()], pa.binary()),
                pa.array([np.array([x for _, x, _ in found], np.uint32).tobytes()], pa.binary()),
                pa.array([np.array([len(x) for _, _, x in found], np.int64).tobytes()], pa.binary()),
                pa.array([squeeze.compress(b"".join(x for _, _, x in found))], pa.binary()),
            ],
            names=_BLOCK,
        )


def _open(block: dict) -> tuple[np.ndarray, np.ndarray, wordhash.Words, np.ndarray]:
    """(doc_ids, ties, words, word hashes) of a shard's block."""
    data = zstandard.ZstdDecompressor().decompress(block["texts"])
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(block["sizes"], np.int64))])
    texts = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    )
    words = wordhash.split_words(texts.view(pa.large_string()))
    return np.frombuffer(block["ids"], np.int64), np.frombuffer(block["ties"], np.uint32), words, words.hashes()


def _anchors(words: wordhash.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position in the batch) of the anchors at cover positions."""
    found, at = wordhash.shingles(words, hashes, ANCHOR)
    inside = at - np.repeat(words.first[:-1], words.counts)[at] if len(at) else at
    on = np.isin(inside % PERIOD, COVER)
    return found[on], at[on]


def _windows(words: wordhash.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, 32 further bits, position in the batch) of all whole windows."""
    found, at = wordhash.shingles(words, hashes, LENGTH)
    more, _ = wordhash.shingles(words, wordhash.mix(hashes + np.uint64(7)), LENGTH)
    return found, (more >> np.uint64(32)).astype(np.uint32), at


class Parcels:
    """Entries of some shards by bucket: arrays side by side, and how many entries each shard has in each."""

    def __init__(self, buckets: int, columns: dict[str, type]):
        self.buckets, self.columns = buckets, columns
        self.schema = pa.schema(
            [("bucket", pa.int32()), ("team", pa.int32()), ("shards", pa.binary()), ("counts", pa.binary())]
            + [(c, pa.binary()) for c in columns]
        )
        self.clear()

    def clear(self) -> None:
        self.held: list[tuple[int, tuple[np.ndarray, ...]]] = []
        self.size = 0

    def add(self, shard: int, *arrays: np.ndarray) -> None:
        self.held.append((shard, arrays))
        self.size += sum(a.nbytes for a in arrays)

    def batch(self, team: int) -> pa.RecordBatch:
        """One row for each bucket that has entries; then there are none."""
        keys = np.concatenate([np.empty(0, np.uint64), *(a[0] for _, a in self.held)])
        owner = np.repeat(np.arange(len(self.held)), [len(a[0]) for _, a in self.held])
        shards = np.array([s for s, _ in self.held], np.int32)
        bucket = ((keys >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, first = np.unique(bucket[order], return_index=True)
        spans = _spans(first, len(order))
        counts = [np.bincount(owner[order[a:b]], minlength=len(shards)).astype(np.int32) for a, b in spans]
        columns = []
        for i, kind in enumerate(self.columns.values()):
            values = np.concatenate([np.empty(0, kind), *(a[i] for _, a in self.held)])[order]
            columns.append(pa.array([values[a:b].tobytes() for a, b in spans], pa.binary()))
        self.clear()
        n = len(found)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(found, pa.int32()), pa.array([team] * n, pa.int32()), pa.array([shards.tobytes()] * n, pa.binary()),
                pa.array([c.tobytes() for c in counts], pa.binary()), *columns,
            ],
            schema=self.schema,
        )

    @property
    def ddl(self) -> str:
        return "bucket int, team int, " + ", ".join(f"{c} binary" for c in ("shards", "counts", *self.columns))


def _answer(rows: list[dict], hit: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """For each row its entries that are hit, by the same shards."""
    out, at = [], 0
    for r in rows:
        counts = np.frombuffer(r["counts"], np.int32)
        own = slice(at, at + int(counts.sum()))
        at = own.stop
        if hit[own].any():
            left = np.bincount(np.repeat(np.arange(len(counts)), counts)[hit[own]], minlength=len(counts))
            out.append((r["team"], r["shards"], left.astype(np.int32).tobytes(), *(v[own][hit[own]].tobytes() for v in columns.values())))
    names = ["team", "shards", "counts", *columns]
    kinds = [pa.int32()] + [pa.binary()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)


def _replies(table: pa.Table, columns: dict[str, type]) -> dict[int, list[list[np.ndarray]]]:
    """Of each shard, its parts of the replies: a list a column."""
    out: dict[int, list[list[np.ndarray]]] = {}
    for r in table.to_pylist():
        counts = np.frombuffer(r["counts"], np.int32)
        cuts = np.cumsum(counts)[:-1]
        split = [np.split(np.frombuffer(r[c], t), cuts) for c, t in columns.items()]
        for k, shard in enumerate(np.frombuffer(r["shards"], np.int32).tolist()):
            if counts[k]:
                mine = out.setdefault(shard, [[] for _ in columns])
                for i, part in enumerate(split):
                    mine[i].append(part[k])
    return out


_ANCHOR = {"keys": np.uint64, "twice": np.uint8}
_WINDOW = {"keys": np.uint64, "more": np.uint32, "ids": np.int64, "ties": np.uint32}
_LATE = {"keys": np.uint64, "more": np.uint32}


def _send_anchors(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcels, team = Parcels(buckets, _ANCHOR), None
        for batch in batches:
            for block in batch.to_pylist():
                if parcels.held and (block["team"] != team or parcels.size > SENT_BYTES):
                    yield parcels.batch(team)
                team = block["team"]
                _, _, words, hashes = _open(block)
                keys, times = np.unique(_anchors(words, hashes)[0], return_counts=True)
                parcels.add(block["shard"], keys, (times > 1).astype(np.uint8))
        if parcels.held:
            yield parcels.batch(team)

    return run


def _gathered(rows: list[dict], columns: dict[str, type]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in columns.items()]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard of a bucket its anchors that occur twice or more anywhere."""
    for _, rows in runs(batches, "bucket"):
        keys, twice = _gathered(rows, _ANCHOR)
        _, code, times = np.unique(keys, return_inverse=True, return_counts=True)
        hit = (times + np.bincount(code, weights=twice) > 1)[code]
        yield _answer(rows, hit, {"keys": keys})


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values if len(ordered) else np.zeros(len(values), dtype=bool)


def _blocks(table: pa.Table) -> Iterator[dict]:
    """One block after the other, in order of shards."""
    table = table.sort_by("shard")
    for i in range(table.num_rows):
        yield table.slice(i, 1).to_pylist()[0]


def _send_windows(buckets: int) -> Callable:
    """Windows that contain a repeated anchor, each sequence once a shard with its first document."""

    def run(key: tuple, blocks: pa.Table, found: pa.Table) -> pa.Table:
        parcels, out, team = Parcels(buckets, _WINDOW), [], key[0].as_py()
        replies = _replies(found, {"keys": np.uint64})
        for block in _blocks(blocks):
            if block["shard"] not in replies:
                continue
            ids, ties, words, hashes = _open(block)
            keys, at = _anchors(words, hashes)
            hot = np.zeros(len(hashes) + 1, dtype=np.int64)
            hot[at[_member(keys, np.sort(np.concatenate(replies[block["shard"]][0])))] + 1] = 1
            hot = np.cumsum(hot)
            keys, more, at = _windows(words, hashes)
            near = hot[np.minimum(at + LENGTH - ANCHOR + 1, len(hashes))] > hot[at]
            keys, more, at = keys[near], more[near], at[near]
            order = np.lexsort((at, more, keys))
            first = np.ones(len(order), dtype=bool)
            k, m = keys[order], more[order]
            first[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
            own = np.sort(order[first])  # by position: doc_ids then compress to almost nothing
            doc = words.doc[at[own]]
            parcels.add(block["shard"], keys[own], more[own], ids[doc], ties[doc])
            if parcels.size > SENT_BYTES:
                out.append(parcels.batch(team))
        out.append(parcels.batch(team))
        return pa.Table.from_batches(out, schema=parcels.schema)

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard of a bucket its windows whose first document lies in another shard."""
    for _, rows in runs(batches, "bucket"):
        keys, more, ids, ties = _gathered(rows, _WINDOW)
        order = np.lexsort((ties, ids, more, keys))
        k, m = keys[order], more[order]
        late = np.zeros(len(order), dtype=bool)
        late[order[1:]] = (k[1:] == k[:-1]) & (m[1:] == m[:-1])
        yield _answer(rows, late, {"keys": keys, "more": more})


def _removed(words: wordhash.Words, hashes: np.ndarray, late: np.ndarray, late_more: np.ndarray) -> np.ndarray:
    """Words covered by windows that are not the first of their sequence."""
    keys, more, at = _windows(words, hashes)
    order = np.lexsort((at, more, keys))
    k, m = keys[order], more[order]
    again = np.zeros(len(order), dtype=bool)
    again[order[1:]] = (k[1:] == k[:-1]) & (m[1:] == m[:-1])
    if len(late):
        pair = np.dtype([("k", np.uint64), ("m", np.uint32)])
        own, theirs = np.empty(len(keys), pair), np.empty(len(late), pair)
        own["k"], own["m"], theirs["k"], theirs["m"] = keys, more, late, late_more
        close = np.flatnonzero(_member(keys, np.sort(late)))
        again[close[np.isin(own[close], theirs)]] = True
    edge = np.zeros(len(hashes) + LENGTH + 1, dtype=np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + LENGTH, -1)
    return np.cumsum(edge)[: len(hashes)] > 0


def _finish(key: tuple, blocks: pa.Table, found: pa.Table) -> pa.Table:
    replies, out = _replies(found, _LATE), []
    for block in _blocks(blocks):
        ids, ties, words, hashes = _open(block)
        late = replies.get(block["shard"], [[], []])
        late = [np.concatenate([np.empty(0, t), *parts]) for parts, t in zip(late, _LATE.values(), strict=True)]
        gone = _removed(words, hashes, *late)
        data = words.data.tobytes()
        cut = np.add.reduceat(np.append(gone, False), words.first[:-1].clip(max=len(gone))) * (words.counts > 0)
        digests = []
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            kept = data[words.starts[a] : words.ends[b - 1]].split() if b > a else []
            if cut[i]:
                kept = [w for w, g in zip(kept, gone[a:b].tolist(), strict=True) if not g]
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        out.append(
            pa.table(
                [
                    pa.array(ids, pa.int64(), mask=(ids == LEAST_ID) & (ties < 1 << 31)),
                    pa.array(words.counts, pa.int64()),
                    pa.array(cut.astype(np.int64)),
                    pa.array(digests, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )
        )
    return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in _RESULT.items()})


_RESULT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    tables = Tables(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = size // SHARD_BYTES + 1
    buckets = shards // GROUP + 1
    rows = rows.withColumn("tie", F.xxhash64("text").bitwiseAND(F.lit((1 << 32) - 1)))
    shard = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(shards)).cast("int")
    pieces = rows.select(shard.alias("shard"), "doc_id", "tie", "text").mapInArrow(_pack, BLOCKS)
    blocks = tables.add(pieces.repartition("shard").sortWithinPartitions("shard").mapInArrow(_merge, BLOCKS), "blocks")
    teams = blocks.groupBy("team")

    def exchanged(sent: DataFrame, receive: Callable, columns: str) -> DataFrame:
        schema = f"team int, shards binary, counts binary, {columns}"
        return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(receive, schema)

    anchors = blocks.mapInArrow(_send_anchors(buckets), Parcels(buckets, _ANCHOR).ddl)
    repeated = tables.add(exchanged(anchors, _repeated, "keys binary"), "anchors")
    windows = teams.cogroup(repeated.groupBy("team")).applyInArrow(_send_windows(buckets), Parcels(buckets, _WINDOW).ddl)
    later = tables.add(exchanged(windows, _later, "keys binary, more binary"), "windows")
    tables.drop("anchors")
    return teams.cogroup(later.groupBy("team")).applyInArrow(_finish, RESULT)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
p AS (SELECT r, doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS g
      FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
o AS (SELECT r, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, r, i) AS n FROM p),
x AS (SELECT DISTINCT r, i + k AS i FROM o, range(20) AS t(k) WHERE n > 1),
y AS (SELECT r, list(i) AS gone FROM x GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(
         list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END,
         ' ')) AS kept_sha256
FROM w LEFT JOIN y USING (r)
"""
