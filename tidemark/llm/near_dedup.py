"""MinHash near-duplicates: SuperMinHash signatures, banding, exact verification, union-find groups.

1. Each text's set of word shingles becomes a signature of one value a band.  SuperMinHash lets an
   element visit the positions in an order of its own (one permutation an element, so positions are
   negatively correlated and the estimate varies less) with values that rise by rank; once every
   position holds a value of the current rank or less, later ranks can't change it and the pass stops.
2. Texts with equal sets are one class; classes with an equal band share a bucket.  Buckets of the same
   members are one.  Classes that are connected through buckets are a family (union-find over ids).
3. The full set of each class in a family travels once to the family's task.  There sets are compared,
   breadth first from linked to not yet reached members: exact components of the group with at most
   (members - 1) links out of it, never all pairs.
4. A family of more than `BLOCK` members or `BLOCK_ELEMENTS` shingles goes through rounds of pivots instead:
   every member of a bucket that still holds two components is compared with one pivot and the up to `BLOCK`
   members beside it.  What then lies outside the largest component of its bucket is compared with the
   whole bucket, in pairs of blocks.  So no group grows with the data, a tight family of n moves some n sets
   a round, and no pair of one bucket in two components is given up.
5. Links of all groups are joined into components by distributed union-find.

Sets are sets of 64-bit shingle hashes.  With bands of 6 rows and 48 bands a pair at similarity 0.8
shares no bucket with probability 5e-7.

Null and empty texts have no set, link with nothing and stand alone.  Rows that repeat a doc_id are one
node with several sets.  A null doc_id takes part in no link: its component_id is null and it is kept.
Extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import wordhash
from tidemark.llm.components import components
from tidemark.llm.memory import tidy_batches
from tidemark.llm.staging import Tables, small

BANDS, ROWS = 48, 6
POSITIONS = 293  # the least prime from BANDS * ROWS on, so that strides generate whole permutations
BLOCK, BLOCK_ELEMENTS = 8192, 1 << 21  # a task compares its members in some BLOCK ** 2 steps at most
STARS = 2  # rounds of pivots in families above those bounds
SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def supermin(elements: np.ndarray, owner: np.ndarray, n: int, positions: int = POSITIONS) -> np.ndarray:
    """(n, positions) signature values of n sets; element i belongs to set owner[i].

    The permutation of an element is an arithmetic progression modulo a prime, by which ranks at any
    two positions are distributed as under a uniform permutation.
    """
    values = np.full(n * positions, np.iinfo(np.uint64).max, dtype=np.uint64)
    start = (wordhash.mix(elements + np.uint64(1)) % np.uint64(positions)).astype(np.int64)
    stride = (wordhash.mix(elements + np.uint64(2)) % np.uint64(positions - 1)).astype(np.int64) + 1
    at, base = start, owner * positions
    going, done = np.arange(n), np.zeros(n, dtype=bool)
    for rank in range(positions):
        if not len(elements):
            break
        slot = base + at
        open_ = values[slot] >= np.uint64(rank) << np.uint64(48)
        new = (np.uint64(rank) << np.uint64(48)) | (
            wordhash.mix(elements[open_] ^ np.uint64((rank + 3) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(16)
        )
        np.minimum.at(values, slot[open_], new)
        at = at + stride
        at -= positions * (at >= positions)
        if rank % 4 == 3 or rank < 4:
            full = (values.reshape(n, positions)[going] < np.uint64(rank + 1) << np.uint64(48)).all(axis=1)
            done[going[full]] = True
            going = going[~full]
            rest = ~done[owner]
            elements, owner, at, stride, base = elements[rest], owner[rest], at[rest], stride[rest], base[rest]
    return values.reshape(n, positions)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(n, bands) 64-bit keys; bands with equal rows have equal keys, different bands different ones."""
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        key = wordhash.mix(key ^ parts[:, :, r])
    return key.view(np.int64)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(element, text) of every text's set of k-word shingles, ordered by text and element."""
    words = wordhash.split_words(texts, lower=True)
    hashes = words.hashes()
    found, at = wordhash.shingles(words, hashes, k)
    owner = np.searchsorted(words.first, at, side="right") - 1
    few, whole = wordhash.short_sets(words, hashes, k)
    found, owner = np.concatenate([found, whole]), np.concatenate([owner, few])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    first = np.ones(len(found), dtype=bool)
    first[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[first], owner[first]


def _sign(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in wordhash.chunks(batch["text"], 2 << 20):
                texts, ids = batch["text"].slice(low, high - low), batch["doc_id"].slice(low, high - low)
                elements, owner = shingle_sets(texts, k)
                n = high - low
                sizes = np.bincount(owner, minlength=n)
                full = np.flatnonzero(sizes)
                if not len(full):
                    continue
                begin = (np.cumsum(sizes) - sizes)[full]
                keys = np.empty((len(full), 2), dtype=np.uint64)
                keys[:, 0] = np.add.reduceat(elements, begin)
                keys[:, 1] = np.add.reduceat(wordhash.mix(elements ^ np.uint64(0x5851F42D4C957F2D)), begin)
                place = np.cumsum(sizes > 0) - 1
                bands = band_keys(supermin(elements, place[owner], len(full)))
                offsets = np.arange(0, bands.size + 1, BANDS, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(full)),
                        pa.array(sizes[full], pa.int64()),
                        pa.array([keys[i].tobytes() for i in range(len(full))], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "bands"],
                )

    return run


def _sets(k: int) -> Callable:
    """(doc_id, elements) of each text: its whole set, as sorted 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in wordhash.chunks(batch["text"]):
                elements, owner = shingle_sets(batch["text"].slice(low, high - low), k)
                cuts = np.searchsorted(owner, np.arange(high - low + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(low, high - low),
                        pa.array(
                            [elements[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()
                        ),
                    ],
                    names=["doc_id", "elements"],
                )

    return run


def linked(sets: list[np.ndarray], similar: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= similar * union."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= similar * (int(sizes.sum()) - both) else []
    flat, member = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    code, member = code[shared], member[shared]
    order = np.argsort(code, kind="stable")
    postings, begin = member[order], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(times)))])
    cuts = np.searchsorted(member, np.arange(n + 1))
    waiting, found = np.ones(n, dtype=bool), []
    for seed in range(n):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        reached = [seed]
        while reached and waiting.any():
            x = reached.pop()
            own = code[cuts[x] : cuts[x + 1]]
            length = begin[own + 1] - begin[own]
            at = np.repeat(begin[own] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            both = np.bincount(postings[at], minlength=n)
            hits = np.flatnonzero(waiting & (100 * both >= similar * (sizes + sizes[x] - both)))
            waiting[hits] = False
            found += [(x, y) for y in hits.tolist()]
            reached += hits.tolist()
    return found


def _verify(similar: int) -> Callable:
    """Links of each run of rows with the same group; runs may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            pairs = linked(sets, similar) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[p[i]] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"]
            )

        group, ids, sets = None, [], []
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in ("bucket", "i", "j")), strict=True))
            for key, doc, elements in zip(keys, batch["doc_id"].to_pylist(), batch["elements"], strict=True):
                if key != group:
                    if len(ids) > 1:
                        yield close(ids, sets)
                    group, ids, sets = key, [], []
                ids.append(doc)
                sets.append(np.frombuffer(elements.as_buffer(), dtype=np.uint64))
        if len(ids) > 1:
            yield close(ids, sets)

    return run


def classes(df: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of every text with a set."""
    return df.select("doc_id", "text").where("text is not null").mapInArrow(tidy_batches(_sign(k)), SIGNED)


def _members(reps: DataFrame, tables: Tables) -> DataFrame:
    """(rep, n_shingles, bucket, center) of the classes that share a bucket; center: its smallest rep."""
    banded = reps.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = (
        banded.groupBy("bucket")
        .agg(
            F.count("*").alias("n"),
            F.sum("n_shingles").alias("elements"),
            F.bit_xor(F.xxhash64("rep")).alias("members"),
            F.min("rep").alias("center"),
        )
        .where("n > 1")
        .groupBy("n", "elements", "members")
        .agg(F.min("bucket").alias("bucket"), F.min("center").alias("center"))
    )
    buckets = tables.add(buckets.select("bucket", "center"), "buckets")
    return tables.add(banded.join(small(buckets), "bucket"), "members")


def _verified(placed: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Links within the groups (bucket, i, j) of placed doc_ids."""
    grouped = sets.join(placed, "doc_id").select("bucket", "i", "j", "doc_id", "elements")
    return (
        grouped.repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j", "doc_id")
        .mapInArrow(tidy_batches(_verify(similar)), "a long, b long")
    )


def _cut(n: str, elements: str) -> Column:
    """Number of blocks for so many members and shingles."""
    return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(elements) / BLOCK_ELEMENTS), F.lit(1)).cast("int")


def _block(blocks: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col(blocks)).cast("int")


def _open(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """Members of the buckets that still hold two components, with `component` and the bucket's lowest, `low`."""
    if found is None:
        now = members.withColumn("component", F.col("rep"))
    else:
        now = members.join(found, F.col("rep") == F.col("node"), "left")
        now = now.withColumn("component", F.coalesce("component", "rep"))
    ends = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return now.join(ends.where("low < high").select("bucket", "low"), "bucket")


def _starred(left: DataFrame, later: bool) -> DataFrame:
    """Each open member beside one pivot: placed in (pivot, salt, 0), the pivot in all salts.

    A bucket's pivot is its smallest member, later the smallest outside the lowest component.
    """
    aim = F.col("component") != F.col("low") if later else F.col("component") == F.col("low")
    pivots = left.where(aim).groupBy("bucket").agg(
        F.min("rep").alias("pivot"), F.min_by("component", "rep").alias("of")
    )
    pairs = left.join(pivots, "bucket").where("component <> of").groupBy("rep").agg(
        F.min("pivot").alias("pivot"), F.first("n_shingles").alias("n_shingles")
    )
    counts = pairs.groupBy("pivot").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("elements"))
    counts = counts.select("pivot", _cut("n", "elements").alias("salts"))
    own = pairs.join(counts, "pivot").select("pivot", _block("salts", 1).alias("i"), F.col("rep").alias("doc_id"))
    copied = counts.select(
        "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("i"), F.col("pivot").alias("doc_id")
    )
    return own.unionAll(copied).select(F.col("pivot").alias("bucket"), "i", F.lit(0).alias("j"), "doc_id")


def _crossed(left: DataFrame) -> DataFrame:
    """Blocks of the members outside each bucket's largest component, each beside every block of all members."""
    by = left.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("elements"))
    sizes = by.groupBy("bucket").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"),
        (F.sum("n") - F.max("n")).alias("rest"),
        F.sum("n").alias("every"),
        F.sum("elements").alias("elements"),
        (F.sum("elements") - F.max_by("elements", F.struct("n", "component"))).alias("rest_elements"),
    )
    sizes = sizes.select(
        "bucket", "main", _cut("rest", "rest_elements").alias("rows"), _cut("every", "elements").alias("columns")
    )
    cut = left.join(sizes, "bucket")
    every = F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i")
    rest = F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j")
    across = cut.select("bucket", every, _block("columns", 3).alias("j"), F.col("rep").alias("doc_id"))
    down = cut.where("component <> main").select(
        "bucket", _block("rows", 2).alias("i"), rest, F.col("rep").alias("doc_id")
    )
    return across.unionAll(down).distinct()


def _links(texts: DataFrame, members: DataFrame, k: int, similar: int, tables: Tables) -> DataFrame:
    """(a, b) links that connect all classes of similar sets."""
    families = components(members.select(F.col("rep").alias("a"), F.col("center").alias("b")))
    reps = members.select("rep", "n_shingles").distinct().join(families, F.col("rep") == F.col("node"))
    reps = tables.add(reps.select("rep", "n_shingles", F.col("component").alias("family")), "candidates")
    sizes = reps.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("elements"))
    large = tables.add(sizes.where((F.col("n") > BLOCK) | (F.col("elements") > BLOCK_ELEMENTS)).select("family"), "large")
    asked = small(reps.select(F.col("rep").alias("doc_id")))
    sets = tables.add(
        texts.join(asked, "doc_id", "left_semi").mapInArrow(tidy_batches(_sets(k)), "doc_id long, elements binary"), "sets"
    )
    placed = reps.join(small(large), "family", "left_anti").select(
        F.col("family").alias("bucket"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("rep").alias("doc_id")
    )
    placed = small(tables.add(placed, "placed"))
    links = tables.add(_verified(placed, sets, similar), "links")
    if large.isEmpty():
        return links
    members = members.join(reps.select("rep", "family"), "rep").join(small(large), "family", "left_semi")
    members = tables.add(members.select("rep", "n_shingles", "bucket"), "members-of-large")
    found = None
    for later in range(STARS):
        left = tables.add(_open(members, found), f"open-{later}")
        if left.isEmpty():
            return links
        placed = tables.add(_starred(left, later > 0), f"starred-{later}")
        links = links.unionAll(tables.add(_verified(placed, sets, similar), f"links-{later}"))
        found = components(links)
    left = tables.add(_open(members, found), "open")
    return links.unionAll(tables.add(_verified(tables.add(_crossed(left), "crossed"), sets, similar), "links-crossed"))


def group(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, similar: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of df.

    similar: least percentage of intersection to union.
    """
    tables = Tables(df.sparkSession)
    df = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = tables.add(classes(df.where("doc_id is not null"), k), "signatures")
    # one class of equal sets, under its smallest doc_id
    reps = named.groupBy("n_shingles", "set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    reps = tables.add(reps, "classes")
    owned = named.join(reps.select("n_shingles", "set_key", "rep"), ["n_shingles", "set_key"])
    owned = tables.add(owned.select("doc_id", "n_shingles", "rep"), "owners")
    tables.drop("signatures")
    members = _members(reps, tables)
    tables.drop("classes")
    links = _links(df.where("doc_id is not null and text is not null"), members, k, similar, tables)
    # a repeated doc_id ties its classes together
    by_id = owned.groupBy("doc_id").agg(
        F.min("rep").alias("first"), F.max("rep").alias("last"), F.max("n_shingles").alias("n_shingles")
    )
    ties = owned.join(by_id.where("first < last").select("doc_id", "first"), "doc_id").where("rep <> first")
    found = components(links.unionAll(ties.select(F.col("rep").alias("a"), F.col("first").alias("b"))))
    tables.drop(but="owners")
    settled = by_id.join(found, F.col("first") == F.col("node"), "left").select(
        F.col("doc_id").alias("id"), "n_shingles", F.coalesce("component", "first").alias("component_id")
    )
    return (
        df.select("doc_id")
        .join(settled, F.col("doc_id") == F.col("id"), "left")
        .select(
            "doc_id",
            F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"),
            F.coalesce("component_id", "doc_id").alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, similar=80)
