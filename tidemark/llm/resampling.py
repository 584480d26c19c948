"""Importance resampling towards a target distribution of hashed word runs, by a dictionary of distinct features.

1. Each task counts the features of its documents in blocks of some megabytes: the block's distinct features with their totals,
   and for each document (feature number, count) pairs.  The blocks are a written table.
2. The features of all blocks are added up to a dictionary; each distinct string is hashed once, here, into its bucket.
3. Buckets are added up, likewise those of the target, and each bucket gets a gain.  Buckets are of a fixed number and so
   are broadcast.
4. The dictionary's gains are joined back by feature to the blocks that hold it (a frequent feature has one row a block, not one
   an occurrence) and meet the block's document counts there.

The draw takes the highest scores: counts by score give each score the number of rows above it, in two levels of sums; scores are
whole numbers within some tens of thousands whatever the size of the table (`above`), so the counts are small, and only
rows of one score are ranked among each other.

Null texts have no words and a weight of 0; rows that repeat a doc_id are documents of their own with equal noise; ties go to
the smaller doc_id, null last, and then to any of the equal rows; extra columns don't matter; an empty table gives an empty result, and
an empty target is uniform.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import wordhash
from tidemark.llm.memory import tidy_batches
from tidemark.llm.staging import Tables

BUCKETS, MOST_WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
BLOCK_BYTES = 4 << 20
SCORES = 256  # neighbouring scores that are added up first
BLOCKS = (
    "block long, features array<string>, totals array<long>, doc_ids array<long>, words array<long>, pairs array<long>, "
    "codes binary, counts binary"
)
WEIGHTS = "doc_id long, n_words long, n_features long, weight long"

SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False  # after A-Z became a-z


def occurrences(words: wordhash.Words, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, number of words) of all runs of 1 to `most` words of one text."""
    hashes = words.hashes()
    found = [(wordhash.mix(hashes), np.arange(len(hashes)), 1)]
    found += [(*wordhash.shingles(words, hashes, k), k) for k in range(2, most + 1)]
    sizes = [np.full(len(at), k) for _, at, k in found]
    return np.concatenate([h for h, _, _ in found]), np.concatenate([at for _, at, _ in found]), np.concatenate(sizes)


def count_block(doc_ids: pa.Array, texts: pa.Array, most: int, number: int) -> pa.RecordBatch:
    """One row: the distinct features of some documents, the most frequent ones first, and each document's counts."""
    words = wordhash.split_words(texts, lower=True, separator=SEPARATOR)
    n, size = len(texts), words.counts
    hashes, at, length = occurrences(words, most)
    _, first, code, totals = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-totals, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pair, counts = np.unique(words.doc[at] << 32 | place[code], return_counts=True)
    data = words.data.tobytes()
    low = at[first[order]]
    high = low + length[first[order]]
    if most == 1:
        spelled = [data[a:b] for a, b in zip(words.starts[low].tolist(), words.ends[low].tolist(), strict=True)]
    else:
        spans = list(zip(words.starts.tolist(), words.ends.tolist(), strict=True))
        spelled = [b" ".join(data[a:b] for a, b in spans[i:j]) for i, j in zip(low.tolist(), high.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            pa.array([pa.array(spelled, pa.binary()).cast(pa.string())], pa.list_(pa.string())),
            pa.array([totals[order]], pa.list_(pa.int64())),
            pa.array([doc_ids], pa.list_(pa.int64())),
            pa.array([size], pa.list_(pa.int64())),
            pa.array([np.bincount(pair >> 32, minlength=n)], pa.list_(pa.int64())),
            pa.array([(pair & 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary()),
            pa.array([counts.astype(np.uint32).tobytes()], pa.binary()),
        ],
        names=[f.split()[0] for f in BLOCKS.split(", ")],
    )


def _blocks(most: int, block_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for low, high in wordhash.chunks(batch["text"], block_bytes):
                part = batch.slice(low, high - low)
                data = wordhash.utf8(part["text"])[0]
                if held and (size + len(data) > block_bytes or sum(len(h) for h in held) >= 1 << 16):
                    yield _counted(held, most, number)
                    held, size, number = [], 0, number + 1
                held.append(part)
                size += len(data)
        if held:
            yield _counted(held, most, number)

    return run


def _counted(held: list[pa.RecordBatch], most: int, number: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    texts = pa.chunked_array([c.cast(pa.large_string()) for c in table["text"].chunks], pa.large_string())
    return count_block(table["doc_id"].combine_chunks(), texts.combine_chunks(), most, number)


def blocks(df: DataFrame, text: str, key: str | None, most: int = MOST_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    own = F.lit(None) if key is None else F.col(f"`{key}`")
    rows = df.select(own.cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(tidy_batches(_blocks(most, block_bytes)), BLOCKS)


def dictionary(counted: DataFrame, buckets: int) -> DataFrame:
    """(feature, bucket, n): each distinct string, hashed once, and how often the blocks hold it."""
    each = counted.select(F.explode(F.arrays_zip("features", "totals")).alias("f"))
    summed = each.groupBy(F.col("f.features").alias("feature")).agg(F.sum("f.totals").alias("n"))
    return summed.select("feature", (F.crc32(F.col("feature").cast("binary")) % buckets).alias("bucket"), "n")


def gains(own: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all buckets, from two dictionaries: how much likelier the target is to hold the bucket."""
    spark = own.sparkSession
    both = own.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    sums = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = spark.range(buckets).withColumnRenamed("id", "bucket").join(F.broadcast(sums), "bucket", "left").fillna(0, ["s", "t"])
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return every.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))  # total: one row


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            row = {c: batch[c][i] for c in batch.schema.names}
            codes, counts = (np.frombuffer(row[c].as_py(), np.uint32).astype(np.int64) for c in ("codes", "counts"))
            gain = np.zeros(int(codes.max(initial=-1)) + 1, np.int64)
            if row["found"].is_valid:
                found = row["found"].values
                gain[found.field("code").to_numpy()] = found.field("gain").to_numpy()
            first = np.concatenate([[0], np.cumsum(row["pairs"].values.to_numpy())])
            n = np.diff(np.concatenate([[0], np.cumsum(counts)])[first])
            total = np.diff(np.concatenate([[0], np.cumsum(counts * gain[codes])])[first])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [row["doc_ids"].values, row["words"].values, pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"]
            )


def weights(
    df: DataFrame, target: DataFrame, tables: Tables, key: str = "doc_id", text: str = "text", target_text: str = "text",
    most: int = MOST_WORDS, buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; weight: the floored mean of its features' gains."""
    counted = tables.add(blocks(df, text, key, most, block_bytes), "blocks")
    known = tables.add(dictionary(counted, buckets), "dictionary")
    wanted = tables.add(dictionary(blocks(target, target_text, None, most, block_bytes), buckets), "target")
    gain = tables.add(gains(known, wanted, buckets), "gains")
    worth = known.select("feature", "bucket").join(F.broadcast(gain), "bucket").select("feature", "gain")  # `buckets` rows
    held = counted.select("block", F.posexplode("features").alias("code", "feature"))
    found = held.join(worth, "feature").groupBy("block").agg(F.collect_list(F.struct("code", "gain")).alias("found"))
    rows = counted.select("block", "doc_ids", "words", "pairs", "codes", "counts").join(found, "block", "left")
    return rows.drop("block").mapInArrow(tidy_batches(_weigh), WEIGHTS)


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Seeded Gumbel noise in thousandths, between -3,200 and 23,000."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def above(scores: DataFrame) -> DataFrame:
    """(score, n, above): rows of each score and rows of greater ones.

    Scores are whole thousandths of a logarithm of counts plus noise: within +-1000 ln(count + buckets) and the noise's range
    there are fewer than 100,000, whatever the number of rows.
    """
    counts = scores.groupBy("score").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("score") / SCORES))
    down = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("range").agg(F.sum("n").alias("held")).select("range", F.coalesce(F.sum("held").over(down), F.lit(0)).alias("before"))
    within = Window.partitionBy("range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(F.broadcast(ranges), "range").select(
        "score", "n", (F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("above")
    )


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored (doc_id, n_words, score, ...: read twice) with rank: place among the drawn rows, null for the others."""
    fit = scored.where(F.col("n_words") >= least_words)
    taken = fit.count() * percent // 100
    cut = F.broadcast(above(fit).where(F.col("above") < taken).select(F.col("score").alias("at"), "above"))
    marked = scored.join(cut, (F.col("score") == F.col("at")) & (F.col("n_words") >= least_words), "left").drop("at")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    place = F.col("above") + F.row_number().over(order)
    first = marked.where("above is not null").withColumn("rank", place.cast("long"))
    first = first.withColumn("rank", F.when(F.col("rank") <= taken, F.col("rank")))
    return first.unionByName(marked.where("above is null").withColumn("rank", F.lit(None).cast("long"))).drop("above")


def resample(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", most: int = MOST_WORDS,
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; rank is null where the row wasn't drawn."""
    tables = Tables(df.sparkSession)
    found = weights(df, target, tables, key, text, target_text, most, buckets, block_bytes)
    scored = tables.add(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    tables.drop(but="scored")
    return draw(scored, least_words, percent)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(documents, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


#: Words by expression; crc32 as eight shifts a byte (its table by rule), once a distinct word.
ORACLE = r"""
WITH RECURSIVE shifted(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM shifted WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM shifted WHERE k = 8
), word AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
), goal AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), distinct_word AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM word UNION SELECT w FROM goal)
), byte AS (
  SELECT w, list_prepend(4294967295::BIGINT, [(('0x' || substr(h, 2 * i + 1, 2))::BIGINT) FOR i IN range(length(h) // 2)]) AS b FROM distinct_word
), hashed AS (
  SELECT w, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM byte, crc
), s AS (SELECT bucket, count(*) AS n FROM word JOIN hashed USING (w) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS n FROM goal JOIN hashed USING (w) GROUP BY bucket
), total AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t
), gain AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * (total.s + 10000) / ((s.n + 1) * (total.t + 10000)))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (bucket), total
), weighed AS (
  SELECT doc_id, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS g FROM word JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features,
         CASE WHEN g IS NULL THEN 0 ELSE g // n_features - CASE WHEN g < 0 AND g % n_features <> 0 THEN 1 ELSE 0 END END AS weight,
         CAST(floor(-1000 * ln(-ln((('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM documents d LEFT JOIN weighed USING (doc_id)
), ranked AS (
  SELECT *, weight + noise AS score,
         row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place,
         count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS taken FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CAST(CASE WHEN n_features >= 20 AND place <= taken THEN place END AS BIGINT) AS rank FROM ranked
"""
