"""From raw documents to packed training sequences: toxicity, near-duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents, and extra columns of any name unchanged.  Null and empty texts pass all
stages but mixing, which takes no document without words.  An empty table passes all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import mixing, near_dedup, packing, secret_scan, toxicity
from tidemark.llm.staging import fresh, small, staged

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Is there SQL for the rows of run()?  No: the classifier and the packing can't be expressed.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh(docs, "_toxicity")
    return toxicity.score(docs, model, name).where(F.col(name) < toxicity.PREDICTED).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles): the one with the smallest doc_id.

    Rows that repeat a doc_id are documents of their own with hashed keys; equal ones among them count once.
    Rows without a doc_id are kept.
    """
    again, key = fresh(docs, "_again"), fresh(docs, "_key")
    ids = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(again)).agg(F.count("*").alias("n"))
    repeated = staged(ids.where("n > 1").select(again), "repeated")
    keyed = docs.withColumn(key, F.col("doc_id"))
    if several := not repeated.isEmpty():
        own = F.xxhash64(F.lit("row"), "doc_id", F.coalesce("text", F.lit("")), F.col("text").isNull())
        marked = docs.join(small(repeated), F.col("doc_id") == F.col(again), "left")
        keyed = marked.withColumn(key, F.when(F.col(again).isNull(), F.col("doc_id")).otherwise(own))
    grouped = near_dedup.group(keyed, key=key).where("doc_id is not null and not kept")
    gone = fresh(keyed, "_gone")
    dropped = staged(grouped.select(F.col("doc_id").alias(gone)).distinct(), "dropped")
    kept = keyed.join(small(dropped), F.col(key) == F.col(gone), "left_anti")
    if several:
        order = Window.partitionBy(key).orderBy(F.xxhash64(*_columns(docs)))
        rank = fresh(kept, "_rank")
        first = kept.where(F.col(again).isNotNull()).withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
        kept = kept.where(F.col(again).isNull()).unionByName(first.drop(rank))
    return kept.select(*_columns(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and lengths adjusted."""
    redacted = secret_scan.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    size, copies, copy = (fresh(docs, c) for c in ("_size", "_copies", "_copy"))
    names = {"size": size, "source_size": fresh(docs, "_source_size"), "target": fresh(docs, "_target"), "copies": copies}
    taken = mixing.mix(docs, names=names).where(F.col(copies) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*_columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all training sequences with their token ids."""
    return packing.pack(docs, TOKENIZER)


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
