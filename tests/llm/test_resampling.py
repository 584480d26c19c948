"""Weights, scores and draws against plain sums."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tidemark.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, block long, features int, score double, n int"
SF = "/root/testdata/sf0.001"


def features(text, most):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, most, buckets, least, percent, seed):
    s = Counter(zlib.crc32(f.encode()) % buckets for _, t in rows for f in features(t, most)[1])
    t = Counter(zlib.crc32(f.encode()) % buckets for text in target for f in features(text, most)[1])
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))

    out = []
    for i, text in rows:
        n, own = features(text, most)
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, n, len(own), weight, score, None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for rank, row in enumerate(fit[: len(fit) * percent // 100], 1):
        row[5] = rank
    return sorted(map(tuple, out), key=str)


def rows():
    rng = random.Random(9)
    vocabulary = ["The", "le", "été", "日本", "x9", "a_b", "c-d", "é\x7fü"] + [f"v{i}" for i in range(80)]
    out = [(i, " ".join(rng.choice(vocabulary[: 4 + i % 90]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    out += [(7, None), (7, ""), (None, "v1 v2 " * 12), (None, "v1 v2 " * 12), (900, "-- ..\n"), (901, "V3 " * 30_000), (902, "the v3 v4 " * 9)]
    return out + [(i, "copy of the same text " * 6) for i in range(1000, 1060)]


@pytest.mark.parametrize(("most", "block_bytes", "percent"), [(1, 4 << 20, 10), (3, 500, 40), (2, 4 << 20, 100)])
def test_against_plain_sums(spark, monkeypatch, most, block_bytes, percent):
    monkeypatch.setattr(resampling, "SCORES", 16)
    target = ["the v3 v4 the v5", None, "日本 v3 x9"]
    df = spark.createDataFrame([(i, t, 1, 2, 0.5, 3) for i, t in rows()], SCHEMA).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, goal, most=most, buckets=50, least_words=5, percent=percent, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == plain(rows(), target, most, 50, 5, percent, "2024")


def test_empty_tables(spark):
    df, goal = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(df, goal).count() == 0
    one = spark.createDataFrame([(1, "a b c", 1, 1, 0.0, 1)], SCHEMA)
    got = resampling.resample(one, goal.limit(0), least_words=1, percent=100).first()
    assert (got.n_features, got["rank"]) == (3, 1)


def test_a_frequent_word_has_one_row_a_block(spark):
    df = spark.createDataFrame([(i, "the same words", 1, 1, 0.0, 1) for i in range(3000)], SCHEMA).coalesce(1)
    counted = resampling.blocks(df, "text", "doc_id").collect()
    assert len(counted) == 1 and sorted(counted[0].totals) == [3000] * 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_query_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.sql(resampling.ORACLE).fetchall()
    got = resampling.op12_resampling(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r["rank"] is not None for r in got) == sum(r.n_features >= 20 for r in got) // 10
