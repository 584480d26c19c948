"""Runs against a plain search of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, runs int, collapsed string"


def plain(words, least=24, times=3):
    """Every period, islands of equal words that far apart; a multiple of a smaller period is no smallest one."""
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, times * q) and not any(
                all(words[k] == words[k + d] for k in range(i, i + n - d)) for d in range(1, q)
            ):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(rng):
    out = []
    for _ in range(60):
        words = [rng.choice("abcdefgh" * rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            root = [rng.choice("ab" if rng.random() < 0.5 else "abcdefghijkl") for _ in range(rng.randint(1, 14))]
            words += root * rng.randint(2, 12) + root[: rng.randint(0, len(root))]
            words += [rng.choice("xyz") for _ in range(rng.randint(0, 3))]
        out.append(words)
    return out


@pytest.mark.parametrize(("least", "times"), [(24, 3), (4, 2), (6, 4), (1, 2)])
def test_runs_against_all_periods(least, times):
    cases = texts(random.Random(least * 10 + times))
    cases += [["a"] * 100, list("ab" * 40), [], ["x"], list("abaababaabaab" * 5), (list("aaab" * 4) + ["c"]) * 7]
    numbers = [np.array([ord(w) for w in c], np.int64) for c in cases]
    for case, got in zip(cases, periodic_runs.find(numbers, least, times), strict=True):
        assert list(zip(*(x.tolist() for x in got), strict=True)) == plain(case, least, times)


def test_next_smaller():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.integers(0, 9, n)
        want = [next((j for j in range(i + 1, n) if values[j] < values[i]), n) for i in range(n)]
        assert periodic_runs.next_smaller(values).tolist() == want


def test_common_prefixes():
    rng = np.random.default_rng(2)
    letters = np.append(rng.integers(0, 2, 60), 7)
    found = periodic_runs.Suffixes(letters)
    pairs = [(i, j) for i in range(61) for j in range(61) if i != j]
    want = []
    for i, j in pairs:
        n = 0
        while max(i, j) + n < 61 and letters[i + n] == letters[j + n]:
            n += 1
        want.append(n)
    a, b = np.array(pairs).T
    assert found.common(a, b).tolist() == want
    assert sorted(range(61), key=lambda i: letters[i:].tolist()) == np.argsort(found.rank).tolist()


def expected(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = [
        hashlib.sha256(t.encode()).hexdigest()
        for t in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))
    ]
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha)


def rows():
    rng = random.Random(3)
    out = [(i, rng.choice([" ", "\n", " \t "]).join(w), 1, "x") for i, w in enumerate(texts(rng))]
    out += [(60 + i, " ".join(rng.choice(["é", "日本", "b", "c\x1cd"]) for _ in range(rng.randint(1, 200))), 1, "x") for i in range(60)]
    out += [(5, None, 1, "x"), (None, "", 1, "x"), (None, "b " * 30, None, None), (None, "b " * 30, 1, "x"), (5, "\x0b \r", 1, "x")]
    return out + [(700, " ".join(map(str, range(500))), 1, "x")] * 2


def test_query_against_plain(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = periodic_runs.op11_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [expected(i, t) for i, t, *_ in rows()]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_operator_keeps_texts_and_spans(spark):
    df = spark.createDataFrame([(1, "q " + "a b c " * 9 + "z", 1, "x")], SCHEMA)
    row = periodic_runs.runs(df).first()
    assert (row.n_words, row.collapsed) == (29, "q a b c z")
    assert [tuple(r) for r in row.runs] == [(1, 27, 3)] and tuple(row.strongest) == (1, 27, 3)
    assert periodic_runs.runs(df.limit(0)).count() == 0


def test_long_texts():
    rng = np.random.default_rng(4)
    root = rng.integers(0, 1000, 70_000)
    text = np.concatenate([[5000], np.tile(root, 4)[:250_000], [5001], np.tile([1, 2, 1, 2, 2], 20_000)])
    (start, length, period), = periodic_runs.find([text])
    whole = [r for r in zip(start.tolist(), length.tolist(), period.tolist(), strict=True) if r[1] > 1000]
    assert whole == [(1, 250_000, 70_000), (250_002, 100_000, 5)]
