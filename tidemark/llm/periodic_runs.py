"""Periodic runs of words, found by the runs theorem.

A run is a stretch of words with smallest period q, at least `times` periods and `least` words long, that no
neighbouring word extends.  Every run holds a Lyndon root that is the longest Lyndon word at its place under one of the two
orders of the letters.  Those words end where the inverse suffix array has its next smaller (for the other order, next
greater) value; each is extended to both sides by longest common extensions, which are range minima of the
LCP array, looked up in a sparse table (of the reversed words for the left side).

All of it is array code over the words of some texts end to end, with a letter of its own around each.  Words that
no run can hold are left out first: a run of length n repeats, q words further, a window of n - q words, so each of its words lies
in a window of least - least // times words that occurs twice in its text.

One pass over the table, no shuffle; whole texts, a text's runs within one task.  Null texts and texts without words have
no words and no runs; repeated rows are separate rows; null keys stay null; extra columns don't matter; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.memory import tidy_batches
from tidemark.llm.wordhash import mix

LEAST, TIMES = 24, 3
BATCH_WORDS = 1 << 17
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = (
    "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
    "strongest struct<start:long,length:long,period:long>, collapsed string"
)
SPACE = r"[\x20\x09-\x0D]+"


class Suffixes:
    """Suffix array of some letters, the last of which occurs once, and common prefixes of its suffixes."""

    def __init__(self, letters: np.ndarray):
        n = len(letters)
        rank = np.unique(letters, return_inverse=True)[1].astype(np.int64)
        by_length = [rank.astype(np.int32)]  # ranks by the first 1, 2, 4, ... letters
        step = 1
        while True:
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
            if rank[order[-1]] == n - 1:
                break
            by_length.append(rank.astype(np.int32))
            step *= 2
        self.rank = rank
        first, second = order[:-1].copy(), order[1:].copy()
        common = np.zeros(n - 1, np.int32)
        for k in reversed(range(len(by_length))):
            same = by_length[k][first] == by_length[k][second]
            grown = same.astype(np.int32) << k
            common += grown
            first += grown
            second += grown
        self.least = [common]  # of 1, 2, 4, ... neighbours
        while 2 << (len(self.least) - 1) <= n - 1:
            below, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(below[:-half], below[half:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes a and b; they differ pairwise."""
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(self.least[k][low[own]], self.least[k][high[own] - (1 << k)])
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """Place of the first smaller value after each one, len(values) if there is none: up and down a pyramid of minima."""
    n = len(values)
    size = 1 << max(n - 1, 1).bit_length()
    levels = [np.append(values, np.full(size - n, np.iinfo(values.dtype).max, values.dtype))]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    at, height, out = np.arange(1, n + 1), np.full(n, -1), np.full(n, n)
    open_ = np.flatnonzero(at < n)
    for k in range(len(levels) - 1):
        place = at[open_]
        odd = (place & 1).astype(bool)
        hit = odd & (levels[k][np.minimum(place, len(levels[k]) - 1)] < values[open_])
        height[open_[hit]] = k
        at[open_] = np.where(hit, place, (place + odd) >> 1)
        open_ = open_[~hit]
        open_ = open_[at[open_] < len(levels[k + 1])]
    for k in reversed(range(len(levels))):
        own = np.flatnonzero(height == k)
        if k:
            left = at[own] * 2
            at[own] = left + (levels[k - 1][left] >= values[own])
            height[own] = k - 1
        else:
            out[own] = at[own]
    return out


def lyndon_runs(letters: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs by start, then period; the first and the last letter occur once."""
    n = len(letters)
    forward = Suffixes(letters)
    starts, ends = [], []
    for rank in (forward.rank, n - 1 - forward.rank):
        end = next_smaller(rank)
        own = np.flatnonzero((end < n) & ((end - np.arange(n)) * times < n))
        own = own[own > 0]
        starts.append(own)
        ends.append(end[own])
    start, end = np.concatenate(starts), np.concatenate(ends)
    right = forward.common(start, end)
    del forward
    left = Suffixes(letters[::-1]).common(n - start, n - end)
    period = end - start
    length, start = left + period + right, start - left
    kept = np.flatnonzero(length >= np.maximum(least, times * period))
    code, first = np.unique(start[kept] * n + period[kept], return_index=True)
    return code // n, length[kept][first], code % n


def repeated(letters: np.ndarray, width: int) -> np.ndarray:
    """Which letters lie in a window of `width` letters that occurs twice (or whose hash does)."""
    n = len(letters) - width + 1
    if n < 2:
        return np.zeros(len(letters), bool)
    each, window = mix(letters.astype(np.uint64) + np.uint64(1)), np.zeros(n, np.uint64)
    for j in range(width):
        window *= np.uint64(0xD6E8FEB86659FD93)
        window += each[j : j + n]
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    edge = np.zeros(len(letters) + 1, np.int64)
    found = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    edge[found] += 1
    edge[found + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def find(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text's words, as numbers, the runs: (start, length, period)."""
    none = (np.empty(0, np.int64),) * 3
    out = [none] * len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes + 1) - sizes  # each text follows a letter of its own
    if not sizes.sum():
        return out
    letters = np.zeros(int(first[-1] + sizes[-1]), np.int64)
    top = 0
    for at, text in zip(first.tolist(), texts, strict=True):
        letters[at - 1] = top
        letters[at : at + len(text)] = text + (top + 1)  # texts share no letters
        top += 2 + int(text.max(initial=0))
    held = repeated(letters, least - least // times)
    change = np.flatnonzero(np.diff(held, prepend=False, append=False))
    low, high = change[::2], change[1::2]
    low, high = low[high - low >= least], high[high - low >= least]
    if not len(low):
        return out
    lengths = high - low
    begin = np.cumsum(lengths + 1) - lengths
    chosen = np.repeat(low - begin, lengths) + (inside := np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum()))
    joined = top + np.arange(int(begin[-1] + lengths[-1]) + 1)  # every letter that isn't a text's occurs once
    joined[inside] = letters[chosen]
    start, length, period = lyndon_runs(joined, least, times)
    stretch = np.searchsorted(begin, start, side="right") - 1
    start = start - begin[stretch] + low[stretch]
    own = np.searchsorted(first, start, side="right") - 1
    for i in np.unique(own).tolist():
        rows = np.flatnonzero(own == i)
        out[i] = (start[rows] - first[i], length[rows], period[rows])
    return out


def strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> dict[str, int] | None:
    """The run with the greatest length / period; of equal ones the first, then the one of the smallest period."""
    best = None
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):  # by start, then period
        if best is None or n * best["period"] > best["length"] * q:
            best = {"start": s, "length": n, "period": q}
    return best


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _numbers(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def _search(least: int, times: int) -> Callable:
    def done(keys: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = find([_numbers(t) for t in texts], least, times)
        collapsed = [
            b" ".join(compress(t, (~dropped(len(t), *f)).tolist()) if len(f[0]) else t) for t, f in zip(texts, found, strict=True)
        ]
        offsets = np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(3)], fields=list(RUN))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), runs),
                pa.array([strongest(*f) for f in found], RUN), pa.array(collapsed, pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, held = [], [], 0
        for batch in batches:
            for key, text in zip(batch[0], batch[1].cast(pa.large_binary()), strict=True):
                texts.append((text.as_py() or b"").split())  # bytes split at space and tab to carriage return, as the words do
                keys.append(key.as_py())
                held += len(texts[-1])
                if held >= BATCH_WORDS or len(keys) >= 4096:
                    yield done(keys, texts)
                    keys, texts, held = [], [], 0
        if keys:
            yield done(keys, texts)

    return run


def runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed) of every row.

    strongest: the run with the greatest length / period, null without runs; collapsed: the text's words without those that a
    run holds after its first period, joined by one space.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(tidy_batches(_search(least, times)), FOUND)


def with_periods(documents: DataFrame) -> DataFrame:
    """(doc_id, text): in the tenth of documents whose checksum of doc_id says so, the words from some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, 1, a), F.slice(tail, 1, n - a)), " ")

    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    made = F.get(F.transform(F.array(words), planted), 0)  # so the words are split once
    chosen = (h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return documents.select("doc_id", F.when(chosen, made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(with_periods(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("strongest.start").alias("start"),
        F.col("strongest.length").alias("length"),
        F.col("strongest.period").alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
