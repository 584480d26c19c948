"""Brings related documents together: each document goes to the leaf of the nearest centroid.

A vector is the text's words, hashed into `SIZE` slots and weighted by rarity; words that the sample holds
fewer than twice weigh nothing.  Centroids come from a bounded sample (the rows of the smallest hashes), about one
for each shard's worth of text, and `LEAVES` at most.  A leaf that would be too large is split into centroids of
its own, and where its vectors can't be told apart (copies) or there are centroids enough, its rows are dealt out
by their hashes, so leaves keep their size however large the table is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tidemark.llm import wordhash

SIZE, TABLE = 1024, 1 << 18
SAMPLE_ROWS, SAMPLE_CHARS = 4096, 1 << 17
LEAVES = 2048
ROUNDS, SPLITS, LARGE, SEED = 8, 3, 2, 7


def slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the table, slot) of every word."""
    words = wordhash.split_words(texts, lower=True)
    hashes = words.hashes()
    return words.doc, (hashes % np.uint64(TABLE)).astype(np.int64), ((hashes >> np.uint64(40)) % np.uint64(SIZE)).astype(np.int64)


def vectors(texts: pa.Array, weight: np.ndarray) -> np.ndarray:
    doc, place, slot = slots(texts)
    out = np.bincount(doc * SIZE + slot, weights=weight[place], minlength=len(texts) * SIZE).reshape(len(texts), SIZE)
    out = np.sqrt(out).astype(np.float32)  # repeated words count less
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        order = np.argsort(own := (x @ centroids.T).argmax(axis=1), kind="stable")
        found, first = np.unique(own[order], return_index=True)
        centroids = np.add.reduceat(x[order], first, axis=0)
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-9)
    return centroids


@dataclass
class Model:
    weight: np.ndarray  # of each place of the table
    centroids: np.ndarray
    splits: np.ndarray  # leaves of each centroid
    first: np.ndarray  # number of its first leaf

    def leaves(self, texts: pa.Array, rank: np.ndarray) -> np.ndarray:
        """The leaf of each text; rank: a hash of each row."""
        if self.splits.sum() == 1:
            return np.zeros(len(texts), np.int64)
        out = np.empty(len(texts), np.int64)
        for low, high in wordhash.chunks(texts, 1 << 20):
            for at in range(low, high, 1024):
                to = min(high, at + 1024)
                own = (vectors(texts.slice(at, to - at), self.weight) @ self.centroids.T).argmax(axis=1)
                out[at:to] = self.first[own] + rank[at:to] % self.splits[own]
        return out


def fit(texts: list[str | None], sizes: list[int], leaves: int) -> Model:
    """A model of a sample; sizes: of the whole texts."""
    weight = np.zeros(TABLE)
    if leaves < 2 or len(texts) < 2:
        return Model(weight, np.zeros((1, SIZE), np.float32), np.array([max(1, leaves)]), np.array([0]))
    rng = np.random.default_rng(SEED)
    array = pa.array(texts, pa.large_string())
    doc, place, _ = slots(array)
    df = np.bincount(np.unique(place * len(texts) + doc) // len(texts), minlength=TABLE)
    weight = np.where(df > 1, np.log1p((len(texts) - df + 0.5) / (df + 0.5)), 0.0)
    x = np.concatenate([vectors(array.slice(i, 512), weight) for i in range(0, len(texts), 512)])
    share = np.array(sizes, np.float64) + 1
    share *= leaves / share.sum()
    centroids = _means(x, min(leaves, LEAVES), rng)
    for _ in range(SPLITS):
        own = (x @ centroids.T).argmax(axis=1)
        load = np.bincount(own, weights=share, minlength=len(centroids))
        large = np.flatnonzero(load > LARGE)
        if not len(large) or len(centroids) + load[large].sum() > LEAVES:
            break
        parts = [_means(x[own == j], int(np.ceil(load[j])), rng) for j in large]
        centroids = np.concatenate([np.delete(centroids, large, axis=0), *parts])
    load = np.bincount((x @ centroids.T).argmax(axis=1), weights=share, minlength=len(centroids))
    splits = np.maximum(1, np.ceil(load / LARGE)).astype(np.int64)
    return Model(weight.astype(np.float32), centroids, splits, np.cumsum(splits) - splits)
