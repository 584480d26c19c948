"""Vectorised words, word hashes and shingles of Arrow text columns (numpy only).

A word is a maximal run of characters other than space and tab..carriage return.  All of those
separators are single bytes in UTF-8 and never part of a longer sequence, so words are found on the
raw bytes of an Arrow string array without decoding it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


SPAN = 1 << 16
_POWER, _INVERSE = powers(SPAN), powers(SPAN, np.uint64(pow(int(_BASE), -1, 1 << 64)))  # _BASE is odd


@dataclass
class Words:
    """The words of a batch of texts: byte spans in `data`, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of text i: words first[i] .. first[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a difference of running sums over all bytes, brought back to the word's start."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        low = 0
        while low < len(out):  # some thousands of words at a time: the arrays below are per byte
            begin = int(self.starts[low])
            high = max(low + 1, int(np.searchsorted(self.ends, begin + SPAN, side="right")))
            span = int(self.ends[high - 1]) - begin
            power, inverse = (_POWER, _INVERSE) if span <= SPAN else (powers(span), powers(1))  # a long word is alone
            sums = np.zeros(span + 1, dtype=np.uint64)
            np.multiply(_BYTE[self.data[begin : begin + span]], power[:span], out=sums[1:])
            np.cumsum(sums, out=sums)
            starts, ends = self.starts[low:high] - begin, self.ends[low:high] - begin
            out[low:high] = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
            low = high
        return mix(out)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and its n + 1 offsets into them; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array, lower: bool = False, separator: np.ndarray = SEPARATOR) -> Words:
    """Words of each text; `lower` maps A-Z to a-z and nothing else."""
    data, offsets = utf8(texts)
    if lower:
        data = ASCII_LOWER[data]
    start, end = edges(data, offsets, separator)
    starts = np.flatnonzero(start)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def edges(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte of some texts is the first of a word, and whether it is the last."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
    return start, end


def shingles(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k consecutive words of one text, position of its first word in the batch)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    position = np.arange(len(hashes))
    last = np.repeat(words.first[1:], words.counts)
    keep = np.flatnonzero(position + k <= last)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        rolled *= _BASE
        rolled += hashes[j : j + n]
    return mix(rolled[keep]), keep


def short_sets(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts with 1 to k - 1 words, hash of each one's whole word sequence)."""
    few = np.flatnonzero((words.counts > 0) & (words.counts < k))
    out = np.empty(len(few), dtype=np.uint64)
    for i, text in enumerate(few):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in hashes[words.first[text] : words.first[text + 1]]:
                h = h * _BASE + w
            out[i] = h + words.counts[text].astype(np.uint64) * _GOLDEN
    return few, mix(out)


def chunks(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes of text each, so that a batch's arrays stay small."""
    _, offsets = utf8(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to
