"""Lexical retrieval packing: windows of related documents with next to no padding.

Documents are first brought together by their words (placement.py) into shards of half a million tokens or some more,
wherever they lie in the files.  Each shard gets a BM25 inverted index of its words, whose document counts,
number of documents and average length are those of all documents.  A seed document's shared words,
all of them, are its query; every unused document that holds one of them is ranked, and they fill its window
from the best down.  The document that doesn't fit is cut, and its rest seeds the next window with
neighbours of its own.  A window holds equal texts once, unless its shard has nothing else left.  The last window of a shard is cut into sequences whose lengths are powers of two, which need no padding.  Texts are shuffled once, and
the distinct words of each shard.  The result doesn't depend on the layout of the files.

Texts are tokenized by distinct word: the tokenizer drops white space and never joins across it, so the
ids of a text are those of its words in order; each text ends with one end id.

Null and empty texts are the end id alone; rows that repeat a doc_id are separate documents; a null
doc_id stays null.  Extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import placement, wordhash
from tidemark.llm.memory import tidy_batches, tidy_group, tidy_pair, trim

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 1 << 19
TOKEN_BYTES = 4  # about, of a text
PARTS, MOST_PARTS = 64, 4096  # of the distinct words
ASKED = 256  # documents of a ranking that are sorted at once; the next ones follow when they are used up
COMMON, FREQUENT = 512, 16  # at most so many words have a row of weights; each is held by a 16th of the shard or more
K1, B = 1.2, 0.75
CACHED_WORDS = 1_000_000  # of a worker's store
SIGNS = 8  # at a word's end that are looked at one by one
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "ids array<int>"
)


_SMALL, _ACCENT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)  # small letters a-z; what follows 0xC3 in other ones
_SMALL[97:123] = True
_ACCENT[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True
_SIGN, _PLAIN = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SIGN[33:127] = ~_PLAIN[33:127]


class WordTokenizer:
    """Ids of distinct words, kept in a table by word hash; the store is emptied when it holds too many.

    A word of small letters is one pre-token that the tokenizer's normalisation leaves alone, so its bytes, as the
    tokenizer spells them, go straight to its model; other words go through all of it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = np.arange(256, dtype="<u4")  # of each byte of a small letter
        for b in range(0x9F, 0xC0):
            self.spelling[b] = ord(bytewise.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][1])
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.count = 0
        self.begin = np.zeros(1, np.int64)  # of word i: ids[begin[i]] .. ids[begin[i + 1]]
        self.ids = np.empty(0, self.dtype)
        self.slots(1 << 16)

    def slots(self, n: int) -> None:
        self.table, self.place = np.zeros(n, np.uint64), np.zeros(n, np.int32)  # word hashes, 0 where free, and their words
        self.shift = np.uint64(64 - (n - 1).bit_length())

    def look(self, keys: np.ndarray) -> np.ndarray:
        """The number of each word, -1 of unknown ones."""
        out, left, at = np.full(len(keys), -1, np.int64), np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(left):
            held = self.table[at]
            hit = held == keys[left]
            out[left[hit]] = self.place[at[hit]]
            on = ~hit & (held != 0)
            left, at = left[on], (at[on] + 1) & (len(self.table) - 1)
        return out

    def put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct new words."""
        left, at = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(left):
            free = self.table[at] == 0
            self.table[at[free]] = keys[left[free]]  # one of those that want a slot gets it
            got = self.table[at] == keys[left]
            self.place[at[got]] = numbers[left[got]]
            left, at = left[~got], (at[~got] + 1) & (len(self.table) - 1)

    def add(self, keys: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        before, self.count = self.count, self.count + len(keys)
        used = int(self.begin[before])
        self.begin = _longer(self.begin, self.count + 1)
        self.begin[before + 1 : self.count + 1] = used + np.cumsum(lengths)
        self.ids = _longer(self.ids, used + len(flat))
        self.ids[used : used + len(flat)] = flat
        if 2 * self.count > len(self.table):
            held = np.flatnonzero(self.table)
            known, numbers = self.table[held], self.place[held]
            self.slots(1 << (2 * self.count).bit_length())
            self.put(known, numbers)
        self.put(keys, np.arange(before, self.count))

    def find(self, keys: np.ndarray, words: wordhash.Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, length) in ids of distinct words; first: a place of each among some words."""
        keys = np.maximum(keys, np.uint64(1))
        at = self.look(keys)
        new = np.flatnonzero(at < 0)
        if self.count + len(new) > CACHED_WORDS and self.count:
            self.clear()
            new = np.arange(len(keys))
        if len(new):
            order, lengths, flat = self.tokens(words.data, words.starts[first[new]], words.ends[first[new]])
            at[new[order]] = self.count + np.arange(len(new))
            self.add(keys[new[order]], lengths, flat)
        return self.begin[at], self.begin[at + 1] - self.begin[at]

    def tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, number of ids of each word in that order, all ids end to end) of some words of data."""
        size = ends - starts
        line = data[np.minimum(ranges(starts, size + 1), len(data) - 1)]  # with a space after each
        after = np.cumsum(size + 1) - 1
        line[after] = 0x20
        small = _SMALL[line]
        accented = (line[:-1] == 0xC3) & _ACCENT[line[1:]]
        small[:-1] |= accented
        small[1:] |= accented
        small[after] = True
        plain = np.logical_and.reduceat(small, after - size)
        own = np.repeat(plain, size + 1)
        words = self.spelling[line[own]].tobytes().decode("utf-32-le").split(" ")[:-1]
        others = line[~own].tobytes().decode("utf-8", "replace").split(" ")[:-1]
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(w)] for w in words]
        found += [x.ids for x in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), self.dtype, int(lengths.sum()))
        return np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]), lengths, flat

    def encode(self, texts: pa.Array) -> Encoded:
        """Some texts, each with its end id; a megabyte of text at a time, so that only ids and places are kept of all."""
        ids, sizes, words = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        known, codes = [], []
        for low, high in wordhash.chunks(texts, 1 << 20):
            part = pieces(texts.slice(low, high - low))
            keys, code = coded([part.hashes()])
            first = np.empty(len(keys), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            begin, lengths = self.find(keys, part, first)
            sums = np.concatenate([[0], np.cumsum(lengths[code])])
            ends = sums[part.first[1:]] + np.arange(1, high - low + 1)
            out = np.full(int(ends[-1]), END_ID, np.uint32)
            inside = np.ones(len(out), dtype=bool)
            inside[ends - 1] = False
            out[inside] = np.concatenate([self.ids[:0], *self._ids(begin, lengths, code)])
            ids.append(out)
            sizes.append(np.diff(ends, prepend=0))
            words.append(part.counts)
            known.append(keys)
            codes.append(code)
            del part, first, begin, lengths, sums, inside
            trim()
        keys, again = coded(known)
        low = 0
        for i, own in enumerate(known):
            codes[i] = again[low : low + len(own)][codes[i]]
            low += len(own)
        words, offsets = np.concatenate(words), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        doc = np.repeat(np.arange(len(words), dtype=np.int32), words)
        return Encoded(np.concatenate(ids), offsets, doc, keys, np.concatenate([np.empty(0, np.int32), *codes]))

    def _ids(self, begin: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> Iterator[np.ndarray]:
        for low in range(0, len(code), 1 << 18):  # index arrays take many bytes an id
            own = code[low : low + (1 << 18)]
            yield self.ids[ranges(begin[own], lengths[own])]


def _longer(values: np.ndarray, n: int) -> np.ndarray:
    """With room for n values and, where they are too few, some more."""
    return values if n <= len(values) else np.concatenate([values, np.zeros(n + n // 4 - len(values), values.dtype)])


@lru_cache(maxsize=1)
def shared_tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a worker process, so that words which many shards hold are tokenized once a worker."""
    return WordTokenizer(path)


@dataclass
class Encoded:
    """Texts as ids, and their words as places among the distinct word hashes."""

    ids: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray  # of each word
    keys: np.ndarray
    code: np.ndarray  # of each word


def pieces(texts: pa.Array) -> wordhash.Words:
    """Words for the tokenizer, fewer distinct ones than the texts have, with the same ids in a row.

    It maps capitals to small letters, so A-Z do so here, unless a special token might be spelled out.  And
    it always cuts between a letter or digit and a sign, so the signs at a word's end are a word of their own.
    """
    data, offsets = wordhash.utf8(texts)
    start, end = wordhash.edges(data, offsets)
    if b"<|" not in data.tobytes():
        data = wordhash.ASCII_LOWER[data]
        signed = np.flatnonzero(end & _SIGN[data])
        last = _before_signs(data, start, signed)
        accented = (data[last] >= 0x80) & (data[last] != 0x97) & (data[last] != 0xB7) & (data[last - 1] == 0xC3)
        last = last[_PLAIN[data[last]] | accented & ~start[last]]
        end[last] = True
        start[last + 1] = True
    starts = np.flatnonzero(start)
    return wordhash.Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def _before_signs(data: np.ndarray, start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The last byte of each word that is no sign, or its first byte; start: of words, last: of each word."""
    last = last.copy()
    left = np.arange(len(last))
    for _ in range(SIGNS):  # most words end in one sign or two
        left = left[_SIGN[data[last[left]]] & ~start[last[left]]]
        if not len(left):
            return last
        last[left] -= 1
    place = np.where(_SIGN[data] & ~start, -1, np.arange(len(data), dtype=np.int32))
    last[left] = np.maximum.accumulate(place)[last[left]]
    return last


def coded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of some arrays, in order of appearance, and the place of every value among them, end to end."""
    found = pa.array(np.concatenate([np.empty(0, np.uint64), *parts])).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def ranges(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for each of the lengths, end to end."""
    if not len(begin):
        return np.empty(0, np.int64)
    return np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


@dataclass
class Corpus:
    """Of all documents: their number, their words, and how many hold each word that a shard holds twice."""

    documents: int
    words: int
    known: np.ndarray  # ascending word hashes
    df: np.ndarray

    def counts(self, keys: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Documents that hold each word; words that one document of the shard holds are never asked for."""
        if not len(self.known):
            return own
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, self.df[at], own)


class Index:
    """BM25 postings of a shard's words."""

    def __init__(self, doc: np.ndarray, hashes: np.ndarray, n: int, corpus: Corpus | None = None):
        keys, code = np.unique(hashes, return_inverse=True)
        self.build(doc, keys, code, n, corpus)

    @classmethod
    def of(cls, found: Encoded, corpus: Corpus) -> Index:
        out = cls.__new__(cls)
        out.build(found.doc, found.keys, found.code, len(found.offsets) - 1, corpus)
        return out

    def build(self, doc: np.ndarray, keys: np.ndarray, code: np.ndarray, n: int, corpus: Corpus | None) -> None:
        pair = (code.astype(np.int64) << 32) | doc
        pair.sort()
        edge = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
        times = np.diff(edge, append=len(pair)).astype(np.int32)
        pair = pair[edge]
        del edge
        size = np.bincount(doc, minlength=n)
        term, self.doc = (pair >> 32).astype(np.int32), pair.astype(np.int32)  # the low half
        del pair
        df = np.bincount(term, minlength=len(keys))
        # words of one document alone are never asked for
        twice = df > 1
        own = twice[term]
        term, self.doc, times = (np.cumsum(twice, dtype=np.int32) - 1)[term[own]], self.doc[own], times[own]
        keys, df = keys[twice], df[twice]
        total, mean, every = (n, size.mean() if n else 1, df)
        if corpus is not None:
            total, mean, every = corpus.documents, corpus.words / max(corpus.documents, 1), corpus.counts(keys, df)
        idf = np.log1p((total - every + 0.5) / (every + 0.5))
        length = K1 * (1 - B + B * size / max(mean, 1))
        self.weight = idf[term] * times * (K1 + 1) / (times + length[self.doc])
        asked = (self.doc.astype(np.int64) << 32) | term
        asked.sort()
        self.words = asked.astype(np.int32)  # of each document its shared words
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=n))])
        del asked
        self.live = np.arange(n)  # documents that may still be found; postings and columns of weights are by place among them
        # a word that many documents hold has a row of weights, the others have postings
        common = np.argsort(-df, kind="stable")[:COMMON]
        common = common[df[common] * FREQUENT > n]
        self.row = np.full(len(df), len(common))
        self.row[common] = np.arange(len(common))
        dense = self.row[term] < len(common)
        self.rows = np.zeros((len(common), n))
        self.rows[self.row[term[dense]], self.doc[dense]] = self.weight[dense]
        rare = np.bincount(term[~dense], minlength=len(df))
        self.doc, self.weight = self.doc[~dense], self.weight[~dense]
        self.begin = np.concatenate([[0], np.cumsum(rare)])

    def forget(self, unused: np.ndarray) -> None:
        """Leaves used documents out of postings and weights; their words can still be asked for."""
        stays = unused[self.live]
        kept = stays[self.doc]
        self.begin = np.concatenate([[0], np.cumsum(kept)])[self.begin]
        self.doc, self.weight = (np.cumsum(stays, dtype=np.int32) - 1)[self.doc[kept]], self.weight[kept]
        self.rows, self.live = np.compress(stays, self.rows, axis=1), self.live[stays]

    def neighbours(self, seed: int, unused: np.ndarray, most: int | None = None) -> list[int]:
        """Unused documents that share words with the seed, best first; all of them without `most`."""
        asked = self.words[self.first[seed] : self.first[seed + 1]]
        if not len(asked):
            return []
        at = ranges(self.begin[asked], self.begin[asked + 1] - self.begin[asked])
        row = self.row[asked]
        score = np.bincount(self.doc[at], weights=self.weight[at], minlength=len(self.live))
        row = row[row < len(self.rows)]
        score = score + sum(self.rows[row[i : i + 32]].sum(axis=0) for i in range(0, len(row), 32))
        score[~unused[self.live]] = 0  # every weight is positive
        score = np.ceil(score * 1e9)  # sums in another order are still ties
        docs = np.flatnonzero(score)
        if most is not None and len(docs) > most:
            least = np.partition(score[docs], len(docs) - most)[len(docs) - most]
            docs = docs[score[docs] >= least]  # with its ties
        return self.live[docs[np.argsort(-score[docs], kind="stable")]].tolist()


def fill(sizes: np.ndarray, index: Index, window: int = WINDOW, kind: np.ndarray | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); only the last is shorter than the window.

    kind: equal for equal texts.  A window takes a text once, unless nothing else is left.
    """
    kinds = list(range(len(sizes))) if kind is None else kind.tolist()
    unused = np.ones(len(sizes), dtype=bool)
    sequences: list[list[tuple[int, int, int]]] = []
    now: list[tuple[int, int, int]] = []
    room, queue, follow = window, [], 0
    seed = last = None
    left = held = len(sizes)
    inside: set[int] = set()  # kinds of the window
    put_off: list[int] = []  # equal to what it holds: they are asked for again when it is full
    ahead = 0  # documents before it are used or put off
    free = False  # nothing is left that the window doesn't hold

    def next_document() -> int | None:
        nonlocal queue, follow, ahead, free, seed
        while seed is not None:
            while queue:
                if unused[d := queue.pop()]:
                    if free or kinds[d] not in inside:
                        return d
                    put_off.append(d)
                    unused[d] = False
            queue = index.neighbours(seed, unused, ASKED)[::-1]
            if not queue:  # nothing left that shares a word with the seed: the last document asks
                seed = last if seed != last else None
        while follow < len(sizes) and not (unused[follow] or kinds[follow] in inside):
            follow += 1
        ahead = max(ahead, follow)
        while ahead < len(sizes) and not (unused[ahead] and kinds[ahead] not in inside):
            ahead += 1
        if ahead < len(sizes):
            return ahead
        free = True
        unused[put_off] = True
        put_off.clear()
        while follow < len(sizes) and not unused[follow]:
            follow += 1
        return follow if follow < len(sizes) else None

    while (doc := next_document()) is not None:
        unused[doc] = False
        left -= 1
        if left < 0.7 * held:
            held, kept = left, unused.copy()
            kept[put_off] = True
            index.forget(kept)
        start, size = 0, int(sizes[doc])
        inside.add(kinds[doc])
        while start < size:
            n = min(room, size - start)
            now.append((doc, start, n))
            start, room = start + n, room - n
            if not room:
                sequences.append(now)
                now, room = [], window
                inside, ahead, free = ({kinds[doc]} if start < size else set()), 0, False
                unused[put_off] = True
                put_off.clear()
                queue, seed = [], doc  # what is left of this document seeds the next window
        seed, last = doc if seed is None else seed, doc
    if now:
        sequences.append(now)
    return sequences


def binary(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A short sequence cut into sequences whose lengths are powers of two, longest first."""
    total = sum(n for _, _, n in sequence)
    out, pieces = [], list(reversed(sequence))
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        room, now = 1 << bit, []
        while room:
            doc, start, n = pieces.pop()
            k = min(n, room)
            now.append((doc, start, k))
            room -= k
            if k < n:
                pieces.append((doc, start + k, n - k))
        out.append(now)
    return out


def occurrence(values: np.ndarray) -> np.ndarray:
    """How often each value came before, so that equal rows are dealt apart."""
    order = np.argsort(values, kind="stable")
    first = np.append(True, values[order[1:]] != values[order[:-1]])[: len(values)]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - begin
    return out


def _place(model: placement.Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch["rank"].to_numpy()
            leaf = model.leaves(batch["text"], (rank ^ (occurrence(rank) * 0x9E3779B97F4A7C1)) & ((1 << 62) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", *batch.schema.names])

    return run


def _distinct(parts: int) -> Callable:
    """Of a shard, its words and how many of its documents hold each, by ranges of hashes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        texts = table["text"].combine_chunks()
        found, counts, words = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        for low, high in wordhash.chunks(texts, 1 << 20):
            split = pieces(texts.slice(low, high - low))
            own, code = coded([split.hashes()])
            held = np.sort(code.astype(np.int64) * (high - low) + split.doc)
            held = held[np.append(True, held[1:] != held[:-1])[: len(held)]] // (high - low)
            found.append(own)
            counts.append(np.bincount(held, minlength=len(own)))
            words += len(code)
        keys, code = np.unique(np.concatenate(found), return_inverse=True)
        df = np.bincount(code, weights=np.concatenate(counts), minlength=len(keys))
        cuts = np.searchsorted(keys >> np.uint64(32), (np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts))
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.table(
            {
                "part": pa.array(range(parts), pa.int64()), "leaf": pa.array([key[0].as_py()] * parts, pa.int64()),
                "documents": pa.array([len(texts)] * parts, pa.int64()), "words": pa.array([words] * parts, pa.int64()),
                "hashes": pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
                "df": pa.array([df[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary()),
            }
        )

    return run


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, code = np.unique(keys, return_inverse=True)
    return found, np.bincount(code, weights=counts, minlength=len(found)).astype(np.int64)


def _everywhere(table: pa.Table) -> pa.Table:
    """The same range of words of all shards: how many of all documents hold the words that a shard holds twice."""
    own = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    counts = [np.frombuffer(x, np.int32) for x in table["df"].to_pylist()]
    keys, df = _summed(np.concatenate(own), np.concatenate(counts))
    twice = [k[c > 1] for k, c in zip(own, counts, strict=True)]
    n = table.num_rows
    totals = [pa.array([sum(table[c].to_pylist())] * n, pa.int64()) for c in ("documents", "words")]
    return pa.table(
        [
            table["part"], table["leaf"], *totals, pa.array([k.tobytes() for k in twice], pa.binary()),
            pa.array([df[np.searchsorted(keys, k)].tobytes() for k in twice], pa.binary()),
        ],
        names=["part", "leaf", "documents", "words", "hashes", "df"],
    )


def _pack(path: str, window: int, with_ids: bool) -> Callable:
    def run(key: tuple, table: pa.Table, counts: pa.Table) -> pa.Table:
        counts = counts.sort_by("part")
        known, df = (
            np.frombuffer(b"".join(counts[c].to_pylist()), kind) for c, kind in (("hashes", np.uint64), ("df", np.int64))
        )
        corpus = Corpus(counts["documents"][0].as_py(), counts["words"][0].as_py(), known, df)
        del counts
        table = table.sort_by([("rank", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        ids, texts = table["doc_id"].combine_chunks(), table["text"].combine_chunks()
        del table
        kind = texts.cast(pa.large_string()).fill_null("").dictionary_encode().indices.to_numpy()
        found = shared_tokenizer(path).encode(texts)
        del texts
        trim()
        tokens, offsets = found.ids, found.offsets
        sizes = np.diff(offsets)
        index = Index.of(found, corpus)
        del found
        trim()
        made = fill(sizes, index, window, kind)
        del index
        if made and sum(n for _, _, n in made[-1]) < window:
            made[-1:] = binary(made[-1])
        rows, sequence = [], key[0].as_py() << 32
        for pieces in made:
            at = 0
            for d, start, n in pieces:
                low = int(offsets[d]) + start
                rows.append((d, start, n, zlib.crc32(tokens[low : low + n]), int(sizes[d]), sequence, at, low))
                at += n
            sequence += 1
        columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
        if with_ids:
            cuts = np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)
            flat = pa.array(tokens[ranges(columns[7], columns[2])].view(np.int32))
            own = pa.ListArray.from_arrays(pa.array(cuts), flat)
        else:
            own = pa.nulls(len(rows), pa.list_(pa.int32()))
        return pa.table(
            [ids.take(pa.array(columns[0])), *(pa.array(c) for c in columns[1:7]), own],
            names=[f.split()[0] for f in PIECES.split(", ")],
        )

    return run


def place(df: DataFrame, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, int]:
    """(leaf, doc_id, text, rank) of doc_id and text; about how many leaves there are."""
    rows = df.withColumn("rank", F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)))
    length = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    count, total = df.agg(F.count("*"), F.sum(length.cast("long"))).first()
    leaves = -(-(total or 0) // (TOKEN_BYTES * shard_tokens))
    sample = []
    if leaves > 1:
        few = rows.where(F.col("rank") <= min((1 << 62) - 1, (1 << 62) * 2 * placement.SAMPLE_ROWS // count))
        few = few.select("rank", "doc_id", F.substring("text", 1, placement.SAMPLE_CHARS).alias("text"), length.alias("size"))
        sample = few.orderBy("rank", "doc_id").limit(placement.SAMPLE_ROWS).collect()
    model = placement.fit([r["text"] for r in sample], [r["size"] for r in sample], leaves)
    del sample
    trim()  # the driver's memory is bounded too
    return rows.mapInArrow(tidy_batches(_place(model)), "leaf long, doc_id long, text string, rank long"), max(1, leaves)


def pack(
    df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = True,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """The pieces of all sequences; tokenizer: path of a tokenizer file that every machine has."""
    placed, leaves = place(df.selectExpr(f"CAST(`{key}` AS LONG) AS doc_id", f"`{text}` AS text"), shard_tokens)
    counts = "part long, leaf long, documents long, words long, hashes binary, df binary"
    found = placed.groupBy("leaf").applyInArrow(tidy_group(_distinct(min(max(PARTS, leaves // 4), MOST_PARTS))), counts)
    found = found.groupBy("part").applyInArrow(_everywhere, counts)
    return placed.groupBy("leaf").cogroup(found.groupBy("leaf")).applyInArrow(tidy_pair(_pack(tokenizer, window, with_ids)), PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(documents, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")
