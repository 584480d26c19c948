"""Toxicity: a convolutional text classifier in numpy.

Words (letters and digits, lower-cased) are hashed into embedding rows, a row for the word and one for
its beginning.  Filters of widths 1 to 3 slide over the whole text, each keeps its maximum, and a
logistic layer scores the maxima.  The embeddings start from class log-odds of the training texts and
everything is then trained by Adam.  A window starts at a word of the text or at the empty position after it and
never reaches the next text, so a score depends on its own text alone.  A quarter of the labelled texts stays out of
training; on it one threshold a language is chosen, where the language is told from the text's own function
words, and drawn towards the threshold of all languages as if `PRIOR` more examples lay there.  Scores are
scaled so that every language's threshold lies at 0.7.

Training reads every labelled row and its whole text.  Rows are dealt into shards of some `SHARD_BYTES` by a hash, which
are staged as embedding rows (two bytes a word and beginning).  Class log-odds are sums over all shards; in each of `ROUNDS` rounds every shard
trains a copy of the model on its rows, and the model moves by the mean of its copies' changes, an embedding row by
that of the copies which changed it.  Thresholds come from counts of all texts that stay out, by language and `BINS` bins of
probability.  The model has a fixed size, and nothing but such sums reaches the driver.

Null and empty texts are scored as texts without words.  Without labels of both classes every score is
0.  Null doc_ids are never held out; rows that repeat a doc_id are scored each; extra columns stay, but for one
that has the score's name, which is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm import wordhash
from tidemark.llm.memory import tidy_batches, tidy_group
from tidemark.llm.staging import Tables, small

SHARD_BYTES = 16 << 20  # of text, about
SLICE = 1 << 17  # positions whose responses are held at once
ROWS, SIZE, FILTERS, WIDTHS = 1 << 15, 8, 8, (1, 2, 3)
GAP = max(WIDTHS)  # so that a window from the first empty position on ends before the next text
BEGINNING = 4  # bytes
ROUNDS, EPOCHS, BATCH, RATE, SEED = 3, 6, 32, 0.02, 7  # EPOCHS in all rounds
CALIBRATION = 0.25  # of the labelled texts
BINS = 1 << 12  # of probabilities
PART = 1 << 14  # numbers of a sum that are added in one group
PRIOR = 25  # examples by which a language's threshold is drawn towards that of all
PREDICTED = 0.7

#: Frequent function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the of and to is that for it with was this from are be by",
    "fr": "le les et un une que qui dans pour sur est au du elle pas",
    "de": "der die und zu von mit ist sich das nicht ein dem den auf im",
    "es": "el los y que en un por con para del las es su se como",
}
LANGUAGES = [*FUNCTION_WORDS]

_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word rows, beginning rows, n + 1 offsets); each text is followed by `GAP` empty positions.

    Row ROWS is the empty one.
    """
    data, offsets = wordhash.utf8(texts)
    data = wordhash.ASCII_LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1  # Latin-1 capitals
    data[at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]] += 0x20
    clean = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    ).view(pa.large_string())
    words = wordhash.split_words(clean, separator=_SEPARATOR)
    begins = wordhash.Words(words.data, words.starts, np.minimum(words.ends, words.starts + BEGINNING), words.first)
    place = np.arange(len(words.starts)) + GAP * words.doc
    offsets = words.first + GAP * np.arange(len(words.first))
    out = np.full((2, int(offsets[-1])), ROWS, dtype=np.int32)
    out[0, place] = words.hashes() % np.uint64(ROWS)
    out[1, place] = wordhash.mix(begins.hashes()) % np.uint64(ROWS)
    return out[0], out[1], offsets


def _language_rows() -> np.ndarray:
    """Language of each embedding row whose word is a function word of one language only."""
    out = np.full(ROWS + 1, len(LANGUAGES), dtype=np.int8)
    for i, words in enumerate(FUNCTION_WORDS.values()):
        rows, _, offsets = features(pa.array(words.split()))
        out[rows[offsets[:-1]]] = i
    return out


def languages(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of each text's language; len(LANGUAGES) without any function word."""
    kind = _language_rows()[words]
    seen = np.flatnonzero(kind < len(LANGUAGES))
    doc = np.searchsorted(offsets, seen, side="right") - 1
    n = len(offsets) - 1
    counts = np.bincount(doc * len(LANGUAGES) + kind[seen], minlength=n * len(LANGUAGES)).reshape(n, -1)
    return np.where(counts.sum(axis=1) > 0, counts.argmax(axis=1), len(LANGUAGES))


@dataclass
class Model:
    embedding: np.ndarray  # (ROWS + 1, SIZE); the last row stays zero
    filters: list[np.ndarray]  # for each width (width, SIZE, FILTERS)
    bias: np.ndarray  # (widths * FILTERS)
    weights: np.ndarray
    intercept: float
    thresholds: np.ndarray  # of each language, and of texts without one

    def responses(self, words: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
        """For each width (positions, FILTERS); a position's window starts there."""
        x = self.embedding[words] + self.embedding[begins]
        y = x @ np.concatenate([f for w in self.filters for f in w], axis=1)
        out, at = [], 0
        for width in WIDTHS:
            z = y[:, at : at + FILTERS].copy()
            for j in range(1, width):
                z[:-j] += y[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            out.append(z)
            at += width * FILTERS
        return out

    def probabilities(self, words: np.ndarray, begins: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.empty(0)
        if np.diff(offsets).max() > SLICE:
            pooled = self.maxima(words, begins, offsets)[0].reshape(len(offsets) - 1, -1)
        else:
            spans = np.stack([offsets[:-1], offsets[1:] - GAP + 1], axis=1).ravel()
            pooled = np.concatenate([np.maximum.reduceat(z, spans, axis=0)[::2] for z in self.responses(words, begins)], axis=1)
        hidden = np.maximum(pooled + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.weights + self.intercept, -30, 30).astype(np.float64)))

    def maxima(self, words: np.ndarray, begins: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, widths, FILTERS): each text's largest responses and their positions, of however long a text."""
        shape, k = (len(offsets) - 1, len(WIDTHS), FILTERS), np.arange(FILTERS)
        value, best = np.full(shape, -np.inf, np.float32), np.zeros(shape, np.int64)
        for low in range(0, len(words), SLICE):
            high = min(low + SLICE, len(words))
            found = self.responses(words[low : high + GAP - 1], begins[low : high + GAP - 1])
            for d in range(int(np.searchsorted(offsets, low, side="right")) - 1, int(np.searchsorted(offsets, high))):
                a, b = max(int(offsets[d]), low) - low, min(int(offsets[d + 1]) - GAP + 1, high) - low
                if a >= b:
                    continue
                for w, z in enumerate(found):
                    at = a + z[a:b].argmax(axis=0)
                    better = z[at, k] > value[d, w]
                    value[d, w, better], best[d, w, better] = z[at, k][better], low + at[better]
        return value, best

    def arrays(self) -> list[np.ndarray]:
        """What is trained, but for the intercept."""
        return [self.embedding, *self.filters, self.bias, self.weights]

    def scores(self, texts: pa.Array) -> np.ndarray:
        words, begins, offsets = features(texts)
        p = self.probabilities(words, begins, offsets)
        t = self.thresholds[languages(words, offsets)]
        low = PREDICTED * p / t
        high = PREDICTED + (1 - PREDICTED) * (p - t) / (1 - t)
        return np.where(p < t, np.minimum(low, np.nextafter(PREDICTED, 0)), np.maximum(high, PREDICTED))


class _Adam:
    def __init__(self, value: np.ndarray):
        self.value, self.m, self.v, self.t = value, np.zeros_like(value), np.zeros_like(value), 0

    def step(self, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        self.t += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * gradient
        self.v[rows] = 0.99 * self.v[rows] + 0.01 * gradient**2
        self.value[rows] -= RATE * self.m[rows] / (np.sqrt(self.v[rows]) + 1e-6)


def _seen(parts: list, y: np.ndarray) -> np.ndarray:
    """(2, ROWS + 1): texts of each class that hold a row."""
    counts = np.zeros((2, ROWS + 1))
    for (words, begins), label in zip(parts, y, strict=True):
        counts[int(label), np.unique(np.concatenate([words, begins]))] += 1
    return counts


def _log_odds(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n: texts of each class."""
    odds = np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2))
    seen = counts.sum(axis=0)
    odds *= seen / (seen + 5)  # rows seen in few texts are shrunk towards zero
    odds[ROWS] = 0
    return np.clip(odds, -3, 3)


def _start(counts: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> Model:
    embedding = rng.normal(0, 0.05, (ROWS + 1, SIZE)).astype(np.float32)
    embedding[:, 0] = _log_odds(counts, n) / 3
    embedding[ROWS] = 0
    size = len(WIDTHS) * FILTERS
    filters = [rng.normal(0, 0.2, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0] = np.abs(f[0, 0]) + 0.5
    return Model(
        embedding, filters, np.zeros(size, np.float32), np.full(size, 0.1, np.float32), -1.0,
        np.full(len(LANGUAGES) + 1, 0.5),
    )


def _learn(model: Model, parts: list, y: np.ndarray, own: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Trains the model in place on the texts `own`."""
    adam = {id(a): _Adam(a) for a in model.arrays()}
    intercept = _Adam(np.array([model.intercept], np.float32))
    for _ in range(epochs):
        order = rng.permutation(own)
        for low in range(0, len(order), BATCH):
            _step(model, adam, intercept, [parts[i] for i in order[low : low + BATCH]], y[order[low : low + BATCH]])


def train(texts: list[str | None], labels: list[int]) -> Model:
    """A model of some texts and their labels, 0 or 1, of one process; both must occur."""
    rng = np.random.default_rng(SEED)
    y = np.array(labels, dtype=np.float32)
    words, begins, offsets = features(pa.array(texts, pa.large_string()))
    parts = [(words[a:b], begins[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    aside = rng.random(len(y)) < CALIBRATION
    own = np.flatnonzero(~aside) if len(set(y[~aside].tolist())) == 2 else np.arange(len(y))
    model = _start(_seen([parts[i] for i in own], y[own]), np.bincount(y[own].astype(int), minlength=2), rng)
    _learn(model, parts, y, own, EPOCHS, rng)
    model.thresholds = _thresholds(model, parts, y, aside if aside.any() else ~aside)
    return model


def _step(model: Model, adam: dict, intercept: _Adam, parts: list, y: np.ndarray) -> None:
    words, begins = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    offsets = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    values, best = model.maxima(words, begins, offsets)
    n = len(y)
    pooled = values.reshape(n, -1) + model.bias
    hidden = np.maximum(pooled, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ model.weights + model.intercept, -30, 30)))
    error = ((p - y) / n).astype(np.float32)
    back = error[:, None] * model.weights * (pooled > 0)
    rows, gradients = [], []
    for w, width in enumerate(WIDTHS):
        b = back[:, w * FILTERS : (w + 1) * FILTERS]
        change = np.zeros_like(model.filters[w])
        for j in range(width):
            at = np.minimum(best[:, w] + j, len(words) - 1)
            x = model.embedding[words[at]] + model.embedding[begins[at]]  # (texts, FILTERS, SIZE)
            change[j] = np.einsum("nf,nfs->sf", b, x)
            g = b[:, :, None] * model.filters[w][j].T[None]
            for r in (words[at], begins[at]):
                rows.append(r.ravel())
                gradients.append(g.reshape(-1, SIZE))
        adam[id(model.filters[w])].step(change)
    touched, code = np.unique(np.concatenate(rows), return_inverse=True)
    total = np.zeros((len(touched), SIZE), np.float32)
    np.add.at(total, code, np.concatenate(gradients))
    adam[id(model.embedding)].step(total[touched < ROWS], touched[touched < ROWS])
    adam[id(model.weights)].step(error @ hidden)
    adam[id(model.bias)].step(back.sum(axis=0))
    intercept.step(np.array([error.sum()]))
    model.intercept = float(intercept.value[0])


def _histogram(model: Model, parts: list, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(languages, BINS, 2): texts by language, probability and label."""
    out = np.zeros((len(LANGUAGES) + 1, BINS, 2))
    for low in range(0, len(rows), BATCH):  # responses take some hundred bytes a word
        part = [parts[i] for i in rows[low : low + BATCH]]
        words, begins = (np.concatenate([p[k] for p in part]) for k in (0, 1))
        offsets = np.concatenate([[0], np.cumsum([len(p[0]) for p in part])])
        place = np.minimum((model.probabilities(words, begins, offsets) * BINS).astype(int), BINS - 1)
        np.add.at(out, (languages(words, offsets), place, y[rows[low : low + BATCH]].astype(int)), 1)
    return out


def _best(counts: np.ndarray) -> float:
    """The threshold of the best F1, halfway to the next lower bin that holds a text; within 0.05 and 0.95."""
    bins = np.flatnonzero(counts.sum(axis=1))[::-1]
    hits, found = np.cumsum(counts[bins, 1]), np.cumsum(counts[bins].sum(axis=1))
    i = int((2 * hits / (found + hits[-1])).argmax())
    lower = (bins[i + 1] + 1) / BINS if i + 1 < len(bins) else 0
    return float(np.clip((bins[i] / BINS + lower) / 2, 0.05, 0.95))


def _cuts(counts: np.ndarray) -> np.ndarray:
    """The threshold of each language, from counts as `_histogram` gives them."""
    every = counts.sum(axis=0)
    out = np.full(len(counts), _best(every) if every[:, 1].any() else 0.5)
    for i, own in enumerate(counts):
        n = own.sum(axis=0).min()
        if n:
            out[i] = (n * _best(own) + PRIOR * out[i]) / (n + PRIOR)
    return out


def _thresholds(model: Model, parts: list, y: np.ndarray, aside: np.ndarray) -> np.ndarray:
    return _cuts(_histogram(model, parts, y, np.flatnonzero(aside)))


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(3)) == 1


@dataclass
class Shard:
    """Labelled texts as embedding rows."""

    number: int
    parts: list[tuple[np.ndarray, np.ndarray]]
    y: np.ndarray
    aside: np.ndarray


PACKED = "shard long, toxic binary, aside binary, sizes binary, words binary, begins binary"


def _as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
        buffers = [None, pa.py_buffer(2 * offsets.astype(np.int64)), pa.py_buffer(values.astype(np.uint16))]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers).cast(pa.binary())

    for batch in batches:
        for low, high in wordhash.chunks(batch["text"], 1 << 20):
            part = batch.slice(low, high - low)
            words, begins, offsets = features(part["text"])
            kept = [part[c] for c in ("doc_id", "shard", "rank", "aside")]
            yield pa.RecordBatch.from_arrays([*kept, binary(words, offsets), binary(begins, offsets)], names=["doc_id", "shard", "rank", "aside", "words", "begins"])


def _packed(key: tuple, table: pa.Table) -> pa.Table:
    """A shard as one row, in an order that doesn't depend on the files."""
    table = table.sort_by([("rank", "ascending"), ("doc_id", "ascending"), ("toxic", "ascending")])
    words, begins = (table[c].to_pylist() for c in ("words", "begins"))
    cells = (
        table["toxic"].to_numpy().astype(np.int8).tobytes(), table["aside"].to_numpy().astype(np.int8).tobytes(),
        np.array([len(w) // 2 for w in words], np.int64).tobytes(), b"".join(words), b"".join(begins),
    )
    names = [f.split()[0] for f in PACKED.split(", ")]
    return pa.table([pa.array([key[0].as_py()], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names=names)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            toxic, aside, sizes, words, begins = (
                np.frombuffer(batch[c][i].as_buffer(), kind)
                for c, kind in (("toxic", np.int8), ("aside", np.int8), ("sizes", np.int64), ("words", np.uint16), ("begins", np.uint16))
            )
            ends = np.cumsum(sizes)
            parts = [(words[a:b], begins[a:b]) for a, b in zip(ends - sizes, ends, strict=True)]
            yield Shard(batch["shard"][i].as_py(), parts, toxic.astype(np.float32), aside.astype(bool))


def _added(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("first")
    total = sum(np.frombuffer(v.as_buffer(), np.float64) for v in table["sums"].combine_chunks())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def _total(shards: DataFrame, numbers: Callable[[Shard], np.ndarray]) -> np.ndarray:
    """The sum of some numbers over all shards, added within tasks and then by parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, None
        for shard in _shards(batches):
            own = numbers(shard)
            total, first = (own, shard.number) if total is None else (total + own, first)
        if total is not None:
            cells = [total[i : i + PART].tobytes() for i in range(0, len(total), PART)]
            columns = [pa.array(range(len(cells)), pa.int32()), pa.array([first] * len(cells), pa.int64()), pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "first", "sums"])

    found = shards.mapInArrow(tidy_batches(run), "part int, first long, sums binary")
    rows = found.groupBy("part").applyInArrow(_added, "part int, sums binary").collect()  # numbers of the model's size
    return np.concatenate([np.empty(0), *(np.frombuffer(r["sums"], np.float64) for r in sorted(rows))])


def _shard_counts(whole: bool) -> Callable[[Shard], np.ndarray]:
    def run(shard: Shard) -> np.ndarray:
        own = np.flatnonzero(~shard.aside | whole)
        n = np.bincount(shard.y.astype(int) + 2 * shard.aside, minlength=4)
        return np.concatenate([n, _seen([shard.parts[i] for i in own], shard.y[own]).ravel()])

    return run


def _changes(model: Model, number: int, whole: bool) -> Callable[[Shard], np.ndarray]:
    """A shard's changes to the model, times its texts; its texts for each embedding row that it changed, and its texts."""

    def run(shard: Shard) -> np.ndarray:
        own = np.flatnonzero(~shard.aside | whole)
        copy = Model(
            model.embedding.copy(), [f.copy() for f in model.filters], model.bias.copy(), model.weights.copy(),
            model.intercept, model.thresholds,
        )
        _learn(copy, shard.parts, shard.y, own, EPOCHS // ROUNDS, np.random.default_rng([SEED, number, shard.number]))
        n = len(own)
        change = [(a.astype(np.float64) - b) * n for a, b in zip(copy.arrays(), model.arrays(), strict=True)]
        touched = change[0].any(axis=1) * n
        return np.concatenate([*(c.ravel() for c in change), [(copy.intercept - model.intercept) * n], touched, [n]])

    return run


def _moved(model: Model, sums: np.ndarray) -> Model:
    every, touched = max(sums[-1], 1), np.maximum(sums[-ROWS - 2 : -1], 1)
    made, at = [], 0
    for a in model.arrays():
        change = sums[at : at + a.size].reshape(a.shape) / (every if made else touched[:, None])
        made.append((a + change).astype(np.float32))
        at += a.size
    return Model(made[0], made[1:-2], made[-2], made[-1], model.intercept + sums[at] / every, model.thresholds)


def examples(documents: DataFrame, labels: DataFrame, tables: Tables) -> DataFrame:
    """Every labelled row that is not held out, by shards."""
    open_rows = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    known = tables.add(labels.where(open_rows & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct(), "labels")
    rows = documents.where(open_rows)
    size = rows.agg(F.sum((F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    rank = F.xxhash64("doc_id", "text")
    aside = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < int(CALIBRATION * (1 << 20))
    dealt = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(rank, F.lit(shards)).alias("shard"), rank.alias("rank"), aside.alias("aside"))
    coded = dealt.mapInArrow(tidy_batches(_as_rows), "doc_id long, shard long, rank long, aside boolean, words binary, begins binary")
    labelled = coded.join(small(known), "doc_id").repartition(min(shards, 4096), "shard")
    return tables.add(labelled.groupBy("shard").applyInArrow(tidy_group(_packed), PACKED), "examples")


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    """A model of all labelled rows that are not held out; None without both classes."""
    tables = Tables(documents.sparkSession)
    try:
        shards, whole = examples(documents, labels, tables), False
        sums = _total(shards, _shard_counts(whole))
        if not len(sums) or not ((sums[:2] + sums[2:4]) > 0).all():
            return None
        n = sums[:2]
        if not (n > 0).all():  # too few texts to leave some out
            whole = True
            sums = _total(shards, _shard_counts(whole))
            n = sums[:2] + sums[2:4]
        model = _start(sums[4:].reshape(2, -1), n, np.random.default_rng(SEED))
        for number in range(ROUNDS):
            model = _moved(model, _total(shards, _changes(model, number, whole)))
        judged = bool(sums[2:4].any())  # texts that stay out, if there are any
        counts = _total(shards, lambda shard: _histogram(model, shard.parts, shard.y, np.flatnonzero(shard.aside == judged)).ravel())
        model.thresholds = _cuts(counts.reshape(len(LANGUAGES) + 1, BINS, 2))
        return model
    finally:
        tables.drop()


def _score(model: Model | None, text: str, name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[text]
            scores = np.zeros(len(texts))
            if model is not None:
                for low, high in wordhash.chunks(texts, 1 << 19):
                    scores[low:high] = model.scores(texts.slice(low, high - low))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    return run


def score(df: DataFrame, model: Model | None, name: str = "score", text: str = "text") -> DataFrame:
    """The given columns and the score under that name; a column that has the name already is replaced."""
    rest = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()])
    return rest.mapInArrow(tidy_batches(_score(model, text, name)), StructType([*rest.schema.fields, StructField(name, DoubleType())]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= PREDICTED).cast("int").alias("predicted"),
    )
