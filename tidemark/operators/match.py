"""Greedy box matching (M-A to M-E): sequential rules over the boxes of one image or frame.

Images are small and many, so they are dealt into buckets of some hundred thousand boxes; a task takes a
bucket's boxes as arrays and goes through its images.  The number of buckets follows the number of rows.
Each rule is a pure function of two `Boxes`, used alike by batch operators and tests; the rules by confidence take
stacks of images of about one size and go through them box by box, all images of a stack at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGES = ["x1", "y1", "x2", "y2"]
BUCKET_ROWS = 100_000
STACKED_BOXES, STACK = 16, 1 << 20  # boxes an image that is padded; pairs of boxes in a stack


class Boxes(NamedTuple):
    """Corner boxes of one image in order, with class, confidence and side after a fit to 640."""

    edges: np.ndarray
    cls: np.ndarray
    conf: np.ndarray
    side: np.ndarray

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Boxes:
        n = len(pdf)

        def column(name: str, default: float) -> np.ndarray:
            return pdf[name].to_numpy(float) if name in pdf else np.full(n, default)

        return cls(pdf[EDGES].to_numpy(float), column("cls", 0), column("conf", 1), column("side640", np.inf))

    def rows(self, at: slice | np.ndarray) -> Boxes:
        return Boxes(*(a[at] for a in self))


def ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(..., n, m) of two arrays of corner boxes; 0 where the union is empty."""
    a, b = a[..., :, None, :], b[..., None, :, :]
    low, high = np.maximum(a[..., :2], b[..., :2]), np.minimum(a[..., 2:], b[..., 2:])
    both = np.clip(high - low, 0, None).prod(axis=-1)

    def area(x: np.ndarray) -> np.ndarray:
        return np.clip(x[..., 2:] - x[..., :2], 0, None).prod(axis=-1)

    union = area(a) + area(b) - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def by_overlap(p: Boxes, t: Boxes, least: float = 0.5) -> tuple[int, int, int]:
    """M-A: best overlaps first, class by class; ties to higher positions.  (tp, fp, fn)"""
    values = np.where(p.cls[:, None] == t.cls[None], ious(p.edges, t.edges), 0.0)
    i, j = np.nonzero(values >= least)
    used_p, used_t, tp = set(), set(), 0
    for k in np.lexsort((-j, -i, -values[i, j])):
        if i[k] not in used_p and j[k] not in used_t:
            used_p.add(i[k])
            used_t.add(j[k])
            tp += 1
    return tp, len(p.cls) - tp, len(t.cls) - tp


def by_confidence(p: Boxes, t: Boxes, least: float = 0.5, coordinates: bool = False) -> np.ndarray:
    """M-B, M-C: most certain predictions first, each to its best unused box; -1 without one.

    coordinates: equal confidences go by coordinates instead of position.
    """
    return by_confidence_of(Stack.of(p, t), least, coordinates)[0]


class Stack(NamedTuple):
    """n images with room for equally many boxes: arrays (n, boxes, ...), and where they hold a box."""

    at: np.ndarray  # numbers of the images
    p: Boxes
    t: Boxes
    p_there: np.ndarray
    t_there: np.ndarray

    @classmethod
    def of(cls, p: Boxes, t: Boxes) -> Stack:
        there = (np.ones((1, len(b.conf)), dtype=bool) for b in (p, t))
        return cls(np.zeros(1, dtype=int), *(Boxes(*(a[None] for a in b)) for b in (p, t)), *there)

    def ious(self) -> np.ndarray:
        """(n, predictions, boxes); -1 where there is no box."""
        return np.where(self.t_there[:, None, :], ious(self.p.edges, self.t.edges), -1.0)

    def certain_first(self, coordinates: bool = False) -> np.ndarray:
        """(n, predictions): positions from the highest confidence down; what isn't there comes last."""
        keys = tuple(self.p.edges.transpose(2, 0, 1)[::-1]) if coordinates else (np.broadcast_to(np.arange(self.p_there.shape[1]), self.p_there.shape),)
        return np.lexsort((*keys, -self.p.conf, ~self.p_there), axis=-1)


def by_confidence_of(s: Stack, least: float = 0.5, coordinates: bool = False) -> np.ndarray:
    """by_confidence of each image: (n, predictions)."""
    values, order, every = s.ious(), s.certain_first(coordinates), np.arange(len(s.at))
    out, free = np.full(s.p_there.shape, -1), s.t_there.copy()
    if not free.shape[1]:
        return out
    for i in order.T:
        left = np.where(free, values[every, i], -1.0)
        j = left.argmax(axis=1)
        hit = np.flatnonzero((left[every, j] >= least) & s.p_there[every, i])
        out[hit, i[hit]] = j[hit]
        free[hit, j[hit]] = False
    return out


def agree(r: Boxes, c: Boxes, strong: float = 0.16, least: float = 0.90, apart: float = 0.02) -> bool:
    """M-D: every strong reference box has an unused candidate of its class, and no strong one is left."""
    values = ious(r.edges, c.edges)
    free = np.ones(len(c.conf), dtype=bool)
    for i in np.flatnonzero(r.conf >= strong):
        left = np.where(free & (c.cls == r.cls[i]), values[i], -1.0)
        if not len(left) or left.max() < least or abs(c.conf[j := int(left.argmax())] - r.conf[i]) > apart:
            return False
        free[j] = False
    return not bool((free & (c.conf >= strong)).any())


def nearest(tracks: list, candidates: list, most: float) -> list[tuple[int, int]]:
    """M-E: (track, candidate) by centre distance below a limit; ties to lower positions."""
    if not len(tracks) or not len(candidates):
        return []
    d = np.hypot(*(np.asarray(tracks)[:, None] - np.asarray(candidates)[None]).transpose(2, 0, 1))
    out, used_t, used_c = [], set(), set()
    i, j = np.nonzero(d < most)
    for k in np.lexsort((j, i, d[i, j])):
        if i[k] not in used_t and j[k] not in used_c:
            used_t.add(i[k])
            used_c.add(j[k])
            out.append((int(i[k]), int(j[k])))
    return out


def images(p: pd.DataFrame, t: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, Boxes, Boxes]]:
    """The images of a bucket: key values, boxes of either table in order of `ord`."""
    p, t = (x.sort_values([*keys, "ord"], kind="stable") for x in (p, t))
    every = pd.concat([p[keys], t[keys]]).drop_duplicates().sort_values(keys)
    at = pd.MultiIndex.from_frame(every)
    cuts = [np.searchsorted(at.get_indexer(pd.MultiIndex.from_frame(x[keys])), np.arange(len(every) + 1)) for x in (p, t)]
    whole = [Boxes.of(x) for x in (p, t)]
    for n, key in enumerate(every.itertuples(index=False, name=None)):
        yield key, *(w.rows(slice(c[n], c[n + 1])) for w, c in zip(whole, cuts, strict=True))


def _room(n: np.ndarray) -> np.ndarray:
    """The next power of two; as many as there are where they are many or none."""
    return np.where((n > 0) & (n <= STACKED_BOXES), 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(int), n)


def stacks(p: pd.DataFrame, t: pd.DataFrame, keys: list[str]) -> tuple[pd.DataFrame, Iterator[Stack]]:
    """Key values of a bucket's images, and the images in stacks; boxes in order of `ord`."""
    both = pd.concat([p[keys], t[keys]], ignore_index=True)
    image = both.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    every = both.iloc[np.unique(image, return_index=True)[1]]
    own = image[: len(p)], image[len(p) :]
    order = [np.lexsort((x["ord"].to_numpy(), i)) for x, i in zip((p, t), own, strict=True)]
    boxes = [Boxes.of(x.iloc[o]) for x, o in zip((p, t), order, strict=True)]
    n = np.stack([np.bincount(i, minlength=len(every)) for i in own])
    first = np.cumsum(n, axis=1) - n
    room = _room(n)

    def made() -> Iterator[Stack]:
        sizes, kind = np.unique(room, axis=1, return_inverse=True)
        for k, (a, b) in enumerate(sizes.T):
            some = np.flatnonzero(kind.ravel() == k)
            step = max(1, STACK // max(1, int(a) * int(b)))
            for low in range(0, len(some), step):
                at = some[low : low + step]
                placed, there = [], []
                for side, width in enumerate((int(a), int(b))):
                    there.append(np.arange(width) < n[side, at, None])
                    place = np.where(there[-1], first[side, at, None] + np.arange(width), 0)
                    placed.append(boxes[side].rows(place))
                yield Stack(at, *placed, *there)

    return every, made()


def by_bucket(a: DataFrame, b: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """The rows that fn(p, t) makes of each bucket's boxes."""
    rows = a.select(keys[0]).unionAll(b.select(keys[0])).count()
    bucket = F.pmod(F.xxhash64(*keys), F.lit(rows // BUCKET_ROWS + 8)).alias("_bucket")
    x, y = a.select("*", bucket).groupBy("_bucket"), b.select("*", bucket).groupBy("_bucket")
    return x.cogroup(y).applyInPandas(fn, schema)


def by_image(a: DataFrame, b: DataFrame, keys: list[str], fn: Callable[[Boxes, Boxes], list[tuple]], columns: str) -> DataFrame:
    """keys and the rows that fn makes of each image's two sets of boxes."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in a.select(keys).schema.fields)
    names = [*keys, *[c.split()[0] for c in columns.split(", ")]]

    def run(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for key, x, y in images(p, t, keys) for r in fn(x, y)], columns=names)

    return by_bucket(a, b, keys, run, f"{fields}, {columns}")


def match_counts(predictions: DataFrame, truth: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """M-A: keys, tp, fp, fn; tables: keys, ord, x1, y1, x2, y2, cls."""
    return by_image(predictions, truth, keys, lambda p, t: [by_overlap(p, t, least)], "tp long, fp long, fn long")


def scored_predictions(
    predictions: DataFrame, truth: DataFrame, keys: list[str], least: float = 0.5, coordinates: bool = False
) -> DataFrame:
    """M-B, M-C: one row a prediction: keys, conf, tp, tiny, small (of the matched box's side640)."""

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in predictions.select(keys).schema.fields)

    def run(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        every, some = stacks(p, t, keys)
        parts = [every.iloc[:0].assign(conf=0.0, tp=0, tiny=0, small=0)]
        for s in some:
            image, i = np.nonzero(s.p_there)
            if not len(i):
                continue
            j = by_confidence_of(s, least, coordinates)[image, i]
            side = np.where(j >= 0, s.t.side[image, j], np.inf) if s.t.side.shape[1] else np.full(len(j), np.inf)
            found = {"conf": s.p.conf[image, i], "tp": (j >= 0).astype(int), "tiny": (side < 16).astype(int), "small": (side < 32).astype(int)}
            parts.append(every.iloc[s.at[image]].reset_index(drop=True).assign(**found))
        return pd.concat(parts, ignore_index=True)

    return by_bucket(predictions, truth, keys, run, f"{fields}, conf double, tp int, tiny int, small int")


def parity(reference: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """M-D, E7: keys, agree."""
    return by_image(reference, candidate, keys, lambda p, t: [(agree(p, t),)], "agree boolean")
