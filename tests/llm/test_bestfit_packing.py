"""Plans against best fit on single pieces; whole round trips."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import bestfit_packing

SCHEMA = "doc_id long, text string, length long, piece int, number double, ids int"


def plain(lengths, window):
    """Best-fit decreasing, one piece after the other: contents of the sequences."""
    sequences = []
    for n in sorted(lengths, reverse=True):
        fits = [s for s in sequences if window - sum(s) >= n]
        if fits:
            min(fits, key=lambda s: window - sum(s)).append(n)
        else:
            sequences.append([n])
    return sequences


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 7, 32, 100])
    lengths = [min(window, int(rng.paretovariate(0.8))) for _ in range(rng.randint(0, 400))] + [min(5, window)] * rng.choice([0, 200])
    counts = Counter(lengths)
    made = bestfit_packing.plan(counts, window)
    at, held = defaultdict(set), defaultdict(list)
    for n, count in counts.items():
        sequence, offset = made.place(np.full(count, n), np.arange(count))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            own = set(range(o, o + n))
            assert not own & at[s] and o + n <= window
            at[s] |= own
            held[s].append(n)
    assert all(own == set(range(len(own))) for own in at.values())  # no gaps
    assert made.sequences == len(held)
    assert Counter(sum(h) for h in held.values()) == Counter(sum(h) for h in plain(lengths, window))  # equal rooms are ties


def test_plan_does_not_grow_with_the_counts():
    rng = random.Random(1)
    few = {n: rng.randint(1, 300) for n in range(1, 2049)}
    many = {n: c * 1_000_003 + 1 for n, c in few.items()}
    a, b = (bestfit_packing.plan(c, 2048) for c in (few, many))
    assert len(b.low) < 4 * len(a.low) and len(b.low) < 40 * 2048
    total = sum(n * c for n, c in many.items())
    assert -(-total // 2048) <= b.sequences <= 1.01 * total / 2048


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def rows():
    rng = random.Random(4)
    words = ["The", "été", "don't", "日本", "x9", "(a)", "…", "naïve"] + [f"word{i}" for i in range(50)]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))) for i in range(80)]
    out += [(3, None), (None, ""), (None, "same text here"), (None, "same text here"), (500, "long " * 700)]
    return out + [(i, "copies of one text") for i in range(600, 700)]


@pytest.mark.parametrize("class_rows", [1 << 18, 8])
def test_round_trip(spark, class_rows):
    from tokenizers import Tokenizer

    path, window = tokenizer(), 64
    df = spark.createDataFrame([(i, t, 1, 2, 0.5, 3) for i, t in rows()], SCHEMA).repartition(4)
    got = bestfit_packing.pack(df, path, window=window, class_rows=class_rows).collect()
    plain_tokenizer = Tokenizer.from_file(path)
    want = Counter((i, (*plain_tokenizer.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in rows())
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in got)
    assert all(r.start == r.piece * window for r in got)
    cut = Counter((i, k // window, ids[k : k + window]) for (i, ids), n in want.items() for _ in range(n) for k in range(0, len(ids), window))
    assert cut == Counter((r.doc_id, r.piece, tuple(r.ids)) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= window
    assert len(sequences) == len(plain([r.length for r in got], window))


def test_the_result_does_not_depend_on_the_layout(spark):
    df = spark.createDataFrame([(i, t, 1, 2, 0.5, 3) for i, t in rows()], SCHEMA)
    a, b = (bestfit_packing.pack(df.repartition(n), tokenizer(), window=64, with_ids=False, class_rows=16) for n in (1, 5))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_empty_table(spark):
    assert bestfit_packing.pack(spark.createDataFrame([], SCHEMA), tokenizer()).count() == 0
