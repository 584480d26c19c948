"""Word hashes and the words that packing gives its tokenizer, against plain versions; memory per byte of text."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from tidemark.llm import packing, wordhash


def plain_hash(word: bytes) -> int:
    total = len(word)
    for i, b in enumerate(word):
        total += int(wordhash._BYTE[b]) * pow(int(wordhash._BASE), i, 1 << 64)
    return int(wordhash.mix(np.array([total % (1 << 64)], np.uint64))[0])


def texts():
    rng = random.Random(5)
    ends = ["", ".", "!?", "—", "-" * 40, "é", "é.", "×.", "A", "7,"]
    words = ["".join(rng.choice("abcdXYZé.,-#7") for _ in range(rng.randint(0, 9))) + rng.choice(ends) for _ in range(4000)]
    long = "x" * (wordhash.SPAN + 17)
    return [" ".join(words), None, "", long + " tail. " + long + "...", "=" * 3000 + " a" + "." * 3000, *words[:200]]


def test_hashes_against_plain():
    words = wordhash.split_words(pa.array(texts()))
    got = words.hashes()
    spans = [words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends, strict=True)]
    few = [i for i, w in enumerate(spans) if len(w) < 100]
    assert [int(got[i]) for i in few] == [plain_hash(spans[i]) for i in few]
    long = [int(got[i]) for i, w in enumerate(spans) if w == b"x" * len(w) and len(w) > wordhash.SPAN]
    assert long == [plain_hash(b"x" * (wordhash.SPAN + 17))]


def test_packing_tokenizes_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    for part in (texts(), texts()[::-1]):  # the second time most words are known
        found = own.encode(pa.array(part))
        for text, a, b in zip(part, found.offsets[:-1], found.offsets[1:], strict=True):
            assert found.ids[a:b].tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_hashing_takes_a_few_bytes_a_byte_of_text():
    words = wordhash.split_words(pa.array(["lorem ipsum dolor " * 100_000]))
    tracemalloc.start()
    words.hashes()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 * len(words.starts) + (24 * wordhash.SPAN + (4 << 20))


def test_each_word_is_tokenized_once_however_few_are_new():
    own = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    first, few = " ".join(f"w{i}" for i in range(30_000)), " ".join(f"new{i}x" for i in range(50))
    own.encode(pa.array([first]))
    own.encode(pa.array([first + " " + few]))
    asked, tokens = [], own.tokens
    own.tokens = lambda *a: asked.append(a) or tokens(*a)
    own.encode(pa.array([few, first]))
    assert asked == []


def test_encoding_takes_a_few_bytes_a_byte_of_text():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    texts = pa.array([" ".join(rng.choices(words, k=20_000)) for _ in range(100)])
    own = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    own.encode(texts[:1])
    tracemalloc.start()
    found = own.encode(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    kept = found.ids.nbytes + found.doc.nbytes + found.code.nbytes
    assert most < 1.5 * kept + (16 << 20)


def test_used_documents_leave_the_rows_of_common_words():
    doc, hashes = np.repeat(np.arange(40), 2), np.tile(np.array([5, 9], np.uint64), 40)
    index = packing.Index(doc, hashes, 40)
    unused = np.arange(40) >= 30
    index.forget(unused)
    assert index.rows.shape[1] == 10 and index.neighbours(0, unused) == list(range(30, 40))
