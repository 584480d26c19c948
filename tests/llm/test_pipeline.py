"""The pipeline's stages on a small corpus."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(3)) for _ in range(900)]

    def text(bad):
        w = [rng.choice(words) for _ in range(60)] + ["grmpf", "blarg"] * bad
        rng.shuffle(w)
        return " ".join(w)

    labels = [int(i % 4 == 0) for i in range(400)]
    rows = [(i, text(y), "en", f"s{i % 5}", 0) for i, y in enumerate(labels)]
    rows += [(1000 + i, rows[2 * i + 1][1] + (" tail" if i % 2 else ""), "en", "s1", 0) for i in range(30)]
    rows += [(2000, f"here token = {'0f1e2d3c' * 5} ends", "en", None, 0), (2001, None, None, None, None), (2002, "", "en", "s1", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    marked = [(i, 1, y) for i, y in enumerate(labels)]
    spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), labels


def test_stages(spark, folder):
    path, labels = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, path)
        if name != "packing":
            assert made.columns == docs.columns
        docs = spark.createDataFrame(made.collect(), made.schema)
        rows[name] = docs.toPandas()
    kept = set(rows["toxicity"].doc_id)
    assert sum(i in kept for i, y in enumerate(labels) if y) <= 2
    assert sum(i in kept for i, y in enumerate(labels) if not y) >= 297
    near = rows["near_dedup"].doc_id.tolist()
    assert len(near) == len(set(near))
    for i in range(30):
        assert not (2 * i + 1 in near and 1000 + i in near)
    assert {2000, 2001, 2002} <= set(near)
    hidden = rows["secrets"].set_index("doc_id").loc[2000]
    assert "0f1e2d3c" not in hidden.text and hidden.n_chars == len(hidden.text)
    assert set(rows["mixing"].doc_id) <= set(near)
    packed = rows["packing"]
    assert set(packed.doc_id) == set(rows["mixing"].doc_id)
    assert packed.length.sum() == sum(packed.drop_duplicates(["doc_id", "sequence_id", "offset"]).length)


def test_run_is_the_stages_in_a_row(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    ran = corpus_pipeline.run(spark, path)
    key = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(map(str, ran.select(key).collect())) == sorted(map(str, docs.select(key).collect()))
    assert ran.count() == docs.count() > 0


TAKEN = "score double, base string, spans string, kept int, size long, source_size int, target string, copies string, _key int, _again int, _n int, _toxicity int, _size int"


def test_stages_keep_extra_columns_of_any_name(spark, folder):
    path, _ = folder
    plain = spark.read.parquet(f"{path}/documents.parquet").where("doc_id >= 300 and doc_id < 320 or doc_id > 1990")
    extra = [(0.5, "b", "s", 4, 5, 6, "t", "c", 7, 8, 9, 10, 11)]
    wide = plain.crossJoin(spark.createDataFrame(extra, TAKEN))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made, lean = stage(spark, wide, path), stage(spark, plain, path)
        assert made.columns == wide.columns
        rows = made.collect()
        assert all(tuple(r)[5:] == extra[0] for r in rows)
        assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, map(tuple, lean.collect()))), name


def test_stages_pass_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0, name
        docs = spark.createDataFrame([], docs.schema)


def test_repeated_ids_lose_copies_alone(spark, folder):
    rng = random.Random(3)
    text = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(50)) for _ in range(5)]
    rows = [(7, text[0]), (7, text[1]), (7, text[1]), (7, None), (8, text[0] + " tail"), (9, text[2]), (9, text[2] + " end"), (9, text[3]), (None, text[4]), (None, text[4]), (1, text[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder[0]).collect()]
    assert sorted(k for k in kept if k[0] is None) == [(None, text[4])] * 2 and (1, text[4]) in kept
    assert kept.count((7, text[1])) == 1 and (7, None) in kept and (9, text[3]) in kept
    assert sum(t is not None and t.startswith(text[0]) for _, t in kept) == 1
    assert sum(t is not None and t.startswith(text[2]) for _, t in kept) == 1
    assert len(kept) == 8
