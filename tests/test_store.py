"""Content-addressed files, versions and tables."""

import hashlib
import zipfile

import pytest

from tidemark.sources import store


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture
def folders(tmp_path):
    root = tmp_path / "found"
    for folder in ("a", "b"):
        (root / folder / "x").mkdir(parents=True)
    (root / "a/x/1.txt").write_bytes(b"one")
    (root / "b/x/1.txt").write_bytes(b"one")
    (root / "a/x/2.txt").write_bytes(b"changed")
    (root / "a/empty").write_bytes(b"")
    with zipfile.ZipFile(root / "z.zip", "w") as z:
        z.writestr("x/2.txt", b"two")
        z.writestr("x/3.txt", b"three" * 500_000)
        z.mkdir("folder")
    (root / "no.zip").write_bytes(b"no archive")
    return root


def test_digests_of_files_and_members(spark, folders):
    got = {(r.name, r.is_archive): (r.sha256, r.length) for r in store.digests(spark, str(folders)).collect()}
    assert got[("x/3.txt", True)] == (sha(b"three" * 500_000), 2_500_000) and got[("a/x/1.txt", False)] == (sha(b"one"), 3)
    assert got[("a/empty", False)] == (sha(b""), 0) and got[("no.zip", False)][0] == sha(b"no archive") and len(got) == 7


def test_versions_appear_whole(spark, folders, tmp_path):
    entries = {"x/1.txt": b"one", "x/2.txt": b"two", "x/3.txt": b"three" * 500_000, "empty": b""}
    manifest = spark.createDataFrame([(n, sha(d)) for n, d in entries.items()], "name string, sha256 string")
    taken = store.copies(manifest, store.digests(spark, str(folders)))
    rows = {r.name: r for r in taken.collect()}
    assert rows["x/1.txt"].path.endswith("found/a/x/1.txt") and rows["x/2.txt"].member == "x/2.txt"
    kept, key = store.Store(str(tmp_path / "store")), store.signature(entries=sorted(entries))
    broken = taken.selectExpr("name", "sha256", "CASE WHEN name <> 'empty' THEN path END AS path", "member")
    with pytest.raises(Exception, match="missing or changed"):
        kept.publish(broken, key)
    assert kept.read(spark, key) is None  # objects may be there, the version isn't
    kept.publish(taken, key)
    kept.publish(broken, key)  # it is there
    kept.materialise(spark, key, str(tmp_path / "out"))
    assert {n: (tmp_path / "out" / n).read_bytes() for n in entries} == entries
    (tmp_path / "out/x/1.txt").write_bytes(b"ONE")
    (tmp_path / "out/empty").unlink()
    problems = {r.name: r.problem for r in kept.check(spark, key, str(tmp_path / "out")).collect()}
    assert problems == {"x/1.txt": "changed", "empty": "missing", "x/2.txt": None, "x/3.txt": None}
    object_ = tmp_path / "store/objects" / sha(b"two")[:2] / sha(b"two")
    object_.write_bytes(b"spoilt")
    with pytest.raises(Exception, match="has changed"):
        kept.materialise(spark, key, str(tmp_path / "again"))
    with pytest.raises(FileNotFoundError):
        kept.materialise(spark, "none", str(tmp_path / "again"))


def test_tables_by_signature(spark, tmp_path):
    made = []

    def make(n):
        def run():
            made.append(n)
            return spark.range(n)

        return run

    keys = [store.signature(inputs=["a", 1], code="c", most=None), store.signature(most=None, code="c", inputs=["a", 2])]
    assert store.signature(b=1, a=2) == store.signature(a=2, b=1)
    for key, n, hit in ((keys[0], 3, False), (keys[0], 4, True), (keys[1], 5, False)):
        rows, there = store.cached(spark, str(tmp_path), key, make(n))
        assert there is hit and rows.count() == (3 if key == keys[0] else 5)
    assert made == [3, 5]

    def fails():
        return spark.range(4).selectExpr("IF(id = 3, raise_error('no'), id) AS id")

    with pytest.raises(Exception, match="no"):
        store.cached(spark, str(tmp_path), "x", fails)
    assert store.cached(spark, str(tmp_path), "x", make(2))[1] is False


def sealed_rows(spark):
    from tidemark.sources import chain

    rows = [(f"s{i % 3}", f"line {i}", i) for i in range(90)] + [("one", None, 0)]
    return chain, chain.seal(spark.createDataFrame(rows, "stream_id string, line string, at int").repartition(4), ["at"])


def test_sealed_lines_are_a_chain(spark):
    chain, sealed = sealed_rows(spark)
    last = ""
    for r in sealed.where("stream_id = 's1'").orderBy("n").collect():
        last = sha(f"{last}{r.line}".encode())
        assert r.digest == last and r.line == f"line {3 * r.n + 1}"
    for segment in (1, 4, 100):
        assert chain.problems(sealed, chain.summary(sealed), segment).count() == 0


@pytest.mark.parametrize("segment", [1, 5, 100])
def test_changed_missing_swapped_and_cut_lines_are_named(spark, segment):
    chain, sealed = sealed_rows(spark)
    kept = chain.summary(sealed)

    def found(rows):
        return sorted((r.stream_id, r.n, r.problem) for r in chain.problems(rows, kept, segment).collect())

    changed = sealed.selectExpr("stream_id", "n", "IF(stream_id = 's0' AND n = 7, 'x', line) AS line", "digest")
    assert found(changed) == [("s0", 7, "changed")]
    assert found(sealed.where("NOT (stream_id = 's1' AND n IN (0, 9, 10))")) == [("s1", 1, "missing"), ("s1", 11, "missing"), ("s1", 27, "cut")]
    swapped = sealed.selectExpr("stream_id", "CASE WHEN stream_id = 's2' AND n = 4 THEN 5 WHEN stream_id = 's2' AND n = 5 THEN 4 ELSE n END AS n", "line", "digest")
    assert found(swapped) == [("s2", 4, "changed"), ("s2", 5, "changed"), ("s2", 6, "changed")]
    assert found(sealed.where("n < 29")) == [(s, 29, "cut") for s in ("s0", "s1", "s2")]
    assert found(sealed.where("stream_id <> 'one'")) == [("one", 0, "cut")]
    assert found(sealed.unionAll(sealed.where("stream_id = 's0' AND n = 3"))) == [("s0", 3, "repeated"), ("s0", 31, "cut")]
