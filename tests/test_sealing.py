"""Hash trees over sealed frames, and the unseal of one caller."""

import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from resight.operators import hashtree, sealing, sealstore

SPLITS = "frame_id string, individual_id string, split_fold string"


def entries(spark, n, repeat=1):
    return spark.createDataFrame([(f"f{i:05d}", f"f{i:05d}:{i}") for i in range(n) for _ in range(repeat)], "frame_id string, e string")


def by_hand(rows, size, fan):
    """(low, n, sha256) of leaves, and the root, from sorted (key, entry)."""
    leaves, first = {}, {}
    for at, (key, entry) in enumerate(sorted(rows)):
        first.setdefault(key, at)
        leaves.setdefault(first[key] // size, []).append((key, entry))
    out = []
    for k in sorted(leaves):
        sha = hashlib.sha256()
        for _, e in leaves[k]:
            sha.update(len(e.encode()).to_bytes(8, "little") + e.encode())
        out.append((leaves[k][0][0], len(leaves[k]), sha.hexdigest()))
    level = [x[2] for x in out]
    while True:
        level = [hashlib.sha256("|".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        if len(level) == 1:
            return out, level[0]


@pytest.mark.parametrize(("n", "repeat", "size", "fan"), [(1000, 1, 64, 4), (90, 7, 10, 3), (5, 1, 100, 256), (64, 1, 1, 4)])
def test_tree_equals_one_by_hand(spark, monkeypatch, n, repeat, size, fan):
    monkeypatch.setattr(hashtree, "FAN", fan)
    rows = entries(spark, n, repeat)
    leaves = hashtree.leaves(rows, "frame_id", "e", size)
    want, root = by_hand([tuple(r) for r in rows.collect()], size, fan)
    assert [(r["low"], r["n"], r["sha256"]) for r in leaves.orderBy("leaf").collect()] == want
    assert hashtree.root(leaves) == root and hashtree.same(rows.repartition(7), "frame_id", "e", leaves, root)


def test_changes_are_located(spark):
    rows = entries(spark, 500)
    leaves = hashtree.leaves(rows, "frame_id", "e", 50)
    root = hashtree.root(leaves)
    touched = rows.withColumn("e", F.when(F.col("frame_id") == "f00123", "x").otherwise(F.col("e")))
    found = [tuple(r) for r in hashtree.changed(touched, "frame_id", "e", leaves).collect()]
    assert found == [(2, "f00100", "f00150", 50, 50)] and not hashtree.same(touched, "frame_id", "e", leaves, root)
    gone = rows.filter("frame_id < 'f00200' or frame_id >= 'f00250'")
    assert [tuple(r)[1:] for r in hashtree.changed(gone, "frame_id", "e", leaves).collect()] == [("f00200", "f00250", 50, 0)]
    new = rows.unionByName(spark.createDataFrame([("a", "a:1"), ("zz", "zz:1")], rows.schema))
    assert sorted(tuple(r)[3:] for r in hashtree.changed(new, "frame_id", "e", leaves).collect()) == [(50, 51), (50, 51)]
    assert hashtree.changed(rows, "frame_id", "e", leaves).count() == 0
    none = hashtree.leaves(rows.limit(0), "frame_id", "e", 50)
    assert none.count() == 0 and hashtree.root(none) == hashlib.sha256().hexdigest() and hashtree.same(rows.limit(0), "frame_id", "e", none, hashtree.root(none))
    assert not hashtree.same(rows, "frame_id", "e", none, hashtree.root(none))


def frames(spark):
    s = spark.createDataFrame([(f"f{i}", f"i{i % 3}", "test" if i % 2 else "dev") for i in range(20)], SPLITS)
    return s, s.select("frame_id", F.md5("frame_id").alias("md5"))


def test_manifest_with_a_tree(spark, tmp_path):
    s, r = frames(spark)
    m = sealing.seal(s, r, beside=f"file://{tmp_path}/seal")
    assert m.n_sealed == 10 and m.sha256 == sealing.seal(s, r).sha256
    assert sealing.verify(m, s, r) and not sealing.verify(m, s, r.withColumn("md5", F.lit("0")))
    assert spark.read.parquet(m.extra["frame_ids"]).count() == 10 and sealing.changed_ranges(m, s, r).count() == 0


def test_one_of_many_callers_opens(spark, tmp_path):
    s, r = frames(spark)
    store = sealstore.Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(FileNotFoundError):
        store.read()
    store.write(sealing.seal(s, r))
    ready, out = threading.Barrier(4), []

    def call(k):
        ready.wait()
        try:
            out.append(sealstore.unseal(sealstore.Store(spark, store.path), s, r, lambda: {"k": k}, "2025-06-01", str(k))[0]["k"])
        except sealing.SealedError:
            out.append(None)

    threads = [threading.Thread(target=call, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(x is not None for x in out) == 1 and store.read().opened and store.claimed()["who"] == str(next(x for x in out if x is not None))
    with pytest.raises(sealing.SealedError):
        store.abandon()


def test_crashes_leave_a_manifest(spark, tmp_path):
    s, r = frames(spark)
    store = sealstore.Store(spark, f"file://{tmp_path}/store")
    store.write(sealing.seal(s, r))

    class Crash(BaseException):
        pass


    # the process ends while it holds the claim: nothing after it runs
    assert store.claim("gone", "2025-01-01")
    assert not store.read().opened and store.claimed() == {"who": "gone", "when": "2025-01-01"}
    with pytest.raises(sealing.SealedError):
        sealstore.unseal(store, s, r, dict, "2025-06-01")
    store.abandon()
    # it ends while the next version is written aside
    spark.createDataFrame([("half",)], "value string").write.text(f"{store.path}/_half")
    assert not store.read().opened
    # the evaluation fails, or is interrupted: the claim is given back
    for error in (ValueError, Crash):
        with pytest.raises(error):
            sealstore.unseal(store, s, r, lambda error=error: (_ for _ in ()).throw(error()), "2025-06-01")
        assert store.claimed() is None and not store.read().opened
    # changed data is refused, and stays sealed
    with pytest.raises(sealing.SealedError):
        sealstore.unseal(store, s, r.withColumn("md5", F.lit("0")), dict, "2025-06-01")
    assert sealstore.unseal(store, s, r, lambda: {"ok": 1}, "2025-06-01")[1].opened and store.read().opened_date == "2025-06-01"
