import os

import pytest
from pyspark.sql import functions as F

from resight.operators import gates, near_dup, registry, sealing, splits
from resight.sources import cohorts, images, tables


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path_rel string")


def test_field_cohort_anomalies(spark):
    rows = cohorts.field_cohort(paths(spark, "21 (error)/21-01-1224.jpg", "74/74-02-01025.jpg", "66/extra from 0125/IMG_0854.jpg", "7/IMG_1.jpg", "notes/1.jpg", "1.jpg"))
    found = {r["path_rel"]: (r["local_id"], r["session"], r["date"], r["date_source"]) for r in rows.collect()}
    assert found == {
        "21 (error)/21-01-1224.jpg": (20, "1", "2024-12", "filename"),
        "74/74-02-01025.jpg": (74, "2", None, "filename_baddate"),
        "66/extra from 0125/IMG_0854.jpg": (66, None, "2025-01", "subfolder"),
        "7/IMG_1.jpg": (7, None, None, "none"),
    }


def test_dated_cohort(spark):
    found = {r["path_rel"]: (r["local_id"], r["date"]) for r in cohorts.dated_cohort(paths(spark, "23.01.2025/03.1.jpg", "23.01.2025/x.jpg", "misc/1.jpg")).collect()}
    assert found == {"23.01.2025/03.1.jpg": (3, "2025-01-23")}


def test_images(spark):
    names = ["a/1.JPG", "a/.hidden.png", "a/иллюстрация.jpg", "a/2.txt", "b/3.jpeg"]
    found = paths(spark, *names).filter(images.is_image(F.col("path_rel")))
    assert {r[0] for r in found.collect()} == {"a/1.JPG", "b/3.jpeg"}


def test_dimensions(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\0" * 8
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (48).to_bytes(2, "big") + (64).to_bytes(2, "big") + b"\0" * 12
    assert [images.dimensions(x) for x in (png, jpg, b"", None, b"\xff\xd8\xff")] == [(640, 480), (64, 48), (0, 0), (0, 0), (0, 0)]
    (tmp_path / "3").mkdir()
    (tmp_path / "3" / "1.png").write_bytes(png)
    (tmp_path / "3" / "no.txt").write_bytes(b"x")
    row = images.base_records(images.list_images(spark, str(tmp_path), content=True)).collect()
    assert [(r["path_rel"], r["width"], r["height"]) for r in row] == [("3/1.png", 640, 480)]


@pytest.mark.parametrize("names,kept", [(("1.jpg", "10.jpg"), "10.jpg"), (("03.1.jpg", "03.jpg"), "03.jpg"), (("b.jpg", "1.jpg"), "b.jpg"), (("12.jpg", "11.jpg"), "11.jpg")])
def test_survivors(spark, names, kept):
    df = spark.createDataFrame([(n, "same") for n in names] + [("9.jpg", None), ("8.jpg", None)], "path_rel string, md5 string")
    left, dropped = registry.exact_dedup(df)
    assert {r["path_rel"] for r in left.collect()} == {kept, "9.jpg", "8.jpg"}
    assert [(r["drop"], r["keep"]) for r in dropped.collect()] == [(next(n for n in names if n != kept), kept)]


FRAMES = [
    ("F1", "TK", "TK-001", 1, "2024-12", None, "a1"), ("F2", "TK", "TK-001", 1, "2025-01", None, "a2"), ("F3", "TK", "TK-001", 1, None, None, "a3"),
    ("F4", "TK", "TK-002", 2, None, "1", "a4"), ("F5", "PW", "PW-001", 1, None, "1", "a5"), ("F6", "PW", "PW-001", 1, None, "2", "a6"), ("F7", "GCN", "GCN-001", 1, None, None, "a7"),
]


def frames(spark):
    df = spark.createDataFrame(FRAMES, "frame_id string, cohort string, individual_id string, local_id int, date string, session string, md5 string")
    return registry.with_recapture(df.withColumn("path_rel", F.concat("frame_id", F.lit(".jpg"))).withColumn("role", F.lit("target")))


def test_splits(spark):
    built = {r["frame_id"]: r for r in splits.build(frames(spark)).collect()}
    assert [built[f"F{i}"]["split_role"] for i in (3, 4, 5, 6, 7)] == ["excluded_nodate", "excluded_nodate", "gallery", "probe", "excluded_nodate"]
    assert built["F2"]["interval_months"] == 1.0 and built["F6"]["interval_months"] == 1.0
    assert built["F1"]["n_sessions"] == 3  # an undated frame counts as a session of its own
    assert {built[f"F{i}"]["split_fold"] for i in (1, 2, 3)} < {"dev", "test"} or len({built[f"F{i}"]["split_fold"] for i in (1, 2, 3)}) == 1
    assert built["F4"]["split_fold"] == "distractor" and built["F5"]["split_fold"] == "aux" and built["F7"]["split_fold"] == "train"
    assert not built["F4"]["in_train_pool"] and built["F5"]["in_train_pool"]


def test_gates_and_seal(spark, tmp_path):
    reg = frames(spark)
    s = splits.to_splits(splits.build(reg, test_share=1.0))
    manifest = sealing.seal(s, reg)
    assert manifest.n_sealed == 3 and manifest.frame_ids == ["F1", "F2", "F3"]
    sealing.write_manifest(spark, manifest, str(tmp_path / "m"))
    assert sealing.read_manifest(spark, str(tmp_path / "m")) == manifest
    assert gates.passed(gates.split_gates(s, s, sealing.verify(manifest, s, reg)))
    assert not gates.passed(gates.split_gates(s, None, True))  # no evidence fails
    touched = reg.withColumn("md5", F.when(F.col("frame_id") == "F2", "zz").otherwise(F.col("md5")))
    assert not sealing.verify(manifest, s, touched)
    read = []
    with pytest.raises(sealing.SealedError):
        sealing.load_split("test", lambda: read.append(1), lambda: read.append(1))
    assert not read  # refused before any read
    assert sealing.load_split("test", lambda: reg, lambda: s, unseal=True, manifest=manifest).count() == 3
    result, after = sealing.unseal_once(manifest, s, reg, lambda: {"ok": 1}, "2025-06-01")
    assert result == {"ok": 1} and after.opened
    with pytest.raises(sealing.SealedError):
        sealing.unseal_once(after, s, reg, dict, "2025-06-02")

    def broken():
        raise ValueError

    with pytest.raises(ValueError):
        sealing.unseal_once(manifest, s, reg, broken, "2025-06-01")
    assert not manifest.opened


def test_registry_gates_find_faults(spark):
    rows = [("F1", "ZZ-1", "target", "TK", "2025-13", "/abs.jpg", "m", None, None), ("F2", "TK-1", "target", "GCN", "2025-01", "b.jpg", "m", True, None)]
    reg = spark.createDataFrame(rows, "frame_id string, individual_id string, role string, cohort string, date string, path_rel string, md5 string, has_recapture boolean, session string")
    found = {r["name"]: r["ok"] for r in gates.registry_gates(reg).collect()}
    assert found == dict.fromkeys(["namespace", "dates", "unique_md5", "recapture_known", "external", "paths_relative", "paths_exist", "near_duplicates"], False)


@pytest.mark.parametrize("spare", [2, 3, 4, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, spare):
    monkeypatch.setattr(near_dup, "SPARE", ((10**9, spare),))
    import random

    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(12)]
    hashes = base + [b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 8))) for b in base for _ in range(6)]
    rows = [("C", f"{h:016x}", f"p{i}", f"m{i}", f"i{i % 3}") for i, h in enumerate(hashes)] + [("C", "", "pe", "me", "i"), ("C", None, "pn", "mn", "i")]
    df = spark.createDataFrame(rows, "cohort string, phash string, path_rel string, md5 string, individual_id string")
    found = {(x["a"], x["b"]): x["dist"] for x in near_dup.near_pairs(df).collect()}
    expected = {}
    for i in range(len(hashes)):
        for j in range(i):
            if (d := (hashes[i] ^ hashes[j]).bit_count()) <= 6:
                expected[tuple(sorted((f"p{i}", f"p{j}")))] = d
    assert found == expected


def test_upsert_and_cache(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "frame_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "frame_id string, v int")
    assert sorted(tuple(r) for r in tables.upsert(old, new).collect()) == [("a", 1), ("b", 2), ("c", 2)]
    made = []
    for _ in range(2):
        out = tables.cached(spark, str(tmp_path), lambda: made.append(1) or old, "k")
    assert len(made) == 1 and out.count() == 2
    at = str(tmp_path / "b")
    done, whole = tables.in_batches(old, lambda x: x, at, "frame_id", 3, 60)
    assert done.count() == 2 and whole
    done, whole = tables.in_batches(new, lambda x: x, at, "frame_id", 3, 60)  # other rows under the same path
    assert sorted(tuple(r) for r in done.collect()) == [("b", 2), ("c", 2)] and whole
    done, whole = tables.in_batches(new, lambda x: x, at, "frame_id", 3, 0)
    assert done.count() == 0 and not whole


def test_frame_ids_keep_all_rows_of_wide_tables(spark):
    n = 400_000
    wide = {f"c{i}": F.md5(F.concat(F.col("id").cast("string"), F.lit(str(i)))) for i in range(3)}
    rows = spark.range(n).select((F.col("id") % 3).alias("cohort"), (F.col("id") % 1000).alias("individual_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("date"), F.col("id").cast("string").alias("path_rel"), "id").withColumns(wide)
    found = registry.with_frame_ids(rows)
    out = found.agg(F.count("*").alias("n"), F.count_distinct("frame_id").alias("ids"), F.count_distinct("id").alias("rows"), F.max(F.substring("frame_id", 2, 9).cast("int")).alias("last"), F.max(F.length("c2")).alias("c")).first()
    assert tuple(out) == (n, n, n, n - 1, 32)
    first = found.orderBy("cohort", "individual_id", F.col("date").asc_nulls_last(), "path_rel").limit(3).collect()
    assert [r["frame_id"] for r in first] == ["F00000", "F00001", "F00002"]


def test_all_cohorts_are_dispatched(spark):
    assert set(cohorts.PARSERS) == {"TK", "PW", "LAB", "GCN"}
    with pytest.raises(ValueError):
        cohorts.parse("GCN", paths(spark, "x.jpg"))


def test_rehearsal_and_deleted_crops(spark, tmp_path):
    reg = frames(spark)
    s = splits.to_splits(splits.build(reg, test_share=1.0))
    manifest = sealing.seal(s, reg)
    masks = iter([[1, 0], [1, 0], [1, 0], [0, 1]])
    good = sealing.rehearse(manifest, s, reg, reg, mask=lambda: next(masks), crops=s.filter("split_fold <> 'test'").select("frame_id"))
    assert all(good.values()) and len(good) == 6
    bad = sealing.rehearse(manifest, s, reg, reg.limit(0), mask=lambda: next(masks), crops=s.select("frame_id").unionByName(s.select("frame_id")))
    assert {k for k, v in bad.items() if not v} == {"files", "mask_deterministic", "append"}
    for i in (1, 2, 4):
        (tmp_path / f"F{i}.png").write_bytes(b"x")
    sealed = s.filter("split_fold = 'test'").select("frame_id")
    assert tables.delete_files(spark, str(tmp_path), sealed, ".png") == 2 and [p.name for p in tmp_path.glob("*.png")] == ["F4.png"]


def test_digest_is_one_hash_over_ranges(spark):
    import hashlib

    rows = spark.range(5000).select(F.format_string("F%05d", "id").alias("frame_id"), F.md5(F.col("id").cast("string")).alias("md5"), (F.col("id") % 7).alias("individual_id")).repartition(9)
    text = "|".join(f"F{i:05d}:{hashlib.md5(str(i).encode()).hexdigest()}" for i in range(5000))
    assert tuple(sealing.digest(rows).first()) == (hashlib.sha256(text.encode()).hexdigest(), 5000, 7)


def test_shuffle_files_go_once_a_table_is_written(spark):
    import time

    from resight.scratch import written

    def files():
        return {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(setting), files()
    assert written(spark.range(1000).repartition(4, "id"), "moved").count() == 1000
    end = time.time() + 10
    left = files() - before
    while time.time() < end and [x for x in left if x.endswith(".data")]:
        time.sleep(0.5)
        left = files() - before
    # the count's own, of one row a task, may stay
    assert sum(os.path.getsize(x) for x in left if os.path.exists(x)) < 1000 and spark.conf.get(setting) == was
