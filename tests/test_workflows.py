import numpy as np
import pytest
from pyspark.sql import functions as F

from resight.operators import matching, ranking, splits, vision
from resight.operators.scoring import pooled
from resight.plans import workflows
from resight.sources import cohorts, images


def write(path, rgb):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(vision.encode_png(rgb))


def photo(seed):
    return np.random.default_rng(seed).integers(0, 255, (6, 6, 3)).astype(np.uint8).repeat(8, 0).repeat(8, 1)


def test_ingest(spark, tmp_path):
    write(tmp_path / "TK" / "1" / "01-01-1224.png", photo(1))
    write(tmp_path / "TK" / "1" / "01-02-0125.png", photo(2))
    write(tmp_path / "TK" / "2" / "02-01-1224.png", photo(2))  # the same bytes under another individual
    close = photo(1)
    close[0, 0] = 0
    write(tmp_path / "TK" / "3" / "03-01-1224.png", close)
    write(tmp_path / "LAB" / "23.01.2025" / "07.png", photo(4))
    registry, dropped, pairs = workflows.ingest(spark, {"TK": str(tmp_path / "TK"), "LAB": str(tmp_path / "LAB")})
    rows = {r["path_rel"]: r for r in registry.collect()}
    assert len(rows) == 4 and [r["keep"] for r in dropped.collect()] == ["TK/1/01-02-0125.png"]
    assert rows["TK/1/01-01-1224.png"]["individual_id"] == "TK-001" and rows["TK/1/01-01-1224.png"]["n_sessions"] == 2
    assert rows["TK/1/01-01-1224.png"]["width"] == 48 and rows["LAB/23.01.2025/07.png"]["date"] == "2025-01-23"
    assert sorted(r["frame_id"] for r in rows.values()) == [f"F0000{i}" for i in range(4)]
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {("TK/1/01-01-1224.png", "TK/3/03-01-1224.png")}


def test_jpeg_is_read_by_the_image_source(spark, tmp_path):
    rgb = np.full((40, 60, 3), (200, 120, 40), np.uint8)
    rgb[:, 30:] = (20, 60, 180)
    jvm = spark._jvm
    photo = jvm.java.awt.image.BufferedImage(60, 40, 1)
    for y in range(40):
        for x in range(60):
            r, g, b = (int(v) for v in rgb[y, x])
            photo.setRGB(x, y, r << 16 | g << 8 | b)
    (tmp_path / "a").mkdir()
    jvm.javax.imageio.ImageIO.write(photo, "jpg", jvm.java.io.File(str(tmp_path / "a" / "1.jpg")))
    (tmp_path / "a" / "2.png").write_bytes(vision.encode_png(rgb))
    (tmp_path / "a" / "3.jpeg").write_bytes(b"no photo")
    (tmp_path / "a" / "4.txt").write_bytes(b"no photo")
    found = images.pixels(spark, str(tmp_path))
    read = {r["path_rel"]: (r["decoded"], vision.from_pixels(r["image"])) for r in found.collect()}
    assert set(read) == {"a/1.jpg", "a/2.png", "a/3.jpeg"} and not read["a/3.jpeg"][0] and read["a/3.jpeg"][1] is None
    assert (read["a/2.png"][1] == rgb).all() and np.abs(read["a/1.jpg"][1].astype(int) - rgb)[5:35, 5:25].max() < 12
    hashed = {r["frame_id"]: r for r in vision.phashes(found.withColumnRenamed("path_rel", "frame_id")).collect()}
    assert hashed["a/2.png"]["phash"] == vision.phash(rgb) and not hashed["a/3.jpeg"]["decoded"] and hashed["a/3.jpeg"]["phash"] is None
    assert len(hashed["a/1.jpg"]["phash"]) == 16


def test_evaluate(spark):
    r = np.random.default_rng(0)
    rows = []
    for i in range(12):
        center = r.normal(size=8)
        for s, date in enumerate(("2024-12", "2025-01", "2025-02")):
            rows.append((f"F{i}-{s}", "TK", f"TK-{i:03d}", date, None, True, (center + 0.05 * r.normal(size=8)).tolist()))
    df = spark.createDataFrame(rows, "frame_id string, cohort string, individual_id string, date string, session string, has_recapture boolean, emb array<double>")
    own = splits.build(df, test_share=0.0, open_share=0.3)
    record = workflows.evaluate(own, "TK")
    assert record["modes"]["rolling"]["micro_1"] == 1.0 and record["modes"]["single"]["n_probe"] > 0
    assert set(record["modes"]["rolling"]["by_interval"]) == {1.0, 2.0}
    assert record["open_set"]["fitted_here"] and record["open_set"]["tar"] == 1.0
    assert not workflows.evaluate(own, "TK", threshold=0.5)["open_set"]["fitted_here"]
    probes = own.filter("split_role = 'probe'").withColumn("tkey", F.lit(1))
    hits = ranking.hits(pooled(probes, own.withColumn("tkey", F.lit(0))), probes)
    assert workflows.completed_recall(hits, hits.limit(3).select("probe_id")).first()["n_probe"] == 3


def test_lab_summary(spark):
    rows = [(1, "2024-10-01"), (1, "2024-11-01"), (1, "2025-02-01"), (2, "2024-10-01")]
    b = cohorts.intervals(spark.createDataFrame(rows, "individual_id int, session_date string"), "individual_id", "session_date")
    row = workflows.lab_summary(b).first()
    assert (row["frames"], row["individuals"], row["recaptured"], row["single_session"]) == (4, 2, 1, 1)
    assert row["bins"] == {"~1мес": 1, "4-5мес": 1}


def test_diagnostics(spark):
    score = matching.build("sift")
    r = np.random.default_rng(0)
    f = ([(float(x), float(y)) for x, y in r.uniform(0, 100, (12, 2))], r.normal(size=(12, 8)).tolist())
    df = spark.createDataFrame([("a", f), ("b", ([], []))], "frame_id string, f struct<pts: array<struct<x: double, y: double>>, des: array<array<double>>>")
    assert workflows.self_match(df.filter("frame_id = 'a'"), score, "f") == {"scores": [12.0], "broken": False}
    assert workflows.self_match(df, score, "f")["broken"]
    assert workflows.pair_cost(lambda a, b: 0.0, [(1, 2)] * 20) >= 0
    took = {r["step"]: r for r in workflows.latency(spark, {"one": lambda x: x, "two": lambda x: sum(range(1000))}, range(5)).collect()}
    assert set(took) == {"one", "two"} and all(r["n"] == 5 and r["p90"] >= r["median"] >= 0 for r in took.values())
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 10)], "k string, v double")
    assert tuple(workflows.latencies(rows, "k", "v").first()) == ("a", 3.75, 2.0, pytest.approx(7.6), 4)
