import numpy as np
import pytest
from pyspark.sql import functions as F

from resight.operators import calibration, catalog, experiment, gallery, matching, metrics, openset, ranking, vocabulary
from resight.operators.scoring import pairwise, pooled


def vectors(spark, n=40, dims=6, seed=1):
    r = np.random.default_rng(seed)
    rows = [(i, int(i % 5), int(i % 3), r.normal(size=dims).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "frame_id long, individual_id long, tkey long, emb array<double>")


def test_pooled_equals_brute_force(spark):
    rows, df = vectors(spark)
    unit = {i: np.array(e) / np.linalg.norm(e) for i, _, _, e in rows}
    expected = {}
    for p, _, pt, _ in rows:
        for q, who, qt, _ in rows:
            if qt < pt and p != q:
                s = round(float(unit[p] @ unit[q]), 6)
                if (p, who) not in expected or (-s, q) < (-expected[p, who][0], expected[p, who][1]):
                    expected[p, who] = (s, q)
    for tile in (7, 4096):
        found = {(r["probe_id"], r["individual_id"]): (r["score"], r["ref_id"]) for r in pooled(df, df, tile=tile).collect()}
        assert found.keys() == expected.keys()
        assert all(abs(found[k][0] - expected[k][0]) < 1e-9 and found[k][1] == expected[k][1] for k in expected)


def test_pooled_groups_sessions_and_ids_of_their_own(spark):
    rows, df = vectors(spark, 60)
    df = df.withColumns({"g": F.col("frame_id") % 4, "s": F.when(F.col("frame_id") % 3 > 0, F.concat_ws("-", F.col("individual_id").cast("string"), F.col("tkey").cast("string")))})
    session = {i: f"{w}-{t}" if i % 3 else None for i, w, t, _ in rows}
    for itself in (True, False):
        found = {(r["probe_id"], r["individual_id"]) for r in pooled(df, df, group="g", apart="s", strictly_earlier=False, itself=itself, tile=5).collect()}
        expected = {(p, w) for p, _, _, _ in rows for q, w, _, _ in rows if p % 4 == q % 4 and not (itself and p == q) and (session[p] is None or session[p] != session[q])}
        assert found == expected
    strings = df.withColumn("frame_id", F.concat(F.lit("u"), F.col("frame_id").cast("string")))
    assert pooled(strings, df, strictly_earlier=False, itself=False).count() == 60 * 5
    undated = df.withColumn("tkey", F.lit(None).cast("long"))
    assert pooled(df, undated).count() == 0 and pooled(undated, df).count() == 0


def test_rates_of_many_scores(spark):
    import time

    known, new = (spark.range(100_000).select(F.rand(s).alias("score")) for s in (1, 1000))  # rand adds the number of the partition to its seed
    began = time.monotonic()
    rates = openset.at_or_above(known, new)
    out = rates.agg(F.count("*").alias("n"), F.max("tar").alias("a"), F.min("far").alias("b"), F.max(F.abs(F.col("tar") - (1 - F.col("t")))).alias("off")).first()
    assert out["n"] == 200_000 and out["a"] == 1.0 and out["b"] == 0.0 and out["off"] < 0.01
    assert time.monotonic() - began < 30


def test_quantiles(spark):
    r = np.random.default_rng(0)
    values = r.integers(0, 50, 999).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(6)
    row = openset.quantiles(df, {str(q): ("v", q) for q in (0.0, 0.137, 0.5, 0.9, 1.0)}).first()
    for q in (0.0, 0.137, 0.5, 0.9, 1.0):
        assert row[str(q)] == pytest.approx(np.quantile(values, q))
    assert openset.quantiles(df.limit(0), {"x": ("v", 0.5)}).first()["x"] is None


def test_no_references(spark):
    _, df = vectors(spark)
    first = df.filter("tkey = 0")
    scores = pooled(first, first)
    hits = ranking.hits(scores, first)
    assert scores.count() == 0 and hits.count() == first.count()
    assert metrics.micro_recall(hits).first()["micro_1"] == 0.0


def test_ties_by_id(spark):
    s = spark.createDataFrame([("p", 2, i, 1.0, 0) for i in (3, 1, 2)], "probe_id string, truth int, individual_id int, score double, ref_id int")
    assert [r["individual_id"] for r in ranking.top_k(s, 3).orderBy("rank").collect()] == [1, 2, 3]
    probes = spark.createDataFrame([("p", 2)], "frame_id string, individual_id int")
    assert ranking.hits(s, probes).first()["true_rank"] == 2


def test_open_set_edges(spark):
    known = spark.createDataFrame([(x,) for x in (9.0, 8.0, 3.0)], "score double")
    new = spark.createDataFrame([(x,) for x in (4.0, 2.0)], "score double")
    empty = new.limit(0)
    assert openset.youden(known, new).first()["threshold"] == 8.0
    t = openset.tri_state(known, new).first()
    assert (t["known_from"], t["new_below"]) == (8.0, 8.0)
    t = openset.tri_state(known, empty).first()
    assert (t["known_from"], t["new_below"]) == (3.0, 3.0)
    assert openset.youden(known, empty).first()["threshold"] == 8.0  # the median
    m = metrics.open_set(known, empty, 8.0).first()
    assert m["far"] is None and m["tar"] == pytest.approx(2 / 3)


def test_slices(spark):
    cols = "frame_id string, cohort string, individual_id string, date string, session string, split_role string, split_fold string, is_open_new boolean"
    rows = [
        ("a", "TK", "TK-1", "2024-12", None, "gallery", "dev", False), ("b", "TK", "TK-1", "2025-01", None, "probe", "dev", None), ("c", "TK", "TK-2", "2025-01", None, "probe", "dev", True),
        ("d", "TK", "TK-3", "2025-01", None, "gallery", "distractor", False), ("e", "TK", "TK-1", None, "2", "excluded_nodate", "dev", False), ("f", "TK", "TK-9", "2025-01", None, "probe", "test", False),
    ]
    c = gallery.slice_cohort(spark.createDataFrame(rows, cols), "TK")
    ids = lambda df: {r["frame_id"] for r in df.collect()}
    assert (ids(c.refs_all), ids(c.gallery_single), ids(c.known_probe), ids(c.new_probe)) == ({"a", "b", "d", "e"}, {"a", "d"}, {"b"}, {"c"})
    times = {r["frame_id"]: r["tkey"] for r in c.refs_all.collect()}
    assert times == {"a": 20241200, "b": 20250100, "d": -1, "e": None}
    legacy = gallery.slice_cohort(spark.createDataFrame(rows, cols), "TK", legacy_undated=True)
    assert {r["frame_id"]: r["tkey"] for r in legacy.refs_all.collect()}["e"] == 2


def test_geometry_finds_inliers():
    r = np.random.default_rng(0)
    p = r.uniform(0, 500, (60, 2))
    m = np.array([[1.1, -0.2, 30], [0.3, 0.9, -10]])
    q = p @ m[:, :2].T + m[:, 2]
    q[:20] += r.uniform(50, 200, (20, 2))
    for kind in ("affine", "homography"):
        assert 40 <= matching.verify(p, q, kind) <= 42
        assert matching.inlier_mask(p, q, kind)[20:].all()
    assert matching.verify(p, q, "affine") == matching.verify(p, q, "affine")
    angle = np.array([[0.8, -0.6], [0.6, 0.8]])
    turned = p @ angle.T + 5
    assert matching.verify(p, turned, "partial") == 60 and matching.verify(p, turned, "soft") >= 59
    assert np.allclose(matching.affine_from_inliers(p[20:], q[20:], np.ones(40, bool)), m.ravel())
    assert matching.verify(p[:3], q[:3]) == 3 and not matching.inlier_mask(p[:3], q[:3]).any()
    assert matching.affine_from_inliers(p, q, np.zeros(60, bool)) is None


def test_descriptor_matching():
    r = np.random.default_rng(0)
    d, pts = r.normal(size=(30, 16)), r.uniform(size=(30, 2))
    order = r.permutation(30)
    a, b = matching.match(pts, d, pts[order] + 100, d[order] + 0.01 * r.normal(size=(30, 16)))
    assert len(a) == 30 and np.allclose(a + 100, b)
    assert len(matching.match(pts[:1], d[:1], pts, d)[0]) == 0


def test_feature_scorer(spark):
    r = np.random.default_rng(0)
    pts, des = r.uniform(0, 100, (20, 2)), r.normal(size=(20, 8))
    rows = []
    for i, (shift, noise) in enumerate(((0, 0), (7, 0.01), (0, 9))):
        rows.append((i, i // 2, i, ([(float(x), float(y)) for x, y in pts + shift], (des + noise * r.normal(size=des.shape)).tolist())))
    df = spark.createDataFrame(rows, "frame_id long, individual_id long, tkey long, f struct<pts: array<struct<x: double, y: double>>, des: array<array<double>>>")
    found = {(x["probe_id"], x["ref_id"]): x["score"] for x in pooled(df, df, payload="f", score=pairwise(matching.build("sift"))).collect()}
    assert found[1, 0] == 20.0 and found[2, 0] < 6
    with pytest.raises(ValueError):
        matching.build("none")


def test_catalog(spark):
    rows, df = vectors(spark)
    df = df.withColumns({"individual_id": F.concat(F.lit("i"), "individual_id"), "date": F.col("tkey").cast("string"), "session": F.lit(None).cast("string")})
    asks = catalog.with_own_session(df.select(F.col("frame_id").alias("query_id"), "frame_id", "emb"), df)
    found = catalog.identify(asks, df, 2, 0.0, 1.0, exclude_own_session=True)
    own = {i: (w, t) for i, w, t, _ in rows}
    for r in found.collect():
        assert own[r["frame_id"]] != own[r["query_id"]] and r["n_photos"] == 8
    alone = spark.createDataFrame([(99,)], "query_id long")
    v = catalog.verdicts(alone, catalog.scores(asks, df, True)).first()
    assert v["verdict"] == "new" and v["confidence"] == 0.0
    grown = catalog.register(df.select("individual_id", "frame_id"), spark.createDataFrame([("", 100), ("i1", 101)], "name string, frame_id long"))
    assert {r["individual_id"] for r in grown.filter("frame_id > 99").collect()} == {"NEW-1", "i1 (2)"}
    own = spark.createDataFrame([("Otto", "a"), ("Otto (2)", "b"), ("NEW-3", "c"), ("x", "REG-001")], "individual_id string, frame_id string")
    new = spark.createDataFrame([("Otto", "p"), ("Otto (3)", "q"), ("", "r"), ("Otto", "s"), ("Otto (2)", "t")], "name string, frame_id string")
    grown = {r["frame_id"]: r["individual_id"] for r in catalog.register(own, new).collect()}
    assert grown == {"a": "Otto", "b": "Otto (2)", "c": "NEW-3", "REG-001": "x", "p": "Otto (3)", "q": "Otto (3) (2)", "r": "NEW-4", "s": "Otto (4)", "t": "Otto (2) (2)"}


def test_sessions_of_undated_frames(spark):
    rows = [("a", "i", "2025-01", "1"), ("b", "i", "2025-01", "2"), ("c", "i", None, "1"), ("d", "i", None, "1"), ("e", "j", "2025-01", None), ("f", "i", "", None)]
    c = spark.createDataFrame(rows, "frame_id string, individual_id string, date string, session string")
    asked = spark.createDataFrame([(x, x) for x in "abcdefz"] + [("none", None)], "query_id string, frame_id string")
    found = {}
    for r in catalog.session_of(c, asked).collect():
        found.setdefault(r["query_id"], set()).add(r["frame_id"])
    assert found == {"a": {"a", "b"}, "b": {"a", "b"}, "c": {"c"}, "d": {"d"}, "e": {"e"}, "f": {"f"}, "z": {"z"}}
    assert {r["query_id"]: r["date"] for r in catalog.date_of(c, asked).collect()}["f"] is None


def test_grid_prepares_shared_settings_once(spark):
    made = []
    prepare = lambda a: made.append(a) or spark.range(10 * a)
    runs = experiment.run_grid(spark, prepare, lambda df, a, b: df.filter(F.col("id") >= b).agg(F.count("*").alias("n")), {"a": [1, 2], "b": [0, 5, 9]}, ["a"])
    assert [(r["config_no"], r["a"], r["b"], r["n"]) for r in runs.orderBy("config_no").collect()] == [(0, 1, 0, 10), (1, 1, 5, 5), (2, 1, 9, 1), (3, 2, 0, 20), (4, 2, 5, 15), (5, 2, 9, 11)]
    assert made == [1, 2]


def test_calibration_and_experiments(spark):
    rows, df = vectors(spark)
    fitted = calibration.fit(pooled(df, df, strictly_earlier=False).withColumn("score", F.col("score") * 100)).first()
    assert fitted["hi"] > fitted["lo"] and fitted["n_genuine"] == 40
    dated = df.withColumns({"date": F.col("tkey").cast("string"), "session": F.lit(None).cast("string")})
    times = {i: (w, t) for i, w, t, _ in rows}
    expected = {(a, b) for a in times for b in times if times[a][0] == times[b][0] and times[a][1] < times[b][1]}
    assert {tuple(r) for r in calibration.genuine_pairs(dated).collect()} == expected
    assert {tuple(r) for r in calibration.genuine_pairs(dated, 5).collect()} < expected and calibration.genuine_pairs(dated, 5).count() == 5
    impostor = {tuple(r) for r in calibration.impostor_pairs(dated, 6).collect()}
    assert len(impostor) == 6 and all(times[a][0] != times[b][0] for a, b in impostor)
    paired = calibration.fit_on_pairs(dated, lambda a, b: float(np.dot(a, b)), "emb", 20).first()
    assert paired["hi"] > paired["lo"] and paired["n_genuine"] == paired["n_impostor"] == 20
    assert calibration.fit_on_latest(dated, scale=100).first()["n_impostor"] == 5
    probes = df.filter("tkey > 0")
    hits = ranking.hits(pooled(probes, df), probes)
    c = experiment.compare(experiment.all_methods({"a": hits, "b": hits.withColumn("hit_1", F.lit(True))}), "a")
    rows = {r["method"]: r for r in experiment.adopt(c, "a").collect()}
    assert rows["b"]["adopted"] and not rows["a"]["adopted"] and rows["a"]["p"] == 1.0
    assert experiment.decide(c, "b", "a", 0.1, 1.0) == "better" and experiment.decide(c, "b", "a", 2.0, 1.0) == "too_slow"
    assert experiment.grid(spark, x=[1, 2, 3], y=["a", "b"]).count() == 6


def test_quantiles_by_group(spark):
    """Equal to NumPy's for groups of any size, one of all rows, ties, nulls, and a group without values."""
    noise = np.random.default_rng(0)
    rows = [("one", float(v)) for v in noise.integers(0, 50, 3000)] + [("two", float(v)) for v in noise.normal(size=7)] + [("three", 1.5), ("none", None), ("none", None), (None, 2.0), (None, 4.0)]
    rows += [(f"g{i % 300}", float(i)) for i in range(1000)] + [("one", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(9)
    shares = {"least": 0.0, "q1": 0.25, "median": 0.5, "p90": 0.9, "most": 1.0}
    found = {r["k"]: r for r in openset.grouped_quantiles(df, "k", "v", shares).collect()}
    for k in {r[0] for r in rows}:
        own = [v for g, v in rows if g == k and v is not None]
        assert found[k]["n"] == len(own)
        for name, share in shares.items():
            assert found[k][name] == (pytest.approx(np.quantile(own, share)) if own else None)
    assert len(found) == 305 and openset.grouped_quantiles(df.limit(0), "k", "v", shares).count() == 0
    alone = openset.grouped_quantiles(df.withColumn("k", F.lit(1)), "k", "v", {"median": 0.5}).first()
    assert alone["median"] == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_features_are_not_broadcast(spark, small, monkeypatch):
    """Spark takes them for small before it runs; as broadcasts they would all pass through the driver."""
    from resight.plans import photo_queries

    monkeypatch.setattr(photo_queries, "written", lambda df, label: df)
    f = photo_queries._described(spark, small)
    pairs = spark.createDataFrame([(1, 2)], "probe_id long, ref_id long")
    for made in (f, photo_queries.keypoint_pose(spark, small), vocabulary.scored(pairs, f, f, matching.feature_block("partial"))):
        assert "BroadcastExchange" not in made._jdf.queryExecution().executedPlan().toString()
