"""Pruned retrieval against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from resight.operators import pruned, ranking
from resight.operators.scoring import pooled

SCHEMA = "frame_id long, individual_id long, tkey long, own string, emb array<double>"


def clustered(spark, noise, n, dims=6, groups=25, spread=0.05):
    """Vectors about a few directions, of an individual each in three, with repeats, nulls in time and vectors of nought."""
    base = noise.normal(size=(groups, dims))
    rows = []
    for i in range(n):
        g = int(noise.integers(0, groups))
        x = base[g] + spread * noise.normal(size=dims)
        if i % 50 == 0:
            x = base[g]
        if i % 97 == 0:
            x = np.zeros(dims)
        rows.append((i, 3 * g + i % 3, None if i % 41 == 0 else int(noise.integers(0, 5)), f"s{i % 7}", [float(v) for v in x]))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("options", [{}, {"strictly_earlier": False}, {"apart": "own"}, {"strictly_earlier": False, "itself": False}])
def test_same_rows_as_all_pairs(spark, options):
    v = clustered(spark, np.random.default_rng(0), 700)
    probes = v.filter("frame_id % 3 > 0")
    want = {tuple(r) for r in ranking.top_k(pooled(probes, v, **options), 4).select("probe_id", "truth", "individual_id", "score", "ref_id", "rank").collect()}
    found, stats = pruned.nearest(probes, v, 4, tile=16, each=16, **options)
    assert {tuple(r) for r in found.select("probe_id", "truth", "individual_id", "score", "ref_id", "rank").collect()} == want
    assert stats["scored"] <= stats["tile_pairs"]


def test_most_pairs_of_tiles_are_skipped(spark):
    v = clustered(spark, np.random.default_rng(1), 3000, spread=0.02).filter("frame_id % 97 > 0")
    found, stats = pruned.nearest(v, v, 2, strictly_earlier=False, tile=32, each=32)
    assert stats["scored"] < 0.25 * stats["tile_pairs"]
    assert found.count() == 2 * v.count()


def test_odd(spark):
    v = clustered(spark, np.random.default_rng(2), 30)
    empty = v.limit(0)
    for probes, refs in ((empty, v), (v, empty), (empty, empty)):
        assert pruned.nearest(probes, refs, 3)[0].count() == 0
    few = pruned.nearest(v, v.filter("individual_id < 6"), 50, strictly_earlier=False)[0]  # fewer individuals than asked for
    assert few.count() == pooled(v, v.filter("individual_id < 6"), strictly_earlier=False).count()
    same = v.withColumn("emb", F.array(*[F.lit(1.0)] * 6))
    want = {tuple(r) for r in ranking.top_k(pooled(same, same, strictly_earlier=False), 3).select("probe_id", "individual_id", "ref_id").collect()}
    assert {tuple(r) for r in pruned.nearest(same, same, 3, strictly_earlier=False, tile=4, each=4)[0].select("probe_id", "individual_id", "ref_id").collect()} == want


def test_rows_are_sent_by_block_where_nothing_can_be_skipped(spark):
    noise = np.random.default_rng(3)
    rows = [(i, i % 7, i % 4, None, [float(x) for x in noise.normal(size=8)]) for i in range(1200)]
    v = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    found, stats = pruned.nearest(v, v, 5, strictly_earlier=False, tile=4, each=400)
    assert stats["scored"] > 0.5 * stats["tile_pairs"] > 40_000
    # a block for each task that sorted a range at least, as there are fewer rows than pruned.ROWS; three rounds
    assert stats["sent"] <= 3 * 4 * 4
    want = ranking.top_k(pooled(v, v, strictly_earlier=False), 5).select("probe_id", "individual_id", "score", "ref_id", "rank")
    assert {tuple(r) for r in found.select(*want.columns).collect()} == {tuple(r) for r in want.collect()}


def test_curve_keeps_near_places_together():
    at = np.stack(np.meshgrid(*[np.arange(8)] * pruned.AXES), -1).reshape(-1, pruned.AXES)
    cells = at[np.argsort(pruned._curve(at))].reshape(-1, 8, pruned.AXES)
    assert (cells.max(1) - cells.min(1) == 1).all()


def test_neighbours_are_scored_at_once_with_all_that_any_meets():
    codes = np.sort(np.array([p * 8 + r for p, r in ((0, 1), (0, 2), (1, 2), (1, 3), (6, 0))], np.int32))
    assert list(pruned._together(codes, 8, 16)) == [([0, 1, 6], [0, 1, 2, 3])]
    assert list(pruned._together(codes, 8, 4096)) == [([0], [1, 2]), ([1], [2, 3]), ([6], [0])]


def test_only_named_tiles_are_sent(spark):
    rows = [(7, [1 * 4 + 0, 1 * 4 + 3, 2 * 4 + 1], [(t, [float(t)]) for t in (8, 9, 10, 11)])]
    both = spark.createDataFrame(rows, "r_block long, codes array<int>, p array<struct<tile: long, payload: array<double>>>")
    assert [(r["r_block"], r["codes"], [t["tile"] for t in r["p"]]) for r in pruned._trimmed(both, 4).collect()] == [(7, [4, 7, 9], [9, 10])]


def test_scores_below_a_probes_least_go():
    import pyarrow as pa

    from resight.operators.scoring import _meet, cosine_block

    def side(ids, who, x):
        return [pa.array(ids), pa.array(who), pa.array([None] * len(ids), pa.int64()), pa.array(x, pa.list_(pa.float64())), pa.array([None] * len(ids), pa.string())]

    p, r = side([1, 2], [0, 0], [[1.0, 0.0], [1.0, 0.0]]), side([3, 4, 5], [0, 1, 2], [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]])
    made = [b for b in _meet(p, r, cosine_block, False, False, True, 6, 3, np.array([0.6, -np.inf]))]
    assert [(a, b) for x in made for a, b in zip(x[0].to_pylist(), x[4].to_pylist(), strict=True)] == [(1, 3), (1, 4), (2, 3), (2, 4), (2, 5)]
