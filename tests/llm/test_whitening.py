"""Whitening against NumPy over the whole table, and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from resight.llm import whitening
from resight.llm.common import table


def by_numpy(vectors):
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    apart = (n * x - sums).astype(np.float64) / n
    values, turn = np.linalg.eigh(apart.T @ apart / n)
    values, turn = values[::-1], turn[:, ::-1]
    k = min(32, x.shape[1])
    return ((n * x - sums) ** 2).sum(1), apart @ turn[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_query(spark, small):
    rows = table(spark, small, "embeddings").orderBy("vec_id").collect()
    deviation, z, shares = by_numpy([r["embedding"] for r in rows])
    got = whitening.op13_whitening(spark, small).orderBy("vec_id", "component").toPandas()
    assert len(got) == z.size and set(got["n"]) == {len(rows)} and got["identity_error"].nunique() == 1
    assert got["identity_error"].iloc[0] < 1e-9
    mine = got["whitened"].to_numpy().reshape(z.shape)
    signs = np.sign((mine * z).sum(0))
    assert np.abs(mine * signs - z).max() < 1e-8
    assert np.abs(mine.T @ mine / len(mine) - np.eye(32)).max() < 1e-9
    assert got["deviation"].to_numpy().reshape(z.shape)[:, 0].tolist() == deviation.tolist()
    assert np.allclose(got["explained"].to_numpy().reshape(z.shape)[0], shares, rtol=1e-12)


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    good = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(0, 3, (40, 5)))]
    odd = [(100, None), (101, []), (102, [1.0, nan, 0.0, 0.0, 0.0]), (103, [inf, 0.0, 0.0, 0.0, 0.0]), (104, [1.0, None, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0, 0.0, 0.0])]
    keep = [*good, good[0], (None, [0.5] * 5)]
    df = spark.createDataFrame(keep + odd, "vec_id long, embedding array<double>")
    deviation, z, _ = by_numpy([v for _, v in keep])
    for made in (df, df.withColumns({"x": F.lit("x"), "w": F.lit(1), "n": F.lit(2), "component": F.lit(3)})):
        got = whitening.whitened(made).toPandas()
        assert len(got) == len(keep) * 5 and set(got["n"]) == {len(keep)}
        assert sorted(got[got["component"] == 1]["deviation"]) == sorted(deviation.tolist())
        assert np.allclose(np.sort(got[got["component"] == 1]["whitened"].abs()), np.sort(np.abs(z[:, 0])))
        assert got["identity_error"].iloc[0] < 1e-9
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(df.filter("vec_id = 100")).columns == whitening.whitened(df).columns


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0]] * 5, [[float(i), 2.0 * i] for i in range(30)]])
def test_without_variance(spark, vectors):
    """Components without variance have no whitened value, and the others are whole."""
    got = whitening.whitened(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).toPandas()
    assert len(got) == 2 * len(vectors) and got[got["component"] == 2]["whitened"].isna().all()
    varied = len({tuple(v) for v in vectors}) > 1
    assert got[got["component"] == 1]["whitened"].notna().all() == varied and got["identity_error"].isna().all() != varied


def test_far_from_nought(spark):
    """Small spreads around large means, and sums about 2^53, keep their precision."""
    rng = np.random.default_rng(1)
    rows = [(i, [1e9 + float(a), -2e9 + float(a + b), float(c) * 1e5]) for i, (a, b, c) in enumerate(rng.normal(0, 1, (200, 3)))]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert got["identity_error"].iloc[0] < 1e-4 and got["whitened"].notna().all()
