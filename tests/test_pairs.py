"""Samples of pairs against lists of all pairs."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from resight.operators import pairs

SCHEMA = "frame_id string, individual_id string, date string"


def frames(spark, sizes, dates=4):
    rows = [(f"f{w}-{k:04d}", f"i{w}", f"2024-0{1 + k % dates}") for w, n in enumerate(sizes) for k in range(n)]
    rows += [("u0", "i0", None), ("u1", None, "2024-01")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def genuine(rows):
    return {(a[0], b[0]) if a[2] < b[2] else (b[0], a[0]) for a, b in combinations(rows, 2) if a[1] is not None and a[1] == b[1] and a[2] and b[2] and a[2] != b[2]}


def impostors(rows):
    return {frozenset((a[0], b[0])) for a, b in combinations(rows, 2) if a[1] is not None and b[1] is not None and a[1] != b[1]}


@pytest.mark.parametrize("sizes", [[7, 3, 1], [40, 1, 1], [1, 1, 1], [5] * 6])
def test_all_or_as_many_as_are_asked_for(spark, sizes):
    rows, df = frames(spark, sizes)
    for every, made, key in ((genuine(rows), pairs.genuine, tuple), (impostors(rows), pairs.impostors, frozenset)):
        for n in (1, 4, max(1, len(every) - 1), len(every), len(every) + 5, 10_000):
            found = [key(r) for r in made(df, n).collect()]
            assert len(found) == len(set(found)) == min(n, len(every)) and set(found) <= every


def test_the_same_however_rows_are_dealt(spark):
    _, df = frames(spark, [30, 20, 5])
    for made in (pairs.genuine, pairs.impostors):
        one, two, other = ({tuple(r) for r in made(x, 20, seed).collect()} for x, seed in ((df, 1), (df.repartition(2), 1), (df, 2)))
        assert one == two != other


def test_genuine_pairs_are_alike_in_chance(spark):
    rows, df = frames(spark, [6, 3])
    every = genuine(rows)
    met = Counter(tuple(r) for seed in range(60) for r in pairs.genuine(df, 6, seed).collect())
    mean = 60 * 6 / len(every)
    assert set(met) <= every and sum((met[p] - mean) ** 2 / mean for p in every) < 3 * len(every)


def test_impostors_are_of_individuals_alike(spark):
    """One individual has 99 % of the frames, and no larger part in the sample than the others."""
    rows, df = frames(spark, [4950, *[1] * 25, *[5] * 5])
    found = pairs.impostors(df, 400)
    who = {r[0]: r[1] for r in rows}
    part = Counter(who[x] for r in found.collect() for x in r)
    assert found.count() == 400 and all(who[r["a"]] != who[r["b"]] for r in found.collect())
    assert part["i0"] < 4 * 800 / 31  # its pairs repeat least, so a little more than the others


def test_odd(spark):
    _, df = frames(spark, [3])
    assert pairs.impostors(df, 5).count() == 0 and pairs.genuine(df.limit(0), 5).count() == 0 and pairs.impostors(df.limit(0), 5).count() == 0
    assert pairs.genuine(df.withColumn("date", F.lit("2024-01")), 5).count() == 0


def test_running_sums(spark):
    rows = [(i, int(v)) for i, v in enumerate(np.random.default_rng(0).integers(0, 9, 500))]
    found = {r["k"]: r["before"] for r in pairs.running(spark.createDataFrame(rows, "k long, v long").repartition(7), "k", "v", "before").collect()}
    total = 0
    for k, v in rows:
        assert found[k] == total
        total += v
