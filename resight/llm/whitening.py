"""Embedding whitening: the covariance's upper triangle as column aggregates, decomposed by LAPACK.

One aggregation gives the sums of all dimensions. A second one has a generated expression for each pair of dimensions
i <= j, the sum of the products of their entries, each less a pivot: the whole number nearest to its mean. So products
stay small, and their sums as doubles are exact up to 2^53; what a pivot leaves of a mean, half a unit at most, is taken
off on the driver. Tasks hold a number for each pair and shuffle that; the driver gets one row. The symmetric matrix is
decomposed there, the size of the vectors being its only bound, and every row is projected in the tasks that read it.
A third aggregation measures the covariance of what came out.

Defined results: rows without a vector, and with an entry that is null, not finite or beyond 2^53 once it is a whole
number, are dropped, as are vectors that don't have the most frequent length (ties: the longer); repeated rows and ids
count as often as they stand there, and a null id is an id; a component whose variance is nil but for rounding has
null as `whitened` and no part in identity_error, which is null if no component is left; a deviation beyond a long is
null; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm.common import discard, materialize, table

#: What an entry is multiplied by and what is added after rounding down.
SCALE, SHIFT = 64, 1_000_000
#: Components of a row at most.
COMPONENTS = 32
#: Whole numbers beyond this aren't exact as doubles.
EXACT = 1 << 53
#: Rows that a task projects at once.
ROWS = 4096


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x (array of longs) of the rows whose vectors count."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    fits = F.forall(F.col(vector), lambda c: F.coalesce(F.abs(c.cast("double")) < (EXACT - SHIFT - 1) / SCALE, F.lit(False)))  # NaN is above all
    right = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(fits)
    lengths = right.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    right = right if lengths is None else right.filter(F.size(vector) == lengths["d"])
    return right.select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def triangle(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """One row: n, and p_i_j, the sum of the products of columns i <= j, for every pair, in one aggregation."""
    # columns that can't be null halve what the generated code does for a pair
    named = rows.select(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = combinations_with_replacement(range(len(columns)), 2)
    return named.agg(F.count("*").alias("n"), *[F.expr(f"sum(c{i} * c{j}) as p_{i}_{j}") for i, j in pairs])


def symmetric(row: object, d: int) -> list[list]:
    """The matrix of triangle()'s row."""
    at = iter(row[1:])
    out = [[0] * d for _ in range(d)]
    for i, j in combinations_with_replacement(range(d), 2):
        out[i][j] = out[j][i] = next(at)
    return out


class Fit:
    """The fit list's n, sums by dimension, eigenvalues (falling), unit eigenvectors as columns, and total variance."""

    def __init__(self, whole: DataFrame, d: int):
        cell = lambda i: F.col("x")[i]
        ends = whole.agg(F.count("*"), *[F.sum(cell(i).cast("decimal(38,0)")) for i in range(d)]).first()
        self.n, self.sums = ends[0], [int(s) for s in ends[1:]]
        pivots = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        left = np.array([(s - self.n * p) / self.n for s, p in zip(self.sums, pivots, strict=True)])
        sums = symmetric(triangle(whole, [cell(i) - p for i, p in enumerate(pivots)]).first(), d)
        cov = np.array(sums, np.float64) / self.n - np.outer(left, left)
        values, vectors = np.linalg.eigh(cov)
        self.values, self.vectors, self.trace = values[::-1].copy(), vectors[:, ::-1].copy(), float(np.trace(cov))

    def kept(self) -> np.ndarray:
        """Which of the first components have variance, beyond rounding."""
        values = self.values[:COMPONENTS]
        return values > len(self.values) * np.finfo(np.float64).eps * max(float(values[0]), 0.0)


def projected(whole: DataFrame, fit: Fit) -> DataFrame:
    """vec_id, deviation and w, the whitened components (null without variance), a row for each row of whole."""
    n, sums, kept = fit.n, np.array(fit.sums, dtype=object), fit.kept()
    small = max(abs(s) for s in fit.sums) < 1 << 62
    turn = fit.vectors[:, :COMPONENTS] / np.sqrt(np.where(kept, fit.values[:COMPONENTS], 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                if small and n * int(np.abs(x).max()) < 1 << 62:
                    apart = n * x - sums.astype(np.int64)
                else:
                    apart = n * x.astype(object) - sums
                peak = int(np.abs(apart).max())
                wide = apart if peak * peak * x.shape[1] < 1 << 63 else apart.astype(object)
                deviation = [v if v < 1 << 63 else None for v in (wide * wide).sum(1).tolist()]
                z = (apart.astype(np.float64) / n) @ turn
                z[:, ~kept] = np.nan
                flat = pa.array(z.reshape(-1), from_pandas=True)  # NaN becomes null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "w"])

    kind = whole.schema["vec_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")


def identity_error(rows: DataFrame, kept: list[int]) -> float | None:
    """The largest absolute entry of the covariance of the whitened components less the identity."""
    if not kept:
        return None
    k = len(kept)
    means = rows.agg(*[F.avg(F.col("w")[i]) for i in kept]).first()
    row = triangle(rows, [F.col("w")[i] - m for i, m in zip(kept, means, strict=True)]).first()
    return float(np.abs(np.array(symmetric(row, k)) / row["n"] - np.eye(k)).max())


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row of vectors that
    counts and each component up to COMPONENTS."""
    whole = materialize(whole_vectors(vectors, vec_id, vector), "vectors")
    some = whole.select(F.size("x").alias("d")).first()
    if some is None:
        kind = vectors.schema[vec_id].dataType.simpleString()
        discard(whole)
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    fit = Fit(whole, some["d"])
    rows = materialize(projected(whole, fit), "whitened")
    discard(whole)
    error = identity_error(rows, np.flatnonzero(fit.kept()).tolist())
    shares = [max(0.0, float(v)) / fit.trace if fit.trace > 0 else 0.0 for v in fit.values[:COMPONENTS]]
    parts = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("at") + 1)
    return parts.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
