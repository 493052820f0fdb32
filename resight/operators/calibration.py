"""Confidence calibration: the score range between impostors and genuine matches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resight.functions import scalars as S
from resight.operators import pairs
from resight.operators.catalog import session_name
from resight.operators.openset import quantiles
from resight.operators.ranking import top_k
from resight.operators.scoring import pooled
from resight.scratch import written


def fit(scores: DataFrame, low: float = 0.9, high: float = 0.8) -> DataFrame:
    """From pooled scores (probe_id, truth, individual_id, score): lo, hi, n_genuine, n_impostor.

    lo is a high percentile of each probe's best wrong individual, hi one of its own; hi is above lo.
    """
    best = scores.groupBy("probe_id", "truth").agg(F.max(F.when(F.col("individual_id") == F.col("truth"), F.col("score"))).alias("genuine"), F.max(F.when(F.col("individual_id") != F.col("truth"), F.col("score"))).alias("impostor"))
    best = written(best, "best")
    ends = quantiles(best, {"lo": ("impostor", low), "hi": ("genuine", high)})
    out = ends.crossJoin(best.agg(F.count("genuine").alias("n_genuine"), F.count("impostor").alias("n_impostor")))  # of one row each
    return out.select(F.round("lo").alias("lo"), F.greatest(F.round("hi"), F.round("lo") + 1).alias("hi"), "n_genuine", "n_impostor")


def fit_on_latest(frames: DataFrame, k: int = 5, scale: float = 1.0, **scoring: object) -> DataFrame:
    """Of each individual with two dates the first frame of the latest, against all frames of other sessions; its best k
    individuals count. Scores are multiplied by scale, as lo and hi are whole numbers."""
    days = frames.filter(S.missing("date").isNotNull()).groupBy("individual_id").agg(F.max("date").alias("date"), F.min("date").alias("_first")).filter("date <> _first")
    asked = frames.join(days.select("individual_id", "date"), ["individual_id", "date"], "left_semi").groupBy("individual_id").agg(F.min("frame_id").alias("frame_id"))
    named = frames.withColumns({"_session": session_name(), "tkey": F.lit(None).cast("long")})
    scores = pooled(named.join(asked, ["individual_id", "frame_id"], "left_semi"), named, strictly_earlier=False, apart="_session", **scoring)
    return fit(top_k(scores, k).withColumn("score", F.round(F.col("score") * scale, 6)))


def genuine_pairs(frames: DataFrame, most: int | None = None, seed: int = 42) -> DataFrame:
    """a, b: pairs of frames of one individual on different dates, the earlier first; `most` of them at random, if given."""
    if most is not None:
        return pairs.genuine(frames, most, seed)
    dated = frames.filter(S.missing("date").isNotNull())
    left, right = (dated.select("individual_id", F.col("date").alias(f"{x}_date"), F.col("frame_id").alias(x)) for x in ("a", "b"))
    return left.join(right, "individual_id").filter("a_date < b_date").select("a", "b")


def impostor_pairs(frames: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """a, b: n pairs of frames of different individuals (pairs.impostors)."""
    return pairs.impostors(frames, n, seed)


def fit_on_pairs(frames: DataFrame, score: Callable[[object, object], float], payload: str, n: int = 500, seed: int = 42, low: float = 0.9, high: float = 0.75) -> DataFrame:
    """lo, hi, n_genuine, n_impostor from the scores of sampled pairs, where there are no pooled scores; hi is above lo."""

    @F.arrow_udf("double")
    def rate(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([float(score(x, y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    sides = lambda drawn: drawn.join(frames.select(F.col("frame_id").alias("a"), F.col(payload).alias("pa")), "a").join(frames.select(F.col("frame_id").alias("b"), F.col(payload).alias("pb")), "b")
    both = sides(genuine_pairs(frames, n, seed)).select(rate("pa", "pb").alias("genuine"), F.lit(None).cast("double").alias("impostor"))
    both = written(both.unionByName(sides(impostor_pairs(frames, n, seed)).select(F.lit(None).cast("double").alias("genuine"), rate("pa", "pb").alias("impostor"))), "pairs")
    ends = quantiles(both, {"lo": ("impostor", low), "hi": ("genuine", high)})
    out = ends.crossJoin(both.agg(F.count("genuine").alias("n_genuine"), F.count("impostor").alias("n_impostor")))
    lo, hi = F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(1.0))
    return out.select(lo.alias("lo"), F.when(hi > lo, hi).otherwise(lo + 1).alias("hi"), "n_genuine", "n_impostor")
