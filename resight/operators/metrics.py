"""Recall and verification metrics over hits (a row for each probe) and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resight.functions.stats import wilson
from resight.operators.ranking import KS


def _share(c: Column | str) -> Column:
    return F.avg((F.col(c) if isinstance(c, str) else c).cast("double"))


def micro_recall(hits: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Each probe weighs one."""
    return hits.agg(F.count("*").alias("n_probe"), *[_share(f"hit_{k}").alias(f"micro_{k}") for k in ks])


def macro_recall(hits: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Each individual weighs one."""
    own = hits.groupBy("truth").agg(*[_share(f"hit_{k}").alias(f"hit_{k}") for k in ks])
    return own.agg(F.count("*").alias("n_identity"), *[F.avg(f"hit_{k}").alias(f"macro_{k}") for k in ks])


def report(hits: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row: micro and macro recall, false rejection rate, sizes, and the Wilson interval of recall at the first k.

    Hits are combined by individual first; the rest is sums over individuals, so there is one shuffle of hits.
    """
    own = hits.groupBy("truth").agg(F.count("*").alias("n"), *[F.sum(F.col(f"hit_{k}").cast("long")).alias(f"s_{k}") for k in ks])
    out = own.agg(F.sum("n").alias("n_probe"), F.count("*").alias("n_identity"), *[F.sum(f"s_{k}").alias(f"s_{k}") for k in ks], *[F.avg(F.col(f"s_{k}") / F.col("n")).alias(f"macro_{k}") for k in ks])
    micro = [(F.col(f"s_{k}") / F.col("n_probe")).alias(f"micro_{k}") for k in ks]
    return out.select("n_probe", "n_identity", *micro, *[f"macro_{k}" for k in ks], *[(1 - F.col(f"s_{k}") / F.col("n_probe")).alias(f"frr_{k}") for k in ks], wilson(F.col(f"s_{ks[0]}"), F.col("n_probe")).alias(f"wilson_{ks[0]}"))


def recall_by(hits: DataFrame, by: str, k: int = 1) -> DataFrame:
    """by, n, recall for each value that isn't null or NaN."""
    return hits.filter(F.col(by).isNotNull() & ~F.isnan(F.col(by).cast("double"))).groupBy(by).agg(F.count("*").alias("n"), _share(f"hit_{k}").alias("recall"))


def adjacent_recall(hits: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """By session_no, and of all together (session_no null), in one pass."""
    return hits.groupingSets([["session_no"], []], "session_no").agg(F.count("*").alias("n"), *[_share(f"hit_{k}").alias(f"recall_{k}") for k in ks])


def random_baseline(refs: DataFrame) -> DataFrame:
    return refs.agg((1 / F.count_distinct("individual_id")).alias("random_top1"))


def open_set(known: DataFrame, new: DataFrame, threshold: float | Column, score: str = "score") -> DataFrame:
    """One row: tar, far, frr, baks, baus, g at a threshold; null where a side is empty."""
    both = known.select(F.col(score).alias("s"), F.lit(True).alias("known")).unionByName(new.select(F.col(score).alias("s"), F.lit(False).alias("known")))
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    accepted = (F.col("s") >= t).cast("double")
    out = both.agg(F.avg(F.when(F.col("known"), accepted)).alias("tar"), F.avg(F.when(~F.col("known"), accepted)).alias("far"), F.count_if("known").alias("n_known"), F.count_if(~F.col("known")).alias("n_new"))
    return out.select("n_known", "n_new", "tar", "far", (1 - F.col("tar")).alias("frr"), F.col("tar").alias("baks"), (1 - F.col("far")).alias("baus"), F.sqrt(F.greatest("tar", F.lit(0.0)) * F.greatest(1 - F.col("far"), F.lit(0.0))).alias("g"))
