"""Ranks of individuals by pooled score. One rule for ties everywhere: higher score, then smaller individual_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 5, 10)


def _order(probe: str) -> Window:
    return Window.partitionBy(probe).orderBy(F.desc("score"), "individual_id")


def ranked(scores: DataFrame, probe: str = "probe_id") -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(_order(probe)))


def top_k(scores: DataFrame, k: int, probe: str = "probe_id") -> DataFrame:
    return ranked(scores, probe).filter(F.col("rank") <= k)


def hits(scores: DataFrame, probes: DataFrame, ks: tuple[int, ...] = KS, probe: str = "frame_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """probe_id, truth, true_rank (null: not found), hit_k..., and `keep`: a row for each probe, also without references.

    The true rank is one plus the number of individuals before the true one, an aggregate: no sort of all individuals.
    """
    own = scores.filter("individual_id = truth").select("probe_id", F.col("score").alias("_own"))
    before = (F.col("score") > F.col("_own")) | ((F.col("score") == F.col("_own")) & (F.col("individual_id") < F.col("truth")))
    rank = scores.join(own, "probe_id").groupBy("probe_id").agg((F.count_if(before) + 1).alias("true_rank"))
    rows = probes.select(F.col(probe).alias("probe_id"), F.col("individual_id").alias("truth"), *keep).join(rank, "probe_id", "left")
    return rows.select("*", *[F.coalesce(F.col("true_rank") <= k, F.lit(False)).alias(f"hit_{k}") for k in ks])


def margins(scores: DataFrame, probe: str = "probe_id") -> DataFrame:
    """probe_id, top1, top2 (null if there is one individual only), best: two aggregates' worth of rows a probe."""
    two = top_k(scores, 2, probe)
    return two.groupBy(probe).agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("top2"), F.max(F.when(F.col("rank") == 1, F.col("individual_id"))).alias("best"))


def latest_per_individual(frames: DataFrame, date: str = "date", frame: str = "frame_id") -> DataFrame:
    """The frame of the latest date (then smallest id) of each individual, by an aggregate."""
    latest = frames.groupBy("individual_id").agg(F.max(date).alias(date))
    return frames.join(latest, ["individual_id", date], "left_semi").groupBy("individual_id", date).agg(F.min(frame).alias(frame))


def diverse_best(pairs: DataFrame, one_month: int = 4, two_months: int = 3, most: int = 8) -> DataFrame:
    """Examples to look at: the best pair of each individual; of these the top by interval, and the middle one of all.

    pairs: individual_id, probe_id, ref_id, interval_months, score.
    """
    best = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("individual_id").orderBy(F.desc("score"), "probe_id", "ref_id"))).filter("_n = 1").drop("_n")
    order = [F.desc("score"), F.col("individual_id")]
    n = best.count()
    middle = best.orderBy(*order).limit(n // 2 + 1).orderBy("score", F.desc("individual_id")).limit(1)
    chosen = best.filter("interval_months = 1").orderBy(*order).limit(one_month).unionByName(best.filter("interval_months = 2").orderBy(*order).limit(two_months)).unionByName(middle)
    return chosen.dropDuplicates(["individual_id"]).orderBy(*order).limit(most)


def first_occurrences(values: Column | str, among: Column | str) -> Column:
    """The first occurrence of each value of an array, in order, of those that are among another's."""
    return F.array_intersect(F.array_distinct(values), among)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a hash of their key and the seed, then by the key: however rows are dealt, they are the same."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
