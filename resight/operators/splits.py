"""Leak-free temporal splits: roles by session, folds and open-set individuals by a hash of the individual."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resight.functions import scalars as S
from resight.schema import SPLITS

SEED, TEST_SHARE, OPEN_SHARE = 42, 0.5, 0.15


def temporal_roles(frames: DataFrame) -> DataFrame:
    """The individual's earliest session is its gallery, later ones are probes with the interval since; frames
    without valid time are excluded. Adds tkey, split_role, interval_months.

    The earliest session is an aggregate that is joined back, so frames of one individual need not meet.
    """
    keyed = frames.withColumn("tkey", S.time_key("cohort", "date", "session"))
    first = keyed.groupBy("individual_id").agg(F.min("tkey").alias("_first"))
    keyed = keyed.join(first, "individual_id", "left")
    role = F.when(F.col("tkey").isNull(), "excluded_nodate").when(F.col("tkey") == F.col("_first"), "gallery").otherwise("probe")
    months = F.when(F.col("split_role") == "probe", S.interval("_first", "tkey")).otherwise(F.lit(0.0))
    return keyed.withColumn("split_role", role).withColumn("interval_months", months).drop("_first")


def eval_folds(frames: DataFrame, test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """split_fold: whole individuals, by cohort, recapture and hash."""
    hashed = S.fraction(F.concat(F.lit("fold:"), "individual_id"), seed)
    fold = (
        F.when(F.col("cohort").isin("PW", "LAB"), "aux")
        .when((F.col("cohort") == "TK") & ~F.coalesce("has_recapture", F.lit(False)), "distractor")
        .when(F.col("cohort") == "TK", F.when(F.col("_hash") < test_share, "test").otherwise("dev"))
        .otherwise("train")
    )
    return _hashed(frames, hashed).withColumn("split_fold", fold).drop("_hash")


def _hashed(frames: DataFrame, hashed) -> DataFrame:
    """With _hash, computed once for each individual and joined back."""
    return frames.join(frames.select("individual_id").distinct().withColumn("_hash", hashed), "individual_id", "left")


def open_set(frames: DataFrame, open_share: float = OPEN_SHARE, seed: int = SEED) -> DataFrame:
    """is_open_new: individuals of dev and test whose gallery is withheld (open_excluded), so that their probes are new."""
    is_open = F.col("split_fold").isin("dev", "test") & (F.col("_hash") < open_share)
    out = _hashed(frames, S.fraction(F.concat(F.lit("open:"), "individual_id"), seed)).withColumn("is_open_new", F.coalesce(is_open, F.lit(False))).drop("_hash")
    return out.withColumn("split_role", F.when(F.col("is_open_new") & (F.col("split_role") == "gallery"), "open_excluded").otherwise(F.col("split_role")))


def train_pool(frames: DataFrame) -> DataFrame:
    """in_train_pool: what models may learn from; never the target cohort's test or distractor frames."""
    target = F.col("cohort") == "TK"
    return frames.withColumn("in_train_pool", (F.col("split_fold").isin("train", "aux", "dev") & ~target) | (target & (F.col("split_fold") == "dev")))


def build(frames: DataFrame, test_share: float = TEST_SHARE, open_share: float = OPEN_SHARE, seed: int = SEED) -> DataFrame:
    return frames.transform(temporal_roles).transform(eval_folds, test_share, seed).transform(open_set, open_share, seed).transform(train_pool)


def to_splits(frames: DataFrame) -> DataFrame:
    return frames.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SPLITS])
