"""Which references a probe may be compared with: one earliest session, the session before, or all earlier frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resight.functions import scalars as S

#: Time of distractors: before everything, so they are in each probe's gallery.
DISTRACTOR_TIME = -1


@dataclass
class Cohort:
    refs_all: DataFrame
    gallery_single: DataFrame
    known_probe: DataFrame
    new_probe: DataFrame


def slice_cohort(frames: DataFrame, cohort: str, fold: str = "dev", legacy_undated: bool = False) -> Cohort:
    """frames: splits with crops (or features). Adds tkey, the sortable time."""
    own = frames.filter(F.col("cohort") == cohort)
    own = own.withColumn("tkey", S.order_key("date", "session", legacy_undated) if cohort != "PW" else F.col("session").try_cast("bigint"))
    if cohort != "TK":
        return Cohort(own, own.filter("split_role = 'gallery'"), own.filter("split_role = 'probe'"), own.limit(0))
    is_open = F.coalesce("is_open_new", F.lit(False))
    base = own.filter(F.col("split_fold").isin(fold, "distractor"))
    refs = base.filter(~is_open).withColumn("tkey", F.when(F.col("split_fold") == "distractor", F.lit(DISTRACTOR_TIME).cast("bigint")).otherwise(F.col("tkey")))
    probes = own.filter((F.col("split_fold") == fold) & (F.col("split_role") == "probe"))
    return Cohort(refs, refs.filter((F.col("split_role") == "gallery") | (F.col("split_fold") == "distractor")), probes.filter(~is_open), probes.filter(is_open))


def comparison_pool(frames: DataFrame, fold: str = "dev") -> tuple[DataFrame, DataFrame]:
    """(gallery with distractors, probes), without open individuals: for comparing methods."""
    c = slice_cohort(frames, "TK", fold)
    return c.gallery_single, c.known_probe


def earliest_and_later(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dated frames of recaptured individuals: those of the earliest date, and later ones with the months since."""
    dated = frames.filter(S.missing("date").isNotNull() & F.coalesce("has_recapture", F.lit(False)))
    dated = dated.join(dated.groupBy("individual_id").agg(F.min("date").alias("first_date")), "individual_id")
    later = dated.filter("date > first_date").withColumn("interval_months", S.month_gap("first_date", "date"))
    return dated.filter("date = first_date"), later


def consecutive_sessions(frames: DataFrame, time: str = "tkey") -> DataFrame:
    """session_no, earlier, later, for each pair of neighbouring sessions. One row for each distinct session meets."""
    sessions = frames.select(F.col(time).alias("earlier")).filter("earlier is not null").distinct()
    order = Window.orderBy("earlier")
    return sessions.select("earlier", F.lead("earlier").over(order).alias("later"), F.row_number().over(order).alias("session_no")).filter("later is not null")


def adjacent(frames: DataFrame, time: str = "tkey", individual: str = "individual_id") -> tuple[DataFrame, DataFrame]:
    """(references, probes) with session_no: frames of each session, and the next session's frames of individuals that
    are in both (others have nothing to be found)."""
    pairs = consecutive_sessions(frames, time)
    refs = frames.join(pairs.select(F.col("earlier").alias(time), "session_no"), time)
    probes = frames.join(pairs.select(F.col("later").alias(time), "session_no"), time)
    return refs, probes.join(refs.select("session_no", individual).distinct(), ["session_no", individual], "left_semi")
