"""The frame registry: one row a photo, from cohort frames to ids, recapture statistics and exact de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resight.functions import scalars as S
from resight.schema import REGISTRY, ROLES, SPECIES
from resight.scratch import written


def union_cohorts(*cohorts: DataFrame) -> DataFrame:
    """Cohorts under the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cohorts)


def union_distinct(key: str, *tables: DataFrame) -> DataFrame:
    """Tables under the union of their columns, one row of each key; of rows that differ, the least."""
    rows = union_cohorts(*tables)
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*columns)).alias("_row")).select(key, "_row.*")


def with_identity(frames: DataFrame) -> DataFrame:
    """individual_id in one namespace, species and role of the cohort."""
    return frames.withColumns({"individual_id": S.individual_id("cohort", "local_id"), "species": S.lookup("cohort", SPECIES), "role": S.lookup("cohort", ROLES)})


def with_recapture(frames: DataFrame) -> DataFrame:
    """n_sessions (distinct sessions of the individual) and has_recapture (two or more)."""
    stats = frames.groupBy("individual_id").agg(F.count_distinct(S.session_key("date", "session")).cast("int").alias("n_sessions"))
    bare = frames.drop("n_sessions", "has_recapture")
    return bare.join(stats, "individual_id", "left").withColumn("has_recapture", F.col("n_sessions") >= 2)


def exact_dedup(frames: DataFrame, digest: str = "md5", path: str = "path_rel") -> tuple[DataFrame, DataFrame]:
    """(one frame of each digest, (drop, keep) paths). Frames without a digest all stay.

    The survivor is the smallest by survivor keys, then path: an aggregate, not a sort of each group, so a digest
    of very many copies is combined before the shuffle.
    """
    keys = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(S.survivor_keys(path))], F.col(path).alias("path"))
    best = frames.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(keys).alias("best")).select(digest, F.col("best.path").alias("keep"))
    marked = frames.join(best, digest, "left")
    first = Window.partitionBy(digest, path).orderBy(path)
    # equal digest and path twice: one row stays
    kept = marked.filter(F.col(digest).isNull()).drop("keep").unionByName(
        marked.filter(F.col(path) == F.col("keep")).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "keep")
    )
    return kept, marked.filter(F.col(path) != F.col("keep")).select(F.col(path).alias("drop"), "keep")


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Adds the number of each row in order, from 0 and without gaps.

    Ranges are sorted in parallel and written with their numbers, so that a row's range is settled before ranges are
    counted; the counts are the only thing that meets in one place (a row for each range).
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = written(ranged.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_row")).drop("_id"), "numbered")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part", "left").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def with_frame_ids(frames: DataFrame) -> DataFrame:
    """F00000, F00001... in the order of cohort, individual, date, path."""
    rows = numbered(frames, ["cohort", "individual_id", F.col("date").asc_nulls_last(), "path_rel"], "_number")
    return rows.withColumn("frame_id", F.format_string("F%05d", "_number")).drop("_number")


def to_registry(frames: DataFrame) -> DataFrame:
    """The registry's columns in order, nulls for those that are missing."""
    have = set(frames.columns)
    return frames.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in REGISTRY])


def summary(registry: DataFrame) -> DataFrame:
    """Frames, individuals and recaptured individuals by cohort, and of all (cohort null), in one pass."""
    return registry.groupingSets([["cohort"], []], "cohort").agg(
        F.count("*").alias("frames"), F.count_distinct("individual_id").alias("individuals"), F.count_distinct(F.when(F.col("has_recapture"), F.col("individual_id"))).alias("recaptured")
    )


def sessions_histogram(registry: DataFrame) -> DataFrame:
    return registry.select("cohort", "individual_id", "n_sessions").distinct().groupBy("cohort", "n_sessions").agg(F.count("*").alias("individuals"))


def photos_per_individual(registry: DataFrame) -> DataFrame:
    sizes = registry.groupBy("cohort", "individual_id").agg(F.count("*").alias("n"))
    # numbers of individuals by number of photos: the median is exact and its task holds distinct numbers only
    counts = sizes.groupBy("cohort", "n").agg(F.count("*").alias("individuals"))
    return counts.groupBy("cohort").agg(F.min("n").alias("least"), F.max("n").alias("most"), (F.sum(F.col("n") * F.col("individuals")) / F.sum("individuals")).alias("mean"), F.percentile("n", 0.5, F.col("individuals")).alias("median"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def report(registry: DataFrame, near_pairs: int = 0, dropped: int = 0) -> str:
    """A Markdown summary. What is collected has a row for each cohort and number of sessions."""
    rows = summary(registry).orderBy(F.col("cohort").asc_nulls_last()).collect()
    out = ["# Registry", "", "| cohort | frames | individuals | recaptured |", "|---|---|---|---|"]
    out += [f"| {r['cohort'] or 'all'} | {r['frames']} | {r['individuals']} | {r['recaptured']} |" for r in rows]
    out += ["", "| cohort | sessions | individuals |", "|---|---|---|"]
    out += [f"| {r['cohort']} | {r['n_sessions']} | {r['individuals']} |" for r in sessions_histogram(registry).orderBy("cohort", "n_sessions").collect()]
    return "\n".join([*out, "", f"Near-duplicate pairs: {near_pairs}. Dropped exact duplicates: {dropped}.", ""])
