"""Integrity gates: each is one row (name, ok, detail). Missing evidence fails a gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resight.functions import scalars as S

COHORTS = ("TK", "PW", "LAB", "GCN")


def _count_gates(df: DataFrame, bad: dict[str, Column]) -> DataFrame:
    """Each passes if no row is bad; detail is their number. All are counted in one pass."""
    counts = df.agg(*[F.count_if(c).alias(name) for name, c in bad.items()])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("n")) for name in bad])).alias("g"))
    return rows.select("g.name", (F.col("g.n") == 0).alias("ok"), F.col("g.n").cast("string").alias("detail"))


def _rows_gate(df: DataFrame, name: str) -> DataFrame:
    """Passes if there is no row."""
    return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), (F.col("n") == 0).alias("ok"), F.col("n").cast("string").alias("detail"))


def _all(gates: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


def registry_gates(registry: DataFrame, files: DataFrame | None = None, near_pairs: DataFrame | None = None) -> DataFrame:
    """Namespace, dates, unique digests, recapture flags, external cohorts, paths, near-duplicates across sessions."""
    bare = registry.filter(F.col("md5").isNotNull()).groupBy("md5").agg(F.count("*").alias("n")).filter("n > 1")
    gates = [
        _count_gates(
            registry,
            {
                "namespace": ~F.coalesce(F.split("individual_id", "-").getItem(0).isin(*COHORTS), F.lit(False)),
                "dates": S.missing("date").isNotNull() & ~S.valid_date("date"),
                "recapture_known": (F.col("role") == "target") & F.col("has_recapture").isNull(),
                "external": (F.col("cohort") == "GCN") & ~F.coalesce(F.col("role") == "external", F.lit(False)),
                "paths_relative": F.coalesce(F.col("path_rel").rlike(r"^(/|[A-Za-z]:|\w+://)"), F.lit(True)),
            },
        ),
        _rows_gate(bare, "unique_md5"),
    ]
    spark = registry.sparkSession
    missing = [(n, False, "no evidence") for n, df in (("paths_exist", files), ("near_duplicates", near_pairs)) if df is None]
    if missing:
        gates.append(spark.createDataFrame(missing, "name string, ok boolean, detail string"))
    if files is not None:
        gates.append(_rows_gate(registry.join(files.select("path_rel").distinct(), "path_rel", "left_anti"), "paths_exist"))
    if near_pairs is not None:
        gates.append(_rows_gate(cross_session_pairs(registry, near_pairs), "near_duplicates"))
    return _all(gates)


def cross_session_pairs(registry: DataFrame, near_pairs: DataFrame) -> DataFrame:
    """Near-duplicate pairs of one individual whose sessions differ: they would leak from gallery to probe."""
    if "same_session" in near_pairs.columns:  # of near_dup.own_pairs: nothing to look up
        return near_pairs.filter("same_individual and not same_session").select("a", "b")
    keyed = registry.select("path_rel", "individual_id", S.session_key("date", "session").alias("s"))
    a, b = (keyed.select(F.col("path_rel").alias(x), F.col("individual_id").alias(f"{x}_i"), F.col("s").alias(f"{x}_s")) for x in ("a", "b"))
    if "same_individual" in near_pairs.columns:  # most pairs are of two, and go before their paths are shuffled
        near_pairs = near_pairs.filter("same_individual")
    return near_pairs.select("a", "b").hint("merge").join(a, "a").hint("merge").join(b, "b").filter((F.col("a_i") == F.col("b_i")) & (F.col("a_s") != F.col("b_s"))).select("a", "b")


def overlap(left: DataFrame, right: DataFrame, column: str = "individual_id") -> DataFrame:
    return left.select(column).intersect(right.select(column))


def split_gates(splits: DataFrame, rebuilt: DataFrame | None = None, manifest_ok: bool | None = None) -> DataFrame:
    """Folds by whole individuals, disjoint pools and folds, disjoint sessions, closed galleries, determinism, seal."""
    test = splits.filter("split_fold = 'test'")
    tkey = S.time_key("cohort", "date", "session")
    roles = splits.withColumn("k", tkey).groupBy("individual_id", "k").agg(F.bool_or(F.col("split_role") == "gallery").alias("g"), F.bool_or(F.col("split_role") == "probe").alias("p"))
    gates = [
        _rows_gate(splits.groupBy("individual_id").agg(F.count_distinct("split_fold").alias("n")).filter("n > 1"), "one_fold"),
        _rows_gate(overlap(splits.filter("in_train_pool"), test), "train_test_disjoint"),
        _rows_gate(overlap(splits.filter("split_fold = 'dev'"), test), "dev_test_disjoint"),
        _rows_gate(roles.filter("g and p"), "sessions_disjoint"),
        _count_gates(splits, {"open_not_in_gallery": F.coalesce("is_open_new", F.lit(False)) & (F.col("split_role") == "gallery")}),
    ]
    if rebuilt is not None:
        columns = sorted(set(splits.columns) & set(rebuilt.columns))
        a, b = splits.select(columns), rebuilt.select(columns)
        gates.append(_rows_gate(a.exceptAll(b).unionByName(b.exceptAll(a)), "deterministic"))
    rows = [("deterministic", False, "no evidence")] if rebuilt is None else []
    rows.append(("manifest", bool(manifest_ok), "no evidence" if manifest_ok is None else ""))
    gates.append(splits.sparkSession.createDataFrame(rows, "name string, ok boolean, detail string"))
    return _all(gates)


def passed(gates: DataFrame) -> bool:
    return bool(gates.agg(F.bool_and("ok")).first()[0])
