"""Queries of pruned retrieval, each with the SQL of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.operators import pruned
from resight.plans.proxy import VECTORS_SQL, pooled_sql, table, vectors
from resight.plans.queries import _micro, query


@query(f"WITH {VECTORS_SQL}, {pooled_sql()} SELECT probe_id, individual_id, score, ref_id, rank FROM pooled_ranked WHERE rank <= 5")
def pruned_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best earlier individuals of each vector, with their best references."""
    v = vectors(spark, sf_dir)
    found, _ = pruned.nearest(v.filter("tkey > 0"), v, 5, tile=64, each=64)
    return found.select("probe_id", "individual_id", _micro(), "ref_id", "rank")


_POINT = "[cos(p_partkey * 0.37) * 10, sin(p_partkey * 0.37) * 10, cos(p_size * 0.9) * 20, sin(p_size * 0.9) * 20, p_retailprice / 100]"


@query(
    f"""WITH v AS (SELECT p_partkey AS id, p_partkey % 211 AS who, CAST({_POINT} AS DOUBLE[]) AS e FROM part), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS len FROM v),
    s AS (SELECT p.id AS probe_id, r.who AS individual_id, max(CAST(round(list_dot_product(p.e, r.e) / (p.len * r.len) * 1000000) AS BIGINT)) AS score FROM n p JOIN n r ON p.id <> r.id AND p.id % 3 = 0 GROUP BY 1, 2)
    SELECT probe_id, individual_id, score, rank, TRUE AS mostly_skipped FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, individual_id) AS rank FROM s) WHERE rank <= 3"""
)
def pruned_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best individuals of every third part by what it is like, among all parts, and whether most pairs of tiles were skipped."""
    p, k, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    point = F.array(F.cos(k * 0.37) * 10, F.sin(k * 0.37) * 10, F.cos(s * 0.9) * 20, F.sin(s * 0.9) * 20, F.col("p_retailprice").cast("double") / 100)
    v = p.select(k.alias("frame_id"), (k % 211).alias("individual_id"), F.lit(None).cast("long").alias("tkey"), point.alias("emb"))
    found, stats = pruned.nearest(v.filter("frame_id % 3 = 0"), v, 3, strictly_earlier=False, tile=16, each=16)
    return found.select("probe_id", "individual_id", _micro(), "rank", F.lit(2 * stats["scored"] < stats["tile_pairs"]).alias("mostly_skipped"))
