"""The engine's tables made from the driver's star schema, in Spark and in SQL, so that operators can be checked.

Frames: an order is a photo, a customer an individual, the market segment its cohort. Embeddings: a label is an
individual, the vector's id modulo four its session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.functions import scalars as S
from resight.operators.registry import with_identity, with_recapture

COHORT_OF = {"AUTOMOBILE": "TK", "BUILDING": "TK", "FURNITURE": "PW", "HOUSEHOLD": "LAB", "MACHINERY": "GCN"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, cohort, local_id, session, date, path_rel, md5, phash."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    cohort = S.lookup("c_mktsegment", COHORT_OF)
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    date = F.when(cohort == "LAB", day).when((cohort == "TK") & (key % 97 != 0), F.date_format("o_orderdate", "yyyy-MM"))
    session = F.when(cohort == "PW", F.quarter("o_orderdate").cast("string")).when(cohort == "LAB", day)
    stem = F.concat((key % 37).cast("string"), F.when(key % 5 == 0, ".1").otherwise(""))
    return rows.select(
        F.format_string("F%08d", key).alias("frame_id"), cohort.alias("cohort"), F.col("o_custkey").cast("int").alias("local_id"), session.alias("session"), date.alias("date"),
        F.concat_ws("/", cohort, F.col("o_custkey").cast("string"), key.cast("string"), F.concat(stem, F.lit(".jpg"))).alias("path_rel"),
        F.md5(F.expr("o_orderkey div 3").cast("string")).alias("md5"),
        F.concat((key % 4).cast("string"), F.substring(F.md5(F.expr("o_orderkey div 5").cast("string")), 2, 15)).alias("phash"),
    )


FRAMES_SQL = """frames AS (
  SELECT printf('F%08d', o_orderkey) AS frame_id, cohort, CAST(o_custkey AS INTEGER) AS local_id,
    CASE cohort WHEN 'PW' THEN CAST(quarter(o_orderdate) AS VARCHAR) WHEN 'LAB' THEN strftime(o_orderdate, '%Y-%m-%d') END AS session,
    CASE WHEN cohort = 'LAB' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN cohort = 'TK' AND o_orderkey % 97 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS date,
    cohort || '/' || o_custkey || '/' || o_orderkey || '/' || (o_orderkey % 37) || CASE WHEN o_orderkey % 5 = 0 THEN '.1' ELSE '' END || '.jpg' AS path_rel,
    CAST(o_orderkey % 37 AS VARCHAR) || CASE WHEN o_orderkey % 5 = 0 THEN '.1' ELSE '' END AS stem,
    md5(CAST(o_orderkey // 3 AS VARCHAR)) AS md5, (o_orderkey % 4) || substr(md5(CAST(o_orderkey // 5 AS VARCHAR)), 2, 15) AS phash
  FROM (SELECT *, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'TK' WHEN 'BUILDING' THEN 'TK' WHEN 'FURNITURE' THEN 'PW' WHEN 'HOUSEHOLD' THEN 'LAB' WHEN 'MACHINERY' THEN 'GCN' END AS cohort
        FROM orders JOIN customer ON c_custkey = o_custkey))"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_recapture(with_identity(frames(spark, sf_dir)))


REGISTRY_SQL = f"""{FRAMES_SQL},
ident AS (SELECT *, printf('%s-%03d', cohort, local_id) AS individual_id, coalesce(date, session, 'None') AS skey,
    CASE cohort WHEN 'PW' THEN session ELSE date END AS tkey, CASE cohort WHEN 'TK' THEN 'target' WHEN 'PW' THEN 'target' WHEN 'LAB' THEN 'temporal_aux' ELSE 'external' END AS role FROM frames),
registry AS (SELECT i.*, n_sessions, n_sessions >= 2 AS has_recapture FROM ident i JOIN (SELECT individual_id, CAST(count(DISTINCT skey) AS INTEGER) AS n_sessions FROM ident GROUP BY 1) USING (individual_id))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, individual_id, tkey, emb."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").alias("individual_id"), (F.col("vec_id") % 4).alias("tkey"), F.col("embedding").alias("emb"))


VECTORS_SQL = """v AS (SELECT vec_id AS frame_id, label AS individual_id, vec_id % 4 AS tkey, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS len FROM v),
first AS (SELECT individual_id, min(tkey) AS t0 FROM v GROUP BY 1)"""


def pooled_sql(probe: str = "TRUE", ref: str = "TRUE", pair: str = "r.tkey < p.tkey", name: str = "pooled", dims: str = "p.e, r.e", norm: str = "p.len * r.len") -> str:
    """Common table expressions of pooled scores over VECTORS_SQL; score in millionths."""
    return f"""{name}_all AS (SELECT p.frame_id AS probe_id, p.individual_id AS truth, r.individual_id, r.frame_id AS ref_id, CAST(round(list_dot_product({dims}) / ({norm}) * 1000000) AS BIGINT) AS score
  FROM (SELECT n.*, t0 FROM n JOIN first USING (individual_id)) p JOIN (SELECT n.*, t0 FROM n JOIN first USING (individual_id)) r ON p.frame_id <> r.frame_id AND {pair} WHERE {probe} AND {ref}),
{name} AS (SELECT probe_id, truth, individual_id, max(score) AS score, arg_min(ref_id, (-score, ref_id)) AS ref_id FROM {name}_all GROUP BY ALL),
{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, individual_id) AS rank FROM {name})"""
