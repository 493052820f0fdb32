"""Queries of what passes through files, seals, galleries by cohort, photos and plugged-in models, each with its SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from resight import scratch
from resight.functions import scalars as S
from resight.operators import calibration, catalog, experiment, gallery, matching, openset, ranking, registry, sealing, sealstore, splits, vision
from resight.operators.scoring import pairwise, pooled
from resight.plans import workflows
from resight.plans.proxy import FRAMES_SQL, REGISTRY_SQL, VECTORS_SQL, frames, pooled_sql, table, vectors
from resight.plans.proxy import registry as proxy_registry
from resight.plans.queries import _ROLES, query
from resight.sources import cohorts, images, tables

# ---- files ---------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{scratch.folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"


@query("SELECT c_custkey, c_name, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in order, read back by schema and by columns; an empty value is null."""
    at = _folder(spark, "csv")
    schema = StructType([StructField("c_custkey", LongType()), StructField("c_name", StringType()), StructField("c_acctbal", DoubleType()), StructField("c_mktsegment", StringType())])
    own = table(spark, sf_dir, "customer").select(*schema.names).withColumn("c_mktsegment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    tables.write_csv(own, at, order=["c_mktsegment", "c_custkey"])
    return tables.read_csv(spark, at, schema, ["c_mktsegment", "c_custkey", "c_name", "c_acctbal"])


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def partitioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "table")
    tables.write_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), at, "o_orderstatus")
    return spark.read.parquet(at).select("o_orderkey", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


@query("SELECT count(*) AS n, 'é' AS note FROM region")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "json")
    tables.write_json(spark, {"n": table(spark, sf_dir, "region").count(), "note": "é"}, at)
    return spark.createDataFrame([tables.read_json(spark, at)], "n long, note string")


@query("SELECT 'made' AS step, 1 AS made, count(*) AS n FROM nation UNION ALL SELECT 'same rows', 1, count(*) FROM nation UNION ALL SELECT 'changed rows', 2, count(*) FROM nation")
def cached_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived table is made once for the same rows, and again when a row changes."""
    at, made, out = _folder(spark, "cache"), [], []
    own = table(spark, sf_dir, "nation").select("n_nationkey", F.md5(F.col("n_name").cast("binary")).alias("md5"))
    touched = own.withColumn("md5", F.when(F.col("n_nationkey") == 0, "x").otherwise(F.col("md5")))
    for step, rows in (("made", own), ("same rows", own), ("changed rows", touched)):
        found = tables.cached(spark, at, lambda rows=rows: made.append(1) or rows, tables.content_key(rows, "md5", "names"))
        out.append((step, len(made), found.count()))
    return spark.createDataFrame(out, "step string, made int, n long")


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, TRUE AS complete, FALSE AS complete_in_no_time FROM orders")
def batches_under_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, at = table(spark, sf_dir, "orders").select("o_orderkey"), _folder(spark, "batches")
    found, whole = tables.in_batches(own, lambda x: x.withColumn("twice", F.col("o_orderkey") * 2), at, "o_orderkey", 3, 3600)
    _, none = tables.in_batches(own, lambda x: x, at, "o_orderkey", 3, 0)
    return found.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys")).select("*", F.lit(whole).alias("complete"), F.lit(none).alias("complete_in_no_time"))


@query("SELECT doc_id, CAST(doc_id % 4000 + 1 AS INTEGER) AS width, CAST(doc_id % 3000 + 1 AS INTEGER) AS height, 'unknown' AS stage, 'none' AS stage_source FROM documents")
def base_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of photos: a PNG for even ids, a JPEG for odd ones."""
    d = F.col("doc_id")
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexed(d % 4000 + 1, 8), hexed(d % 3000 + 1, 8), F.lit("0802000000"))
    jpg = F.concat(F.lit("FFD8FFE000046162FFC0001108"), hexed(d % 3000 + 1, 4), hexed(d % 4000 + 1, 4), F.lit("03"))
    own = table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.when(d % 2 == 0, png).otherwise(jpg)).alias("content"))
    return images.base_records(own).select("doc_id", "width", "height", "stage", "stage_source")


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5, base64(encode(coalesce(text, ''))) AS encoded FROM documents")
def digests_and_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return own.select("doc_id", F.md5("content").alias("md5"), S.base64_of("content").alias("encoded"))


@query(f"""WITH {FRAMES_SQL}, a AS (SELECT frame_id, local_id, date FROM frames WHERE cohort = 'LAB'), k AS (SELECT local_id, date, min(frame_id) AS f FROM a GROUP BY 1, 2), g AS (SELECT local_id, min(date) AS d0, CAST(count(DISTINCT date) AS INTEGER) AS n FROM k GROUP BY 1)
SELECT k.local_id AS id, date AS session_date, n AS n_sessions, CASE WHEN date = d0 THEN 'gallery' ELSE 'probe' END AS role, CAST(CAST(date AS DATE) - CAST(d0 AS DATE) AS INTEGER) AS interval_days, CAST(0 AS INTEGER) AS variant FROM k JOIN g USING (local_id)""")
def lab_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From file names; photos of an individual on one day are copies, of which one stays."""
    own = frames(spark, sf_dir).filter("cohort = 'LAB'").groupBy("local_id", "date").agg(F.count("*").alias("n"))
    day = F.concat_ws(".", F.substring("date", 9, 2), F.substring("date", 6, 2), F.substring("date", 1, 4))
    files = own.select(F.explode(F.array(F.lit(""), F.lit(".7"))).alias("v"), day.alias("day"), "local_id", "date")
    files = files.select(F.concat(F.col("day"), F.lit("/"), F.col("local_id").cast("string"), F.col("v"), F.lit(".jpg")).alias("path_rel"), F.md5(F.concat_ws("-", F.col("local_id").cast("string"), "date")).alias("md5"))
    return cohorts.lab_benchmark(files).select("id", "session_date", "n_sessions", "role", "interval_days", "variant")


@query("SELECT cohort, count(*) AS n, count(local_id) AS named FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'TK' WHEN 1 THEN 'PW' WHEN 2 THEN 'LAB' ELSE 'GCN' END AS cohort, o_custkey AS local_id FROM orders) GROUP BY 1")
def parse_all_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parsers by name, the external one with its metadata."""
    o, key, who = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    part = lambda k, path: o.filter(key % 4 == k).select(path.alias("path_rel"), F.lit("m").alias("md5"))
    files = {
        "TK": part(0, F.format_string("%d/IMG_%d.jpg", who, key)), "PW": part(1, F.format_string("%d/%d-01 (%d).jpg", who, who, key)),
        "LAB": part(2, F.format_string("%s/%d.%d.jpg", F.date_format("o_orderdate", "dd.MM.yyyy"), who, key)), "GCN": part(3, F.format_string("Raw_Data/%d/%d.jpg", who, key)),
    }
    meta = o.filter(key % 4 == 3).select(who.cast("string").alias("identity"), F.format_string("%d.jpg", key).alias("file_name"), F.lit("s").alias("survey"), F.lit("r").alias("recapture_id"))
    return cohorts.parse_all(files, meta).groupBy("cohort").agg(F.count("*").alias("n"), F.count("local_id").alias("named"))


# ---- galleries -----------------------------------------------------------------------------------------------------

_SLICED = f"""{_ROLES}, x AS (SELECT *, CASE WHEN NOT has_recapture THEN 'distractor' WHEN local_id % 2 = 0 THEN 'test' ELSE 'dev' END AS fold, has_recapture AND local_id % 7 = 3 AS open FROM roles WHERE cohort = 'TK'),
refs AS (SELECT *, CASE WHEN fold = 'distractor' THEN -1 ELSE CAST(replace(date, '-', '') AS BIGINT) * 100 END AS t FROM x WHERE fold IN ('dev', 'distractor') AND NOT open)"""


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = splits.temporal_roles(proxy_registry(spark, sf_dir))
    fold = F.when(F.col("cohort") != "TK", "train").when(~F.col("has_recapture"), "distractor").when(F.col("local_id") % 2 == 0, "test").otherwise("dev")
    return s.withColumns({"split_fold": fold, "is_open_new": (F.col("cohort") == "TK") & F.col("has_recapture") & (F.col("local_id") % 7 == 3)})


@query(
    f"""{_SLICED} SELECT part, frame_id, coalesce(tkey, -9) AS tkey FROM (SELECT 'refs' AS part, frame_id, t AS tkey FROM refs UNION ALL SELECT 'single', frame_id, t FROM refs WHERE split_role = 'gallery' OR fold = 'distractor'
    UNION ALL SELECT 'known', frame_id, CAST(replace(date, '-', '') AS BIGINT) * 100 FROM x WHERE fold = 'dev' AND split_role = 'probe' AND NOT open UNION ALL SELECT 'new', frame_id, CAST(replace(date, '-', '') AS BIGINT) * 100 FROM x WHERE fold = 'dev' AND split_role = 'probe' AND open)"""
)
def slice_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = gallery.slice_cohort(_sliced(spark, sf_dir), "TK")
    part = lambda df, name: df.select(F.lit(name).alias("part"), "frame_id", F.coalesce("tkey", F.lit(-9)).alias("tkey"))
    return part(c.refs_all, "refs").unionByName(part(c.gallery_single, "single")).unionByName(part(c.known_probe, "known")).unionByName(part(c.new_probe, "new"))


@query(f"{_SLICED} SELECT 'gallery' AS part, frame_id FROM refs WHERE split_role = 'gallery' OR fold = 'distractor' UNION ALL SELECT 'probe', frame_id FROM x WHERE fold = 'dev' AND split_role = 'probe' AND NOT open")
def comparison_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = gallery.comparison_pool(_sliced(spark, sf_dir))
    return g.select(F.lit("gallery").alias("part"), "frame_id").unionByName(p.select(F.lit("probe").alias("part"), "frame_id"))


_MONTHS = "(CAST(substr({0}, 1, 4) AS INTEGER) * 12 + CAST(substr({0}, 6, 2) AS INTEGER))"


@query(f"WITH {REGISTRY_SQL}, d AS (SELECT *, min(date) OVER (PARTITION BY individual_id) AS d0 FROM registry WHERE date IS NOT NULL AND has_recapture) SELECT frame_id, CASE WHEN date = d0 THEN 'earliest' ELSE 'later' END AS part, CASE WHEN date > d0 THEN CAST({_MONTHS.format('date')} - {_MONTHS.format('d0')} AS DOUBLE) END AS months FROM d")
def earliest_and_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, later = gallery.earliest_and_later(proxy_registry(spark, sf_dir))
    return first.select("frame_id", F.lit("earliest").alias("part"), F.lit(None).cast("double").alias("months")).unionByName(later.select("frame_id", F.lit("later").alias("part"), F.col("interval_months").alias("months")))


# ---- catalog -------------------------------------------------------------------------------------------------------


@query(f"WITH {REGISTRY_SQL} SELECT q.frame_id AS query_id, c.frame_id FROM registry q JOIN registry c ON q.frame_id = c.frame_id OR (q.date = c.date AND q.individual_id = c.individual_id) UNION ALL SELECT 'unknown', 'unknown'")
def session_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of each frame's individual and date; undated and unknown frames are alone."""
    r = proxy_registry(spark, sf_dir)
    asked = r.select(F.col("frame_id").alias("query_id"), "frame_id").unionByName(spark.createDataFrame([("unknown", "unknown"), ("none", None)], "query_id string, frame_id string"))
    return catalog.session_of(r, asked)


@query(f"WITH {REGISTRY_SQL} SELECT frame_id AS query_id, date FROM registry")
def date_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = proxy_registry(spark, sf_dir)
    return catalog.date_of(r, r.select(F.col("frame_id").alias("query_id"), "frame_id"))


@query(f"WITH {REGISTRY_SQL}, u AS (SELECT o_orderkey AS query_id, md5(CAST(o_orderkey AS VARCHAR)) AS md5 FROM orders) SELECT query_id, frame_id FROM u JOIN registry USING (md5)")
def frames_for_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads whose bytes are a frame's."""
    uploads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").cast("string").cast("binary").alias("content"))
    return catalog.frames_for_digest(proxy_registry(spark, sf_dir), uploads)


@query(f"WITH {VECTORS_SQL} SELECT a.frame_id AS a, b.frame_id AS b, round(list_dot_product(a.e, b.e) / (a.len * b.len), 6) AS score FROM n a JOIN n b ON b.frame_id = a.frame_id + 1")
def pair_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    pairs = v.select(F.col("frame_id").alias("a"), (F.col("frame_id") + 1).alias("b"))
    return catalog.pair_score(pairs, v).select("a", "b", F.round("score", 6).alias("score"))


@query(f"WITH {VECTORS_SQL}, {pooled_sql('TRUE', 'TRUE', 'TRUE').replace('p.frame_id <> r.frame_id AND TRUE', 'TRUE')} SELECT probe_id AS query_id, individual_id, score, ref_id AS frame_id FROM pooled")
def uploads_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads whose ids happen to be frames' ids: these are met like any other."""
    v = vectors(spark, sf_dir).withColumns({"date": F.col("tkey").cast("string"), "session": F.lit(None).cast("string")})
    found = catalog.scores(v.select(F.col("frame_id").cast("int").alias("query_id"), "emb"), v, exclude_own_session=False)
    return found.select(F.col("query_id").cast("long").alias("query_id"), "individual_id", F.round(F.col("score") * 1_000_000).cast("long").alias("score"), "frame_id")


@query(f"WITH {REGISTRY_SQL}, x AS (SELECT *, local_id % 5 = 0 AS open FROM registry WHERE cohort = 'LAB') SELECT frame_id, individual_id, date, md5 FROM x WHERE NOT open")
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features joined with splits and registry, without withheld individuals."""
    r = proxy_registry(spark, sf_dir)
    s = r.filter("cohort = 'LAB'").withColumn("is_open_new", F.col("local_id") % 5 == 0)
    return catalog.catalog(r.select("frame_id", F.lit(1).alias("feature")), s, r).select("frame_id", "individual_id", "date", "md5")


@query(f"WITH {REGISTRY_SQL} SELECT a.frame_id AS a, b.frame_id AS b FROM registry a JOIN registry b ON a.individual_id = b.individual_id AND a.date < b.date")
def genuine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.genuine_pairs(proxy_registry(spark, sf_dir))


_APART = "SELECT (sum(n) * sum(n) - sum(n * n)) / 2 AS pairs FROM (SELECT individual_id, count(*) AS n FROM {} GROUP BY 1)"


def _checked(found: DataFrame, r: DataFrame, right: Column) -> DataFrame:
    """How many pairs there are, how many are as they should be, and how many are different."""
    side = lambda x: r.select(F.col("frame_id").alias(x), F.struct("individual_id", "date").alias(f"{x}_i"))
    both = found.join(side("a"), "a").join(side("b"), "b")
    return both.agg(F.count("*").cast("int").alias("n"), F.count_if(right).cast("int").alias("fitting"), F.count_distinct(F.least("a", "b"), F.greatest("a", "b")).cast("int").alias("distinct_pairs"))


@query(f"WITH {REGISTRY_SQL}, t AS (SELECT least(700, count(*)) AS n FROM registry a JOIN registry b ON a.individual_id = b.individual_id AND a.date < b.date) SELECT CAST(n AS INTEGER) AS n, CAST(n AS INTEGER) AS fitting, CAST(n AS INTEGER) AS distinct_pairs FROM t")
def genuine_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of pairs of one individual: all different, of different dates, and as many as are asked for."""
    r = proxy_registry(spark, sf_dir).select("frame_id", "individual_id", "date")
    return _checked(calibration.genuine_pairs(r, 700), r, (F.col("a_i.individual_id") == F.col("b_i.individual_id")) & (F.col("a_i.date") < F.col("b_i.date")))


@query(f"WITH {REGISTRY_SQL}, t AS (SELECT least(200, pairs) AS n FROM ({_APART.format('registry')})) SELECT CAST(n AS INTEGER) AS n, CAST(n AS INTEGER) AS fitting, CAST(n AS INTEGER) AS distinct_pairs FROM t")
def impostor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of pairs of different individuals."""
    r = proxy_registry(spark, sf_dir).select("frame_id", "individual_id", "date")
    return _checked(calibration.impostor_pairs(r, 200), r, F.col("a_i.individual_id") != F.col("b_i.individual_id"))


_ONE = "SELECT frame_id, CASE WHEN o % 100 > 0 THEN 'X' ELSE individual_id END AS individual_id FROM (SELECT *, CAST(substr(frame_id, 2) AS BIGINT) AS o FROM registry)"


@query(f"WITH {REGISTRY_SQL}, one AS ({_ONE}), t AS (SELECT least(300, pairs) AS n FROM ({_APART.format('one')})) SELECT CAST(n AS INTEGER) AS n, CAST(n AS INTEGER) AS fitting, CAST(n AS INTEGER) AS distinct_pairs FROM t")
def impostor_pairs_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where one individual has 99 % of the frames."""
    r = proxy_registry(spark, sf_dir).select("frame_id", F.when(F.substring("frame_id", 2, 20).cast("long") % 100 > 0, F.lit("X")).otherwise(F.col("individual_id")).alias("individual_id"), "date")
    return _checked(calibration.impostor_pairs(r, 300), r, F.col("a_i.individual_id") != F.col("b_i.individual_id"))


@query(
    f"""WITH {REGISTRY_SQL}, lab AS (SELECT * FROM registry WHERE cohort = 'LAB'), g AS (SELECT count(*) AS n FROM lab a JOIN lab b ON a.individual_id = b.individual_id AND a.date < b.date), i AS ({_APART.format("lab")})
    SELECT 20.0 AS lo, CASE WHEN n = 0 THEN 21.0 ELSE 50.0 END AS hi, CAST(least(100, n) AS INTEGER) AS n_genuine, CAST(least(100, pairs) AS INTEGER) AS n_impostor FROM g, i"""
)
def calibration_on_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback over sampled pairs, with a scorer that says 50 of one individual and 20 of two."""
    r = proxy_registry(spark, sf_dir).filter("cohort = 'LAB'")
    found = calibration.fit_on_pairs(r, lambda a, b: 50.0 if a == b else 20.0, "individual_id", 100)
    return found.withColumns({c: F.col(c).cast("int") for c in ("n_genuine", "n_impostor")})


@query(f"WITH {VECTORS_SQL}, {pooled_sql()} SELECT probe_id, ref_id, CAST(probe_id % 4 - ref_id % 4 AS DOUBLE) AS interval_months FROM pooled WHERE individual_id = truth")
def own_pairs_with_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("date", F.format_string("2024-%02d", F.col("tkey") + 1))
    return workflows.with_session_distance(v, pooled(v.filter("tkey > 0"), v), v).select("probe_id", "ref_id", "interval_months")


# ---- seal ----------------------------------------------------------------------------------------------------------

_SEALED = f"""WITH {REGISTRY_SQL}, s AS (SELECT *, CASE WHEN local_id % 3 = 0 THEN 'test' ELSE 'dev' END AS fold FROM registry)"""


def _sealed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = scratch.written(proxy_registry(spark, sf_dir), "registry")
    return r, r.select("frame_id", "cohort", "individual_id", "date", "session", F.when(F.col("local_id") % 3 == 0, "test").otherwise("dev").alias("split_fold"), F.lit("probe").alias("split_role"))


@query(f"{_SEALED} SELECT frame_id, md5, fold AS split_fold FROM s WHERE fold = 'dev' UNION ALL SELECT 'refused', NULL, 'test'")
def load_split_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open fold is read; the sealed one is refused before any read."""
    r, s = _sealed(spark, sf_dir)
    rows = sealing.load_split("dev", lambda: r, lambda: s).select("frame_id", "md5", "split_fold")
    try:
        sealing.load_split("test", lambda: r, lambda: s)
        refused = []
    except sealing.SealedError:
        refused = [("refused", None, "test")]
    return rows.unionByName(spark.createDataFrame(refused, "frame_id string, md5 string, split_fold string"))


@query(f"{_SEALED} SELECT 'whole' AS step, count(*) AS n, TRUE AS ok FROM s WHERE fold = 'test' UNION ALL SELECT 'found', count(*), TRUE FROM s WHERE fold = 'test' AND local_id % 50 = 3 UNION ALL SELECT 'gone', count(*), FALSE FROM s WHERE fold = 'test' AND local_id % 50 = 6")
def sealed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed frames verified by a hash tree: whole; how many of the frames that were touched lie in ranges that are named
    as changed; and how many fewer there are after some were taken away."""
    r, s = _sealed(spark, sf_dir)
    manifest = sealing.seal(s, r, beside=_folder(spark, "seal"))
    touched = r.withColumn("md5", F.when(F.col("local_id") % 50 == 3, F.lit("0")).otherwise(F.col("md5")))
    fewer = s.filter("split_fold <> 'test'").unionByName(s.filter("split_fold = 'test'").join(r.filter("local_id % 50 = 6").select("frame_id"), "frame_id", "left_anti").select(*s.columns))
    ranges = scratch.written(sealing.changed_ranges(manifest, s, touched), "changed")
    named = touched.filter("md5 = '0'").join(s.filter("split_fold = 'test'").select("frame_id"), "frame_id").join(ranges, (F.col("frame_id") >= F.col("low")) & (F.col("high").isNull() | (F.col("frame_id") < F.col("high"))))
    gone = sealing.changed_ranges(manifest, fewer, r).agg(F.coalesce(F.sum(F.col("n") - F.col("n_now")), F.lit(0)).alias("n")).first()["n"]
    out = [("whole", manifest.n_sealed, sealing.verify(manifest, s, r)), ("found", named.count(), not sealing.verify(manifest, s, touched)), ("gone", gone, sealing.verify(manifest, fewer, r))]
    return spark.createDataFrame(out, "step string, n long, ok boolean")


@query(f"{_SEALED} SELECT 'first' AS caller, count(*) AS n, TRUE AS opened FROM s WHERE fold = 'test' UNION ALL SELECT 'others', 0, FALSE UNION ALL SELECT 'after a failure', count(*), FALSE FROM s WHERE fold = 'test'")
def unseal_by_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of callers at the same time one opens the seal; a failed evaluation leaves it sealed."""
    from concurrent.futures import ThreadPoolExecutor

    r, s = _sealed(spark, sf_dir)
    manifest = sealing.seal(s, r)
    store, other = (sealstore.Store(spark, _folder(spark, "store")) for _ in range(2))
    store.write(manifest)
    other.write(manifest)

    def call(k: int) -> int:
        try:
            return sealstore.unseal(store, s, r, lambda: {"n": manifest.n_sealed}, "2025-06-01", str(k))[0]["n"]
        except sealing.SealedError:
            return 0

    def fails() -> dict:
        raise ValueError

    with ThreadPoolExecutor(3) as pool:
        found = sorted(pool.map(call, range(3)))
    try:
        sealstore.unseal(other, s, r, fails, "2025-06-01")
    except ValueError:
        pass
    kept = other.read()
    out = [("first", found[-1], store.read().opened), ("others", sum(found[:-1]), False), ("after a failure", kept.n_sealed, kept.opened or other.claimed() is not None)]
    return spark.createDataFrame(out, "caller string, n long, opened boolean")


@query(f"{_SEALED} SELECT 'sealed' AS step, count(*) AS n, TRUE AS ok FROM s WHERE fold = 'test' UNION ALL SELECT 'read back', count(*), TRUE FROM s WHERE fold = 'test' UNION ALL SELECT 'opened', 7, TRUE UNION ALL SELECT 'second time', 0, FALSE UNION ALL SELECT 'touched', 0, FALSE")
def unseal_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed, written and read, opened once with its evaluation; a second time and changed data are refused."""
    r, s = _sealed(spark, sf_dir)
    at, out = _folder(spark, "manifest"), []
    manifest = sealing.seal(s, r)
    out.append(("sealed", manifest.n_sealed, sealing.verify(manifest, s, r)))
    sealing.write_manifest(spark, manifest, at)
    found = sealing.read_manifest(spark, at)
    out.append(("read back", found.n_sealed, found == manifest and not found.opened))
    result, after = sealing.unseal_once(found, s, r, lambda: {"n": 7}, "2025-06-01")
    sealing.write_manifest(spark, after, at)
    after = sealing.read_manifest(spark, at)
    out.append(("opened", result["n"], after.opened and after.opened_date == "2025-06-01"))
    for step, m, rows in (("second time", after, r), ("touched", found, r.withColumn("md5", F.lit("0")))):
        try:
            sealing.unseal_once(m, s, rows, dict, "2025-06-02")
            out.append((step, 1, True))
        except sealing.SealedError:
            out.append((step, 0, False))
    return spark.createDataFrame(out, "step string, n long, ok boolean")


@query("SELECT * FROM (VALUES ('append', TRUE), ('digest', TRUE), ('files', FALSE), ('mask_deterministic', TRUE), ('not_opened', TRUE), ('registered', TRUE)) t(name, ok)")
def rehearsal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is in order but for files of sealed frames, of which every eleventh photo's is missing."""
    r, s = _sealed(spark, sf_dir)
    files = r.filter(F.substring("frame_id", 2, 8).cast("long") % 11 > 0).select("path_rel")
    photo = np.zeros((60, 80, 3), np.uint8)
    photo[10:50, 20:60] = (230, 180, 20)
    crops = s.filter("split_fold = 'dev'").select("frame_id", F.lit("yellow").alias("seg_method"))
    found = sealing.rehearse(sealing.seal(s, r), s, r, files, mask=lambda: vision.body_mask(photo)[0], crops=crops)
    return spark.createDataFrame(sorted(found.items()), "name string, ok boolean")


@query(f"{_SEALED} SELECT 0.5 AS micro_1, 0.4 AS p, 0.3 AS lo, 0.6 AS hi, count(*) AS n_sealed FROM s WHERE fold = 'test'")
def final_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = _sealed(spark, sf_dir)
    record = sealing.final_record({"rolling": {"micro_1": 0.5, "wilson_1": (0.4, 0.3, 0.6)}}, {}, sealing.seal(s, r))
    return spark.createDataFrame([(record["recall"]["micro_1"], *(record["ci95"][k] for k in ("p", "lo", "hi")), record["n_sealed"])], "micro_1 double, p double, lo double, hi double, n_sealed long")


@query("SELECT count(*) FILTER (n_nationkey % 3 = 0) AS withheld, count(*) FILTER (n_nationkey % 3 > 0) AS kept FROM nation")
def sealed_crops_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of crops, a file a nation, without those of sealed ones once these are deleted."""
    at = _folder(spark, "crops")
    s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("frame_id"), F.when(F.col("n_nationkey") % 3 == 0, "test").otherwise("dev").alias("split_fold"))
    s.select(F.lit("x").alias("value"), "frame_id").write.partitionBy("frame_id").text(at)
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at).select(F.regexp_extract("path", r"(frame_id=[^/]+/[^/]+)$", 1).alias("name"), F.regexp_extract("path", r"frame_id=([^/]+)", 1).alias("frame_id"))
    gone = names.join(s.filter("split_fold = 'test'"), "frame_id", "left_semi").select("name")
    n = tables.delete_files(spark, at, scratch.written(gone, "gone"))
    left = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at)
    return left.agg(F.lit(n).cast("long").alias("withheld"), F.count("*").alias("kept"))


# ---- photos and plugged-in models ----------------------------------------------------------------------------------


#: Photos of a task, and most tasks.
PHOTOS, MOST_TASKS = 256, 10_000


def _photos(spark: SparkSession, sf_dir: str, name: str = "supplier", key: str = "s_suppkey") -> DataFrame:
    """A PNG for each row: a yellow body as wide as its number says, on a dark ground, with a white label for every third."""

    @F.pandas_udf("binary")
    def draw(key: pd.Series) -> pd.Series:
        def one(k: int) -> bytes:
            rgb = np.full((120, 160, 3), 60, np.uint8)
            rgb[30:90, 40 : 60 + k % 40] = (230, 180, 20)
            if k % 3 == 0:
                rgb[5:20, 120:150] = (250, 250, 250)
            return vision.encode_png(rgb)

        return key.map(one)

    ids = table(spark, sf_dir, name).select(F.col(key).alias("frame_id"))
    # ids are small and photos are work: a file of ids is many tasks' photos
    return ids.repartition(min(MOST_TASKS, max(1, -(-ids.count() // PHOTOS))), "frame_id").select("frame_id", draw("frame_id").alias("content"))


_SHARE = "round(60.0 * (20 + s_suppkey % 40) / 19200, 6)"


@query(f"SELECT s_suppkey AS frame_id, 'yellow' AS seg_method, {_SHARE} AS share, s_suppkey % 3 = 0 AS has_label, 512 AS width, 512 AS height FROM supplier")
def crops_by_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vision.crops(_photos(spark, sf_dir), "label")
    return made.select("frame_id", "seg_method", F.round("mask_area_frac", 6).alias("share"), "has_label", images.image_size("crop").alias("d")).select("frame_id", "seg_method", "share", "has_label", "d.*")


def _bright(rgb: np.ndarray) -> np.ndarray:
    return (rgb[..., 0] > 200) & (rgb[..., 2] < 100)


@query(f"SELECT s_suppkey AS frame_id, 'model' AS seg_method, {_SHARE} AS share, FALSE AS has_label FROM supplier")
def crops_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hook of a segmentation model, here a threshold."""
    return vision.crops(_photos(spark, sf_dir), "model", lambda: _bright).select("frame_id", "seg_method", F.round("mask_area_frac", 6).alias("share"), "has_label")


@query("SELECT s_suppkey AS frame_id, 0.6 AS a, 0.8 AS b FROM supplier")
def embeddings_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hook of an embedder, here the photo's sides: unit vectors."""
    made = vision.embeddings(_photos(spark, sf_dir), lambda: lambda rgb: np.array(rgb.shape[:2]))
    return made.select("frame_id", *[F.round(F.col("emb")[i].cast("double"), 6).alias(c) for i, c in enumerate("ab")])


@query("SELECT s_suppkey AS frame_id, 2 AS n, 120.0 AS x, 160.0 AS y FROM supplier")
def features_by_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hook of a feature extractor, of which the first points stay."""
    made = vision.features(_photos(spark, sf_dir), lambda: lambda gray: (np.array([gray.shape] * 3), np.zeros((3, 4))), most=2)
    return made.select("frame_id", F.size("pts").alias("n"), F.col("pts")[0]["x"].cast("double").alias("x"), F.col("pts")[0]["y"].cast("double").alias("y"))


@query("SELECT n_nationkey AS frame_id, TRUE AS hashed, 'ventral' AS side, 1.0 AS yellow FROM nation")
def hashes_and_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual hashes are 16 digits, and a body that is yellow all over is seen from below: a photo for each nation."""
    own = _photos(spark, sf_dir, "nation", "n_nationkey")
    crops = vision.crops(own, "yellow").select("frame_id", F.col("crop").alias("content"))
    return vision.phashes(own).select("frame_id", F.col("phash").rlike("^[0-9a-f]{16}$").alias("hashed")).join(vision.sides(crops).select("frame_id", "side", F.round("yellow_frac", 1).alias("yellow")), "frame_id")


def _same_letter(a: str, b: str) -> float:
    return float(a == b)


def _dense():
    """Stands in for a dense matcher's network: ten points that agree with confidence 0.6 if brands are equal, else 0.4."""
    points = np.random.default_rng(0).uniform(0, 100, (10, 2))
    return lambda a, b: (points, points + 3, np.full(10, 0.6 if a == b else 0.4))


@query("WITH x AS (SELECT n_nationkey, n_regionkey, n_nationkey % 3 AS t FROM nation) SELECT p.n_nationkey AS probe_id, r.t AS individual_id, max(CASE WHEN p.n_regionkey = r.n_regionkey THEN 10.0 ELSE 0.0 END) AS score FROM x p JOIN x r ON r.t < p.t GROUP BY 1, 2")
def learned_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hook of a learned dense matcher: its network is plugged in, sure matches are verified, nation by nation."""
    matching.plug("loftr", _dense)
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("frame_id"), (F.col("n_nationkey") % 3).alias("individual_id"), (F.col("n_nationkey") % 3).alias("tkey"), "n_regionkey")
    return pooled(v.filter("tkey > 0"), v.filter("tkey < 2"), payload="n_regionkey", score=pairwise(matching.build("loftr"))).select("probe_id", "individual_id", "score")


@query("SELECT 'disk_lightglue' AS matcher, FALSE AS broken, count(*) AS n_done, TRUE AS complete, 1.0 AS recall_1, 'better' AS decision FROM nation UNION ALL SELECT 'aliked_lightglue', TRUE, 0, FALSE, 0.0, 'broken'")
def learned_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One matcher that tells every nation, against a baseline that tells none, and one that finds nothing."""
    matching.plug("disk_lightglue", lambda: lambda a, b: (np.arange(20).reshape(10, 2) ** 1.5, np.arange(20).reshape(10, 2) ** 1.5, np.full(10, float(a == b) - 0.5)))
    matching.plug("aliked_lightglue", lambda: lambda a, b: (np.zeros((0, 2)), np.zeros((0, 2)), np.zeros(0)))
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("frame_id"), F.col("n_nationkey").alias("individual_id"), F.lit(1).alias("tkey"), F.col("n_name").alias("name"))
    refs = p.withColumn("frame_id", F.col("frame_id") + 1000)
    base = p.select(F.col("frame_id").alias("probe_id"), F.lit(False).alias("hit_1"))
    rows = []
    for name in ("disk_lightglue", "aliked_lightglue"):
        r = workflows.diagnose(spark, name, p, refs, base, "name", _folder(spark, name), 3600, 10.0, batches=2)
        rows.append((name, r["broken"], r.get("n_done", 0), r.get("complete", False), r.get("recall", {1: 0.0})[1], r["decision"]))
    return spark.createDataFrame(rows, "matcher string, broken boolean, n_done int, complete boolean, recall_1 double, decision string")


@query("SELECT p_partkey // 100 AS pair, count(*) AS n, round(sum(1.1 * x - 0.2 * y + 30), 6) AS x, round(sum(0.3 * x + 0.9 * y - 10), 6) AS y FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part) GROUP BY 1")
def affine_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in arrays through a matrix."""
    own = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 100").alias("pair")).agg(F.collect_list(F.struct(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))).alias("p"))
    moved = own.select("pair", F.explode(S.affine("p", [1.1, -0.2, 30, 0.3, 0.9, -10])).alias("q"))
    return moved.groupBy("pair").agg(F.count("*").alias("n"), F.round(F.sum("q.x"), 6).alias("x"), F.round(F.sum("q.y"), 6).alias("y"))


# ---- records -------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('better', 'better'), ('worse', 'worse'), ('same', 'no_difference'), ('slow', 'too_slow')) t(candidate, decision)")
def adoption_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that hit by rules on the probe's number, against one that hits every second."""
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("probe_id"))
    rules = {"base": F.col("probe_id") % 2 == 0, "better": F.lit(True), "slow": F.lit(True), "worse": F.col("probe_id") % 4 == 0, "same": F.col("probe_id") % 2 == 0}
    c = experiment.compare(experiment.all_methods({m: p.withColumn("hit_1", h) for m, h in rules.items()}), "base")
    return spark.createDataFrame([(m, experiment.decide(c, m, "base", 2.0 if m == "slow" else 0.1, 1.0)) for m in ("better", "worse", "same", "slow")], "candidate string, decision string")


@query(
    f"""WITH {REGISTRY_SQL}, d AS (SELECT local_id, date, min(date) OVER (PARTITION BY local_id) AS d0 FROM registry WHERE cohort = 'LAB'), n AS (SELECT local_id, count(DISTINCT date) AS s FROM d GROUP BY 1)
    SELECT count(*) AS frames, (SELECT count(*) FROM n) AS individuals, (SELECT count(*) FROM n WHERE s >= 2) AS recaptured, (SELECT count(*) FROM n WHERE s < 2) AS single_session,
    count(*) FILTER (date > d0 AND CAST(date AS DATE) - CAST(d0 AS DATE) > 95) AS long_intervals FROM d"""
)
def lab_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cohorts.intervals(frames(spark, sf_dir).filter("cohort = 'LAB'").withColumn("individual_id", F.col("local_id")), "individual_id", "date")
    found = workflows.lab_summary(own)
    return found.select("frames", "individuals", "recaptured", "single_session", F.coalesce(F.try_element_at("bins", F.lit("4-5мес")), F.lit(0)).cast("long").alias("long_intervals"))


@query(f"WITH {VECTORS_SQL}, {pooled_sql()}, h AS (SELECT probe_id, bool_or(individual_id = truth AND rank <= 1) AS hit FROM pooled_ranked WHERE probe_id % 3 = 1 GROUP BY 1) SELECT count(*) AS n_probe, count(*) FILTER (hit) / count(*) AS micro_1 FROM h")
def completed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the probes that were done when scoring was stopped early."""
    v = vectors(spark, sf_dir)
    hits = ranking.hits(pooled(v.filter("tkey > 0"), v), v.filter("tkey > 0"))
    return workflows.completed_recall(hits, v.filter("frame_id % 3 = 1 and tkey > 0").select(F.col("frame_id").alias("probe_id"))).select("n_probe", "micro_1")


@query("SELECT 1.0 AS worst, FALSE AS broken, TRUE AS empty_is_broken, TRUE AS timed")
def matcher_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few frames against themselves, and the time of a pair."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("frame_id"), "p_brand")
    found = workflows.self_match(p, _same_letter, "p_brand")
    none = workflows.self_match(p.filter("frame_id < 0"), _same_letter, "p_brand")
    cost = workflows.pair_cost(_same_letter, [("a", "b")] * 20)
    return spark.createDataFrame([(min(found["scores"]), found["broken"], none["broken"], cost >= 0)], "worst double, broken boolean, empty_is_broken boolean, timed boolean")


@query(f"WITH {REGISTRY_SQL} SELECT individual_id, count(date) AS dated, min(date) AS first, quantile_cont(n, 0.5) AS middle FROM (SELECT *, CASE WHEN cohort = 'LAB' THEN NULL ELSE CAST(substr(frame_id, 2, 8) AS DOUBLE) END AS n FROM registry) GROUP BY 1")
def null_aware_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, least values and medians leave nulls out; a group of nulls has none."""
    r = proxy_registry(spark, sf_dir).withColumn("n", F.when(F.col("cohort") != "LAB", F.substring("frame_id", 2, 8).cast("double")))
    middles = openset.grouped_quantiles(r, "individual_id", "n", {"middle": 0.5}).select("individual_id", "middle")
    return r.groupBy("individual_id").agg(F.count("date").alias("dated"), F.min("date").alias("first")).join(middles, "individual_id")


@query("SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ' ' ORDER BY f, l_suppkey) FILTER (l_suppkey % 2 = 0) AS kept FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS f FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING count(*) FILTER (l_suppkey % 2 = 0) > 0")
def ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrences in order, of which those in a set stay."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda s: s.l_suppkey).alias("all"))
    return own.select("l_orderkey", ranking.first_occurrences("all", F.filter("all", lambda x: x % 2 == 0)).alias("kept")).filter(F.size("kept") > 0).select("l_orderkey", F.array_join(F.col("kept").cast("array<string>"), " ").alias("kept"))


@query("SELECT 50 AS n, 50 AS again, 50 AS ids FROM region LIMIT 1")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample by seed is the same however rows are dealt."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    one, two = ranking.seeded_sample(o, "o_orderkey", 50), ranking.seeded_sample(o.repartition(7), "o_orderkey", 50)
    return one.join(two, "o_orderkey", "left_semi").agg(F.count("*").cast("int").alias("again"), F.count_distinct("o_orderkey").cast("int").alias("ids")).crossJoin(one.agg(F.count("*").cast("int").alias("n")))
