"""The driver's queries of the engine's operators, each with its SQL where SQL can express it.

Scores are compared in millionths, so that equal results don't depend on the order of floating-point sums; ratios of
counts are exact in both engines, and means of ratios are rounded to nine decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.functions import scalars as S
from resight.functions.stats import mcnemar, wilson
from resight.operators import calibration, catalog, experiment, gallery, gates, matching, metrics, near_dup, openset, ranking, registry, sealing, splits
from resight.operators.scoring import pooled
from resight.plans import workflows
from resight.plans.proxy import FRAMES_SQL, REGISTRY_SQL, VECTORS_SQL, frames, pooled_sql, table, vectors
from resight.plans.proxy import registry as proxy_registry
from resight.scratch import folder, written
from resight.sources import cohorts, tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _micro(c: str = "score"):
    return F.round(F.col(c) * 1_000_000).cast("long").alias(c)


# ---- retrieval over embeddings -------------------------------------------------------------------------------------

_KNOWN = "p.tkey > p.t0"
_ROLLING = f"WITH {VECTORS_SQL}, {pooled_sql()}"
_SINGLE = f"WITH {VECTORS_SQL}, {pooled_sql(_KNOWN, 'r.tkey = r.t0', 'TRUE')}"
_HITS = "hits AS (SELECT n.frame_id AS probe_id, n.individual_id AS truth, n.tkey, min(rank) FILTER (pooled_ranked.individual_id = truth) AS true_rank FROM n LEFT JOIN pooled_ranked ON probe_id = frame_id WHERE {} GROUP BY 1, 2, 3)"
_MICRO = "count(*) AS n_probe, " + ", ".join(f"count(*) FILTER (true_rank <= {k}) / count(*) AS micro_{k}" for k in (1, 5, 10))


def _rolling(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    probes = v.filter("tkey > 0")
    scores = pooled(probes, v)
    return scores, ranking.hits(scores, probes, keep=keep)


def _single(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    first = v.groupBy("individual_id").agg(F.min("tkey").alias("t0"))
    v = v.join(first, "individual_id")
    scores = pooled(v.filter("tkey > t0"), v.filter("tkey = t0"), strictly_earlier=False)
    return scores, ranking.hits(scores, v.filter("tkey > t0"))


@query(f"{_ROLLING}, {_HITS.format('n.tkey > 0')} SELECT {_MICRO} FROM hits")
def rolling_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.micro_recall(_rolling(spark, sf_dir)[1])


@query(f"{_SINGLE}, {_HITS.format('n.tkey > (SELECT t0 FROM first WHERE first.individual_id = n.individual_id)')} SELECT {_MICRO} FROM hits")
def single_ref_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.micro_recall(_single(spark, sf_dir)[1])


@query(
    f"{_ROLLING}, {_HITS.format('n.tkey > 0')}, own AS (SELECT truth, "
    + ", ".join(f"count(*) FILTER (true_rank <= {k}) / count(*) AS m{k}" for k in (1, 5, 10))
    + " FROM hits GROUP BY 1) SELECT count(*) AS n_identity, round(avg(m1), 9) AS macro_1, round(avg(m5), 9) AS macro_5, round(avg(m10), 9) AS macro_10 FROM own"
)
def macro_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.macro_recall(_rolling(spark, sf_dir)[1])
    return m.select("n_identity", *[F.round(f"macro_{k}", 9).alias(f"macro_{k}") for k in (1, 5, 10)])


@query(
    f"""{_ROLLING}, {_HITS.format('n.tkey > 0')}, c AS (SELECT count(*) AS n, count(DISTINCT truth) AS ids, {", ".join(f"count(*) FILTER (true_rank <= {k}) AS s{k}" for k in (1, 5, 10))} FROM hits)
    SELECT n AS n_probe, ids AS n_identity, 1 - s1 / n AS frr_1, 1 - s5 / n AS frr_5, 1 - s10 / n AS frr_10,
    round(((s1 / n + 1.96 * 1.96 / (2 * n)) - 1.96 * sqrt(s1 / n * (1 - s1 / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS lo,
    round(((s1 / n + 1.96 * 1.96 / (2 * n)) + 1.96 * sqrt(s1 / n * (1 - s1 / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS hi FROM c"""
)
def frr_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.report(_rolling(spark, sf_dir)[1])
    return r.select("n_probe", "n_identity", "frr_1", "frr_5", "frr_10", F.round("wilson_1.lo", 9).alias("lo"), F.round("wilson_1.hi", 9).alias("hi"))


@query(f"{_ROLLING}, {_HITS.format('n.tkey > 0')} SELECT tkey AS since, count(*) AS n, count(*) FILTER (true_rank <= 1) / count(*) AS recall FROM hits GROUP BY 1")
def recall_by_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _rolling(spark, sf_dir, ("tkey",))[1].withColumnRenamed("tkey", "since")
    return metrics.recall_by(hits, "since")


def _adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    refs, probes = gallery.adjacent(v)
    scores = pooled(probes, refs.withColumn("tkey", F.lit(0)), group="session_no", strictly_earlier=False)
    return ranking.hits(scores, probes, keep=("session_no",))


_ADJACENT = f"""WITH {VECTORS_SQL}, {pooled_sql("EXISTS (SELECT 1 FROM v x WHERE x.individual_id = p.individual_id AND x.tkey = p.tkey - 1)", "TRUE", "r.tkey = p.tkey - 1")},
{_HITS.format("n.tkey > 0 AND EXISTS (SELECT 1 FROM v x WHERE x.individual_id = n.individual_id AND x.tkey = n.tkey - 1)")}"""
_RECALLS = "count(*) AS n, " + ", ".join(f"count(*) FILTER (true_rank <= {k}) / count(*) AS recall_{k}" for k in (1, 5, 10))


@query(f"{_ADJACENT} SELECT CAST(tkey AS INTEGER) AS session_no, {_RECALLS} FROM hits GROUP BY 1")
def adjacent_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.adjacent_recall(_adjacent(spark, sf_dir)).filter("session_no is not null")


@query(f"{_ADJACENT} SELECT {_RECALLS} FROM hits")
def adjacent_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.adjacent_recall(_adjacent(spark, sf_dir)).filter("session_no is null").drop("session_no")


@query(f"{_ROLLING} SELECT probe_id, truth, individual_id, score, ref_id, CAST(rank AS INTEGER) AS rank FROM pooled_ranked WHERE rank <= 3 AND probe_id % 4 > 0")
def topk_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(_rolling(spark, sf_dir)[0], 3).withColumn("score", _micro())


@query(f"{_ROLLING} SELECT probe_id, individual_id, score, ref_id FROM pooled")
def argmax_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling(spark, sf_dir)[0].select("probe_id", "individual_id", _micro(), "ref_id")


@query(f"{_ROLLING} SELECT probe_id, max(score) FILTER (rank = 1) AS top1, max(score) FILTER (rank = 2) AS top2, max(individual_id) FILTER (rank = 1) AS best FROM pooled_ranked GROUP BY 1")
def top1_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.margins(_rolling(spark, sf_dir)[0]).select("probe_id", _micro("top1"), _micro("top2"), "best")


@query(f"WITH {VECTORS_SQL} SELECT 1 / count(DISTINCT individual_id) AS random_top1 FROM v")
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.random_baseline(vectors(spark, sf_dir))


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, catalog): every vector asks against all vectors outside its own session of its individual."""
    v = vectors(spark, sf_dir).withColumns({"date": F.col("tkey").cast("string"), "session": F.lit(None).cast("string")})
    return catalog.with_own_session(v.select(F.col("frame_id").alias("query_id"), "frame_id", "emb"), v), v


_ASKED = f"WITH {VECTORS_SQL}, {pooled_sql('TRUE', 'TRUE', 'NOT (r.individual_id = p.individual_id AND r.tkey = p.tkey)')}"
_CONF = "least(greatest(({} / 1000000.0 - 0.1) / 0.4, 0) * 100, 99)"


@query(f"{_ASKED} SELECT probe_id AS query_id, CAST(rank AS INTEGER) AS rank, p.individual_id, score, ref_id AS frame_id, (SELECT count(*) FROM v WHERE v.individual_id = p.individual_id) AS n_photos FROM pooled_ranked p WHERE rank <= 5")
def session_exclusion_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks, own = _catalog(spark, sf_dir)
    found = catalog.identify(asks, own, 5, 0.1, 0.5, exclude_own_session=True)
    return found.select("query_id", "rank", "individual_id", _micro(), "frame_id", "n_photos")


@query(
    f"""{_ASKED}, top AS (SELECT probe_id, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, max(individual_id) FILTER (rank = 1) AS best FROM pooled_ranked GROUP BY 1),
    c AS (SELECT probe_id AS query_id, best, {_CONF.format('s1')} AS c1, {_CONF.format('s2')} AS c2 FROM top)
    SELECT query_id, best, round(c1, 6) AS confidence, CASE WHEN c1 < 40 THEN 'new' WHEN c1 >= 70 AND round(c1 - coalesce(c2, 0), 1) >= 8 THEN 'known' ELSE 'review' END AS verdict FROM c"""
)
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks, own = _catalog(spark, sf_dir)
    out = catalog.verdicts(asks, catalog.scores(asks, own, True), 0.1, 0.5)
    return out.select("query_id", "best", F.round("confidence", 6).alias("confidence"), "verdict")


_FIT = """best AS (SELECT probe_id, truth, max(score) FILTER (individual_id = truth) / 1000000.0 AS genuine, max(score) FILTER (individual_id <> truth) / 1000000.0 AS impostor FROM pooled GROUP BY 1, 2)"""


_FITTED = "SELECT round(quantile_cont(impostor, 0.9)) AS lo, greatest(round(quantile_cont(genuine, 0.8)), round(quantile_cont(impostor, 0.9)) + 1) AS hi, count(genuine) AS n_genuine, count(impostor) AS n_impostor FROM best"


@query(f"{_ROLLING}, {_FIT.replace(' / 1000000.0', '')} {_FITTED}")
def confidence_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.fit(_rolling(spark, sf_dir)[0].withColumn("score", _micro()))


@query(
    f"""WITH {VECTORS_SQL}, days AS (SELECT individual_id, max(tkey) AS last FROM v GROUP BY 1 HAVING count(DISTINCT tkey) > 1), asked AS (SELECT min(frame_id) AS q FROM v JOIN days USING (individual_id) WHERE tkey = last GROUP BY individual_id),
    {pooled_sql('p.frame_id IN (SELECT q FROM asked)', 'TRUE', 'NOT (r.individual_id = p.individual_id AND r.tkey = p.tkey)')},
    best AS (SELECT probe_id, max(score) FILTER (individual_id = truth) AS genuine, max(score) FILTER (individual_id <> truth) AS impostor FROM pooled_ranked WHERE rank <= 5 GROUP BY 1) {_FITTED}"""
)
def calibration_on_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumns({"date": F.col("tkey").cast("string"), "session": F.lit(None).cast("string")})
    return calibration.fit_on_latest(v, scale=1e6)


def _open(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Best scores, in thousandths, of probes of known labels and of labels 8 and 9, which the gallery lacks."""
    v = vectors(spark, sf_dir)
    best = pooled(v.filter("tkey > 0"), v.filter("individual_id < 8")).groupBy("probe_id", "truth").agg((F.round(F.max("score") * 1_000_000).cast("long") / F.lit(1000)).cast("long").cast("double").alias("score"))
    return best.filter("truth < 8"), best.filter("truth >= 8")


_OPEN = f"""WITH {VECTORS_SQL}, {pooled_sql('p.tkey > 0', 'r.individual_id < 8')}, best AS (SELECT probe_id, truth, CAST(trunc(max(score) / 1000) AS DOUBLE) AS score FROM pooled GROUP BY 1, 2),
rates AS (SELECT t, count(*) FILTER (truth < 8 AND score >= t) / count(*) FILTER (truth < 8) AS tar, count(*) FILTER (truth >= 8 AND score >= t) / count(*) FILTER (truth >= 8) AS far FROM (SELECT DISTINCT score AS t FROM best) CROSS JOIN best GROUP BY 1)"""
_YOUDEN = "y AS (SELECT t AS threshold, tar, far FROM rates ORDER BY round(tar - far, 12) DESC, t LIMIT 1)"


@query(f"{_OPEN} SELECT t, tar, far FROM rates")
def threshold_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openset.at_or_above(*_open(spark, sf_dir))


@query(f"{_OPEN}, {_YOUDEN} SELECT threshold, tar, far FROM y")
def youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openset.youden(*_open(spark, sf_dir))


@query(
    f"""{_OPEN} SELECT count(*) FILTER (truth < 8) AS n_known, count(*) FILTER (truth >= 8) AS n_new, count(*) FILTER (truth < 8 AND score >= 300) / count(*) FILTER (truth < 8) AS tar,
    count(*) FILTER (truth >= 8 AND score >= 300) / count(*) FILTER (truth >= 8) AS far, round(sqrt(count(*) FILTER (truth < 8 AND score >= 300) / count(*) FILTER (truth < 8) * (1 - count(*) FILTER (truth >= 8 AND score >= 300) / count(*) FILTER (truth >= 8))), 9) AS g FROM best"""
)
def open_set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.open_set(*_open(spark, sf_dir), 300.0).select("n_known", "n_new", "tar", "far", F.round("g", 9).alias("g"))


_TRI = f"""{_OPEN}, {_YOUDEN}, k AS (SELECT coalesce(min(t) FILTER (far = 0), max(t) + 1) AS known_from FROM rates), tri AS (SELECT known_from, least(threshold, known_from) AS new_below FROM k, y)"""


@query(f"{_TRI} SELECT known_from, new_below FROM tri")
def tri_state_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openset.tri_state(*_open(spark, sf_dir))


@query(f"{_OPEN} SELECT count(*) FILTER (score >= 350) / count(*) AS known, count(*) FILTER (score >= 250 AND score < 350) / count(*) AS review, count(*) FILTER (score < 250) / count(*) AS new FROM best")
def tri_state_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, new = _open(spark, sf_dir)
    return openset.zone_shares(known.unionByName(new), 350.0, 250.0)


def _half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a second method: the first 32 of the vectors' numbers."""
    v = vectors(spark, sf_dir).withColumn("emb", F.slice("emb", 1, 32))
    return ranking.hits(pooled(v.filter("tkey > 0"), v), v.filter("tkey > 0"))


_AB = f"""WITH {VECTORS_SQL}, half AS (SELECT *, e[1:32] AS h, sqrt(list_dot_product(e[1:32], e[1:32])) AS hl FROM n), {pooled_sql()},
other_all AS (SELECT p.frame_id AS probe_id, p.individual_id AS truth, r.individual_id, CAST(round(list_dot_product(p.h, r.h) / (p.hl * r.hl) * 1000000) AS BIGINT) AS score FROM half p JOIN half r ON r.tkey < p.tkey),
other AS (SELECT probe_id, truth, individual_id, max(score) AS score FROM other_all GROUP BY ALL), other_ranked AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, individual_id) AS rank FROM other),
a AS (SELECT probe_id, bool_or(individual_id = truth AND rank <= 1) AS hit FROM pooled_ranked GROUP BY 1), b AS (SELECT probe_id, bool_or(individual_id = truth AND rank <= 1) AS hit FROM other_ranked GROUP BY 1),
both_ AS (SELECT count(*) AS n, count(*) FILTER (a.hit) AS sa, count(*) FILTER (b.hit) AS sb, count(*) FILTER (a.hit AND NOT b.hit) AS b, count(*) FILTER (b.hit AND NOT a.hit) AS c FROM a JOIN b USING (probe_id)),
tail AS (SELECT sum(exp(lgamma(b + c + 1.0) - lgamma(i + 1.0) - lgamma(b + c - i + 1.0) - (b + c) * ln(2))) AS s FROM both_, range(0, 100000) AS r(i) WHERE i <= least(b, c))"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = experiment.all_methods({"whole": _rolling(spark, sf_dir)[1], "half": _half(spark, sf_dir)})
    return experiment.compare(hits, "whole")


@query(f"{_AB} SELECT 'half' AS method, n, sb / n AS recall, b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * s) END, 6) AS p FROM both_, tail UNION ALL SELECT 'whole', n, sa / n, 0, 0, 1 FROM both_")
def method_ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("method", "n", "recall", "b", "c", F.round("p", 6).alias("p"))


_LO = "((s / n + 3.8416 / (2 * n)) - 1.96 * sqrt(s / n * (1 - s / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)"
_HI = _LO.replace("- 1.96", "+ 1.96")


@query(f"{_AB}, r AS (SELECT 'half' AS method, sb AS s, n, CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * s) END AS p FROM both_, tail UNION ALL SELECT 'whole', sa, n, 1 FROM both_) SELECT method, s / n > (SELECT sa / n FROM both_) AND ({_LO} > (SELECT {_HI} FROM (SELECT sa AS s, n FROM both_)) OR p < 0.05) AS adopted FROM r")
def adoption_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.adopt(_compared(spark, sf_dir), "whole").select("method", "adopted")


@query(f"""{_ROLLING}, pairs AS (SELECT p.individual_id, probe_id, ref_id, probe_id % 4 - ref_id % 4 AS interval_months, score FROM pooled p WHERE individual_id = truth),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY individual_id ORDER BY score DESC, probe_id, ref_id) = 1),
mid AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, individual_id) AS k, count(*) OVER () AS n FROM best) WHERE k = n // 2 + 1),
chosen AS (SELECT * FROM (SELECT individual_id, probe_id, ref_id, interval_months, score FROM best WHERE interval_months = 1 ORDER BY score DESC, individual_id LIMIT 4)
 UNION SELECT * FROM (SELECT individual_id, probe_id, ref_id, interval_months, score FROM best WHERE interval_months = 2 ORDER BY score DESC, individual_id LIMIT 3) UNION SELECT individual_id, probe_id, ref_id, interval_months, score FROM mid)
SELECT * FROM chosen ORDER BY score DESC, individual_id LIMIT 8""")
def best_pair_diverse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _rolling(spark, sf_dir)[0].filter("individual_id = truth").select("individual_id", "probe_id", "ref_id", (F.col("probe_id") % 4 - F.col("ref_id") % 4).alias("interval_months"), "score")
    return ranking.diverse_best(own).withColumn("score", _micro())


# ---- registry ------------------------------------------------------------------------------------------------------


@query(f"WITH {REGISTRY_SQL} SELECT frame_id, cohort, individual_id, role, session, date, path_rel, md5, n_sessions, has_recapture FROM registry")
def registry_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy_registry(spark, sf_dir).select("frame_id", "cohort", "individual_id", "role", "session", "date", "path_rel", "md5", "n_sessions", "has_recapture")


@query(f"WITH {REGISTRY_SQL} SELECT individual_id, n_sessions, has_recapture, count(*) AS n FROM registry GROUP BY ALL")
def recapture_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy_registry(spark, sf_dir).groupBy("individual_id", "n_sessions", "has_recapture").agg(F.count("*").alias("n"))


@query(f"WITH {REGISTRY_SQL} SELECT cohort, n_sessions, count(DISTINCT individual_id) AS individuals FROM registry GROUP BY 1, 2")
def sessions_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.sessions_histogram(proxy_registry(spark, sf_dir))


@query(f"WITH {REGISTRY_SQL}, s AS (SELECT cohort, individual_id, count(*) AS n FROM registry GROUP BY 1, 2) SELECT cohort, min(n) AS least, max(n) AS most, round(avg(n), 9) AS mean, quantile_cont(n, 0.5) AS median FROM s GROUP BY 1")
def photos_per_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.photos_per_individual(proxy_registry(spark, sf_dir)).withColumn("mean", F.round("mean", 9))


@query(f"WITH {REGISTRY_SQL} SELECT cohort, count(*) AS frames, count(DISTINCT individual_id) AS individuals, count(DISTINCT CASE WHEN has_recapture THEN individual_id END) AS recaptured FROM registry GROUP BY GROUPING SETS ((cohort), ())")
def eda_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.summary(proxy_registry(spark, sf_dir))


_DEDUP = f"""WITH {FRAMES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY regexp_matches(stem, '^\\d+\\.\\d+$'), CASE WHEN length(regexp_extract(stem, '^(\\d+)', 1)) = 1 THEN 1 ELSE 0 END, stem, path_rel) AS rn FROM frames)"""


@query(f"{_DEDUP} SELECT frame_id, md5, path_rel FROM k WHERE rn = 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.exact_dedup(frames(spark, sf_dir))[0].select("frame_id", "md5", "path_rel")


@query(f'{_DEDUP} SELECT d.path_rel AS "drop", x.path_rel AS keep FROM k d JOIN k x ON d.md5 = x.md5 AND x.rn = 1 WHERE d.rn > 1')
def dedup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.exact_dedup(frames(spark, sf_dir))[1]


_BITS = " + ".join(f"bit_count(xor(CAST('0x' || substr(a.phash, {i}, 8) AS BIGINT), CAST('0x' || substr(b.phash, {i}, 8) AS BIGINT)))" for i in (1, 9))


@query(f"WITH {REGISTRY_SQL}, h AS (SELECT DISTINCT cohort, phash FROM registry) SELECT a.cohort, a.phash AS a, b.phash AS b, CAST({_BITS} AS INTEGER) AS dist FROM h a JOIN h b ON a.cohort = b.cohort AND a.phash < b.phash WHERE {_BITS} <= 6")
def near_dup_pairs_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different hashes; near_dup_members says which frames have them."""
    return near_dup.near_classes(frames(spark, sf_dir))


@query(f"WITH {REGISTRY_SQL}, h AS (SELECT DISTINCT cohort, phash FROM registry) SELECT a.cohort, a.phash AS a, b.phash AS b, CAST({_BITS} AS INTEGER) AS dist FROM h a JOIN h b ON a.cohort = b.cohort AND a.phash < b.phash WHERE {_BITS} <= 6")
def near_dup_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs from an audit to which frames were added in three parts."""
    import uuid

    # read three times
    r = written(frames(spark, sf_dir).select("cohort", "phash", F.pmod(F.xxhash64("frame_id"), F.lit(3)).alias("part")), "frames")
    name = f"audit_{uuid.uuid4().hex}"
    audit = near_dup.Audit(spark, name, f"{folder(spark)}/{name}", buckets=8)
    for k in range(3):
        audit.add(r.filter(F.col("part") == k))
    return audit.pairs()


@query(f"WITH {REGISTRY_SQL} SELECT cohort, path_rel, phash AS hash FROM registry")
def near_dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.members(proxy_registry(spark, sf_dir))


@query(f"WITH {REGISTRY_SQL} SELECT a.cohort, CAST({_BITS} AS INTEGER) AS dist, least(a.path_rel, b.path_rel) AS a, greatest(a.path_rel, b.path_rel) AS b, a.individual_id = b.individual_id AS same_individual FROM registry a JOIN registry b ON a.cohort = b.cohort AND a.path_rel < b.path_rel AND a.md5 <> b.md5 WHERE {_BITS} <= 6")
def near_dup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_pairs(registry.with_identity(frames(spark, sf_dir)))


@query(f"WITH {REGISTRY_SQL} SELECT printf('F%05d', row_number() OVER (ORDER BY cohort, individual_id, date NULLS LAST, path_rel) - 1) AS frame_id, cohort, individual_id, local_id, role, session, date, has_recapture, n_sessions, path_rel, md5, phash FROM registry")
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = registry.with_frame_ids(proxy_registry(spark, sf_dir).drop("frame_id"))
    return registry.to_registry(numbered).select("frame_id", "cohort", "individual_id", "local_id", "role", "session", "date", "has_recapture", "n_sessions", "path_rel", "md5", "phash")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.value_counts(table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = workflows.latencies(table(spark, sf_dir, "events"), "event_type", "value")
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p90")])


# ---- splits --------------------------------------------------------------------------------------------------------

_ROLES = f"""WITH {REGISTRY_SQL}, f AS (SELECT *, min(tkey) OVER (PARTITION BY individual_id) AS t0 FROM registry),
roles AS (SELECT *, CASE WHEN tkey IS NULL THEN 'excluded_nodate' WHEN tkey = t0 THEN 'gallery' ELSE 'probe' END AS split_role,
 CASE WHEN tkey IS NULL OR tkey = t0 THEN 0.0 WHEN cohort = 'PW' THEN CAST(tkey AS INTEGER) - CAST(t0 AS INTEGER)
 ELSE (CAST(substr(tkey, 1, 4) AS INTEGER) * 12 + CAST(substr(tkey, 6, 2) AS INTEGER)) - (CAST(substr(t0, 1, 4) AS INTEGER) * 12 + CAST(substr(t0, 6, 2) AS INTEGER)) END AS interval_months FROM f)"""


@query(f"{_ROLES} SELECT frame_id, tkey, split_role, CAST(interval_months AS DOUBLE) AS interval_months FROM roles")
def earliest_session_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.temporal_roles(proxy_registry(spark, sf_dir)).select("frame_id", "tkey", "split_role", "interval_months")


@query(f"{_ROLES} SELECT cohort, CAST(interval_months AS DOUBLE) AS interval_months, count(*) AS n FROM roles WHERE split_role = 'probe' GROUP BY 1, 2")
def month_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.temporal_roles(proxy_registry(spark, sf_dir)).filter("split_role = 'probe'").groupBy("cohort", "interval_months").agg(F.count("*").alias("n"))


@query(
    f"""{_ROLES} SELECT frame_id, split_role, CAST(interval_months AS DOUBLE) AS interval_months, CASE cohort WHEN 'PW' THEN 'aux' WHEN 'LAB' THEN 'aux' WHEN 'GCN' THEN 'train' ELSE CASE WHEN has_recapture THEN 'eval' ELSE 'distractor' END END AS pool,
    1 AS folds, TRUE AS open_is_right, TRUE AS trained_is_right FROM roles"""
)
def split_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of splits but for what a hash that SQL lacks decides: dev or test, and who is new. Of these, that
    an individual is in one fold, that new ones are of dev or test and lose their gallery, and who may be learned from."""
    s = splits.to_splits(splits.build(proxy_registry(spark, sf_dir)))
    folds = s.groupBy("individual_id").agg(F.count_distinct("split_fold").cast("int").alias("folds"))
    evaluated = F.col("split_fold").isin("dev", "test")
    role = F.when(F.col("split_role") == "open_excluded", "gallery").otherwise(F.col("split_role"))
    open_right = F.when(F.col("is_open_new"), evaluated & (F.col("split_role") != "gallery")).otherwise(F.col("split_role") != "open_excluded")
    trained = F.col("in_train_pool") == F.when(F.col("cohort") == "TK", F.col("split_fold") == "dev").otherwise(F.col("split_fold").isin("train", "aux"))
    return s.join(folds, "individual_id").select("frame_id", role.alias("split_role"), "interval_months", F.when(evaluated, "eval").otherwise(F.col("split_fold")).alias("pool"), "folds", open_right.alias("open_is_right"), trained.alias("trained_is_right"))


@query(f"{_ROLES} SELECT frame_id, CASE cohort WHEN 'PW' THEN 'aux' WHEN 'LAB' THEN 'aux' WHEN 'GCN' THEN 'train' ELSE CASE WHEN has_recapture THEN 'eval' ELSE 'distractor' END END AS pool, cohort IN ('PW', 'LAB', 'GCN') AS always_train FROM roles")
def train_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = splits.build(proxy_registry(spark, sf_dir))
    pool = F.when(F.col("split_fold").isin("dev", "test"), "eval").otherwise(F.col("split_fold"))
    return s.select("frame_id", pool.alias("pool"), (F.col("in_train_pool") & (F.col("cohort") != "TK")).alias("always_train"))


@query(f"WITH {REGISTRY_SQL} SELECT individual_id, max(date) AS date, arg_min(frame_id, frame_id) FILTER (date = m) AS frame_id FROM (SELECT *, max(date) OVER (PARTITION BY individual_id) AS m FROM registry) WHERE m IS NOT NULL GROUP BY 1")
def latest_frame_per_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.latest_per_individual(proxy_registry(spark, sf_dir))


@query(f"WITH {REGISTRY_SQL} SELECT frame_id, coalesce(CAST(replace(date, '-', '') AS BIGINT) * 100, -1) AS strict_key, coalesce(CAST(replace(date, '-', '') AS BIGINT) * 100, CAST(session AS BIGINT), 0) AS legacy_key, coalesce(CAST(replace(date, '-', '') AS BIGINT), 202412) AS shot FROM registry WHERE cohort <> 'LAB' OR date IS NOT NULL")
def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy_registry(spark, sf_dir).select("frame_id", F.coalesce(S.order_key("date", "session"), F.lit(-1)).alias("strict_key"), S.order_key("date", "session", True).alias("legacy_key"), S.shot_key("date", "session").alias("shot"))


@query(f"WITH {REGISTRY_SQL}, s AS (SELECT DISTINCT tkey FROM registry WHERE tkey IS NOT NULL) SELECT tkey AS earlier, lead(tkey) OVER (ORDER BY tkey) AS later, CAST(row_number() OVER (ORDER BY tkey) AS INTEGER) AS session_no FROM s QUALIFY lead(tkey) OVER (ORDER BY tkey) IS NOT NULL")
def session_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gallery.consecutive_sessions(splits.temporal_roles(proxy_registry(spark, sf_dir)))


@query(
    f"""WITH {REGISTRY_SQL}, own AS (SELECT local_id, min(date) AS g, CAST(count(DISTINCT date) AS INTEGER) AS n_sessions FROM registry WHERE cohort = 'LAB' GROUP BY 1),
    d AS (SELECT frame_id, r.date, g, own.n_sessions, CAST(r.date AS DATE) - CAST(g AS DATE) AS days FROM registry r JOIN own USING (local_id) WHERE cohort = 'LAB')
    SELECT frame_id, g AS gallery_session, n_sessions, CASE WHEN days > 0 THEN 'probe' ELSE 'gallery' END AS role, CAST(days AS INTEGER) AS interval_days, round(days / 30.44, 1) AS interval_months,
    CASE WHEN days = 0 THEN NULL WHEN days <= 40 THEN '~1мес' WHEN days <= 95 THEN '2-3мес' ELSE '4-5мес' END AS interval_bin FROM d"""
)
def lab_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cohorts.intervals(frames(spark, sf_dir).filter("cohort = 'LAB'"), "local_id", "date")
    return own.select("frame_id", "gallery_session", "n_sessions", "role", "interval_days", "interval_months", "interval_bin")


# ---- gates, seal, sinks --------------------------------------------------------------------------------------------


def _faulty_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with faults for every gate to find: rows by the number of their photo."""
    key = F.substring("frame_id", 2, 8).cast("long")
    return written(
        proxy_registry(spark, sf_dir).withColumns({
            "individual_id": F.when(key % 97 == 1, F.concat(F.lit("ZZ-"), "local_id")).otherwise(F.col("individual_id")), "has_recapture": F.when(key % 89 != 2, F.col("has_recapture")),
            "role": F.when(key % 83 == 3, "target").otherwise(F.col("role")), "path_rel": F.when(key % 79 == 4, F.concat(F.lit("/"), "path_rel")).otherwise(F.col("path_rel")),
        }), "faulty",
    )


_FAULTY = """faulty AS (SELECT * REPLACE (CASE WHEN key % 97 = 1 THEN 'ZZ-' || local_id ELSE individual_id END AS individual_id, CASE WHEN key % 89 <> 2 THEN has_recapture END AS has_recapture,
    CASE WHEN key % 83 = 3 THEN 'target' ELSE role END AS role, CASE WHEN key % 79 = 4 THEN '/' || path_rel ELSE path_rel END AS path_rel) FROM (SELECT *, CAST(substr(frame_id, 2, 8) AS BIGINT) AS key FROM registry))"""


@query(
    f"""WITH {REGISTRY_SQL}, {_FAULTY}, p AS (SELECT * FROM faulty),
    h AS (SELECT a.path_rel, a.skey FROM p a JOIN p b ON a.cohort = b.cohort AND a.individual_id = b.individual_id AND a.path_rel < b.path_rel AND a.md5 <> b.md5 AND a.skey <> b.skey WHERE {_BITS} <= 6)
    SELECT name, n = 0 AS ok, CAST(n AS VARCHAR) AS detail FROM (
    SELECT 'namespace' AS name, count(*) FILTER (split_part(individual_id, '-', 1) NOT IN ('TK', 'PW', 'LAB', 'GCN')) AS n FROM p
    UNION ALL SELECT 'dates', count(*) FILTER (date IS NOT NULL AND NOT (CAST(substr(date, 1, 4) AS INTEGER) BETWEEN 2024 AND 2026)) FROM p
    UNION ALL SELECT 'unique_md5', count(*) FROM (SELECT md5 FROM p GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'recapture_known', count(*) FILTER (role = 'target' AND has_recapture IS NULL) FROM p
    UNION ALL SELECT 'external', count(*) FILTER (cohort = 'GCN' AND role <> 'external') FROM p
    UNION ALL SELECT 'paths_relative', count(*) FILTER (path_rel LIKE '/%') FROM p
    UNION ALL SELECT 'paths_exist', count(*) FILTER (key % 73 = 5) FROM p
    UNION ALL SELECT 'near_duplicates', count(*) FROM h)"""
)
def gates_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _faulty_registry(spark, sf_dir)
    return gates.registry_gates(r, files=r.filter(F.substring("frame_id", 2, 8).cast("long") % 73 != 5).select("path_rel"), near_pairs=near_dup.own_pairs(r))


@query(
    f"""WITH {REGISTRY_SQL}, t AS (SELECT * FROM registry WHERE cohort IN ('TK', 'PW')) SELECT name, TRUE AS ok, CASE name WHEN 'manifest' THEN '' ELSE CAST(n AS VARCHAR) END AS detail FROM (
    SELECT 'one_fold' AS name, count(*) FILTER (individual_id IS NULL) AS n FROM t UNION ALL SELECT 'train_test_disjoint', 0 UNION ALL SELECT 'dev_test_disjoint', 0 UNION ALL SELECT 'sessions_disjoint', 0
    UNION ALL SELECT 'open_not_in_gallery', 0 UNION ALL SELECT 'deterministic', 0 UNION ALL SELECT 'manifest', 0)"""
)
def gates_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates pass on splits that were built; gates_split_faults has those that don't."""
    r = written(proxy_registry(spark, sf_dir), "registry")
    s = written(splits.to_splits(splits.build(r)), "splits")
    manifest = sealing.seal(s, r)
    return gates.split_gates(s, splits.to_splits(splits.build(r)), sealing.verify(manifest, s, r))


_FAULTY_SPLITS = """s AS (SELECT frame_id, cohort, individual_id, date, session, tkey, CASE WHEN key % 53 = 1 THEN 'dev' WHEN local_id % 3 = 0 THEN 'test' WHEN local_id % 3 = 1 THEN 'dev' ELSE 'train' END AS split_fold,
    CASE WHEN key % 2 = 0 THEN 'gallery' ELSE 'probe' END AS split_role, key % 31 = 3 AS is_open_new, local_id % 3 = 2 OR key % 47 = 2 AS in_train_pool, key FROM (SELECT *, CAST(substr(frame_id, 2, 8) AS BIGINT) AS key FROM registry))"""


def _faulty_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, who = F.substring("frame_id", 2, 8).cast("long"), F.col("local_id")
    fold = F.when(key % 53 == 1, "dev").when(who % 3 == 0, "test").when(who % 3 == 1, "dev").otherwise("train")
    made = {"split_fold": fold, "split_role": F.when(key % 2 == 0, "gallery").otherwise("probe"), "is_open_new": key % 31 == 3, "in_train_pool": (who % 3 == 2) | (key % 47 == 2), "interval_months": F.lit(0.0)}
    return written(splits.to_splits(proxy_registry(spark, sf_dir).withColumns(made)), "faulty")


@query(
    f"""WITH {REGISTRY_SQL}, {_FAULTY_SPLITS} SELECT name, n = 0 AS ok, CAST(n AS VARCHAR) AS detail FROM (
    SELECT 'one_fold' AS name, count(*) AS n FROM (SELECT individual_id FROM s GROUP BY 1 HAVING count(DISTINCT split_fold) > 1)
    UNION ALL SELECT 'train_test_disjoint', count(*) FROM (SELECT individual_id FROM s WHERE in_train_pool INTERSECT SELECT individual_id FROM s WHERE split_fold = 'test')
    UNION ALL SELECT 'dev_test_disjoint', count(*) FROM (SELECT individual_id FROM s WHERE split_fold = 'dev' INTERSECT SELECT individual_id FROM s WHERE split_fold = 'test')
    UNION ALL SELECT 'sessions_disjoint', count(*) FROM (SELECT individual_id, tkey FROM s GROUP BY ALL HAVING bool_or(split_role = 'gallery') AND bool_or(split_role = 'probe'))
    UNION ALL SELECT 'open_not_in_gallery', count(*) FROM s WHERE is_open_new AND split_role = 'gallery'
    UNION ALL SELECT 'deterministic', 2 * count(*) FROM s WHERE key % 61 = 7)
    UNION ALL SELECT 'manifest', FALSE, ''"""
)
def gates_split_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _faulty_splits(spark, sf_dir)
    r = written(proxy_registry(spark, sf_dir), "registry")
    rebuilt = s.withColumn("split_fold", F.when(F.substring("frame_id", 2, 8).cast("long") % 61 == 7, "other").otherwise(F.col("split_fold")))
    manifest = sealing.seal(s, r)
    touched = r.withColumn("md5", F.when(F.col("frame_id") == manifest.frame_ids[0] if manifest.frame_ids else F.lit(True), "0").otherwise(F.col("md5")))
    return gates.split_gates(s, rebuilt, sealing.verify(manifest, s, touched))


@query(f"WITH {REGISTRY_SQL}, n AS (SELECT cohort, least(a, b) AS a, greatest(a, b) AS b, sa, sb FROM (SELECT a.cohort, a.path_rel AS a, b.path_rel AS b, a.skey AS sa, b.skey AS sb FROM registry a JOIN registry b ON a.cohort = b.cohort AND a.individual_id = b.individual_id AND a.path_rel < b.path_rel AND a.md5 <> b.md5 WHERE {_BITS} <= 6)) SELECT a, b FROM n WHERE sa <> sb")
def cross_session_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registry.with_identity(frames(spark, sf_dir))
    return gates.cross_session_pairs(r, near_dup.near_pairs(r))


@query(f"WITH {REGISTRY_SQL} SELECT sha256(string_agg(frame_id || ':' || md5, '|' ORDER BY frame_id)) AS sha256, count(*) AS n_sealed, count(DISTINCT individual_id) AS n_individuals FROM registry")
def sealed_manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sealing.digest(proxy_registry(spark, sf_dir))


@query("SELECT doc_id, 'old' AS version FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 3 = 0")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    return tables.upsert(d.withColumn("version", F.lit("old")), d.filter("doc_id % 3 = 0").withColumn("version", F.lit("new")), "doc_id")


@query(f"WITH {REGISTRY_SQL} SELECT frame_id, cohort FROM registry WHERE cohort IN ('TK', 'PW') OR md5 LIKE 'a%'")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = proxy_registry(spark, sf_dir).select("frame_id", "cohort", "md5")
    return registry.union_distinct("frame_id", r.filter("cohort in ('TK', 'PW')"), r.filter("md5 like 'a%'")).select("frame_id", "cohort")


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderdate < DATE '1997-01-01' INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-01-01'")
def id_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderdate")
    return gates.overlap(o.filter("o_orderdate < date'1997-01-01'"), o.filter("o_orderdate >= date'2001-01-01'"), "id")


# ---- parsers -------------------------------------------------------------------------------------------------------

_MMYY = "strftime(o_orderdate, '%m%y')"
_TK_PATH = f"""CASE o_orderkey % 5 WHEN 0 THEN printf('%d (error)/%02d-2-%s.JPG', o_custkey, o_custkey % 100, {_MMYY}) WHEN 1 THEN printf('%d/%02d-2-0%s.jpg', o_custkey, o_custkey % 100, {_MMYY})
 WHEN 2 THEN printf('%d/extra from %s/IMG_%d.png', o_custkey, {_MMYY}, o_orderkey) WHEN 3 THEN printf('%d/IMG_%d.jpeg', o_custkey, o_orderkey) ELSE printf('x%d/%02d-2-%s.jpg', o_custkey, o_custkey % 100, {_MMYY}) END"""


def _tk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cust, key, two, mmyy = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_custkey") % 100, F.date_format("o_orderdate", "MMyy")
    forms = [
        F.format_string("%d (error)/%02d-2-%s.JPG", cust, two, mmyy), F.format_string("%d/%02d-2-0%s.jpg", cust, two, mmyy),
        F.format_string("%d/extra from %s/IMG_%d.png", cust, mmyy, key), F.format_string("%d/IMG_%d.jpeg", cust, key),
    ]
    path = F.format_string("x%d/%02d-2-%s.jpg", cust, two, mmyy)
    for i, f in enumerate(forms):
        path = F.when(key % 5 == i, f).otherwise(path)
    return o.select(key.alias("frame"), path.alias("path_rel"))


@query(
    f"""WITH p AS (SELECT o_orderkey AS frame, {_TK_PATH} AS path_rel, o_orderkey % 5 AS form, o_custkey, {_MMYY} AS m FROM orders)
    SELECT frame, CASE form WHEN 0 THEN 20 ELSE CAST(o_custkey AS INTEGER) END AS local_id, CASE WHEN form IN (0, 1) THEN '2' END AS session,
    CASE WHEN form IN (0, 2) THEN '20' || substr(m, 3, 2) || '-' || substr(m, 1, 2) END AS date, CASE form WHEN 0 THEN 'filename' WHEN 1 THEN 'filename_baddate' WHEN 2 THEN 'subfolder' ELSE 'none' END AS date_source FROM p WHERE form < 4"""
)
def parse_field_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.field_cohort(_tk_paths(spark, sf_dir)).select("frame", "local_id", "session", "date", "date_source")


@query("SELECT o_orderkey AS frame, CAST(o_custkey AS INTEGER) AS local_id, CASE WHEN o_orderkey % 3 > 0 THEN CAST(quarter(o_orderdate) AS VARCHAR) END AS session, 'session_code' AS date_source FROM orders")
def parse_session_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    path = F.when(F.col("o_orderkey") % 3 > 0, F.format_string("%d/%d-%02d (%d).jpg", F.col("o_custkey"), F.col("o_custkey"), F.quarter("o_orderdate"), F.col("o_orderkey"))).otherwise(F.format_string("%d/x%d.jpg", F.col("o_custkey"), F.col("o_orderkey")))
    return cohorts.session_cohort(o.select(F.col("o_orderkey").alias("frame"), path.alias("path_rel"))).select("frame", "local_id", "session", "date_source")


@query("SELECT o_orderkey AS frame, CAST(o_custkey AS INTEGER) AS local_id, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%Y-%m-%d') AS session FROM orders WHERE o_orderkey % 7 > 1")
def parse_dated_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day, key = F.date_format("o_orderdate", "dd.MM.yyyy"), F.col("o_orderkey")
    path = F.when(key % 7 == 0, F.format_string("misc/%d.jpg", key)).when(key % 7 == 1, F.format_string("%s/x%d.jpg", day, key)).when(key % 7 == 2, F.format_string("%s/%d.%d.jpg", day, F.col("o_custkey"), key % 3)).otherwise(F.format_string("%s/%d.jpg", day, F.col("o_custkey")))
    return cohorts.dated_cohort(o.select(key.alias("frame"), path.alias("path_rel"))).select("frame", "local_id", "date", "session")


@query("SELECT o_orderkey AS frame, CAST(o_custkey AS INTEGER) AS local_id, 's' || quarter(o_orderdate) AS survey, CAST(o_orderkey % 3 AS VARCHAR) AS recapture FROM orders WHERE o_orderkey % 4 > 0")
def parse_external_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    meta = o.select(F.col("o_orderkey").alias("frame"), F.col("o_custkey").cast("string").alias("identity"), F.format_string("%d.jpg", F.col("o_orderkey")).alias("file_name"), F.concat(F.lit("s"), F.quarter("o_orderdate").cast("string")).alias("survey"), (F.col("o_orderkey") % 3).cast("string").alias("recapture_id"))
    files = meta.filter("frame % 4 > 0").select(F.concat_ws("/", F.lit("Raw_Data"), "identity", "file_name").alias("path_rel"))
    return cohorts.external_cohort(meta, files).select("frame", "local_id", cohorts.note("notes", "survey").alias("survey"), cohorts.note("notes", "recapture_id").alias("recapture"))


# ---- statistics ----------------------------------------------------------------------------------------------------

_LABELLED = "l AS (SELECT d.doc_id, lang, n_chars, quality, toxic FROM documents d JOIN labels USING (doc_id))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


@query(f"WITH {_LABELLED}, c AS (SELECT lang, count(*) AS n, sum(quality) AS s FROM l GROUP BY 1) SELECT lang, n, s / n AS p, round({_LO}, 9) AS lo, round({_HI}, 9) AS hi FROM c")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _labelled(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("s")).withColumn("w", wilson(F.col("s"), F.col("n")))
    return c.select("lang", "n", "w.p", F.round("w.lo", 9).alias("lo"), F.round("w.hi", 9).alias("hi"))


@query(
    f"""WITH {_LABELLED}, c AS (SELECT lang, count(*) FILTER (quality = 0 AND toxic = 1) AS b, count(*) FILTER (quality = 1 AND toxic = 1) AS c FROM l GROUP BY 1)
    SELECT lang, b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(b + c + 1.0) - lgamma(i + 1.0) - lgamma(b + c - i + 1.0) - (b + c) * ln(2))) FROM range(0, 100000) AS r(i) WHERE i <= least(b, c))) END, 6) AS p FROM c"""
)
def mcnemar_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _labelled(spark, sf_dir).groupBy("lang").agg(F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("b"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("c"))
    return c.select("lang", "b", "c", F.round(mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


_STEPS = [0.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0, 1e9]
_SWEEP = f"WITH {_LABELLED}, t AS (SELECT CAST(unnest({_STEPS}) AS DOUBLE) AS t), sw AS (SELECT t, count(*) AS n, sum(quality) / count(*) AS recall FROM t JOIN l ON n_chars >= t GROUP BY 1 HAVING count(*) >= 5)"


@query(f"{_SWEEP} SELECT t, n, recall FROM sw")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.threshold_sweep(_labelled(spark, sf_dir), "n_chars", "quality", _STEPS)


_GRID = {"lang": ["de", "en", "es", "fr"], "least": [0, 400, 1600], "most": [6400, 1_000_000_000]}
_GRID_SQL = f"""WITH {_LABELLED}, g AS (SELECT CAST(row_number() OVER (ORDER BY li, a, b) - 1 AS BIGINT) AS config_no, lang, a AS least, b AS most FROM (VALUES (0, 'de'), (1, 'en'), (2, 'es'), (3, 'fr')) x(li, lang), (VALUES (0), (400), (1600)) y(a), (VALUES (6400), (1000000000)) z(b)),
r AS (SELECT config_no, g.lang, least, most, count(doc_id) AS n, coalesce(sum(quality) / count(doc_id), 0) AS recall FROM g LEFT JOIN l ON l.lang = g.lang AND n_chars BETWEEN least AND most GROUP BY ALL)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages share what is prepared; bounds of the length are run over it."""
    rows = _labelled(spark, sf_dir)
    run = lambda own, lang, least, most: own.filter(F.col("n_chars").between(least, most)).agg(F.count("*").alias("n"), F.coalesce(F.sum("quality") / F.count("*"), F.lit(0.0)).alias("recall"))
    return experiment.run_grid(spark, lambda lang: rows.filter(F.col("lang") == lang), run, _GRID, ["lang"])


@query(f"{_GRID_SQL} SELECT * FROM r")
def config_grid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


@query(f"{_GRID_SQL} SELECT * FROM r ORDER BY recall DESC, config_no LIMIT 1")
def config_grid_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.best_config(_grid(spark, sf_dir))


@query("SELECT vec_id AS frame_id, round(sqrt(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 6) AS length, 1.0 AS self FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").withColumn("u", S.normalised("embedding"))
    return v.select(F.col("vec_id").alias("frame_id"), F.round(F.sqrt(S.cosine("embedding", "embedding")), 6).alias("length"), F.round(S.cosine("u", "u"), 6).alias("self"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points under a known affine map, every fifth moved away, in pairs of a hundred."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.pmod(F.xxhash64("p_partkey"), F.lit(1000)).cast("double").alias("x"), F.pmod(F.xxhash64("p_partkey", F.lit(1)), F.lit(1000)).cast("double").alias("y"))
    off = F.when(F.col("p_partkey") % 5 == 0, 400.0).otherwise(0.0)
    rows = p.select(F.expr("p_partkey div 100").alias("pair"), F.struct(F.col("x").alias("ax"), F.col("y").alias("ay"), (1.1 * F.col("x") - 0.2 * F.col("y") + 30 + off).alias("bx"), (0.3 * F.col("x") + 0.9 * F.col("y") - 10 - off).alias("by")).alias("m"))
    return rows.groupBy("pair").agg(F.array_sort(F.collect_list("m")).alias("matches"))


@query("SELECT p_partkey // 100 AS pair, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (p_partkey % 5 > 0) AS INTEGER) AS inliers, CAST(count(*) FILTER (p_partkey % 5 > 0) AS INTEGER) AS marked, 1.1 AS a, -0.2 AS b, 30.0 AS c, 0.3 AS d, 0.9 AS e, -10.0 AS f FROM part GROUP BY 1")
def affine_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.verified(_matched(spark, sf_dir))
    return found.select("pair", F.size("matches").alias("n"), "inliers", F.size(F.filter("mask", lambda m: m)).alias("marked"), *[F.round(F.col("model")[i], 6).alias(c) for i, c in enumerate("abcdef")])


_NEW = [("", 1), (None, 2), ("L1", 3), ("Otto", 4), ("Otto", 5), ("Otto", 6), ("L2 (2)", 7), ("L2", 8), ("  ", 9), (" L1 ", 10)]


@query(
    f"""WITH RECURSIVE {VECTORS_SQL}, c AS (SELECT DISTINCT 'L' || individual_id AS individual_id FROM v UNION SELECT * FROM (VALUES ('Otto'), ('Otto (2)'))),
    q AS (SELECT row_number() OVER (ORDER BY f) AS i, CASE WHEN trim(coalesce(n, '')) = '' THEN 'NEW-' || row_number() OVER (ORDER BY f) ELSE trim(n) END AS b FROM (VALUES {", ".join(f"({'NULL' if n is None else repr(n)}, {f})" for n, f in _NEW)}) t(n, f)),
    go AS (SELECT CAST(0 AS BIGINT) AS i, list(individual_id) AS used, CAST(NULL AS VARCHAR) AS got FROM c
     UNION ALL SELECT i, list_append(used, g), g FROM (SELECT q.i, used, CASE WHEN NOT list_contains(used, b) THEN b ELSE list_filter(list_transform(range(2, 100), lambda k: b || ' (' || k || ')'), lambda x: NOT list_contains(used, x))[1] END AS g FROM go JOIN q ON q.i = go.i + 1))
    SELECT individual_id, count(*) AS n FROM (SELECT individual_id FROM c UNION ALL SELECT got FROM go WHERE got IS NOT NULL) GROUP BY 1"""
)
def register_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vectors(spark, sf_dir).select(F.concat(F.lit("L"), F.col("individual_id").cast("string")).alias("individual_id")).distinct().withColumn("frame_id", F.lit(0).cast("long"))
    own = own.unionByName(spark.createDataFrame([("Otto", 0), ("Otto (2)", 0)], "individual_id string, frame_id long"))
    return catalog.register(own, spark.createDataFrame(_NEW, "name string, frame_id long")).groupBy("individual_id").agg(F.count("*").alias("n"))


from resight.plans import more_queries  # noqa: E402, F401  (registers its own)
from resight.plans import photo_queries, retrieval_queries  # noqa: E402, F401
