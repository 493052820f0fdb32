"""Workflows over the operators: ingest, evaluation, diagnostics. Each returns lazy tables or small records."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.functions import scalars as S
from resight.operators import experiment, gallery, matching, metrics, near_dup, openset, ranking, registry, vision
from resight.operators.scoring import ScoreBlock, cosine_block, pairwise, pooled
from resight.scratch import written
from resight.sources import cohorts, images, tables


def ingest(spark: SparkSession, folders: dict[str, str], metadata: DataFrame | None = None, hashes: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(registry, dropped duplicates, near-duplicate pairs or None) of cohort folders by name. metadata: of the external cohort.

    Recapture statistics are taken before and after exact de-duplication, as dropped frames may be an individual's
    only ones of a session.
    """
    parts, photos = [], None
    for name, folder in folders.items():
        files = images.list_images(spark, folder, content=True)
        own = images.pixels(spark, folder).select((F.concat(F.lit(f"{name}/"), "path_rel")).alias("frame_id"), "image")
        photos = own if photos is None else photos.unionByName(own)
        records = images.base_records(files)
        parsed = cohorts.parse(name, records, metadata)
        parts.append(parsed.withColumn("path_rel", F.concat(F.lit(f"{name}/"), "path_rel")))
    frames = registry.with_recapture(registry.with_identity(registry.union_cohorts(*parts)))
    kept, dropped = registry.exact_dedup(frames)
    pairs = None
    if hashes:
        marked = vision.phashes(photos).select(F.col("frame_id").alias("path_rel"), "phash")
        kept = kept.drop("phash").join(marked, "path_rel", "left")
        pairs = near_dup.near_pairs(kept)
    kept = registry.with_frame_ids(registry.with_recapture(kept))
    return registry.to_registry(kept.withColumn("phash", F.coalesce("phash", F.lit(""))) if hashes else kept), dropped, pairs


def evaluate_mode(probes: DataFrame, refs: DataFrame, rolling: bool, payload: str = "emb", score: ScoreBlock = cosine_block, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(report row, hits) of probes against all earlier frames, or against one reference session."""
    scores = pooled(probes, refs, payload, strictly_earlier=rolling, score=score)
    hits = ranking.hits(scores, probes, keep=keep)
    return metrics.report(hits), hits


def evaluate(frames: DataFrame, cohort: str, fold: str = "dev", payload: str = "emb", score: ScoreBlock = cosine_block, threshold: float | None = None) -> dict:
    """The record of one cohort: both modes, recall by interval, random baseline, and the open set where there is one.

    The open-set threshold is an argument; without it, it is fitted on these probes, which the record says.
    """
    c = gallery.slice_cohort(frames, cohort, fold)
    keep = ("interval_months",) if "interval_months" in frames.columns else ()
    out: dict = {"cohort": cohort, "random_top1": metrics.random_baseline(c.refs_all).first()[0], "modes": {}}
    for mode, refs in (("single", c.gallery_single), ("rolling", c.refs_all)):
        report, hits = evaluate_mode(c.known_probe, refs, mode == "rolling", payload, score, keep)
        out["modes"][mode] = report.first().asDict(recursive=True)
        if keep:
            out["modes"][mode]["by_interval"] = {r["interval_months"]: (r["n"], r["recall"]) for r in metrics.recall_by(hits, "interval_months").collect()}
    best = lambda probes: pooled(probes, c.refs_all, payload, score=score).groupBy("probe_id").agg(F.max("score").alias("score"))
    if not c.new_probe.isEmpty():
        known, new = best(c.known_probe), best(c.new_probe)
        fitted = threshold is None
        t = openset.youden(known, new).first()["threshold"] if fitted else threshold
        out["open_set"] = metrics.open_set(known, new, t).first().asDict() | {"threshold": t, "fitted_here": fitted}
    return out


def lab_summary(benchmark: DataFrame) -> DataFrame:
    """One row: frames, individuals, recaptured and single-session individuals, probes by interval bin (a map)."""
    bins = benchmark.filter("role = 'probe'").groupBy("interval_bin").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("interval_bin", "n")))).alias("bins"))
    own = benchmark.agg(F.count("*").alias("frames"), F.count_distinct("individual_id").alias("individuals"), F.count_distinct(F.when(F.col("n_sessions") >= 2, F.col("individual_id"))).alias("recaptured"))
    return own.withColumn("single_session", F.col("individuals") - F.col("recaptured")).crossJoin(bins)


def completed_recall(hits: DataFrame, completed: DataFrame, ks: tuple[int, ...] = ranking.KS) -> DataFrame:
    """The report of probes that were done, for scores that were stopped early. completed: probe_id."""
    return metrics.report(hits.join(completed.select("probe_id"), "probe_id", "left_semi"), ks)


def pair_cost(score: Callable[[object, object], float], pairs: Iterable[tuple[object, object]], most: int = 10) -> float:
    """Seconds a pair over the first few."""
    n, began = 0, time.perf_counter()
    for a, b in pairs:
        score(a, b)
        n += 1
        if n >= most:
            break
    return (time.perf_counter() - began) / n if n else float("nan")


def self_match(frames: DataFrame, score: Callable[[object, object], float], payload: str, most: int = 3) -> dict:
    """Scores of a few frames against themselves; a matcher that gives zero is broken and nothing else is tried with it."""
    rows = frames.orderBy("frame_id").limit(most).collect()
    values = [r[payload].asDict(recursive=True) if hasattr(r[payload], "asDict") else r[payload] for r in rows]
    found = [score(v, v) for v in values]
    return {"scores": found, "broken": not found or min(found) <= 0}


def diagnose(spark: SparkSession, name: str, probes: DataFrame, refs: DataFrame, baseline: DataFrame, payload: str, path: str, seconds: float, least_seconds_per_pair: float, batches: int = 8, **options: object) -> dict:
    """A learned matcher against a baseline's hits on the same probes, under a time budget: what a pair costs, whether it
    matches frames with themselves, the recall of the probes that were done, and the rule that was fixed before.

    Probes are scored in batches that are kept below path, so a second run goes on where the first one stopped.
    """
    score = matching.build(name, **options)
    some = probes.orderBy("frame_id").limit(10).select(payload).collect()
    cost = pair_cost(score, [(a[0], b[0]) for a in some for b in some][:10])
    checked = self_match(probes, score, payload)
    out = {"matcher": name, "ms_per_pair": cost * 1000, "self_match": checked["scores"], "broken": checked["broken"]}
    if checked["broken"]:
        return out | {"decision": "broken"}
    work = lambda own: pooled(own, refs, payload, strictly_earlier=False, score=pairwise(score))
    scores, whole = tables.in_batches(probes, work, path, "frame_id", batches, seconds)
    scores = written(scores, "diagnosed")
    done = scores.select("probe_id").distinct()
    hits = ranking.hits(scores, probes.join(done, F.col("frame_id") == F.col("probe_id"), "left_semi"))
    report = metrics.report(hits).first().asDict(recursive=True)
    both = experiment.all_methods({name: hits.select("probe_id", "hit_1"), "baseline": baseline.join(done, "probe_id", "left_semi").select("probe_id", "hit_1")})
    compared = written(experiment.compare(both, "baseline"), "compared")
    decision = experiment.decide(compared, name, "baseline", cost, least_seconds_per_pair) if report["n_probe"] else "no_time"
    return out | {"n_done": report["n_probe"], "complete": whole, "recall": {k: report[f"micro_{k}"] for k in ranking.KS}, "p": next((r["p"] for r in compared.collect() if r["method"] == name), None), "decision": decision}


def latencies(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, mean, median, p90 (linear between neighbours), n of a column of times; groups without a time are left out."""
    some = rows.filter(F.col(value).isNotNull())
    means = some.groupBy(by).agg(F.avg(F.col(value).cast("double")).alias("mean"))
    found = openset.grouped_quantiles(some, by, value, {"median": 0.5, "p90": 0.9}).withColumnRenamed(by, "_by")
    return means.join(found, F.col(by).eqNullSafe(F.col("_by"))).select(by, "mean", "median", "p90", "n")


def latency(spark: SparkSession, steps: dict[str, Callable[[object], object]], items: Iterable[object]) -> DataFrame:
    """step, mean, median, p90, n: milliseconds of each step over the items, one after the other, as a user waits for them."""
    took = []
    for x in items:
        for step, work in steps.items():
            began = time.perf_counter()
            work(x)
            took.append((step, (time.perf_counter() - began) * 1000))
    return latencies(spark.createDataFrame(took, "step string, ms double"), "step", "ms")


def with_session_distance(probes: DataFrame, scores: DataFrame, refs: DataFrame) -> DataFrame:
    """Own best pairs of each probe with the months between them, for examples and overlays."""
    dates = lambda x: x.select(F.col("frame_id"), F.col("date"))
    own = scores.filter("individual_id = truth").join(dates(probes).toDF("probe_id", "probe_date"), "probe_id").join(dates(refs).toDF("ref_id", "ref_date"), "ref_id")
    return own.withColumn("interval_months", S.month_gap("ref_date", "probe_date"))
