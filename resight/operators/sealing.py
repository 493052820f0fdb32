"""Sealed folds: a manifest with a digest over the sealed frames, a guard before any read, and the one-time unseal.

The manifest is a small JSON document that is read and written through Spark, so it may lie in any store that Spark
reads. The digest is a SHA-256 over "frame_id:md5" of all sealed frames in order: ranges are sorted in parallel and
pass through the hash one after the other, so nowhere more than one of them is held. The ids stand in the manifest
while they are few; the digest covers them in any case. With a folder beside the manifest, the ids and the leaves of a
hash tree (hashtree.py) are tables there, and the manifest has the tree's root: then frames are verified where they lie.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.operators import hashtree
from resight.scratch import written
from resight.sources.tables import upsert

SEALED_FOLDS = ("test",)
#: Frames whose ids stand in the manifest.
LISTED = 100_000


class SealedError(RuntimeError):
    """Sealed data was asked for without right."""


@dataclass
class Manifest:
    sealed_folds: list[str]
    n_sealed: int
    n_individuals: int
    frame_ids: list[str]
    sha256: str
    sealed: bool = True
    opened: bool = False
    note: str = ""
    opened_date: str | None = None
    extra: dict = field(default_factory=dict)


def digest(frames: DataFrame) -> DataFrame:
    """One row: sha256, n_sealed, n_individuals."""
    ordered = written(frames.select("frame_id", F.concat_ws(":", "frame_id", "md5").alias("e")).repartitionByRange("frame_id").sortWithinPartitions("frame_id", "e").withColumn("part", F.spark_partition_id()), "sealed")
    sha, between = hashlib.sha256(), b""
    for k in [r[0] for r in ordered.select("part").distinct().orderBy("part").collect()]:  # a row for each range
        # a range of a sorted table, in the order it was written in
        for row in ordered.filter(F.col("part") == k).sort("frame_id", "e").toLocalIterator():
            sha.update(between + row["e"].encode())
            between = b"|"
    counts = frames.agg(F.count("*").alias("n_sealed"), F.count_distinct("individual_id").alias("n_individuals"))
    return counts.select(F.lit(sha.hexdigest()).alias("sha256"), "n_sealed", "n_individuals")


def sealed_frames(splits: DataFrame, registry: DataFrame, folds: tuple[str, ...] = SEALED_FOLDS) -> DataFrame:
    own = splits.filter(F.col("split_fold").isin(*folds)).select("frame_id", "individual_id")
    return own.join(registry.select("frame_id", "md5"), "frame_id", "left")


def _entries(frames: DataFrame) -> DataFrame:
    return frames.select("frame_id", F.concat_ws(":", "frame_id", "md5").alias("e"))


def seal(splits: DataFrame, registry: DataFrame, folds: tuple[str, ...] = SEALED_FOLDS, note: str = "", beside: str | None = None) -> Manifest:
    """beside: a folder for the tables frame_ids and leaves, which must not be there yet."""
    frames = sealed_frames(splits, registry, folds)
    frames = written(frames, "sealed_frames")
    row = digest(frames).first()
    ids = [r[0] for r in frames.select("frame_id").orderBy("frame_id").collect()] if row["n_sealed"] <= LISTED else []
    extra = {}
    if beside is not None:
        frames.select("frame_id").repartitionByRange("frame_id").sortWithinPartitions("frame_id").write.parquet(f"{beside}/frame_ids")
        hashtree.leaves(_entries(frames), "frame_id", "e").write.parquet(f"{beside}/leaves")
        extra = {"root": hashtree.root(frames.sparkSession.read.parquet(f"{beside}/leaves")), "leaves": f"{beside}/leaves", "frame_ids": f"{beside}/frame_ids"}
    return Manifest(list(folds), row["n_sealed"], row["n_individuals"], ids, row["sha256"], note=note, extra=extra)


def verify(manifest: Manifest, splits: DataFrame, registry: DataFrame) -> bool:
    """Whether the sealed frames are those of the manifest: by the tree's root if it has one, else by the digest."""
    frames = sealed_frames(splits, registry, tuple(manifest.sealed_folds))
    if "root" in manifest.extra:
        return hashtree.same(_entries(frames), "frame_id", "e", frames.sparkSession.read.parquet(manifest.extra["leaves"]), manifest.extra["root"])
    return digest(frames).first()["sha256"] == manifest.sha256


def changed_ranges(manifest: Manifest, splits: DataFrame, registry: DataFrame) -> DataFrame:
    """leaf, low, high, n, n_now of the ranges of sealed frames that aren't as they were; of a manifest with a tree."""
    frames = sealed_frames(splits, registry, tuple(manifest.sealed_folds))
    return hashtree.changed(_entries(frames), "frame_id", "e", frames.sparkSession.read.parquet(manifest.extra["leaves"]))


def write_manifest(spark: SparkSession, manifest: Manifest, path: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(manifest)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    return Manifest(**json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())))


def assert_unsealed(stage: str, unseal: bool = False, manifest: Manifest | None = None, splits: DataFrame | None = None, registry: DataFrame | None = None) -> None:
    """Refuse the sealed stage unless asked for; then hold the data against the manifest, if both are there."""
    if stage not in SEALED_FOLDS:
        return
    if not unseal:
        raise SealedError(f"{stage} is sealed")
    if manifest is not None and splits is not None and registry is not None and not verify(manifest, splits, registry):
        raise SealedError("the splits do not match the manifest")


def load_split(stage: str, registry: Callable[[], DataFrame], splits: Callable[[], DataFrame], unseal: bool = False, manifest: Manifest | None = None) -> DataFrame:
    """Registry and splits of one fold. The tables come as functions, so the guard runs before any read."""
    if stage in SEALED_FOLDS and not unseal:
        raise SealedError(f"{stage} is sealed")
    r, s = registry(), splits()
    assert_unsealed(stage, unseal, manifest, s, r)
    own = [c for c in ("split_role", "split_fold", "interval_months", "is_open_new", "in_train_pool") if c in s.columns]
    return r.join(s.select("frame_id", *own), "frame_id", "left").filter(F.col("split_fold") == stage)


def opened(manifest: Manifest, date: str) -> Manifest:
    return Manifest(**(asdict(manifest) | {"opened": True, "opened_date": date}))


def unseal_once(manifest: Manifest, splits: DataFrame, registry: DataFrame, evaluate: Callable[[], dict], date: str, prepare: Callable[[], None] = lambda: None) -> tuple[dict, Manifest]:
    """Verify, refuse a second time, prepare, evaluate; only after success the manifest counts as opened."""
    if manifest.opened:
        raise SealedError(f"opened on {manifest.opened_date}")
    if not verify(manifest, splits, registry):
        raise SealedError("the splits do not match the manifest")
    prepare()
    result = evaluate()
    return result, opened(manifest, date)


def rehearse(manifest: Manifest, splits: DataFrame, registry: DataFrame, files: DataFrame, path: str = "path_rel", readable: Column | None = None, mask: Callable[[], object] | None = None, crops: DataFrame | None = None) -> dict[str, bool]:
    """What can be checked before the unseal, without looking at results: digest, files, rows for all sealed ids.

    readable: a condition on a row of files that can be opened. mask: segments one unsealed photo; two runs must agree.
    crops: the manifest of crops, to which one dummy row of a sealed frame must be appended without repeating an id.
    """
    own = sealed_frames(splits, registry, tuple(manifest.sealed_folds)).select("frame_id")
    paths = registry.join(own, "frame_id", "left_semi").select(path)
    there = files if readable is None else files.filter(readable)
    out = {
        "not_opened": not manifest.opened,
        "digest": verify(manifest, splits, registry),
        "files": paths.join(there.select(path), path, "left_anti").isEmpty(),
        "registered": own.join(registry, "frame_id", "left_anti").isEmpty(),
    }
    if mask is not None:
        out["mask_deterministic"] = bool(np.array_equal(np.asarray(mask()), np.asarray(mask())))
    if crops is not None:
        dummy = own.limit(1)
        grown = upsert(crops, dummy).groupBy("frame_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
        kept = crops.join(dummy, "frame_id", "left_anti").count()
        out["append"] = (grown["rows"] or 0) == kept + 1 and grown["most"] == 1
    return out


def final_record(reports: dict[str, dict], baselines: dict[str, dict], manifest: Manifest) -> dict:
    """The figures of the unsealed evaluation in one record, with the interval's ends by name."""
    rolling = reports.get("rolling", {})
    return {
        "recall": {k: v for k, v in rolling.items() if k.startswith("micro_")},
        "macro": {k: v for k, v in rolling.items() if k.startswith("macro_")},
        "ci95": dict(zip(("p", "lo", "hi"), rolling.get("wilson_1", (None,) * 3), strict=True)),
        "single": reports.get("single", {}),
        "open_set": reports.get("open_set", {}),
        "baselines": baselines,
        "n_sealed": manifest.n_sealed,
        "sha256": manifest.sha256,
        "opened_date": manifest.opened_date,
    }
