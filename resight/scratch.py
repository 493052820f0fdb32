"""Intermediate tables in the cluster's shared folder: they cut lineage, and a lost executor costs only its tasks."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
#: Shuffle files go as soon as what was written from them is there, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """This session's folder below spark.checkpoint.dir; where that is unset, below Spark's warehouse, on one machine only."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        _folders[app] = f"{base.rstrip('/')}/resight-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(drop_all, spark)
    return _folders[app]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_all(spark: SparkSession) -> None:
    """Delete what written() wrote in this session; DataFrames built on it can't be read any more."""
    try:
        root = _folders.pop(spark.sparkContext.applicationId, None)
        if root:
            _delete(spark, root)
    except Exception:  # the session may be gone already; then its folder stays, as any checkpoint does
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the scratch folder and read it back."""
    path, conf = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex[:8]}", df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)
