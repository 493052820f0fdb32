"""Readers and writers of the engine's tables, with explicit schemas."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header; '' is null. Columns that aren't asked for aren't parsed."""
    df = spark.read.schema(schema).option("header", "true").option("nullValue", "").csv(path)
    return df.select(*columns) if columns else df


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON document."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def write_csv(df: DataFrame, path: str, order: list | None = None) -> None:
    """With a header; sorted across files if an order is given."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", "true").csv(path)


def write_json(spark: SparkSession, record: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(record, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str = "frame_id") -> DataFrame:
    """Old rows whose key isn't in new, and the new rows; of new rows that repeat a key, the least by its other columns."""
    others = [c for c in new.columns if c != key]
    one = new.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(key, "_row.*") if others else new.distinct()
    return old.join(one.select(key), key, "left_anti").unionByName(one.select(*new.columns), allowMissingColumns=True)


def without(rows: DataFrame, removed: DataFrame, key: str = "frame_id") -> DataFrame:
    return rows.join(removed.select(key), key, "left_anti")


def cached(spark: SparkSession, path: str, make, key: str) -> DataFrame:
    """A table by content key: read if it was written whole, else made and written."""
    at = f"{path}/{key}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def content_key(rows: DataFrame, digest: str = "md5", *names: str) -> str:
    """A key of a set of rows by their digests and the names of what is derived, so changed inputs miss the cache."""
    row = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(digest).cast("decimal(38,0)")).alias("h")).first()
    return "-".join([*names, str(row["n"]), str(row["h"] or 0).lstrip("-")])


def in_batches(rows: DataFrame, work, path: str, key: str, batches: int, seconds: float) -> tuple[DataFrame, bool]:
    """(work(rows) as far as it came, whether it is complete): in batches by a hash of the key, each written when done,
    until the time is up. A batch that is written already for the same rows is not done again."""
    end = time.monotonic() + seconds
    done, whole = None, True
    for k in range(batches):
        if time.monotonic() >= end:
            whole = False
            break
        own = rows.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == k)
        state = own.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*own.columns).cast("decimal(38,0)")).alias("h")).first()
        made = cached(rows.sparkSession, path, lambda own=own: work(own), f"batch-{batches}-{k}-{state['n']}-{state['h'] or 0}")
        done = made if done is None else done.unionByName(made)
    return (done if done is not None else work(rows.limit(0))), whole


def delete_files(spark: SparkSession, folder: str, names: DataFrame, suffix: str = "") -> int:
    """Delete the files folder/<name><suffix> of a column of names, which may have folders in them; how many there were.

    One listing of the folder is joined with the names, so only files that exist are deleted, one by one.
    """
    from resight.sources.images import below

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", below(F.col("path"), folder).alias("_file"))
    doomed = files.join(names.select(F.concat(F.col(names.columns[0]).cast("string"), F.lit(suffix)).alias("_file")).distinct(), "_file", "left_semi").select("path")
    n, hadoop = 0, spark._jvm.org.apache.hadoop.fs
    for row in doomed.toLocalIterator():
        at = hadoop.Path(row["path"])
        n += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False))
    return n
