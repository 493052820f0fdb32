"""A hash tree over keyed rows: leaves by key range, hashed where they lie, and a root that stands for all.

Rows in order are cut into leaves of LEAF rows; a leaf is named by its first key and has a SHA-256 of its rows, one after
the other. FAN leaves make a node, whose hash is that of theirs, and so on up to one root. Leaves are a table. To verify,
rows are dealt to the ranges that the table says, hashed again in streams, and compared: only the root reaches the driver.
A leaf that differs names the range of keys in which something changed, came or went.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resight.operators.registry import numbered
from resight.scratch import written

#: Rows of a leaf, and children of a node.
LEAF, FAN = 1 << 16, 256


def _hashed(rows: DataFrame) -> DataFrame:
    """leaf, n, sha256 from rows (leaf, key, entry): a leaf's rows are in one task, and pass it as a stream."""
    ordered = rows.select("leaf", "key", "entry").repartition("leaf").sortWithinPartitions("leaf", "key", "entry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, n, sha = None, 0, hashlib.sha256()
        one = lambda: pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), pa.array([n], pa.int64()), pa.array([sha.hexdigest()])], names=["leaf", "n", "sha256"])
        for batch in batches:
            for k, e in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != leaf:
                    if leaf is not None:
                        yield one()
                    leaf, n, sha = k, 0, hashlib.sha256()
                data = e.encode()
                sha.update(len(data).to_bytes(8, "little") + data)  # no two lists of rows read alike
                n += 1
        if leaf is not None:
            yield one()

    return ordered.mapInArrow(run, "leaf long, n long, sha256 string")


def leaves(rows: DataFrame, key: str, entry: str, size: int = LEAF) -> DataFrame:
    """leaf, low (its first key), n, sha256 of the rows' leaves. Rows of equal keys are in one leaf."""
    own = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(entry), F.lit("")).alias("entry"))
    at = written(numbered(own, ["key", "entry"], "at"), "numbered")
    first = at.groupBy("key").agg(F.min("at").alias("first"))
    # a key belongs to the leaf in which it begins
    cut = first.groupBy(F.floor(F.col("first") / size).alias("cut")).agg(F.min("key").alias("low"))
    lows = written(numbered(cut.select("low"), ["low"], "leaf"), "lows")
    return written(_hashed(dealt(own, lows)).join(lows, "leaf").select("leaf", "low", "n", "sha256"), "leaves")


def dealt(rows: DataFrame, lows: DataFrame) -> DataFrame:
    """rows (key, entry) with the leaf of the last low that isn't above the key; keys below all are the first leaf's. lows: low,
    leaf; one for each LEAF rows. Both are sorted together, and what a range begins with is carried over from the one before."""
    marks = lows.select(F.col("low").alias("key"), F.lit(None).cast("string").alias("entry"), F.col("leaf"), F.lit(0).alias("kind"))
    both = marks.unionByName(rows.select("key", "entry", F.lit(None).cast("long").alias("leaf"), F.lit(1).alias("kind")))
    ranged = written(both.repartitionByRange("key", "kind").sortWithinPartitions("key", "kind").withColumn("part", F.spark_partition_id()), "ranges")
    last = {r["part"]: r["leaf"] for r in ranged.groupBy("part").agg(F.max("leaf").alias("leaf")).collect()}  # a row for each range
    carried, before = {}, 0
    for part in sorted(last):
        carried[part] = before
        before = before if last[part] is None else last[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[int, int] = {}
        for b in batches:
            keep, leaf = [], []
            for i, (l, kind, part) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                if kind == 0:
                    now[part] = l
                else:
                    keep.append(i)
                    leaf.append(now.get(part, carried[part]))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(leaf, pa.int64())], names=["key", "entry", "leaf"])

    # files of one range may be read by several tasks: ranges are put in order again
    return ranged.repartition("part").sortWithinPartitions("part", "key", "kind").mapInArrow(run, "key string, entry string, leaf long")


def root(own: DataFrame) -> str:
    """The hash that stands for the leaves (leaf, sha256), level by level."""
    level = own.select(F.col("leaf").alias("at"), "sha256")
    n = level.count()
    if not n:
        return hashlib.sha256().hexdigest()
    while True:
        # FAN children at most
        children = F.array_sort(F.collect_list(F.struct("at", "sha256")))
        level = level.groupBy(F.floor(F.col("at") / FAN).alias("node")).agg(F.sha2(F.concat_ws("|", F.transform(children, lambda c: c["sha256"])), 256).alias("sha256")).select(F.col("node").alias("at"), "sha256")
        n = -(-n // FAN)
        if n <= 1:
            return level.first()["sha256"]
        level = written(level, "level")


def rehashed(rows: DataFrame, key: str, entry: str, stored: DataFrame) -> DataFrame:
    """The leaves of rows as they are now, by the ranges of stored leaves."""
    own = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(entry), F.lit("")).alias("entry"))
    return written(_hashed(dealt(own, stored.select("low", "leaf"))), "rehashed")


def changed(rows: DataFrame, key: str, entry: str, stored: DataFrame) -> DataFrame:
    """leaf, low, high (the next leaf's low, null for the last), n and n_now of the leaves in which something changed."""
    now = rehashed(rows, key, entry, stored).select("leaf", F.col("n").alias("n_now"), F.col("sha256").alias("now"))
    following = stored.select((F.col("leaf") - 1).alias("leaf"), F.col("low").alias("high"))
    both = stored.join(now, "leaf", "full").join(following, "leaf", "left")
    return both.filter(~F.col("sha256").eqNullSafe(F.col("now"))).select("leaf", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_now", F.lit(0)).alias("n_now"))


def same(rows: DataFrame, key: str, entry: str, stored: DataFrame, expected: str) -> bool:
    """Whether rows have the stored leaves' root, which must be the expected one."""
    return root(stored) == expected and root(rehashed(rows, key, entry, stored)) == expected
