"""Samples of pairs of frames without a list of all pairs.

Frames are numbered in the order of their individuals and dates. Then an individual's frames are a range of numbers, and
so are those before a date: a block of frames of one date has as many pairs with earlier frames as its size times the
frames before it, and sums of these over the blocks number all pairs there are. A seeded draw of such numbers is undone by
finding each one's block and dividing: what is drawn is two frames' numbers. Work is linear in frames, whoever has them.

Pairs of two individuals are drawn as pairs of individuals, alike however many frames they have, and then a frame of each.
A pair comes once; where nearly all pairs there are must come, they are listed, as they are few then.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resight.functions import scalars as S
from resight.operators.registry import numbered
from resight.scratch import written

#: Up to how many times the pairs that are asked for all pairs are listed.
LISTED = 4


def running(rows: DataFrame, order: str, value: str, before: str) -> DataFrame:
    """Adds to each row the sum of `value` of the rows before it. Ranges are summed by themselves, and carried over by their totals."""
    ranged = written(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))  # a row for each range
    earlier = totals.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carried"))
    own = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(earlier), "_part").withColumn(before, F.col("_carried") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("_part", "_carried")


def _named(picked: DataFrame, at: DataFrame) -> DataFrame:
    """a, b of pairs of numbers (a_at, b_at)."""
    side = lambda x: at.select(F.col("at").alias(f"{x}_at"), F.col("frame_id").alias(x))
    return picked.join(side("a"), "a_at").join(side("b"), "b_at").select("a", "b")


def genuine(frames: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """a, b: n different pairs of frames of one individual on different dates, the earlier first; all pairs where there are
    no more. Every pair is as likely as any other. Undated frames, and those of no individual, are in none."""
    dated = frames.select("individual_id", S.missing("date").alias("date"), "frame_id").filter("individual_id is not null and date is not null")
    at = numbered(dated, ["individual_id", "date", "frame_id"], "at")
    at = written(at, "at")
    starts = at.groupBy("individual_id").agg(F.min("at").alias("start"))
    blocks = at.groupBy("individual_id", "date").agg(F.min("at").alias("first"), F.count("*").alias("size")).join(starts, "individual_id")
    blocks = blocks.withColumn("ways", F.col("size") * (F.col("first") - F.col("start"))).filter("ways > 0")
    blocks = written(running(blocks, "first", "ways", "before").select("first", "start", "ways", "before"), "blocks")
    total = blocks.agg(F.sum("ways")).first()[0] or 0
    drawn = np.array(sorted(random.Random(seed).sample(range(total), n)) if n < total else range(total), np.int64)

    def undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, start, ways, before = (b.column(c).to_numpy() for c in ("first", "start", "ways", "before"))
            low, high = np.searchsorted(drawn, before), np.searchsorted(drawn, before + ways)
            row = np.repeat(np.arange(len(first)), high - low)
            if len(row):
                k = drawn[np.concatenate([np.arange(i, j) for i, j in zip(low, high, strict=True)])] - before[row]
                width = (first - start)[row]
                yield pa.RecordBatch.from_arrays([pa.array(start[row] + k % width), pa.array(first[row] + k // width)], names=["a_at", "b_at"])

    return _named(blocks.mapInArrow(undo, "a_at long, b_at long"), at)


def impostors(frames: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """a, b: n different pairs of frames of different individuals, or all pairs where there are no more: two individuals,
    each as likely as any other, then a frame of each. Frames of no individual are in none."""
    spark = frames.sparkSession
    at = written(numbered(frames.select("individual_id", "frame_id").filter("individual_id is not null"), ["individual_id", "frame_id"], "at"), "at")
    people = at.groupBy("individual_id").agg(F.min("at").alias("start"), F.count("*").alias("size"))
    people = written(numbered(people.select("start", "size"), ["start"], "who"), "people")
    wide = F.col("size").cast("decimal(38,0)")
    count, whole, squares = people.agg(F.count("*"), F.sum(wide), F.sum(wide * wide)).first()
    total = int((whole * whole - squares) / 2) if count else 0
    noise = np.random.default_rng(seed)
    found: dict[tuple[int, int], None] = {}
    if total <= LISTED * n:
        ranges = [(r["start"], r["size"]) for r in people.orderBy("who").collect()] if total else []  # no more than pairs
        every = [(a, b, s * t) for i, (x, s) in enumerate(ranges) for y, t in ranges[i + 1 :] for a in range(x, x + s) for b in range(y, y + t)]
        # as if drawn one after the other: the least waiting times, a pair's rate being one over its individuals' pairs
        waits = noise.exponential(1.0, len(every)) * np.array([w for _, _, w in every], np.float64)
        found = {every[i][:2]: None for i in np.argsort(waits, kind="stable")[:n].tolist()}
    else:
        tries = 2 * n + 16
        while len(found) < n:
            i, j = noise.integers(0, count, tries), noise.integers(0, count - 1, tries)
            j += j >= i
            u, v = noise.random((2, tries))
            wanted = spark.createDataFrame([(int(w),) for w in np.unique([i, j])], "who long")
            known = {r["who"]: (r["start"], r["size"]) for r in people.join(wanted, "who").collect()}  # of those that were drawn
            for x, y, p, q in zip(i.tolist(), j.tolist(), u.tolist(), v.tolist(), strict=True):
                a, b = known[x][0] + int(p * known[x][1]), known[y][0] + int(q * known[y][1])
                if (b, a) not in found and len(found) < n:
                    found.setdefault((a, b))
            tries = min(2 * tries, 1 << 20)
    return _named(spark.createDataFrame(list(found), "a_at long, b_at long"), at)
