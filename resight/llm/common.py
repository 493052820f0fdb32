"""Helpers shared by the training-data operators: tables, skew-safe lookups, Bloom filters, Arrow kernels."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.scratch import discard as discard
from resight.scratch import written as materialize

#: Bytes of text that a kernel works on at once; one longer text is a slice of its own.
SLICE_BYTES = 8 << 20
#: Keys with at least this share of all rows count as hot; so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1e-3
#: Largest Bloom filter that is sent to tasks; the largest that is looked up by the byte.
BLOOM_BYTES, PLAIN_BYTES = 32 << 20, 1 << 20

#: Rows of an Arrow batch where the session has Spark's default, as texts are long: JVM and worker each hold a few batches.
BATCH_ROWS, SPARK_ROWS = 1500, "10000"

_memory: dict[str, object] = {}
_libc: list[Callable[[int], int]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def smaller_batches(spark: SparkSession) -> None:
    """BATCH_ROWS from now on, unless the session has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == SPARK_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def trim() -> None:
    """Give a worker's free memory back, as the next operator's worker may be another process."""
    pa.default_memory_pool().release_unused()
    if not _libc:
        try:
            _libc.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):  # another C library: its memory stays as it is
            _libc.append(lambda _: 0)
    _libc[0](0)


def trimmed(batches: Iterable) -> Iterator:
    """The batches, and then trim()."""
    yield from batches
    trim()


def remembered(name: str, make: Callable[[], object]) -> object:
    """What a worker remembers for one operator, such as words' tokens. Another operator's goes when it is made, as a
    worker serves one after the other."""
    if name not in _memory:
        _memory.clear()
        trim()
        _memory[name] = make()
    return _memory[name]


def free_name(df: DataFrame, want: str) -> str:
    """A column name that df doesn't have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    while want.lower() in have:
        want += "_"
    return want


def utf8(text: str | Column) -> Column:
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids count as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about `most` bytes in the given binary column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data = batch.column(column)
        ends = np.cumsum(np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1][1:].astype(np.int64) - np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data)])
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_text(df: DataFrame, text: str, keep: dict[str, Column], kernel: Callable[[list[bytes]], dict[str, object]], schema: str) -> DataFrame:
    """Columns `keep` of each row, beside what kernel gives for slices of the texts' UTF-8 bytes. schema: of the kernel's columns."""
    smaller_batches(df.sparkSession)
    bare = df.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], utf8(text).alias("t"))
    n = len(keep)
    names = [f"k{i}" for i in range(n)]
    out = bare.select(names).schema
    for f in df.sparkSession.createDataFrame([], schema).schema:
        out.add(f)
    fields = [f.name for f in out][n:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, n):
            made = kernel(part.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:n], *[pa.array(made[f]) if not isinstance(made[f], pa.Array) else made[f] for f in fields]], names=[*names, *fields])

    made = bare.mapInArrow(lambda batches: trimmed(run(batches)), out)
    return made.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], *fields)


def sampled(rows: DataFrame, by: Column, share: Column | float, most: int) -> DataFrame:
    """The rows whose hash `by` falls in a share of all hashes, to be broadcast if they are no more than twice `most`,
    as a share meant to leave `most` rows does; the check keeps it so if hashes are uneven."""
    part = rows.filter(F.pmod(by, F.lit(1 << 20)) < (share if isinstance(share, Column) else F.lit(share)) * (1 << 20))
    return F.broadcast(part) if part.limit(2 * most + 1).count() <= 2 * most else part


def by_share(left: DataFrame, right: DataFrame, key: str, size: str, flags: list[str], floor: int = 1) -> DataFrame:
    """Left-join `flags` of right (one row per key, with that key's number of left rows in `size`) to left.

    Keys with at least HOT_SHARE of the rows and `floor` rows, so at most 1 / HOT_SHARE keys, are broadcast; the
    others are joined by a shuffle, in which no key is large. Rows with a null key get nulls without a shuffle.
    """
    total, largest = (x or 0 for x in right.agg(F.sum(size), F.max(size)).first())
    bar = max(float(floor), HOT_SHARE * total)
    some, plain = left.filter(F.col(key).isNotNull()), right.select(key, *flags)
    if largest < bar:
        joined = some.join(plain, key, "left")
    else:
        hot, cold = right.filter(F.col(size) >= bar).select(key, *flags), right.filter(F.col(size) < bar).select(key, *flags)
        joined = some.join(F.broadcast(hot), key).unionByName(some.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left"))
    return joined.unionByName(left.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in flags]))


class Bits:
    """A Bloom filter of 64-bit hashes, as 64-bit words; a power of two of bits."""

    def __init__(self, words: np.ndarray):
        self.words, self._plain = words, None

    def __getstate__(self) -> dict:
        return {"words": self.words, "_plain": None}

    def _has(self, h: np.ndarray, k: int) -> np.ndarray:
        at = _probe(h, 64 * len(self.words), k)
        if 8 * len(self.words) > PLAIN_BYTES:
            return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        if self._plain is None:  # a small one is looked up by the byte
            self._plain = np.unpackbits(self.words.view(np.uint8), bitorder="little").view(bool)
        return self._plain[at]

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be among those of the filter."""
        open_ = np.flatnonzero(self._has(hashes, 0))
        for k in range(1, _PROBES):
            open_ = open_[self._has(hashes[open_], k)]
        return open_


def bits_of(keys: DataFrame, hashed: str, per_key: int = 10, most_bytes: int = BLOOM_BYTES) -> Bits:
    """The filter of a column of hashes that are mixed well. Built by the executors. Its size is that of the keys up to
    most_bytes; with more keys it lets more of the others pass, which callers sort out anyway."""
    size = min(1 << max(10, math.ceil(math.log2(per_key * max(1, keys.count())))), 8 * most_bytes)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = np.unique(np.concatenate([_probe(b.column(0).to_numpy(), size, k) for k in range(_PROBES)]))
                word, where = np.unique(at >> 6, return_inverse=True)
                bits = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(bits, where, np.uint64(1) << (at & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    words = np.zeros(size // 64, np.uint64)
    # at most size / 64 rows
    rows = keys.select(hashed).mapInArrow(put, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Bits(words)


def may_be_in(keys: DataFrame, key: str) -> Callable[[str], Column]:
    """Whether a column's value may be among keys: about one in a hundred of the others passes."""
    bits = bits_of(keys.select(F.xxhash64(key).alias("h")), "h")

    @F.arrow_udf("boolean")
    def test(h: pa.Array) -> pa.Array:
        out = np.zeros(len(h), bool)
        out[bits.among(h.to_numpy(zero_copy_only=False))] = True
        return pa.array(out)

    return lambda column: test(F.xxhash64(column))


def text_names(text: str) -> tuple[Column, Column]:
    """Two 64-bit hashes that name a text; null has a name too."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), F.col(text))


def without_texts(docs: DataFrame, text: str, gone: DataFrame) -> DataFrame:
    """The rows of docs whose text isn't among gone: a, b (text_names) and n, the rows with that text; with their columns
    as they are. Texts with at least HOT_SHARE of these rows, 1 / HOT_SHARE at most, are broadcast; of the other rows only
    those that a Bloom filter doubts are shuffled."""
    a, b = free_name(docs, "text_a"), free_name(docs, "text_b")
    gone = gone.select(F.col("a").alias(a), F.col("b").alias(b), "n")
    bar = max(10_000.0, HOT_SHARE * (gone.agg(F.sum("n")).first()[0] or 0))
    hot, cold = (gone.filter(c).drop("n") for c in (F.col("n") >= bar, F.col("n") < bar))
    named = docs.withColumns(dict(zip((a, b), text_names(text), strict=True))).join(F.broadcast(hot), [a, b], "left_anti")
    doubtful = may_be_in(cold, a)(a)
    return named.filter(~doubtful).drop(a, b).unionByName(named.filter(doubtful).join(cold, [a, b], "left_anti").drop(a, b))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PROBES = 5


def _probe(h: np.ndarray, size: int, k: int) -> np.ndarray:
    """The k-th place of hashes; the first takes their low bits, which must be mixed well."""
    at = h.view(np.uint64)
    if k:
        at = mixed(at + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return (at & np.uint64(size - 1)).view(np.int64)
