"""Near-duplicate audit: pairs of 64-bit perceptual hashes within a Hamming distance, by parts that they share.

A hash is cut into parts. Two hashes within `most` bits agree in all parts but `most` at least, so they agree in some
choice of parts - most of them. Hashes are shuffled by the first of these only (`most` + 1 rows a hash, in place of a row
for each choice); within such a bucket a task sorts them by each choice of the others and holds equal ones against each
other. A pair counts where its first agreeing parts are the choice, so it is found once. Buckets of more than HEAVY
hashes are joined by the whole choice instead, so that none of them is one task's. Equal hashes are collapsed first: the
result is pairs of different hashes, beside which hash each frame has, and a large group of copies is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.functions import scalars as S
from resight.scratch import written

MOST = 6
#: Numbers of hashes up to which so many parts beyond `most` must agree; more of them make more and longer keys.
SPARE = ((200_000, 2), (5_000_000, 3), (300_000_000, 4))
#: Hashes of a bucket that one task sorts at most; larger buckets are joined.
HEAVY = 1 << 20
#: Frames of an individual up to which each is held against each; those of larger ones meet by their hashes.
OWN = 1024
#: Groups of a cohort up to which others' old keys are left unread.
FEW = 1000


def hash_halves(phash: str) -> tuple[Column, Column]:
    return tuple(F.conv(F.substring(phash, i, 8), 16, 10).cast("bigint") for i in (1, 9))


def members(frames: DataFrame, phash: str = "phash", group: str = "cohort", frame: str = "path_rel") -> DataFrame:
    """group, frame, hash: which hash each frame has; frames without one are left out."""
    return frames.filter(F.length(phash) == 16).select(F.col(group), F.col(frame), F.lower(phash).alias("hash"))


def _cuts(parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each part of a 64-bit number."""
    at = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _pieces(h: Column, parts: int) -> list[Column]:
    return [F.shiftrightunsigned(h, a).bitwiseAND((1 << n) - 1) for a, n in _cuts(parts)]


def _keys(h: Column, parts: int, spare: int) -> Column:
    """The keys of all choices of `spare` parts of a 64-bit number."""
    pieces = _pieces(h, parts)
    return F.array(*[F.xxhash64(F.lit(i), *[pieces[k] for k in chosen]) for i, chosen in enumerate(combinations(range(parts), spare))])


def _firsts(h: Column, most: int, spare: int) -> Column:
    """The keys of the parts that may be the first in which two hashes agree: the part's number above its bits."""
    return F.array(*[F.lit(i << 32).bitwiseOR(p) for i, p in enumerate(_pieces(h, most + spare)[: most + 1])])


def _met(x: np.ndarray, first: int, most: int, spare: int, fresh: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, dist) of the pairs within `most` bits among hashes that share part `first`, if they agree in none before it. With
    fresh, of those that hold a fresh one."""
    cuts = _cuts(most + spare)
    for rest in combinations(range(first + 1, most + spare), spare - 1):
        key = np.zeros(len(x), np.uint64)
        for k in rest:
            key = (key << np.uint64(cuts[k][1])) | ((x >> np.uint64(cuts[k][0])) & np.uint64((1 << cuts[k][1]) - 1))
        # short keys are sorted by digits, in a third of the time
        short = sum(cuts[k][1] for k in rest) <= 16
        order = np.argsort(key.astype(np.uint16), kind="stable") if short else np.argsort(key)
        key, y = key[order], x[order]
        # bits of which one at least differs, by part: those before the last chosen that aren't chosen
        others = [np.uint64(((1 << cuts[k][1]) - 1) << cuts[k][0]) for k in range((rest or (first,))[-1]) if k != first and k not in rest]
        away, live = 1, np.flatnonzero(key[1:] == key[:-1])
        while len(live):
            differ = y[live] ^ y[live + away]
            dist = np.bitwise_count(differ)
            at = np.flatnonzero((dist <= most) & (dist > 0))
            for mask in others:
                at = at[(differ[at] & mask) != 0]
            if fresh is not None:
                at = at[fresh[order[live[at]]] | fresh[order[live[at] + away]]]
            if len(at):
                yield y[live[at]].view(np.int64), y[live[at] + away].view(np.int64), dist[at].astype(np.int32)
            away += 1
            live = live[live + away < len(key)]
            live = live[key[live + away] == key[live]]


def _pairs_of(old: pa.Table | None, new: pa.Table, most: int, spare: int) -> pa.Table:
    """g, a, b, dist of the pairs of a bucket (g, key, x) that hold a new hash."""
    x = new.column("x").to_numpy().view(np.uint64)
    fresh = None
    if old is not None and old.num_rows and len(x):
        fresh = np.arange(len(x) + old.num_rows) < len(x)
        x = np.concatenate([x, old.column("x").to_numpy().view(np.uint64)])
    found = list(_met(x, new.column("key")[0].as_py() >> 32, most, spare, fresh)) if new.num_rows else []
    a, b, dist = (np.concatenate(c) if found else np.zeros(0, kind) for c, kind in zip(zip(*found, strict=True) if found else [()] * 3, (np.int64, np.int64, np.int32), strict=True))
    g = new.column("g").combine_chunks().take(pa.array(np.zeros(len(a), np.int64))) if len(a) else pa.array([], pa.string())
    return pa.table([g, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(dist)], names=["g", "a", "b", "dist"])


_PAIRS = "g string, a long, b long, dist int"


def _by_choice(hashes: DataFrame, heavy: DataFrame, most: int, spare: int) -> DataFrame:
    """The pairs of heavy buckets (g, key): joined by all parts of a choice."""
    first = F.array(*[F.lit(chosen[0]) for chosen in combinations(range(most + spare), spare)])
    keyed = hashes.select("g", "x", F.posexplode(_keys(F.col("x"), most + spare, spare)).alias("at", "choice"))
    keyed = keyed.withColumn("key", _firsts(F.col("x"), most, spare)[first[F.col("at")]]).join(F.broadcast(heavy), ["g", "key"], "left_semi")  # a row for HEAVY hashes
    a, b = (keyed.select("g", "choice", F.col("x").alias(c)) for c in "ab")
    dist = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("int")
    return a.hint("merge").join(b, ["choice", "g"]).filter("a < b").select("g", "a", "b", dist.alias("dist")).filter(F.col("dist") <= most)


def near_classes(frames: DataFrame, phash: str = "phash", group: str = "cohort", most: int = MOST) -> DataFrame:
    """group, a, b, dist: pairs a < b of different hashes of a group within `most` bits."""
    hi, lo = hash_halves("h")
    distinct = frames.filter(F.length(phash) == 16).select(F.col(group).alias("g"), F.lower(phash).alias("h")).filter("g is not null").distinct()
    distinct = written(distinct.select(F.col("g").cast("string").alias("g"), F.shiftleft(hi, 32).bitwiseOR(lo).alias("x")), "hashes")
    n = distinct.count()
    spare = next((s for limit, s in SPARE if n <= limit), 5)
    keyed = distinct.select("g", F.explode(_firsts(F.col("x"), most, spare)).alias("key"), "x")
    heavy = written(keyed.groupBy("g", "key").count().filter(F.col("count") > HEAVY).select("g", "key"), "heavy") if n > HEAVY else None
    if heavy is not None and not heavy.isEmpty():
        keyed = keyed.join(F.broadcast(heavy), ["g", "key"], "left_anti")
    else:
        heavy = None
    pairs = keyed.groupBy("g", "key").applyInArrow(lambda bucket: _pairs_of(None, bucket, most, spare), _PAIRS)
    if heavy is not None:
        pairs = pairs.unionByName(_by_choice(distinct, heavy, most, spare)).distinct()
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return pairs.select(F.col("g").cast(frames.schema[group].dataType).alias(group), F.least(text("a"), text("b")).alias("a"), F.greatest(text("a"), text("b")).alias("b"), "dist")


def near_pairs(frames: DataFrame, phash: str = "phash", group: str = "cohort", most: int = MOST) -> DataFrame:
    """The audit's report: cohort, dist, a, b (paths, a < b), same_individual, for frames of different bytes.

    Lists every pair of frames, equal hashes too: use near_classes and members where copies may be many.
    """
    own = frames.filter(F.length(phash) == 16).select(F.col(group).alias("g"), F.lower(phash).alias("h"), "path_rel", "md5", "individual_id")
    links = near_classes(frames, phash, group, most).select(F.col(group).alias("g"), "a", "b", "dist")
    shared = own.groupBy("g", "h").count().filter(F.col("count") > 1)  # a hash of one frame is no pair
    links = links.unionByName(shared.select("g", F.col("h").alias("a"), F.col("h").alias("b"), F.lit(0).alias("dist")))
    left, right = (own.select("g", F.col("h").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("path_rel", "md5", "individual_id")]) for s in ("a", "b"))
    # links and frames may be far more than Spark takes them for before it runs: not through the driver
    both = links.hint("merge").join(left, ["g", "a"]).hint("merge").join(right, ["g", "b"]).filter(F.col("a_md5") != F.col("b_md5")).filter((F.col("a") != F.col("b")) | (F.col("a_path_rel") < F.col("b_path_rel")))
    return both.select(F.col("g").alias(group), F.col("dist").cast("int").alias("dist"), F.least("a_path_rel", "b_path_rel").alias("a"), F.greatest("a_path_rel", "b_path_rel").alias("b"), (F.col("a_individual_id") == F.col("b_individual_id")).alias("same_individual"))


def own_pairs(frames: DataFrame, phash: str = "phash", group: str = "cohort", most: int = MOST) -> DataFrame:
    """The rows of near_pairs that are of one individual (paths differ), with same_session: whether date, else session, is the same.

    The frames of an individual meet each other without the audit of the whole group; those of an individual of more than OWN
    frames, which may be any number, are audited with others like it.
    """
    hi, lo = hash_halves("h")
    own = frames.filter(F.length(phash) == 16).select(F.col(group).alias("g"), "individual_id", F.lower(phash).alias("h"), "path_rel", "md5", S.session_key("date", "session").alias("s"))
    large = written(own.groupBy("g", "individual_id").count().filter(F.col("count") > OWN).select("g", "individual_id"), "large")
    any_large = not large.isEmpty()
    number = F.when(F.col("h").rlike("^[0-9a-f]{16}$"), F.shiftleft(hi, 32).bitwiseOR(lo))
    # a text that is no hash is near its copies only, and needed for that
    few = (own.join(large, ["g", "individual_id"], "left_anti") if any_large else own).withColumn("x", number).withColumn("h", F.when(F.col("x").isNull(), F.col("h")))
    left, right = (few.select("g", "individual_id", *[F.col(c).alias(f"{s}_{c}") for c in ("h", "x", "path_rel", "md5", "s")]) for s in ("a", "b"))
    bits = F.bit_count(F.col("a_x").bitwiseXOR(F.col("b_x")))
    both = left.hint("merge").join(right, ["g", "individual_id"]).filter((F.col("a_path_rel") < F.col("b_path_rel")) & (F.col("a_md5") != F.col("b_md5")) & F.coalesce(bits <= most, F.col("a_h") == F.col("b_h")))
    columns = [F.col("g").alias(group), F.col("dist").cast("int").alias("dist"), F.least("a_path_rel", "b_path_rel").alias("a"), F.greatest("a_path_rel", "b_path_rel").alias("b"), F.lit(True).alias("same_individual"), (F.col("a_s") == F.col("b_s")).alias("same_session")]
    out = both.withColumn("dist", F.coalesce(bits, F.lit(0))).select(columns)
    if any_large:
        many = written(own.join(large, ["g", "individual_id"], "left_semi"), "of-large")
        links = near_classes(many, "h", "g", most).unionByName(many.select("g", F.col("h").alias("a"), F.col("h").alias("b"), F.lit(0).alias("dist")).distinct())
        left, right = (many.select("g", "individual_id", F.col("h").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("path_rel", "md5", "s")]) for s in ("a", "b"))
        both = links.hint("merge").join(left, ["g", "a"]).hint("merge").join(right, ["g", "b", "individual_id"]).filter((F.col("a_md5") != F.col("b_md5")) & (F.col("a_path_rel") != F.col("b_path_rel")))
        out = out.unionByName(both.filter((F.col("a") != F.col("b")) | (F.col("a_path_rel") < F.col("b_path_rel"))).select(columns))
    return out


class Audit:
    """Pairs of near hashes, kept up to date as cohorts come: new hashes meet the old ones, which stay where they are.

    Keys of the hashes' first parts are a table in buckets of key and group, the hashes one in buckets of group and hash, so
    that a cohort meets both without a shuffle of theirs: only the cohort's own rows move. Hashes are written last. So a
    cohort whose adding was cut off is added again, and what was written twice counts once.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, most: int = MOST, spare: int = 3, buckets: int | None = None):
        """name: of the tables (name_keys, name_hashes, name_pairs), whose files lie below path. spare: as of SPARE, for the
        hashes that are expected in the end; the result is the same with any."""
        self.spark, self.name, self.path, self.most, self.spare = spark, name, path.rstrip("/"), most, spare
        self.buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
        for table, columns in (("keys", "g string, x long, key long"), ("hashes", "g string, x long"), ("pairs", "g string, a long, b long, dist int")):
            if not spark.catalog.tableExists(f"{name}_{table}"):
                self._append(spark.createDataFrame([], columns), table)

    def _append(self, rows: DataFrame, table: str) -> None:
        by = {"keys": ("key", "g"), "hashes": ("g", "x"), "pairs": ("g", "a")}[table]
        # a file of each bucket from one task
        rows.repartition(self.buckets, *by).write.mode("append").format("parquet").bucketBy(self.buckets, *by).sortBy(*by).option("path", f"{self.path}/{table}").saveAsTable(f"{self.name}_{table}")

    def _table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def fresh(self, frames: DataFrame, phash: str = "phash", group: str = "cohort") -> DataFrame:
        """g, x: hashes of frames that aren't there yet."""
        hi, lo = hash_halves("h")
        own = frames.filter(F.length(phash) == 16).select(F.col(group).cast("string").alias("g"), F.lower(phash).alias("h")).distinct()
        return own.select("g", F.shiftleft(hi, 32).bitwiseOR(lo).alias("x")).join(self._table("hashes"), ["g", "x"], "left_anti")

    def met(self, keyed: DataFrame) -> DataFrame:
        """g, a, b, dist of the pairs within `most` bits that hold one of these hashes, bucket by bucket."""
        most, spare, old = self.most, self.spare, self._table("keys")
        few = [r["g"] for r in keyed.select("g").distinct().limit(FEW).collect()]
        if len(few) < FEW:  # groups that get nothing aren't read
            old = old.filter(F.col("g").isin(few))
        sides = (df.select("g", "key", "x").groupBy("key", "g") for df in (keyed, old))
        return next(sides).cogroup(next(sides)).applyInArrow(lambda own, others: _pairs_of(others, own, most, spare), _PAIRS).distinct()

    def add(self, frames: DataFrame, phash: str = "phash", group: str = "cohort") -> DataFrame:
        """g, a, b, dist: the pairs that these frames bring, which are in pairs() from now on."""
        new = written(self.fresh(frames, phash, group).filter("g is not null"), "new-hashes")
        keyed = new.select("g", "x", F.explode(_firsts(F.col("x"), self.most, self.spare)).alias("key"))
        found = written(self.met(keyed), "new-pairs")
        self._append(found, "pairs")
        self._append(keyed, "keys")
        self._append(new, "hashes")
        return found

    def pairs(self, group: str = "cohort") -> DataFrame:
        """group, a, b, dist: the rows of near_classes over all frames that were added."""
        text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
        own = self._table("pairs").distinct()
        return own.select(F.col("g").alias(group), F.least(text("a"), text("b")).alias("a"), F.greatest(text("a"), text("b")).alias("b"), "dist")
