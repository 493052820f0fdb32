"""URL filters: rules by host and path, and a Bloom filter cascade for what no rule decides.

A cascade decides whether a key is listed, without a join and without error, for every key of the corpus: its first
filter encodes the listed keys, the next one those of the corpus's other keys that the first takes for listed, the
next the listed keys that the second takes for others, and so on until no key is taken wrongly. A page's keys are
its host and the domains above it, as far as listed names have labels.

Filters are built by the executors (bit positions, then an OR by word). Their size is that of the list, so keys are
dealt into shards by a hash, each with a cascade of its own of about SHARD_KEYS listed keys at most: pages pass one
shard after the other, and what a task is sent has a fixed bound whatever the list.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed; longest
rule wins, a block before an allow of equal length; repeated rows are judged row by row; an empty table gives an
empty result; further columns are left alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm.common import materialize, table

#: (verdict, host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Rules up to which they are one expression; beyond, they are looked up by the host's domains.
EXPRESSED = 200
#: Listed names; their subdomains count too.
LISTED = tuple(f"{name}.example.{top}" for name in ("casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: Rates of false positives of the first filter and of those after it.
FIRST, LATER = 1 / 64, 1 / 4
#: Listed keys in a shard: about nine bits each, so 24 MB.
SHARD_KEYS = 20_000_000


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    url = F.col(url) if isinstance(url, str) else url
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    if len(rules) > EXPRESSED:
        hit = _by_table(rules)(host, path)
        return hit["rule"], hit["verdict"]
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=_weight):
        name, slash, rest = text.partition("/")
        fits = (host.eqNullSafe(name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _weight(rule: tuple[str, str]) -> tuple[int, bool]:
    return len(rule[1]), rule[0] == "block"


def _by_table(rules: tuple[tuple[str, str], ...]):
    """The rules of a host and the domains above it, the heaviest first of those whose path fits."""
    table_: dict[str, list[tuple[str, str, str]]] = {}
    for what, text in sorted(rules, key=_weight, reverse=True):
        name, slash, rest = text.partition("/")
        table_.setdefault(name, []).append((slash + rest, text, what))

    def of(host: str, path: str) -> tuple[str | None, str | None]:
        best, at = None, 0
        while at >= 0:
            for start, text, what in table_.get(host[at:], ()):
                if path.startswith(start):
                    best = max(best, (what, text), key=_weight) if best else (what, text)
                    break
            at = host.find(".", at) + 1 or -1
        return (best[1], best[0]) if best else (None, None)

    @F.arrow_udf("rule string, verdict string")
    def look(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        found = [of(h or "", p or "") for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["rule", "verdict"])

    return look


def names_of(host: Column, labels: int) -> Column:
    """The host and the domains above it, of at most so many labels. Empty for an empty host."""
    parts = F.split(host, r"\.")
    own = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    return F.when(F.length(host) > 0, own).otherwise(F.array().cast("array<string>"))


def _hashes(key: Column) -> list[Column]:
    """Two hashes of their own: by different seeds."""
    return [F.xxhash64(key), F.xxhash64(F.lit("second"), key)]


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    x = x.astype(np.int64).view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spots(h1: np.ndarray, h2: np.ndarray, level: int, size: int, probes: int) -> list[np.ndarray]:
    """Bit positions of keys with these two hashes in a level's filter of `size` bits."""
    a, b = _mixed(h1, level), _mixed(h2, level) | np.uint64(1)
    return [((a + np.uint64(k) * b) % np.uint64(size)).astype(np.int64) for k in range(probes)]


@dataclass
class Cascade:
    """levels: (bits as 64-bit words, number of bits, probes), from the first."""

    levels: list[tuple[np.ndarray, int, int]]

    def inside(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        words, size, probes = self.levels[level]
        found = np.ones(len(h1), bool)
        for at in spots(h1, h2, level, size, probes):
            found &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return found

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """For keys of the universe that it was built over."""
        out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
        for level in range(len(self.levels)):
            found = self.inside(h1[open_], h2[open_], level)
            out[open_[~found]] = level % 2 == 1  # not among the keys of this level: of the other kind
            open_ = open_[found]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _plan(n: int, level: int) -> tuple[int, int]:
    rate = LATER if level else FIRST
    return max(64, math.ceil(n * 1.4427 * math.log2(1 / rate) / 64) * 64), max(1, round(math.log2(1 / rate)))


def _taken(known: Cascade, level: int):
    """Whether that level's filter takes a key for one of its own."""

    @F.arrow_udf("boolean")
    def taken(h1: pa.Array, h2: pa.Array) -> pa.Array:
        return pa.array(known.inside(h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False), level))

    return taken


def build(universe: DataFrame) -> Cascade:
    """Over a table of distinct keys: h1, h2, listed. Levels follow until no key is taken wrongly; keys whose two hashes
    are both equal can't be told apart, which is one pair in 2^128."""
    cascade = Cascade([])
    mine, others = universe.filter("listed"), universe.filter("not listed")
    while True:
        level, n = len(cascade.levels), mine.count()
        if not n and level:
            return cascade
        size, probes = _plan(n, level)

        def put(batches, level=level, size=size, probes=probes):
            for b in batches:
                if b.num_rows:
                    at = np.concatenate(spots(b.column(0).to_numpy(), b.column(1).to_numpy(), level, size, probes))
                    word, where = np.unique(at >> 6, return_inverse=True)
                    bits = np.zeros(len(word), np.uint64)
                    np.bitwise_or.at(bits, where, np.uint64(1) << (at & 63).astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

        words = np.zeros(size // 64, np.uint64)
        # at most size / 64 rows, as many as a shard's keys allow
        rows = mine.select("h1", "h2").mapInArrow(put, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        cascade.levels.append((words, size, probes))
        mine, others = materialize(others.filter(_taken(Cascade(list(cascade.levels)), level)("h1", "h2")), f"level{level}"), mine


def _shard(h2: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h2, 7), F.lit(shards))


def _any_listed(cascade: Cascade, shard: int, shards: int):
    """Whether any of a page's keys in this shard is listed."""

    @F.arrow_udf("boolean")
    def any_listed(h1: pa.Array, h2: pa.Array) -> pa.Array:
        a, b = (h.flatten().to_numpy(zero_copy_only=False) for h in (h1, h2))
        own = np.flatnonzero((b.view(np.uint64) >> np.uint64(7)) % np.uint64(shards) == shard)
        found = np.zeros(len(a), bool)
        found[own] = cascade.listed(a[own], b[own])
        ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(h1).to_numpy(zero_copy_only=False))]).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(found)])
        return pa.array(sums[ends[1:]] > sums[ends[:-1]])

    return any_listed


def judge(pages: DataFrame, listed: DataFrame, labels: int, rules: tuple[tuple[str, str], ...] = RULES, page_id: str = "page_id", url: str = "url", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """page_id, host, path, rule, verdict: a row for each row of pages. listed: key; labels: most labels of a key."""
    host, path = host_and_path(url)
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    names = F.explode(names_of(F.col("host"), labels)).alias("key")
    keys = parsed.select("host").distinct().select(names).distinct().join(listed.select("key", F.lit(True).alias("on")).distinct(), "key", "full")
    universe = materialize(keys.select(*[h.alias(f"h{i + 1}") for i, h in enumerate(_hashes(F.col("key")))], F.coalesce("on", F.lit(False)).alias("listed")), "keys")
    shards = max(1, -(-universe.filter("listed").count() // shard_keys))
    own = names_of(F.col("host"), labels)
    bad = F.lit(False)
    for shard in range(shards):
        cascade = build(universe.filter(_shard(F.col("h2"), shards) == shard))
        bad = bad | _any_listed(cascade, shard, shards)(F.transform(own, lambda k: _hashes(k)[0]), F.transform(own, lambda k: _hashes(k)[1]))
        if shard + 1 < shards:  # one shard's filters at a time
            parsed = materialize(parsed.withColumn("bad", bad), "judged")
            bad = F.col("bad")
    parsed = parsed.withColumn("bad", bad)
    return parsed.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    return judge(table(spark, sf_dir, "pages"), listed, max(x.count(".") + 1 for x in LISTED))


_CASES = "\n".join(
    f"WHEN (host = '{n}' OR ends_with(host, '.{n}')) AND starts_with(path, '/{p}') THEN '{{}}'".replace("{}", f"{r}|{v}")
    for v, r in sorted(RULES, key=lambda r: (-len(r[1]), r[0] != "block"))
    for n, _, p in [r.partition("/")]
)
OP5_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT *, CASE {_CASES} END AS hit FROM p)
SELECT page_id, host, path, split_part(hit, '|', 1) AS rule,
       coalesce(split_part(hit, '|', 2), CASE WHEN {" OR ".join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in LISTED)} THEN 'block' ELSE 'allow' END) AS verdict
FROM j
"""
