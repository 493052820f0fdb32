"""Quality rules with host-level verdicts.

Each text gets base counts and a base rule. Failures are then summed by host (here: any column that names
where a document comes from), the hosts' failure rates are shrunk towards the corpus by a beta prior that is
fitted to the hosts themselves, and a host that passes much less often than the corpus is rejected with all it holds.

Defined results: a null or empty text has no words, so it fails the base rule; a document with a null host
gets no host verdict; repeated rows and tied ids are judged row by row; an empty table gives an empty result;
further columns of any name are left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm.common import by_share, free_name, map_text, materialize, table, text_names, without_texts

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: So many rejected hosts at most are broadcast.
MOST_BROADCAST = 100_000
#: A host is rejected if its documents pass less than this share as often as the corpus's do, by its shrunk rate.
LEAST_PASS = 0.5
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = ", ".join(f"{m} long" for m in METRICS)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more among the words. Hashes find candidates, words decide."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashed = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for j in range(window):
        rolled *= _MULTIPLIER
        rolled += hashed[j : j + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    a, b = order[:-1][same], order[1:][same]
    if all((codes[a + j] == codes[b + j]).all() for j in range(window)):
        hits = np.union1d(a, b)
    else:  # two different windows with one hash
        at: dict[bytes, list[int]] = {}
        for i in np.union1d(a, b):
            at.setdefault(codes[i : i + window].tobytes(), []).append(int(i))
        hits = np.array([i for x in at.values() if len(x) > 1 for i in x], np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(texts: list[bytes]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {m: [] for m in METRICS}
    for text in texts:
        words = text.split()
        filled = [x for x in text.split(b"\n") if x.strip()]
        joined = np.frombuffer(b"".join(words), np.uint8)
        for m, v in zip(METRICS, (len(words), int(((joined & 0xC0) != 0x80).sum()), len(text) - len(text.translate(None, SYMBOLS)), len(filled) - len(set(filled)), repeated_words(words)), strict=True):
            out[m].append(v)
    return out


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def beta_prior(n: int, failed: int, squares: float, hosts: int) -> tuple[float, float]:
    """Mean and strength (alpha + beta) of the hosts' failure rates, by the method of moments.

    squares: sum over hosts of n_failed**2 / n_docs. The strength follows from the hosts' variance in excess
    of binomial noise, weighted by their documents; without excess it is 1e6, so that all hosts get the mean.
    """
    if not n:
        return 0.0, 1e6
    mean = failed / n
    noise = mean * (1 - mean)
    excess = squares / n - mean * mean - noise * hosts / n
    return mean, min(max(noise / excess - 1, 1.0), 1e6) if excess > 1e-12 else 1e6


def host_verdicts(hosts: DataFrame, least_pass: float = LEAST_PASS) -> DataFrame:
    """To hosts (host, n_docs, n_failed) add host_rate, the shrunk failure rate, and host_rejected."""
    hosts = materialize(hosts, "hosts")
    sums = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")), F.count("*")).first()
    mean, strength = beta_prior(*(x or 0 for x in sums))
    rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", 1 - rate < least_pass * (1 - mean))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", least_pass: float = LEAST_PASS) -> DataFrame:
    """doc_id, host, the base counts, base_failed, host_rejected, kept: a row for each row of docs."""
    judged = map_text(docs, text, {"doc_id": F.col(doc_id), "host": F.col(host)}, base_counts, SCHEMA)
    judged = materialize(judged.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))), "rules")
    hosts = judged.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    out = by_share(judged, host_verdicts(hosts, least_pass), "host", "n_docs", ["host_rejected"])
    out = out.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", least_pass: float = LEAST_PASS) -> DataFrame:
    """The rows of docs that quality_rules keeps, with their columns as they are.

    Texts are counted once; what fails is then known by the texts' names.
    """
    a, b = text_names(text)
    judged = map_text(docs, text, {"a": a, "b": b, "host": F.col(host)}, base_counts, SCHEMA)
    judged = materialize(judged.select("a", "b", "host", base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("fails")), "judged")
    hosts = judged.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("fails").cast("long")).alias("n_failed"))
    bad = host_verdicts(hosts, least_pass).filter("host_rejected").select(F.col("host").alias(key := free_name(docs, "host_key")))
    good = without_texts(docs, text, materialize(judged.filter("fails").groupBy("a", "b").agg(F.count("*").alias("n")), "failed"))
    if bad.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return good.join(F.broadcast(bad), F.col(host) == F.col(key), "left_anti")
    # no host of so many has a large share left over; nulls are dealt out by text
    return good.join(bad, F.coalesce(F.col(host), F.concat(F.lit("\0"), F.xxhash64(text).cast("string"))) == F.col(key), "left_anti")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *METRICS, "base_failed", "kept", "host_rejected")


#: The same rows from documents.
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS filled FROM d),
grams AS (SELECT rid, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS g
          FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM hit, range({WINDOW}) AS r(j) GROUP BY rid),
base AS (SELECT w.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(filled) - len(list_distinct(filled)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
         FROM w LEFT JOIN covered USING (rid)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
sums AS (SELECT CAST(sum(f) AS DOUBLE) / sum(n) AS mean, sum(f * f / n) / sum(n) AS sq, count(*) / sum(n) AS per FROM hosts),
prior AS (SELECT mean, CASE WHEN sq - mean * mean - mean * (1 - mean) * per > 1e-12
          THEN least(greatest(mean * (1 - mean) / (sq - mean * mean - mean * (1 - mean) * per) - 1, 1.0), 1e6) ELSE 1e6 END AS k FROM sums),
verdicts AS (SELECT source, 1 - (f + mean * k) / (n + k) < {LEAST_PASS} * (1 - mean) AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, FALSE) AS kept, coalesce(rejected, FALSE) AS host_rejected
FROM judged LEFT JOIN verdicts USING (source)
"""
