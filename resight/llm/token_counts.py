"""Token counts from an exact length histogram.

Documents are aggregated by encoded length. Suffix sums over the lengths then answer, for every context limit: how
many documents are longer, how many tokens are left after truncation, how many are lost, and any quantile. The sums
are taken within blocks of lengths and carried over from the blocks' totals, so no task sees all lengths.

Defined results: a null or empty text has length 0, as has one whose tokenizer gives no ids; repeated rows each
count; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resight.llm.common import map_text, materialize, table
from resight.llm.tokens import WordIds, tokenizer_path

#: Lengths in a block.
BLOCK = 1024
#: Context limits that are answered whether a document has that length or not; shares of the quantiles.
CONTEXTS, SHARES = [1 << k for k in range(7, 21)], [0.5, 0.9, 0.99, 1.0]


def histogram(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """length, n_docs."""
    path = path or tokenizer_path("word_bpe_49k.json")

    def kernel(texts: list[bytes]) -> dict[str, object]:
        words = WordIds.of(path)
        return {"length": pa.array(np.array([len(words.encode(t)) // 4 for t in texts], np.int64))}

    return map_text(docs, text, {}, kernel, "length long").groupBy("length").agg(F.count("*").alias("n_docs"))


def limits(counts: DataFrame) -> DataFrame:
    """To each length of a histogram, as a context limit: n_longer and tokens_longer (documents beyond it and their tokens),
    truncated_tokens (tokens if all are cut at the limit), lost_tokens, share_within (documents it holds whole)."""
    counts = counts.withColumn("block", F.expr(f"length div {BLOCK}"))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("length") * F.col("n_docs")).alias("tokens"))
    after = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)  # a row for each 1024 of the longest length
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("docs", "tokens")], *[F.sum(c).over(whole).alias(f"all_{c}") for c in ("docs", "tokens")])
    own = Window.partitionBy("block").orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    sums = counts.join(blocks, "block").select(
        "length", "n_docs", "all_docs", "all_tokens",
        (F.col("docs_after") + F.coalesce(F.sum("n_docs").over(own), F.lit(0))).alias("n_longer"),
        (F.col("tokens_after") + F.coalesce(F.sum(F.col("length") * F.col("n_docs")).over(own), F.lit(0))).alias("tokens_longer"),
    )
    lost = F.col("tokens_longer") - F.col("length") * F.col("n_longer")
    return sums.select("length", "n_docs", "n_longer", "tokens_longer", (F.col("all_tokens") - lost).alias("truncated_tokens"), lost.alias("lost_tokens"), (1 - F.col("n_longer") / F.col("all_docs")).alias("share_within"))


def quantiles(counts: DataFrame, shares: list[float]) -> dict[float, int]:
    """The smallest length that holds at least each share of the documents whole."""
    found = limits(materialize(counts, "lengths"))
    row = found.agg(*[F.min(F.when(F.col("share_within") >= s - 1e-12, F.col("length"))) for s in shares]).first()
    return dict(zip(shares, row, strict=True))


def with_limits(counts: DataFrame, wanted: list[int]) -> DataFrame:
    """A histogram with lengths that no document has, so that limits() answers them as context limits too."""
    spark = counts.sparkSession
    return counts.unionByName(spark.createDataFrame([(int(x), 0) for x in wanted], "length long, n_docs long")).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def report(docs: DataFrame, text: str = "text", path: str | None = None, wanted: list[int] = CONTEXTS, shares: list[float] = SHARES) -> DataFrame:
    """limits() of every length that occurs and of the context limits `wanted`, with all_docs, all_tokens, and the
    quantiles of the lengths as q50, q90...: the smallest length that holds at least that share of the documents whole."""
    counts = materialize(histogram(docs, text, path), "lengths")
    if counts.isEmpty():
        wanted = []
    found = materialize(limits(with_limits(counts, wanted)), "limits")
    whole = counts.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.col("length") * F.col("n_docs")).alias("all_tokens"))
    at = found.agg(*[F.min(F.when((F.col("share_within") >= s - 1e-12) & (F.col("n_docs") > 0), F.col("length"))).alias(f"q{round(100 * s)}") for s in shares])
    return found.crossJoin(F.broadcast(whole.crossJoin(at)))  # one row each


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
