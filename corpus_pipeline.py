"""Documents to packed training sequences: quality rules, quality classifier, near-duplicates, decontamination, packing.

Each stage works on all rows that the one before it kept and drops rows for good; all but the last return the
columns of documents as they are, further columns of any name among them.

Defined results: null and empty texts fail the quality rules and go; rows with a null doc_id are judged like any other,
but no near-duplicate takes another's place by them, so they stay; rows with a null source get no host verdict; a
document without a label is scored by the classifier of those that have one, and without labels of both classes all
score the share of good labels; of rows that repeat an id and a text one stays, rows that share an id with different
texts are judged each by itself; ties of a group go to the smallest doc_id; very long texts are packed whole, in pieces;
an empty table gives an empty result, and an empty benchmark drops nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from resight.llm import decontamination, packing, quality_model, quality_rules, simhash
from resight.llm.common import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or come from a rejected host."""
    return quality_rules.keep_good(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, learned from those of them that have labels, takes for bad."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]

#: The classifier, XXH64 and the tokenizer can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as a table before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
