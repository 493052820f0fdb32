"""Quality classifier: regularised quadratic discriminant analysis.

Each class of labelled documents gets the mean and covariance of its transformed statistics (doc_stats). A class
covariance is shrunk towards the pooled one, and that towards a multiple of the identity; its Cholesky factor is
kept, and a document's score is the logistic of the difference of the classes' log densities, whose Mahalanobis
distances come from triangular solves. Counts, sums and cross products are all that is gathered: d * d numbers a
class, whatever the number of labelled rows; the fit uses all rows that it may learn from.

Defined results: a null or empty text has finite statistics and so a score; several labels of a document each count
in the fit; labels that are null don't; without labels of both classes every score is the share of good labels (0.5
without labels); an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm.common import fold, free_name, map_text, materialize, sampled, table, trim, utf8
from resight.llm.doc_stats import NAMES, statistics

#: Shares of the pooled covariance, and then of the scaled identity, in a class covariance.
TO_POOLED, TO_IDENTITY = 0.5, 0.1
#: Log density ratios beyond this count as this.
MOST_LOGIT = 30.0
#: Labelled documents that the pipeline's stage learns from.
MOST_LABELS = 30_000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3


@dataclass
class Discriminant:
    """Per class (0, 1): log prior, mean, inverse of the Cholesky factor, half its log determinant."""

    priors: list[float]
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    halves: list[float]
    constant: float | None = None

    @classmethod
    def fit(cls, counts: list[int], sums: list[np.ndarray], products: list[np.ndarray], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
        """counts, sums and cross products of the statistics, of the classes 0 and 1."""
        total = sum(counts)
        if min(counts) < 2:
            return cls([], [], [], [], counts[1] / total if total else 0.5)
        d = len(sums[0])
        means = [s / n for n, s in zip(counts, sums, strict=True)]
        scatter = [p - n * np.outer(m, m) for n, m, p in zip(counts, means, products, strict=True)]
        pooled = (scatter[0] + scatter[1]) / max(1, total - 2)
        pooled += np.eye(d) * 1e-6
        scale = np.sqrt(np.diag(pooled))
        inverses, halves = [], []
        for n, s in zip(counts, scatter, strict=True):
            own = (1 - to_pooled) * s / max(1, n - 1) + to_pooled * pooled
            own = own / np.outer(scale, scale)  # so that the identity treats all statistics alike
            own = (1 - to_identity) * own + to_identity * np.trace(own) / d * np.eye(d)
            factor = np.linalg.cholesky(own)
            inverses.append(np.linalg.solve(factor, np.diag(1 / scale)))
            halves.append(float(np.log(np.diag(factor)).sum()))
        return cls([float(np.log(n / total)) for n in counts], means, inverses, halves)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of x."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = [p - h - 0.5 * np.square((x - m) @ v.T).sum(1) for p, m, v, h in zip(self.priors, self.means, self.inverses, self.halves, strict=True)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -MOST_LOGIT, MOST_LOGIT)))


def moments(rows: DataFrame, x: str, label: str) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Count, sum and cross products of the array column x by label 0 and 1. One row of numbers for each task and class."""
    d = len(NAMES)

    def run(batches):
        n, s, p = np.zeros(2, np.int64), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                y = np.asarray(batch.column(1).to_pylist())
                for k in (0, 1):
                    own = v[y == k]
                    n[k] += len(own)
                    s[k] += own.sum(0)
                    p[k] += own.T @ own
        flat = np.concatenate([s, p.reshape(2, -1)], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], flat.shape[1])), pa.array(np.tile(np.arange(flat.shape[1]), 2)), pa.array(np.repeat(n, flat.shape[1])), pa.array(flat.ravel())], names=["label", "i", "n", "v"])

    parts = rows.select(x, F.col(label).cast("long")).mapInArrow(run, "label long, i long, n long, v double")
    found = parts.groupBy("label", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    counts, flat = [0, 0], np.zeros((2, d + d * d))
    for r in found:
        counts[r["label"]] = r["n"]
        flat[r["label"], r["i"]] = r["v"]
    return counts, [flat[k, :d] for k in (0, 1)], [flat[k, d:].reshape(d, d) for k in (0, 1)]


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A table of doc_id and stats, a row for each row of docs."""

    def kernel(texts: list[bytes]) -> dict[str, object]:
        return {"stats": pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))}

    return materialize(map_text(docs, text, {"doc_id": F.col(doc_id)}, kernel, "stats array<double>"), "stats")


def fit(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", held_out: bool = True) -> Discriminant:
    """From the labelled rows, without the held-out fold unless that is turned off. stats: of with_statistics."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    if held_out:
        known = known.filter(fold("doc_id", FOLDS) != HELD_OUT)
    return Discriminant.fit(*moments(stats.join(known, "doc_id").filter("label in (0, 1)"), "stats", "label"))


def scores(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score for each row of stats."""

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))))

    return stats.select("doc_id", score("stats").alias("score"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs."""
    stats = with_statistics(docs, doc_id, text)
    made = scores(stats, fit(stats, labels, doc_id))
    return made.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, most: int = MOST_LABELS) -> DataFrame:
    """The rows of docs that score at least the threshold, with their columns as they are.

    The fit takes about `most` labelled documents at most, by a hash of the id, so that no text is shuffled; all
    documents are scored as they pass.
    """
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (fold(doc_id, FOLDS) != HELD_OUT))
    some = known.select(F.col(doc_id).alias(key := free_name(docs, "labelled"))).distinct()
    n = some.count()
    some = sampled(some, F.xxhash64(key), min(1.0, most / n) if n else 1.0, most)
    model = fit(with_statistics(docs.join(some, F.col(doc_id) == F.col(key), "left_semi"), doc_id, text), labels, doc_id, label)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        made = np.array([statistics(t or b"") for t in texts.to_pylist()]).reshape(-1, len(NAMES))
        trim()
        return pa.array(model.score(made) >= threshold)

    return docs.filter(good(utf8(text)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
