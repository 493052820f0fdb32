"""Comparing methods and settings on one set of probes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resight.functions.stats import mcnemar, wilson
from resight.scratch import written


def all_methods(hits: dict[str, DataFrame]) -> DataFrame:
    """hits of several methods in one table with the column method."""
    return reduce(DataFrame.unionByName, [h.withColumn("method", F.lit(m)) for m, h in hits.items()])


def compare(hits: DataFrame, baseline: str, k: int = 1) -> DataFrame:
    """method, n, recall, ci (p, lo, hi), b (only the baseline hits), c (only the method hits), p (exact McNemar).

    The baseline's hits are joined by probe once; everything else is one aggregate.
    """
    base = hits.filter(F.col("method") == baseline).select("probe_id", F.col(f"hit_{k}").alias("base"))
    rows = hits.join(base, "probe_id").groupBy("method").agg(
        F.count("*").alias("n"), F.sum(F.col(f"hit_{k}").cast("long")).alias("s"), F.count_if(F.col("base") & ~F.col(f"hit_{k}")).alias("b"), F.count_if(~F.col("base") & F.col(f"hit_{k}")).alias("c")
    )
    return rows.select("method", "n", (F.col("s") / F.col("n")).alias("recall"), wilson(F.col("s"), F.col("n")).alias("ci"), "b", "c", mcnemar(F.col("b"), F.col("c")).alias("p"))


def adopt(comparison: DataFrame, baseline: str, alpha: float = 0.05) -> DataFrame:
    """Adds adopted: better than the baseline, and either the intervals are apart or p is below alpha."""
    base = comparison.filter(F.col("method") == baseline).select(F.col("recall").alias("_r"), F.col("ci.hi").alias("_hi"))
    apart = F.col("ci.lo") > F.col("_hi")
    return comparison.crossJoin(base).withColumn("adopted", (F.col("recall") > F.col("_r")) & (apart | (F.col("p") < alpha))).drop("_r", "_hi")


def decide(comparison: DataFrame, candidate: str, baseline: str, seconds_per_pair: float, budget: float, alpha: float = 0.05) -> str:
    """The rule that was fixed before: too slow, better, worse, or no difference."""
    if seconds_per_pair > budget:
        return "too_slow"
    rows = {r["method"]: r for r in comparison.filter(F.col("method").isin(candidate, baseline)).collect()}
    if rows[candidate]["p"] >= alpha:
        return "no_difference"
    return "better" if rows[candidate]["recall"] > rows[baseline]["recall"] else "worse"


def best_config(results: DataFrame, value: str = "recall", order: str = "config_no") -> DataFrame:
    """The row of the largest value; the first in order of ties."""
    return results.orderBy(F.desc(value), order).limit(1)


def grid(spark, **values: list) -> DataFrame:
    """All combinations with config_no, in order."""
    from itertools import product

    names = list(values)
    rows = [(i, *c) for i, c in enumerate(product(*values.values()))]
    return spark.createDataFrame(rows, ["config_no", *names])


def run_grid(spark, prepare, evaluate, values: dict[str, list], shared: list[str]) -> DataFrame:
    """config_no, the settings, and what evaluate(prepared, **settings) gives in its one row, for all combinations.

    prepare(**settings of `shared`) makes what settings beside these have in common; it is written once for each
    combination of the shared ones, and every run of the others reads it.
    """
    out, cache = None, {}
    for row in grid(spark, **values).orderBy("config_no").collect():  # a row for each combination
        settings = row.asDict()
        number = settings.pop("config_no")
        key = tuple(settings[s] for s in shared)
        if key not in cache:
            cache[key] = written(prepare(**{s: settings[s] for s in shared}), "grid")
        made = evaluate(cache[key], **settings).select(F.lit(number).alias("config_no"), *[F.lit(v).alias(k) for k, v in settings.items()], "*")
        out = made if out is None else out.unionByName(made)
    return out


def threshold_sweep(rows: DataFrame, quality: str, hit: str, thresholds: list[float], least: int = 5) -> DataFrame:
    """t, n, recall of the rows whose quality is at least t or unknown, for thresholds with enough rows.

    Each row is counted at the largest threshold that it passes; sums from above do the rest. So rows aren't
    multiplied by the number of thresholds.
    """
    ts = sorted(set(thresholds))
    at = F.when(F.col(quality).isNull() | F.isnan(F.col(quality).cast("double")), len(ts)).otherwise(sum((F.when(F.col(quality) >= t, 1).otherwise(0) for t in ts), F.lit(0)))
    counts = rows.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("s"))
    table = rows.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(ts)], "i int, t double")
    swept = table.join(counts, F.col("at") >= F.col("i")).groupBy("t").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return swept.filter(F.col("n") >= least).select("t", "n", (F.col("s") / F.col("n")).alias("recall"))
