"""Statistics in closed form or as short recurrences over columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def wilson(hits: Column, n: Column, z: float = Z95) -> Column:
    """struct(p, lo, hi) of a share; zeros where n is 0."""
    n_, p = F.nullif(n.cast("double"), F.lit(0.0)), hits.cast("double") / F.nullif(n.cast("double"), F.lit(0.0))
    scale = 1 + z * z / n_
    middle = (p + z * z / (2 * n_)) / scale
    half = z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_)) / scale
    some = [F.when(n > 0, x).otherwise(0.0) for x in (p, F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0)))]
    return F.struct(*[x.alias(name) for x, name in zip(some, ("p", "lo", "hi"), strict=True)])


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b and c discordant pairs; 1 without any. Terms of the binomial tail follow from one another,
    in logarithms, so large counts don't overflow."""
    b, c = b.cast("long"), c.cast("long")
    n, k = b + c, F.least(b, c)
    start = F.struct((-n * F.lit(math.log(2.0))).alias("term"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        start,
        lambda s, i: F.struct((s["term"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("term"), (s["sum"] + F.exp(s["term"])).alias("sum")),
        lambda s: s["sum"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar_p(b: int, c: int) -> float:
    """The same for two numbers."""
    n = b + c
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0


def wilson_ci(hits: int, n: int, z: float = Z95) -> tuple[float, float, float]:
    if not n:
        return 0.0, 0.0, 0.0
    p, scale = hits / n, 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / scale, z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return p, max(0.0, middle - half), min(1.0, middle + half)
