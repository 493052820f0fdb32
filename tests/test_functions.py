import pytest
from pyspark.sql import functions as F

from resight.functions import scalars as S
from resight.functions.stats import mcnemar, mcnemar_p, wilson, wilson_ci

WILSON = [((79, 100), (0.790, 0.700, 0.858)), ((73, 97), (0.753, 0.658, 0.828)), ((61, 97), (0.629, 0.530, 0.718)), ((86, 86), (1, 0.957, 1)), ((53, 78), (0.679, 0.570, 0.773)), ((0, 0), (0, 0, 0))]
MCNEMAR = [((3, 52), 0.0), ((8, 19), 0.0522), ((6, 3), 0.5078), ((12, 2), 0.0129), ((7, 6), 1.0), ((4, 6), 0.7539), ((0, 0), 1.0)]
FRACTIONS = {"TK-004": 0.777509, "TK-007": 0.841269, "TK-009": 0.596226, "TK-010": 0.591887, "TK-027": 0.591232, "TK-044": 0.951812, "TK-048": 0.735386, "TK-065": 0.502146, "TK-072": 0.760074, "TK-062": 0.104682}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_wilson(spark):
    rows = spark.createDataFrame([k for k, _ in WILSON], "h long, n long").select("h", "n", wilson(F.col("h"), F.col("n")).alias("w")).collect()
    found = {(r["h"], r["n"]): tuple(round(x, 3) for x in r["w"]) for r in rows}
    for k, v in WILSON:
        assert found[k] == v == tuple(round(x, 3) for x in wilson_ci(*k))


def test_mcnemar(spark):
    rows = spark.createDataFrame([k for k, _ in MCNEMAR] + [(3000, 3100)], "b long, c long").select("b", "c", mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    found = {(r["b"], r["c"]): r["p"] for r in rows}
    for k, v in MCNEMAR:
        assert round(found[k], 4) == v == round(mcnemar_p(*k), 4)
    assert found[3000, 3100] == pytest.approx(mcnemar_p(3000, 3100), abs=1e-9)


def test_fractions(spark):
    rows = spark.createDataFrame([(k,) for k in FRACTIONS], "k string").select("k", S.fraction(F.concat(F.lit("fold:"), "k")).alias("f")).collect()
    assert {r["k"]: round(r["f"], 6) for r in rows} == FRACTIONS
    assert round(S.hash_fraction("open:TK-062"), 6) == 0.031344
    assert one(spark, S.fraction(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(
    "a,b,gap",
    [("2024-12", "2025-02", 2.0), ("2024-12-31", "2025-01-01", 1.0), ("1", "3", 2.0), ("x", "3", 0.0), ("2025-03", "2025-03", 0.0)],
)
def test_intervals(spark, a, b, gap):
    assert one(spark, S.interval(F.lit(a), F.lit(b))) == gap


def test_time_keys(spark):
    null = F.lit(None).cast("string")
    assert one(spark, S.time_key(F.lit("TK"), F.lit(""), F.lit("2"))) is None
    assert one(spark, S.time_key(F.lit("PW"), null, F.lit("2"))) == "2"
    assert one(spark, S.session_key(null, null)) == "None"
    assert one(spark, S.order_key(F.lit("2025-01"), null)) == 20250100
    assert one(spark, S.order_key(F.lit("2025-01-23"), null)) == 2025012300
    assert one(spark, S.order_key(null, F.lit("2"))) is None
    assert one(spark, S.order_key(null, F.lit("2"), legacy_undated=True)) == 2
    assert one(spark, S.shot_key(null, null)) == 202412


def test_hamming(spark):
    assert one(spark, S.hamming_hex(F.lit("ffffffffffffffff"), F.lit("0000000000000000"))) == 64
    assert one(spark, S.hamming_hex(F.lit("8000000000000001"), F.lit("0000000000000000"))) == 2


def test_dates(spark):
    for d, ok in (("2025-01", True), ("2025-13", False), ("2023-01", False), ("abc", False), ("2025-02-31", True)):
        assert one(spark, S.valid_date(F.lit(d))) is ok


def test_verdicts(spark):
    null = F.lit(None).cast("double")
    cases = [(90.0, 50.0, "known"), (90.0, 85.0, "review"), (39.9, 1.0, "new"), (50.0, 1.0, "review"), (70.0, 62.0, "known")]
    for a, b, v in cases:
        assert one(spark, S.verdict(F.lit(a), F.lit(b))) == v
    assert one(spark, S.verdict(null, null)) == "new"
    assert one(spark, S.verdict(F.lit(80.0), null)) == "known"
    assert one(spark, S.confidence(F.lit(41.0), 8, 41)) == 99.0
    assert one(spark, S.confidence(F.lit(1.0), 8, 41)) == 0.0
    assert [one(spark, S.zone(F.lit(x), 3.0, 9.0)) for x in (9.0, 5.0, 2.0)] == ["known", "review", "new"]


def test_affine(spark):
    points = F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")))
    assert [tuple(p) for p in one(spark, S.affine(points, [1, 0, 5, 0, 2, -1]))] == [(6.0, 3.0)]
