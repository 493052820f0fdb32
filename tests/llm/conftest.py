import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(60_000))
PLAIN = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river at dusk."


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids."""
    rows = [
        (1, PLAIN, "en", "a", 5), (1, PLAIN, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (None, PLAIN + " More words here.", "en", None, 1), (None, None, None, "b", None),
        (4, LONG, "en", "a", 9), (5, " \n\t ", "de", "b", 3), (6, "wörter, ünd ñandú!", "de", "b", 3), (7, PLAIN.upper(), None, "a", 3), (8, "\x00\x1c odd\u2028signs 😀", "fr", "c", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Further columns with names that operators use inside."""
    from pyspark.sql import functions as F

    names = "t k0 f0 fp head nth base_failed host n_docs score stats id label held_out host_key labelled rest pid".split()
    return odd.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(10)] + [(1, 1, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, PLAIN), (2, None), (3, ""), (None, "short one"), (4, PLAIN)], "item_id long, text string")
