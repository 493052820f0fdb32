"""Scalar functions over columns. All but `fraction` are built-in expressions, so they stay in generated code."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from resight.schema import DATED, INTERVAL_BINS

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing(x: ColumnOrName) -> Column:
    """'' and NaN text count as null."""
    x = _c(x)
    return F.when((x == "") | F.lower(x).isin("nan", "none"), None).otherwise(x)


def try_int(x: ColumnOrName) -> Column:
    return _c(x).try_cast("int")


def leading_int(name: ColumnOrName) -> Column:
    """Leading digits of a folder's name as a number, else null."""
    return F.regexp_extract(_c(name), r"^(\d+)", 1).try_cast("int")


def month_from_mmyy(mm: ColumnOrName, yy: ColumnOrName) -> Column:
    """'01', '25' -> '2025-01'. Months are not checked here; the date gate does that."""
    return F.concat(F.lit("20"), _c(yy), F.lit("-"), _c(mm))


def date_from_dotted(name: ColumnOrName) -> Column:
    """'23.01.2025' -> '2025-01-23', else null."""
    parts = [F.regexp_extract(_c(name), r"^(\d{2})\.(\d{2})\.(\d{4})$", i) for i in (3, 2, 1)]
    return F.when(parts[0] != "", F.concat_ws("-", *parts))


def individual_id(cohort: ColumnOrName, local_id: ColumnOrName) -> Column:
    return F.format_string("%s-%03d", _c(cohort), _c(local_id))


def lookup(key: ColumnOrName, values: dict[str, str]) -> Column:
    return reduce(lambda rest, kv: F.when(_c(key) == kv[0], kv[1]).otherwise(rest), reversed(values.items()), F.lit(None).cast("string"))


def session_key(date: ColumnOrName, session: ColumnOrName) -> Column:
    """What counts as one session of an individual: the date, else the session's name, else the word None."""
    return F.coalesce(missing(date), _c(session).cast("string"), F.lit("None"))


def time_key(cohort: ColumnOrName, date: ColumnOrName, session: ColumnOrName) -> Column:
    """The date in dated cohorts, the session elsewhere; null means without valid time."""
    return F.when(_c(cohort).isin(*DATED), missing(date)).otherwise(missing(_c(session).cast("string")))


def _month_number(key: Column) -> Column:
    year, month = (F.regexp_extract(key, r"^(\d{4})-(\d+)", i).try_cast("int") for i in (1, 2))
    return year * 12 + month


def month_gap(earlier: ColumnOrName, later: ColumnOrName) -> Column:
    """Calendar months between two 'YYYY-MM[-DD]', days ignored; null if either is no date."""
    return (_month_number(_c(later)) - _month_number(_c(earlier))).cast("double")


def session_gap(earlier: ColumnOrName, later: ColumnOrName) -> Column:
    """Difference of two session numbers, 0 if either is none."""
    return F.coalesce((try_int(later) - try_int(earlier)).cast("double"), F.lit(0.0))


def interval(earlier: ColumnOrName, later: ColumnOrName) -> Column:
    return F.coalesce(month_gap(earlier, later), session_gap(earlier, later))


def order_key(date: ColumnOrName, session: ColumnOrName, legacy_undated: bool = False) -> Column:
    """Sortable time: YYYYMM00 or YYYYMMDD00 for dates, else the session number.

    Undated frames of dated cohorts would sort before all dates by their session number, and so be in every gallery
    of earlier frames; they get null, and legacy_undated=True brings the number (or 0) back.
    """
    dated = F.regexp_replace(missing(date), "-", "").try_cast("bigint") * 100
    if legacy_undated:
        return F.coalesce(dated, _c(session).try_cast("bigint"), F.lit(0).cast("bigint"))
    return dated


def shot_key(date: ColumnOrName, session: ColumnOrName, undated: int = 202412) -> Column:
    """As order_key without the factor, for comparisons by shot; undated frames count as a given month."""
    return F.coalesce(F.regexp_replace(missing(date), "-", "").try_cast("bigint"), F.lit(undated).cast("bigint"))


def survivor_keys(path: ColumnOrName) -> list[Column]:
    """Sort keys of which file of equal bytes stays: no variant number, two digits before one, name."""
    stem = F.regexp_extract(_c(path), r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)
    digits = F.length(F.regexp_extract(stem, r"^(\d+)", 1))
    return [stem.rlike(r"^\d+\.\d+$").cast("int"), F.when((digits == 0) | (digits >= 2), 0).otherwise(1), stem]


def days_as_months(days: ColumnOrName) -> Column:
    return F.round(_c(days) / F.lit(30.44), 1)


def interval_bin(days: ColumnOrName) -> Column:
    d = _c(days)
    one, few, many = INTERVAL_BINS
    return F.when(d <= 40, one).when(d <= 95, few).when(d.isNotNull(), many)


def valid_date(date: ColumnOrName, years: tuple[int, int] = (2024, 2026)) -> Column:
    """True for 'YYYY-MM[-...]' in the years with a month of 1 to 12; null is no date and so not invalid."""
    year, month = (F.get(F.split(_c(date), "-"), i).try_cast("int") for i in (0, 1))
    return F.coalesce(year.between(*years) & month.between(1, 12), F.lit(False))


def confidence(score: ColumnOrName, lo: float | Column, hi: float | Column) -> Column:
    """In percent: linear between lo and hi, at most 99."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    share = (_c(score) - lo) / F.greatest(hi - lo, F.lit(1e-6))
    return F.least(F.greatest(share, F.lit(0.0)) * 100, F.lit(99.0))


def zone(score: ColumnOrName, new_below: float | Column, known_from: float | Column) -> Column:
    return F.when(_c(score) >= known_from, "known").when(_c(score) < new_below, "new").otherwise("review")


def verdict(top1: ColumnOrName, top2: ColumnOrName, known_from: float = 70.0, margin: float = 8.0, new_below: float = 40.0) -> Column:
    """From the confidences of the best and second best; no candidate at all is new."""
    first, second = _c(top1), F.coalesce(_c(top2), F.lit(0.0))
    return F.when(first.isNull() | (first < new_below), "new").when((first >= known_from) & (F.round(first - second, 1) >= margin), "known").otherwise("review")


def base64_of(content: ColumnOrName) -> Column:
    """Base64 in one line, as a data URI takes it."""
    return F.regexp_replace(F.base64(_c(content)), r"\s", "")


def hamming_hex(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Differing bits of two hashes of 16 hex digits. Halves, as 64 bits with the top one set don't fit a signed cast."""

    def half(x: Column, i: int) -> Column:
        return F.conv(F.substring(x, i, 8), 16, 10).cast("bigint")

    return sum((F.bit_count(half(_c(a), i).bitwiseXOR(half(_c(b), i))) for i in (1, 9)), F.lit(0))


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Dot product of two arrays, the cosine if they are normalised. For few pairs; see operators.scoring for many."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalised(v: ColumnOrName) -> Column:
    length = F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(_c(v), lambda x: x.cast("double") / F.when(length > 0, length).otherwise(1.0))


def affine(points: ColumnOrName, m: list[float]) -> Column:
    """Points (x, y) through a 2 x 3 matrix in row order."""
    a, b, c, d, e, f = (F.lit(float(x)) for x in m)
    return F.transform(_c(points), lambda p: F.struct((a * p.x + b * p.y + c).alias("x"), (d * p.x + e * p.y + f).alias("y")))


def hash_fraction(key: str, seed: int = 42) -> float:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "big") / 2**64


def fraction(key: ColumnOrName, seed: int = 42) -> Column:
    """A number in [0, 1) that depends on key and seed only: blake2b, which Spark doesn't have, in Arrow batches."""

    @F.pandas_udf("double")
    def run(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else hash_fraction(k, seed))

    return run(_c(key))
