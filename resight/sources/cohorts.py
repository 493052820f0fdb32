"""Cohort parsers: expressions over a column of relative paths, so a cohort is parsed in its scan.

Each takes rows with path_rel (below the cohort's folder) and adds cohort, local_id, session, date, date_source, notes;
rows that aren't the cohort's are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resight.functions import scalars as S


def _folder(depth: int) -> Column:
    """The depth-th folder of the path, null if the path is shorter."""
    parts = F.split("path_rel", "/")
    return F.when(F.size(parts) > depth, parts.getItem(depth - 1))


def _stem() -> Column:
    return F.regexp_extract("path_rel", r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)


def _parent() -> Column:
    return F.regexp_extract("path_rel", r"([^/]+)/[^/]+$", 1)


def _rows(files: DataFrame, cohort: str, local_id: Column, session: Column, date: Column, source: Column, notes: Column | None = None) -> DataFrame:
    made = {"cohort": F.lit(cohort), "local_id": local_id, "session": session.cast("string"), "date": date, "date_source": source, "notes": notes if notes is not None else F.lit("")}
    return files.withColumns(made).filter(F.col("local_id").isNotNull())


# How photos are named in the cohorts, and the individual that the folder marked as an error belongs to.
FIELD_NAME = r"^(\d{2})-(\d{1,2})-(\d+)$"
SESSION_NAME = r"^(\d+)-(\d+)\s*\((\d+)\)$"
DATED_NAME = r"^(\d+)(?:\.(\d+))?$"
ERROR_ID = 20


def field_cohort(files: DataFrame) -> DataFrame:
    """TK: a folder for each individual, names id-session-MMYY, or a subfolder with MMYY for other names."""
    stem, folder = _stem(), _folder(1)
    number, digits = F.regexp_extract(stem, FIELD_NAME, 2), F.regexp_extract(stem, FIELD_NAME, 3)
    sub = F.when(F.size(F.split("path_rel", "/")) > 2, F.regexp_extract(_parent(), r"(\d{4})", 1)).otherwise("")
    named = digits != ""
    four = F.length(digits) == 4
    date = F.when(named & four, S.month_from_mmyy(F.substring(digits, 1, 2), F.substring(digits, 3, 2))).when(~named & (sub != ""), S.month_from_mmyy(F.substring(sub, 1, 2), F.substring(sub, 3, 2)))
    source = F.when(named, F.when(four, "filename").otherwise("filename_baddate")).when(sub != "", "subfolder").otherwise("none")
    local_id = F.when(S.leading_int(folder).isNotNull() & F.lower(folder).contains("error"), ERROR_ID).otherwise(S.leading_int(folder))
    return _rows(files, "TK", local_id, F.when(named, number.try_cast("int")), date, source)


def session_cohort(files: DataFrame) -> DataFrame:
    """PW: a folder for each individual, names id-session (frame); no dates."""
    number = F.regexp_extract(_stem(), SESSION_NAME, 2).try_cast("int")
    return _rows(files, "PW", S.leading_int(_folder(1)), number, F.lit(None).cast("string"), F.lit("session_code"))


def dated_cohort(files: DataFrame) -> DataFrame:
    """LAB: a folder DD.MM.YYYY for each session, names id or id.variant; other names are dropped."""
    date = S.date_from_dotted(_folder(1))
    local_id = F.when(date.isNotNull(), F.regexp_extract(_stem(), DATED_NAME, 1).try_cast("int"))
    return _rows(files, "LAB", local_id, date, date, F.lit("subfolder"))


def external_cohort(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """GCN: rows of a metadata table (identity, file_name, survey, recapture_id) whose file is there."""
    own = metadata.filter(S.missing("identity").isNotNull() & S.missing("file_name").isNotNull()).withColumn("path_rel", F.concat_ws("/", F.lit("Raw_Data"), "identity", "file_name"))
    found = own.join(files.select("path_rel").distinct(), "path_rel", "left_semi")
    # an absent value is written as None
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    notes = F.concat(F.lit("survey="), word("survey"), F.lit(";recapture_id="), word("recapture_id"))
    return _rows(found, "GCN", F.col("identity").try_cast("int"), F.col("survey"), F.lit(None).cast("string"), F.lit("none"), notes)


PARSERS = {"TK": field_cohort, "PW": session_cohort, "LAB": dated_cohort, "GCN": external_cohort}


def parse(cohort: str, files: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """The rows of one cohort, by its parser; the external one needs its metadata, and keeps the columns of files."""
    if cohort != "GCN":
        return PARSERS[cohort](files)
    if metadata is None:
        raise ValueError("the external cohort needs its metadata table")
    rows = external_cohort(metadata, files)
    return rows.join(files.select("path_rel", *[c for c in files.columns if c not in rows.columns]), "path_rel")


def parse_all(files: dict[str, DataFrame], metadata: DataFrame | None = None) -> DataFrame:
    """All cohorts (files by name), under the union of their columns."""
    from resight.operators.registry import union_cohorts

    return union_cohorts(*[parse(c, f, metadata) for c, f in files.items()])


def note(notes: Column | str, key: str) -> Column:
    """One value of notes "k=v;k=v"."""
    return F.try_element_at(F.str_to_map(notes if isinstance(notes, Column) else F.col(notes), F.lit(";"), F.lit("=")), F.lit(key))


def lab_benchmark(files: DataFrame) -> DataFrame:
    """The dated cohort as a benchmark: roles by earliest session, intervals in days, their bins. Needs md5."""
    from resight.operators.registry import exact_dedup

    rows = dated_cohort(files)
    kept, _ = exact_dedup(rows)
    kept = kept.withColumns({"stem_raw": _stem(), "variant": F.coalesce(F.regexp_extract(_stem(), r"^\d+\.(\d+)$", 1).try_cast("int"), F.lit(0))})
    return intervals(kept.withColumnRenamed("local_id", "id").withColumnRenamed("date", "session_date"), "id", "session_date")


def intervals(rows: DataFrame, individual: str, date: str) -> DataFrame:
    """Adds n_sessions, role, gallery_session, interval_days, interval_months, interval_bin by individual and ISO date."""
    own = rows.groupBy(individual).agg(F.min(date).alias("gallery_session"), F.count_distinct(date).cast("int").alias("n_sessions"))
    out = rows.join(own, individual)
    probe = F.col(date) != F.col("gallery_session")
    days = F.datediff(F.col(date).cast("date"), F.col("gallery_session").cast("date"))
    out = out.withColumns({"role": F.when(probe, "probe").otherwise("gallery"), "interval_days": F.when(probe, days).otherwise(0)})
    return out.withColumns({"interval_months": S.days_as_months("interval_days"), "interval_bin": F.when(F.col("role") == "probe", S.interval_bin("interval_days"))})
