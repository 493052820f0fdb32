"""Identification against a catalog: top individuals with evidence, confidence and a three-way verdict."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resight.functions import scalars as S
from resight.operators.ranking import margins, ranked
from resight.operators.registry import numbered
from resight.operators.scoring import pooled
from resight.scratch import written


def catalog(features: DataFrame, splits: DataFrame, registry: DataFrame) -> DataFrame:
    """Features with identity, date and digest, without withheld individuals."""
    own = splits.filter(~F.coalesce("is_open_new", F.lit(False))).select("frame_id", "cohort", "individual_id", "date", "session")
    return features.join(own, "frame_id").join(registry.select("frame_id", "md5"), "frame_id", "left")


def session_name(individual: str = "individual_id", date: str = "date", frame: str = "frame_id") -> Column:
    """One name for an individual's session, that is its frames of one date; an undated frame is a session of its own."""
    dated = S.missing(F.col(date).cast("string"))
    return F.when(dated.isNotNull(), F.concat_ws("|", F.lit("d"), F.col(individual).cast("string"), dated)).otherwise(F.concat_ws("|", F.lit("f"), F.col(frame).cast("string")))


def session_of(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, frame_id: all frames of the individual's session that a query's frame belongs to; a frame that the
    catalog lacks is alone. queries: query_id, frame_id (null: no frames)."""
    keyed = catalog.select("frame_id", session_name().alias("k"))
    asked = queries.filter("frame_id is not null").join(keyed, "frame_id", "left")
    known = asked.filter("k is not null").select("query_id", "k").join(keyed, "k").select("query_id", "frame_id")
    return known.unionByName(asked.filter("k is null").select("query_id", "frame_id")).distinct()


def date_of(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, date of the frame that each query (query_id, frame_id) names; null if it is unknown or undated."""
    return queries.join(catalog.select("frame_id", S.missing(F.col("date").cast("string")).alias("date")), "frame_id", "left").select("query_id", "date")


def with_own_session(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """queries (query_id, frame_id or null, ...) with own_session: that of the frame they come from, null for new photos."""
    return queries.join(catalog.select("frame_id", session_name().alias("own_session")), "frame_id", "left")


def pair_score(pairs: DataFrame, features: DataFrame, payload: str = "emb") -> DataFrame:
    """a, b, score of pairs (a, b) of frames, by the cosine of their payloads."""
    side = lambda x: features.select(F.col("frame_id").alias(x), S.normalised(payload).alias(f"_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", S.cosine("_a", "_b").alias("score"))


def frames_for_digest(catalog: DataFrame, uploads: DataFrame) -> DataFrame:
    """query_id, frame_id of uploads (query_id, content) whose bytes are a catalog frame."""
    return uploads.select("query_id", F.md5("content").alias("md5")).join(catalog.select("md5", "frame_id"), "md5").select("query_id", "frame_id")


def scores(queries: DataFrame, catalog: DataFrame, exclude_own_session: bool, payload: str = "emb", **scoring: object) -> DataFrame:
    """query_id, individual_id, score, frame_id (the evidence). queries: query_id, payload, and own_session if its frames
    are not to be met. Whether they are is asked for each time, as a default would hide it."""
    own = F.col("own_session") if exclude_own_session else F.lit(None).cast("string")
    q = queries.select(F.col("query_id").alias("frame_id"), F.lit(None).cast(catalog.schema["individual_id"].dataType).alias("individual_id"), F.lit(None).cast("long").alias("tkey"), F.col(payload).alias("emb"), own.alias("own"))
    c = catalog.select("frame_id", "individual_id", F.lit(None).cast("long").alias("tkey"), F.col(payload).alias("emb"), (session_name() if exclude_own_session else F.lit(None).cast("string")).alias("own"))
    # ids of queries are no ids of frames: only the session tells what is not to be met
    found = pooled(q, c, strictly_earlier=False, itself=False, apart="own" if exclude_own_session else None, **scoring)
    return found.select(F.col("probe_id").alias("query_id"), "individual_id", "score", F.col("ref_id").alias("frame_id"))


def identify(queries: DataFrame, catalog: DataFrame, k: int = 5, lo: float = 0.0, hi: float = 1.0, exclude_own_session: bool = False, **scoring: object) -> DataFrame:
    """query_id, rank, individual_id, score, confidence, frame_id, n_photos: the k best individuals of each query.

    n_photos counts the whole catalog, frames of the own session too.
    """
    best = ranked(scores(queries, catalog, exclude_own_session, **scoring), "query_id").filter(F.col("rank") <= k)
    photos = catalog.groupBy("individual_id").agg(F.count("*").alias("n_photos"))
    return best.join(photos, "individual_id").select("query_id", "rank", "individual_id", "score", S.confidence("score", lo, hi).alias("confidence"), "frame_id", "n_photos")


def verdicts(queries: DataFrame, found: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """query_id, best, confidence, margin, verdict for each query; found: of scores(). No candidate is new with confidence 0."""
    m = margins(found, "query_id").select("query_id", "best", S.confidence("top1", lo, hi).alias("c1"), S.confidence("top2", lo, hi).alias("c2"))
    out = queries.select("query_id").join(m, "query_id", "left")
    return out.select("query_id", "best", F.coalesce("c1", F.lit(0.0)).alias("confidence"), F.round(F.col("c1") - F.coalesce("c2", F.lit(0.0)), 1).alias("margin"), S.verdict("c1", "c2").alias("verdict"))


def register(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """Catalog with new individuals (name, frame_id and the catalog's other columns), whose names are made unique.

    Registered in the order of frame_id: a blank name becomes NEW-n, where n counts the registrations (catalog frames
    REG-... before these); a name that is taken, by the catalog or an earlier registration, gets the first of (2), (3)...
    that is free. Only names that are equal but for such endings can take each other's, so each family of them is
    numbered by itself, from names alone.
    """
    fields = [c for c in catalog.columns if c != "individual_id"]
    before = catalog.filter(F.col("frame_id").cast("string").startswith("REG-")).count()
    rows = numbered(new, ["frame_id"], "_n")
    name = F.trim(F.coalesce("name", F.lit("")))
    rows = rows.withColumn("name", F.when(name == "", F.concat(F.lit("NEW-"), (F.col("_n") + before + 1).cast("string"))).otherwise(name))
    family = lambda c: F.regexp_replace(c, r"( \(\d+\))+$", "")
    taken = catalog.select(F.col("individual_id").cast("string").alias("name"), F.lit(None).cast("long").alias("n")).distinct()
    asked = written(rows.select("name", F.col("_n").alias("n")), "asked")
    names = taken.join(asked.select(family("name").alias("_f")).distinct(), family("name") == F.col("_f"), "left_semi").unionByName(asked)

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        used, after, out = set(group["name"][group["n"].isna()]), {}, []
        asks = group[group["n"].notna()].sort_values("n")
        for base, n in zip(asks["name"], asks["n"], strict=True):
            got, k = base, after.get(base, 2)
            while got in used:
                got, k = f"{base} ({k})", k + 1
            after[base] = k
            used.add(got)
            out.append((int(n), got))
        return pd.DataFrame(out, columns=["_n", "individual_id"])

    settled = names.groupBy(family("name").alias("family")).applyInPandas(settle, "_n long, individual_id string")
    return catalog.unionByName(rows.drop("name").join(settled, "_n").select("individual_id", *[c for c in fields if c in rows.columns]), allowMissingColumns=True)
