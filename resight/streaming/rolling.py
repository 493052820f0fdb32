"""A rolling gallery over a stream of frames: each arriving frame meets the individuals seen strictly before it.

State is one row for each individual: the sum and number of the vectors that are older than the delay, and the newer ones
each with its time. So a frame that comes late, but within the delay, meets what was before it and not what came before it;
frames of equal time don't meet. One that is later than that has null results and is left out of the state. An individual
that isn't seen for `forget` of event time is forgotten; without it, individuals are remembered as long as the stream runs.
This extends the batch engine and is no part of its results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "frame_id long, individual_id long, ts timestamp, n_before long, score double"
STATE = "sum array<double>, n long, folded long, times array<long>, vectors array<array<double>>"


def _updater(delay: int, forget: int | None) -> Callable:
    """delay and forget in microseconds."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, n, folded, times, vectors = state.get if state.exists else (None, 0, None, [], [])
        total, times, vectors = None if total is None else np.asarray(total, float), list(times), [np.asarray(v, float) for v in vectors]
        rows = pd.concat(list(batches)).sort_values(["ts", "frame_id"])
        out = []
        for r in rows.itertuples(index=False):
            t = r.ts.value // 1000
            if folded is not None and t <= folded:
                out.append((r.frame_id, key[0], r.ts, None, None))
                continue
            v = np.asarray(r.emb, float)
            v = v / (np.linalg.norm(v) or 1.0)
            earlier = [x for x, at in zip(vectors, times, strict=True) if at < t]
            parts = earlier if total is None else [total, *earlier]
            gallery = np.sum(parts, axis=0) if parts else None
            out.append((r.frame_id, key[0], r.ts, n + len(earlier), None if gallery is None else float(v @ gallery / (np.linalg.norm(gallery) or 1.0))))
            times.append(t)
            vectors.append(v)
        if times:
            cut = max(times) - delay
            for at, v in zip(times, vectors, strict=True):
                if at <= cut:
                    total, n = v if total is None else total + v, n + 1
            folded = cut if folded is None else max(cut, folded)
            kept = [(at, v) for at, v in zip(times, vectors, strict=True) if at > cut]
            state.update((None if total is None else total.tolist(), n, folded, [at for at, _ in kept], [v.tolist() for _, v in kept]))
            if forget is not None:
                state.setTimeoutTimestamp(max(max(times) // 1000 + forget // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["frame_id", "individual_id", "ts", "n_before", "score"]).astype({"n_before": "Int64"})

    return update


def consistency(frames: DataFrame, delay: str = "7 days", forget: str | None = None) -> DataFrame:
    """For each frame of a stream (frame_id, individual_id, ts, emb) its similarity to the individual's earlier frames."""
    micros = lambda x: int(pd.Timedelta(x).value // 1000)
    kind = GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.EventTimeTimeout
    made = _updater(micros(delay), None if forget is None else micros(forget))
    return frames.withWatermark("ts", delay).groupBy("individual_id").applyInPandasWithState(made, OUTPUT, STATE, "append", kind)


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Event time as an instant; times without a zone count in the session's zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions of a stream of sightings: user, start, end, n."""
    w = F.session_window(ts, gap)
    return _timed(events, ts).withWatermark(ts, watermark).groupBy(user, w.alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sightings(events: DataFrame, width: str = "1 day", slide: str | None = None, watermark: str = "2 days", by: str = "event_type", ts: str = "ts") -> DataFrame:
    """Counts in windows; late rows within the watermark count."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return _timed(events, ts).withWatermark(ts, watermark).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), by, "n", "users")
