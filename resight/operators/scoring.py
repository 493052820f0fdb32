"""Scores of probes against references, pooled by individual, without a pair table.

Rows are sorted by group and time and written as tiles of up to TILE rows of one group, with the least and greatest
time of each. Tiles whose times allow a comparison meet; one Arrow call scores a tile of probes against a tile of
references by matrix products of BLOCK rows, drops what time or self-exclusion forbids, and keeps the best reference
of each individual. So a pair of tiles leaves one row for each probe and individual at most, and these are pooled
again after a shuffle by probe. A tile is sent once to each counterpart that its time allows: n * n / TILE rows at
most, and a small fraction of that where few tiles are earlier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from resight.scratch import written

#: Rows of a tile, and of a matrix product.
TILE, BLOCK = 4096, 256
#: Decimals that scores are compared at, so that ties don't depend on the order of sums.
DECIMALS = 6
#: payloads of probes and of references -> matrix of scores
ScoreBlock = Callable[[pa.Array, pa.Array], np.ndarray]
_COLUMNS = ("id", "individual", "time", "payload", "own")


def _unit(x: pa.Array) -> np.ndarray:
    m = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    n = np.sqrt(np.square(m).sum(1, keepdims=True))
    return m / np.where(n > 0, n, 1.0)


def cosine_block(probes: pa.Array, refs: pa.Array) -> np.ndarray:
    return _unit(probes) @ _unit(refs).T


def pairwise(score: Callable[[object, object], float]) -> ScoreBlock:
    """A block scorer from a scorer of two payloads."""

    def block(probes: pa.Array, refs: pa.Array) -> np.ndarray:
        left, right = probes.to_pylist(), refs.to_pylist()
        return np.array([[score(a, b) for b in right] for a in left], np.float64).reshape(len(left), len(right))

    return block


def _tiles(df: DataFrame, frame: str, individual: str, time: str, payload: str, group: str | None, own: str | None, tile: int, label: str, order: tuple[str, ...] | None = None, ranges: int | None = None) -> DataFrame:
    """A table of g, tile, low, high (times), and a list of each of _COLUMNS. order: columns, time among them or not, in place of time within a group. ranges: files to write, about."""
    g = (F.col(group) if group else F.lit(0)).cast("string").alias("g")
    rows = df.select(g, F.col(frame).alias("id"), F.col(individual).alias("individual"), F.col(time).cast("long").alias("time"), F.col(payload).alias("payload"), (F.col(own) if own else F.lit(None)).cast("string").alias("own"), *[c for c in order or () if c != "time"])
    order = ["g", *([F.col("time").asc_nulls_last()] if order is None else [F.col(c).asc_nulls_last() for c in order]), "id"]
    schema = "g string, tile long, low long, high long, " + ", ".join(f"{c} array<{rows.schema[c].dataType.simpleString()}>" for c in _COLUMNS)
    kinds = [pa.list_(to_arrow_type(rows.schema[c].dataType)) for c in _COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            times = pc.min_max(whole.column("time"))
            lists = [pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), pa.concat_arrays(whole.column(c).chunks)).cast(k) for c, k in zip(_COLUMNS, kinds, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([whole.column("g").chunk(0)[:1], pa.array([n]), pa.array([times["min"].as_py()], pa.int64()), pa.array([times["max"].as_py()], pa.int64()), *lists], names=["g", "tile", "low", "high", *_COLUMNS])

        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            while at < batch.num_rows:
                if held and (size >= tile or held[0].column(0)[0].as_py() != keys[at]):
                    yield flush()
                    n, size = n + 1, 0
                stop = min(batch.num_rows, at + tile - size)
                while keys[stop - 1] != keys[at]:  # sorted by group
                    stop -= 1
                held.append(batch.slice(at, stop - at))
                size, at = size + stop - at, stop
        if held:
            yield flush()

    ranged = rows.repartitionByRange(*order) if ranges is None else rows.repartitionByRange(ranges, *order)
    return written(ranged.sortWithinPartitions(*order).mapInArrow(run, schema), label)


def _meet(p: list[pa.Array], r: list[pa.Array], score: ScoreBlock, strictly_earlier: bool, apart: bool, itself: bool, decimals: int, most: int | None = None, least: np.ndarray | None = None) -> Iterator[tuple[pa.Array, ...]]:
    """(probe ids, their individuals, individuals, scores, reference ids) of the best references, by blocks of probes; with
    most, of each probe's so many best individuals and those that score as the last of them; with least, a number for each
    probe, of scores that reach it."""
    order = pc.sort_indices(pa.table([r[1], r[0]], names=["who", "id"]), sort_keys=[("who", "ascending"), ("id", "ascending")])
    ids, who, times, payload, own = (x.take(order) for x in r)
    codes = who.dictionary_encode().indices.fill_null(-1).to_numpy()
    starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
    lengths = np.diff(np.append(starts, len(codes)))
    first = who.take(pa.array(starts))
    places = np.arange(len(codes))
    if itself:
        same = pa.concat_arrays([p[0], ids]).dictionary_encode().indices.to_numpy()
        left_id, right_id = same[: len(p[0])], same[len(p[0]) :]
    if apart:
        same = pa.concat_arrays([p[4], own]).dictionary_encode().indices.fill_null(-1).to_numpy()
        left_own, right_own = same[: len(p[0])], same[len(p[0]) :]
    if strictly_earlier:
        left_time, right_time = p[2].to_numpy(zero_copy_only=False).astype(np.float64), times.to_numpy(zero_copy_only=False).astype(np.float64)
    for at in range(0, len(p[0]), BLOCK):
        part = slice(at, at + BLOCK)
        s = np.round(score(p[3][part], payload), decimals)
        forbidden = np.zeros(s.shape, bool)
        if itself:
            forbidden |= left_id[part, None] == right_id
        if strictly_earlier:
            with np.errstate(invalid="ignore"):
                forbidden |= ~(right_time < left_time[part, None])
        if apart:
            forbidden |= (left_own[part, None] == right_own) & (left_own[part, None] >= 0)
        s[forbidden] = -np.inf
        best = np.maximum.reduceat(s, starts, axis=1)
        place = np.minimum.reduceat(np.where(s == np.repeat(best, lengths, axis=1), places, len(places)), starts, axis=1)
        kept = best > -np.inf
        if least is not None:
            kept &= best >= least[part, None]
        if most is not None and best.shape[1] > most:
            kept &= best >= -np.partition(-best, most - 1, axis=1)[:, most - 1 : most]
        row, column = np.nonzero(kept)
        if len(row):
            probe = pa.array(row + at)
            yield p[0].take(probe), p[1].take(probe), first.take(pa.array(column)), pa.array(best[row, column]), ids.take(pa.array(place[row, column]))


def pooled(
    probes: DataFrame, refs: DataFrame, payload: str = "emb", frame: str = "frame_id", individual: str = "individual_id", time: str = "tkey", group: str | None = None,
    strictly_earlier: bool = True, apart: str | None = None, itself: bool = True, score: ScoreBlock = cosine_block, tile: int = TILE, decimals: int = DECIMALS, shipped: bool = True,
) -> DataFrame:
    """probe_id, truth, individual_id, score, ref_id: for each probe and individual its best reference (highest score,
    then smallest id). References with null time are never earlier. group: compare within its values only. apart: a
    column of both; rows with the same value of it are not compared. itself: a frame is not compared with itself, that
    is with a reference of its id; turned off where probes have ids of their own. shipped=False: where all tiles meet and
    payloads are large, a task reads the files of two ranges of rows and nothing is shuffled before it is scored."""
    # a file is read at once: without a shuffle it is about a tile
    left, right = (_tiles(df, frame, individual, time, payload, group, apart, tile, label, ranges=None if shipped else max(1, -(-df.count() // tile))) for df, label in ((probes, "probes"), (refs, "refs")))
    side = lambda df, x: df.select(F.col("tile").alias(f"{x}_tile"), *[F.col(c).alias(f"{x}_{c}") for c in _COLUMNS])
    if shipped:
        pairs = left.select("g", F.col("tile").alias("p_tile"), F.col("high").alias("p_high")).join(right.select("g", F.col("tile").alias("r_tile"), F.col("low").alias("r_low")), "g")
        if strictly_earlier:
            pairs = pairs.filter("r_low < p_high")
        both = pairs.join(side(left, "p"), "p_tile").join(side(right, "r"), "r_tile")
    else:
        key = lambda df, x: df.select(F.col("g").alias(f"{x}_g"), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high"), *[F.col(c).alias(f"{x}_{c}") for c in _COLUMNS])
        allowed = F.col("p_g") == F.col("r_g")
        both = key(left, "p").hint("shuffle_replicate_nl").join(key(right, "r"), allowed & (F.col("r_low") < F.col("p_high")) if strictly_earlier else allowed)
    id_type, ref_type, own_type = probes.schema[frame].dataType, refs.schema[frame].dataType, refs.schema[individual].dataType
    schema = f"probe_id {id_type.simpleString()}, truth {own_type.simpleString()}, individual_id {own_type.simpleString()}, score double, ref_id {ref_type.simpleString()}"
    kinds = pa.schema([("probe_id", to_arrow_type(id_type)), ("truth", to_arrow_type(own_type)), ("individual_id", to_arrow_type(own_type)), ("score", pa.float64()), ("ref_id", to_arrow_type(ref_type))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(_COLUMNS)
        for batch in batches:
            for i in range(batch.num_rows):
                p, r = ([batch.column(k + at)[i].values for k in range(n)] for at in (0, n))
                for made in _meet(p, r, score, strictly_earlier, apart is not None, itself, decimals):
                    yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(made, kinds.types, strict=True)], schema=kinds)

    made = both.select(*[f"{x}_{c}" for x in "pr" for c in _COLUMNS]).mapInArrow(run, schema)
    best = F.min(F.struct((-F.col("score")).alias("s"), "ref_id"))
    return made.groupBy("probe_id", "truth", "individual_id").agg(best.alias("b")).select("probe_id", "truth", "individual_id", (-F.col("b.s")).alias("score"), F.col("b.ref_id").alias("ref_id"))
