"""The best individuals of each probe, without scoring what can't be among them.

References and probes are dealt to the nearest of some centres, sorted within them along a curve through the centre's main
directions, and packed into tiles. A tile has a middle and a radius, the widest angle from it. By the triangle inequality
of angles no pair of two tiles is closer than the middles' angle less both radii, so its cosine bounds the tiles' scores.
The tiles that promise most are scored first; then each tile of probes has a floor, the least k-th score of its probes so
far, and tiles whose bound is below that are never scored. The result has the rows of scoring.pooled and ranking.top_k,
ties included.

Neighbouring tiles are a block of up to ROWS rows. Blocks have bounds too, and tiles are only looked at where their blocks'
bound allows it. Rows are sent by block, once to each block that holds a tile to be scored with one of theirs: n * n /
ROWS rows at most, however small the tiles are. Of a block only the tiles that are to be scored there are sent, and a probe
sends nothing on that is below its k-th score so far.

Centres come from a bounded sample by a hash; they decide how much is skipped and not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from resight.operators.ranking import top_k
from resight.operators.scoring import _COLUMNS, DECIMALS, _meet, _tiles, _unit, cosine_block
from resight.scratch import discard, written

#: Rows of a tile, rows for each centre, most centres, rows for each centre that it is learned from, and rounds of that.
TILE, EACH, MOST, SAMPLE, ROUNDS = 256, 512, 1024, 16, 4
#: Directions of a centre that its rows are sorted by, and bits of each.
AXES, BITS = 3, 10
#: Rows of a block of tiles.
ROWS = 4096
#: Blocks whose bounds are taken at once.
BLOCK = 1024
#: How many tiles each tile of probes meets in the first rounds, and in how many blocks they are looked for.
FIRST, NEAR = (2, 8), 8
#: Scores that take as long as one more call to score them.
CALL = 50_000
#: What rounding may add to a score, beside its decimals.
SLACK = 1e-9


def _beside(x: np.ndarray) -> np.ndarray:
    """An order of rows in which near ones are mostly near: halved along the widest direction, again and again."""
    if len(x) < 3:
        return np.arange(len(x))
    y = x - x.mean(0)
    order = np.argsort(y @ np.linalg.svd(y, full_matrices=False)[2][0], kind="stable")
    halves = order[: len(x) // 2], order[len(x) // 2 :]
    return np.concatenate([half[_beside(x[half])] for half in halves])


def centres(refs: DataFrame, payload: str = "emb", frame: str = "frame_id", each: int = EACH) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors about which references lie, near ones beside one another; the AXES main directions about each, over how
    far they reach), by k-means over a sample of MOST * SAMPLE rows at most."""
    n = refs.count()
    count = max(1, min(MOST, n // each))
    share = min(1.0, SAMPLE * count / max(1, n))
    some = refs.filter(F.pmod(F.xxhash64(frame), F.lit(1 << 20)) < share * (1 << 20)).orderBy(F.xxhash64(frame)).limit(MOST * SAMPLE)
    x = _unit(some.select(payload).toArrow().column(0).combine_chunks()) if n else np.zeros((0, 1))
    x = x[np.square(x).sum(1) > 0]
    if not len(x):
        return np.zeros((0, 1)), np.zeros((0, AXES, 1))
    out = x[:count].copy()
    for _ in range(ROUNDS):
        own = (x @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        length = np.sqrt(np.square(sums).sum(1, keepdims=True))
        out = np.where(length > 0, sums / np.where(length > 0, length, 1), out)
    out = out[_beside(out)]
    own, axes = (x @ out.T).argmax(1), np.zeros((len(out), AXES, x.shape[1]))
    order = np.argsort(own, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
        away = x[rows] - out[own[rows[0]]]
        main = np.linalg.svd(away, full_matrices=False)[2][:AXES]
        reach = np.abs(away @ main.T).max()
        axes[own[rows[0]], : len(main)] = main / (1.5 * reach) if reach > 1e-12 else 0
    return out, axes


def _curve(at: np.ndarray) -> np.ndarray:
    """Numbers along a curve through a cube, from AXES whole numbers of BITS bits in rows: their bits in turn."""
    out = np.zeros(len(at), np.int64)
    for bit in range(BITS):
        for k in range(AXES):
            out |= ((at[:, k] >> bit) & 1) << (AXES * bit + AXES - 1 - k)
    return out


def dealt(rows: DataFrame, middles: np.ndarray, axes: np.ndarray, payload: str = "emb") -> DataFrame:
    """Adds _near, the number of the nearest centre as text that sorts alike, and _along, the place on the curve about it."""

    @F.arrow_udf("long")
    def place(x: pa.Array) -> pa.Array:
        out = np.zeros(len(x), np.int64)
        for i in range(0, len(x) if len(middles) else 0, 1024):
            part = _unit(x[i : i + 1024])
            near = (part @ middles.T).argmax(1)
            away = part - middles[near]
            at = np.stack([np.einsum("ij,ij->i", away, axes[near, k]) for k in range(AXES)], 1)
            whole = np.clip((np.nan_to_num(at) + 1) * (1 << BITS - 1), 0, (1 << BITS) - 1).astype(np.int64)
            out[i : i + 1024] = (near << AXES * BITS) | _curve(whole)
        return pa.array(out)

    placed = rows.withColumn("_place", place(payload))
    return placed.withColumns({"_near": F.format_string("%06d", F.shiftright("_place", AXES * BITS)), "_along": F.col("_place").bitwiseAND((1 << AXES * BITS) - 1)}).drop("_place")


def _measured(tiles: DataFrame, label: str) -> DataFrame:
    """tile, low, high, middle and radius of each tile, numbered in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            middles, radii = [], []
            for i in range(b.num_rows):
                x = _unit(b.column(3)[i].values)
                sums = x.sum(0)
                length = np.sqrt(np.square(sums).sum())
                middle = sums / length if length > 1e-12 else np.eye(1, x.shape[1])[0]
                cos = x @ middle
                # a row without direction scores nought with all: no bound holds for it
                radii.append(np.pi if length <= 1e-12 or (np.square(x).sum(1) == 0).any() else float(np.arccos(np.clip(cos.min(), -1, 1))))
                middles.append(middle.tolist())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(3)], pa.array(middles, pa.list_(pa.float64())), pa.array(radii, pa.float64())], names=["tile", "low", "high", "middle", "radius"])

    made = tiles.select("tile", "low", "high", "payload").mapInArrow(run, "tile long, low long, high long, middle array<double>, radius double")
    return written(made, label)


def _block(tile: str, group: int) -> Column:
    """The block of a tile: its first tile's number, of `group` tiles in a row (a power of two)."""
    return F.col(tile) - F.pmod(F.col(tile), F.lit(group))


_OF_TILES = "tiles array<struct<tile: bigint, low: bigint, high: bigint, middle: array<double>, radius: double, floor: double>>"


def _gathered(measured: DataFrame, floor: DataFrame | None, group: int, label: str) -> DataFrame:
    """tile (the block's number), low, high, middle, radius and floor of each block of `group` tiles, and these of its tiles."""
    if floor is None:
        rows = measured.withColumn("floor", F.lit(-2.0))
    else:
        rows = measured.join(floor.select("tile", "floor"), "tile", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    lists = rows.groupBy(_block("tile", group).alias("block")).agg(F.collect_list(F.struct("tile", "low", "high", "middle", "radius", "floor")).alias("tiles"))  # group of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for i in range(b.num_rows):
                tiles = b.column(1)[i].values
                x, radii = _middles(tiles), tiles.field("radius").to_numpy()
                sums = x.sum(0)
                length = np.sqrt(np.square(sums).sum())
                middle = sums / length if length > 1e-12 else np.eye(1, x.shape[1])[0]
                # arccos loses digits near one
                radius = min(np.pi, float((np.arccos(np.clip(x @ middle, -1, 1)) + radii).max()) + 1e-7)
                made.append((pc.min(tiles.field("low")).as_py(), pc.max(tiles.field("high")).as_py(), middle.tolist(), radius, pc.min(tiles.field("floor")).as_py()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64())
            columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, b.column(1)], names=["tile", "low", "high", "middle", "radius", "floor", "tiles"])

    return written(lists.mapInArrow(run, f"tile long, low long, high long, middle array<double>, radius double, floor double, {_OF_TILES}"), label)


def _middles(tiles: pa.StructArray) -> np.ndarray:
    return tiles.field("middle").flatten().to_numpy().reshape(len(tiles), -1)


def _allowed(p: pa.StructArray, r: pa.StructArray, strictly_earlier: bool, slack: float, best: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(whether time allows pairs of tiles, or of blocks, and their bound reaches the floor; cosines of middles). With best,
    of each of p its so many nearest."""
    near = np.clip(_middles(p) @ _middles(r).T, -1, 1)
    bound = np.cos(np.maximum(np.arccos(near) - np.add.outer(p.field("radius").to_numpy(), r.field("radius").to_numpy()), 0))
    # arccos loses digits near one
    allowed = bound + 1e-7 + slack >= p.field("floor").to_numpy()[:, None]
    if strictly_earlier:
        low, high = r.field("low").to_numpy(zero_copy_only=False).astype(float), p.field("high").to_numpy(zero_copy_only=False).astype(float)
        with np.errstate(invalid="ignore"):
            allowed &= low[None] < high[:, None]
    if best is not None and near.shape[1] > best:
        promise = np.where(allowed, near, -2.0)
        allowed &= promise >= -np.partition(-promise, best - 1, axis=1)[:, best - 1 : best]
    return allowed, near


def bounded(probes: DataFrame, refs: DataFrame, strictly_earlier: bool, best: int | None, slack: float) -> DataFrame:
    """p_block, r_block: pairs of blocks that time allows and whose bound reaches the probes' floor; of each BLOCK blocks of
    references the `best` nearest, if given. Bounds are taken by matrix products of BLOCK blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, r = (batch.column(k)[i].values for k in (0, 1))
                row, column = np.nonzero(_allowed(p, r, strictly_earlier, slack, best)[0])
                yield pa.RecordBatch.from_arrays([p.field("tile").take(pa.array(row)), r.field("tile").take(pa.array(column))], names=["p_block", "r_block"])

    parts = [max(1, -(-df.count() // BLOCK)) for df in (probes, refs)]
    left, right = (df.groupBy(F.pmod(F.xxhash64("tile"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("tile", "low", "high", "middle", "radius", "floor")).alias(x)) for df, n, x in zip((probes, refs), parts, "pr", strict=True))
    # BLOCK blocks are sent to each such lot of the other side: the rows' numbers over BLOCK * ROWS, multiplied
    each = left.select("p", F.explode(F.sequence(F.lit(0), F.lit(parts[1] - 1)).cast("array<bigint>")).alias("block"))
    return each.join(right.hint("shuffle_hash"), "block").select("p", "r").mapInArrow(run, "p_block long, r_block long")


def cells(blocks: DataFrame, probes: DataFrame, refs: DataFrame, done: DataFrame | None, group: int, strictly_earlier: bool, best: int | None, slack: float) -> DataFrame:
    """p_block, r_block, codes (numbers of tiles within both, as p * group + r) and near (cosines of middles): what bounds
    allow of these pairs of blocks and hasn't been done. With best, of each tile of probes its so many nearest in the block."""
    pairs = blocks
    pairs = pairs.join(_by_cell(done, group).withColumnRenamed("codes", "done"), ["p_block", "r_block"], "left") if done is not None else pairs.withColumn("done", F.lit(None).cast("array<int>"))
    lists = [df.select(F.col("tile").alias(f"{x}_block"), F.col("tiles").alias(x)).hint("shuffle_hash") for df, x in ((probes, "p"), (refs, "r"))]
    both = pairs.join(lists[0], "p_block").join(lists[1], "r_block").select("p_block", "r_block", "done", "p", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, r = (batch.column(k)[i].values for k in (3, 4))
                left, right = (x.field("tile").to_numpy() % group for x in (p, r))
                codes = np.add.outer(left * group, right).astype(np.int32)
                old = batch.column(2)[i].values
                allowed, near = _allowed(p, r, strictly_earlier, slack, None if best is None else best + (0 if old is None else sum(FIRST)))
                if old is not None:
                    allowed &= ~np.isin(codes, old.to_numpy())
                if allowed.any():
                    lists = [pa.ListArray.from_arrays(pa.array([0, int(allowed.sum())], pa.int32()), pa.array(c[allowed])) for c in (codes, near)]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], *lists], names=["p_block", "r_block", "codes", "near"])

    return both.mapInArrow(run, "p_block long, r_block long, codes array<int>, near array<double>")


def _by_cell(pairs: DataFrame, group: int) -> DataFrame:
    """p_block, r_block, codes from pairs of tiles."""
    code = (F.pmod("p_tile", F.lit(group)) * group + F.pmod("r_tile", F.lit(group))).cast("int")
    return pairs.groupBy(_block("p_tile", group).alias("p_block"), _block("r_tile", group).alias("r_block")).agg(F.collect_list(code).alias("codes"))  # group * group of them


def _trimmed(both: DataFrame, group: int) -> DataFrame:
    """r_block, codes, p: of the tiles p of a block those that codes name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p = batch.column(2)[i].values
                named = np.isin(p.field("tile").to_numpy() % group, batch.column(1)[i].values.to_numpy() // group)
                kept = p.take(pa.array(np.flatnonzero(named)))
                yield pa.RecordBatch.from_arrays([*[batch.column(k)[i : i + 1] for k in (0, 1)], pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)], names=["r_block", "codes", "p"])

    rows = both.select("r_block", "codes", "p")
    return rows.mapInArrow(run, rows.schema)


def _together(codes: np.ndarray, group: int, tile: int) -> Iterator[tuple[list[int], list[int]]]:
    """Tiles of probes and those of references that they are scored with, from sorted codes: neighbours at once, with what any
    of them meets, where that costs less than a call of its own."""
    those: list[int] = []
    met: set[int] = set()
    for some in np.split(codes, np.flatnonzero(np.diff(codes // group)) + 1):
        own = set((some % group).tolist())
        both = met | own
        more = (len(those) + 1) * len(both) - len(those) * len(met) - len(own)
        if those and more * tile * tile > CALL:
            yield those, sorted(met)
            those, both = [], own
        those, met = [*those, int(some[0] // group)], both
    yield those, sorted(met)


def nearest(
    probes: DataFrame, refs: DataFrame, k: int, payload: str = "emb", frame: str = "frame_id", individual: str = "individual_id", time: str = "tkey",
    strictly_earlier: bool = True, apart: str | None = None, itself: bool = True, tile: int = TILE, each: int = EACH, decimals: int = DECIMALS,
) -> tuple[DataFrame, dict[str, int]]:
    """(probe_id, truth, individual_id, score, ref_id, rank up to k; how many pairs of tiles there are, how many had to be
    scored, and how many pairs of blocks were sent to score them): cosines, as of scoring.pooled with the same arguments."""
    middles, axes = centres(refs, payload, frame, each)
    group = 1 << max(0, (ROWS // tile).bit_length() - 1)
    order = ("time", "_along") if strictly_earlier else ("_along",)
    sides = [_tiles(dealt(df, middles, axes, payload), frame, individual, time, payload, "_near", apart, tile, name, order) for df, name in ((probes, "probes"), (refs, "refs"))]
    meta = [_measured(t, f"{name}-tiles") for t, name in zip(sides, ("probe", "ref"), strict=True)]
    side = lambda df, x, *more: df.groupBy(_block("tile", group).alias(f"{x}_block")).agg(F.collect_list(F.struct("tile", *_COLUMNS, *more)).alias(x))
    refs_by_block = written(side(sides[1], "r"), "ref-rows")
    id_type, ref_type, own_type = probes.schema[frame].dataType, refs.schema[frame].dataType, refs.schema[individual].dataType
    schema = f"p_tile long, probe_id {id_type.simpleString()}, truth {own_type.simpleString()}, individual_id {own_type.simpleString()}, score double, ref_id {ref_type.simpleString()}"
    kinds = [to_arrow_type(x) for x in (id_type, own_type, own_type)] + [pa.float64(), to_arrow_type(ref_type)]
    names = ["p_tile", "probe_id", "truth", "individual_id", "score", "ref_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = np.sort(batch.column(0)[i].values.to_numpy())
                p, r = (batch.column(x)[i].values for x in (1, 2))
                place = []
                for x in (p, r):
                    place.append(np.zeros(group, np.int64))
                    place[-1][x.field("tile").to_numpy() % group] = np.arange(len(x))
                flat = [r.field(c).flatten() for c in _COLUMNS]
                stops = np.cumsum(r.field("id").value_lengths().to_numpy())
                for those, met in _together(codes, group, tile):
                    own = p.take(pa.array(place[0][those]))
                    at = pa.array(np.concatenate([np.arange(stops[t - 1] if t else 0, stops[t]) for t in place[1][met]]))
                    probe = [own.field(c).flatten() for c in _COLUMNS]
                    last = own.field("least").flatten()
                    found = pc.index_in(probe[0], value_set=last.field("probe_id"))
                    least = last.field("score").take(found).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    numbers = pa.array(np.repeat(own.field("tile").to_numpy(), own.field("id").value_lengths().to_numpy()))
                    probe[1] = pa.StructArray.from_arrays([probe[1], numbers], names=["own", "tile"])
                    for ids, both, *made in _meet(probe, [c.take(at) for c in flat], cosine_block, strictly_earlier, apart is not None, itself, decimals, k, least):
                        columns = [c.cast(t) for c, t in zip((ids, both.field("own"), *made), kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays([both.field("tile"), *columns], names=names)

    slack = SLACK + 0.5 * 10.0**-decimals
    state, floor, done, sent, scored = None, None, None, 0, 0
    least_type = f"array<struct<probe_id: {id_type.simpleString()}, score: double>>"
    right = _gathered(meta[1], None, group, "ref-blocks")
    for count in (*FIRST, None):
        left = _gathered(meta[0], floor, group, "probe-blocks")
        found = cells(bounded(left, right, strictly_earlier, None if count is None else NEAR, slack), left, right, done, group, strictly_earlier, count, slack)
        if count is None:
            found = written(found.select("p_block", "r_block", "codes"), "cells")
        else:
            best = Window.partitionBy("p_tile").orderBy(F.desc("near"), "r_tile")
            each_pair = found.select("p_block", "r_block", F.explode(F.arrays_zip("codes", "near")).alias("x"))
            each_pair = each_pair.select((F.col("p_block") + F.expr(f"x.codes div {group}")).alias("p_tile"), (F.col("r_block") + F.col("x.codes") % group).alias("r_tile"), "x.near")
            pairs = written(each_pair.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= count).select("p_tile", "r_tile"), "pairs")
            done = pairs if done is None else done.unionByName(pairs)
            found = written(_by_cell(pairs, group), "cells")
        counts = found.agg(F.count("*"), F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()
        sent, scored = sent + counts[0], scored + counts[1]
        if floor is None:
            own = sides[0].withColumn("least", F.lit(None).cast(least_type))
        else:
            own = sides[0].join(floor.select("tile", "least"), "tile", "left")
        both = found.join(side(own, "p", "least").hint("shuffle_hash"), "p_block")
        both = _trimmed(both, group).join(refs_by_block.hint("shuffle_hash"), "r_block")
        made = both.select("codes", "p", "r").mapInArrow(run, schema)
        if state is not None:
            made = made.unionByName(state.drop("rank"))
        best = F.min(F.struct((-F.col("score")).alias("s"), "ref_id"))
        pooled = made.groupBy("p_tile", "probe_id", "truth", "individual_id").agg(best.alias("b")).select("p_tile", "probe_id", "truth", "individual_id", (-F.col("b.s")).alias("score"), F.col("b.ref_id").alias("ref_id"))
        before, state = (found, left, *[x for x in (state, floor) if x is not None]), written(top_k(pooled, k), "best")
        # of probes that have k individuals the last one's score; a tile with one that hasn't has no floor
        last = state.filter(F.col("rank") == k).groupBy("p_tile").agg(F.collect_list(F.struct("probe_id", "score")).alias("least"), F.min("score").alias("floor"))
        sizes = sides[0].select(F.col("tile").alias("p_tile"), F.size("id").alias("rows"))
        whole = F.when(F.size("least") == F.col("rows"), F.col("floor"))
        floor = written(last.join(sizes, "p_tile").select(F.col("p_tile").alias("tile"), whole.alias("floor"), "least"), "floor")
        discard(*before)
    return state.drop("p_tile"), {"tile_pairs": meta[0].count() * meta[1].count(), "scored": scored, "sent": sent}
