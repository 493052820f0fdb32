"""Sequence packing by cutting-stock column generation.

Whole blocks of the sequence length are cut off each document and are sequences by themselves; what is left of
each, shorter than a sequence, is counted in a histogram of at most `size` lengths. A linear program over patterns
(multisets of lengths that fill a sequence exactly) puts as many of these tokens as it can into uncut sequences;
knapsack dynamic programming prices new patterns from its dual values. The patterns' counts are rounded down, and what
that leaves is solved again in integers, as exact knapsacks of the lengths that are left.

The patterns are dealt to documents by rank, task by task: a task reads windows of a bounded number of tokens, ranks
their documents by length, gives each pattern its share of the corpus's count, and completes patterns for the lengths
that are left over; documents that fit nowhere wait for the next window. What waits too long, or at the end of a task,
forms a stream that is cut at sequence ends; its last part is cut into powers of two, so that nothing is padded.
So nothing is sorted or shuffled but the histogram, and what tasks are sent has at most `size` patterns. Sequences are
numbered by task, so the numbers are unique but not dense.

Defined results: a null or empty text is its end id alone; every row is packed, repeated rows and ids too; an empty
table gives no pieces; further columns are left alone.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm.common import materialize, slices, smaller_batches, table, trimmed, utf8
from resight.llm.tokens import WordIds, tokenizer_path

SIZE = 2048
END_ID = 1
#: Pricing rounds, and new patterns in each.
ROUNDS, COLUMNS = 250, 16
#: Tokens that a length in a pattern must be worth.
PENALTY = 8.0
#: Lengths that complete a pattern, beside pairs, and those tried for each.
DEPTH, TRIED = 2, 6
#: Tokens of a task's window, and of the documents that wait for the next one.
WINDOW, WAITING = 6_000_000, 1_000_000
_EPS, _PIVOT = 1e-7, 1e-4
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def price(lengths: np.ndarray, duals: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value for each exact total up to size, and the last length's index in it (-1: none)."""
    best, last = np.full(size + 1, -np.inf), np.full(size + 1, -1)
    best[0] = 0
    for t in range(int(lengths[0]), size + 1):
        k = int(np.searchsorted(lengths, t, "right"))
        value = best[t - lengths[:k]] + duals[:k]
        last[t] = i = int(np.argmax(value))
        best[t] = value[i]
        if best[t] == -np.inf:
            last[t] = -1
    return best, last


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """(lengths with their multiplicities, number of sequences) that fill sequences exactly, within the histogram.

    Minimises the tokens left over, sum(l * s_l), under sum_p a_pl x_p + s_l = h_l by a revised simplex that starts
    from the slacks s. It ends when no pattern gains, or after ROUNDS prices: the program is degenerate, and what it
    has not reached by then is left to completed(), as is the residue of rounding down.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    have = np.array([histogram[int(x)] for x in lengths], np.float64)
    m = len(lengths)
    inverse, solution = np.eye(m), have.copy()
    duals, basis = lengths.astype(np.float64), [None] * m
    rare = np.clip(np.median(have) / have, 0.1, 10.0)
    noise = np.random.default_rng(0)
    for _ in range(ROUNDS):
        # among patterns of about one value, those of few and frequent lengths help most; noise makes them differ
        shaded = duals - PENALTY * rare * noise.uniform(0.5, 1.5, m)
        best, last = price(lengths, shaded, size)
        value = shaded + best[size - lengths]
        made = set()
        for i in np.argsort(-value, kind="stable")[: 4 * COLUMNS]:
            if value[i] <= _EPS * size or len(made) >= COLUMNS:
                break
            pattern, t = [int(i)], size - int(lengths[i])
            while t and last[t] >= 0:
                pattern.append(int(last[t]))
                t -= int(lengths[last[t]])
            if not t:
                made.add(tuple(sorted(pattern)))
        entered = 0
        for pattern in sorted(made, key=lambda p: (-sum(duals[i] for i in p), p)):
            which, times = np.unique(pattern, return_counts=True)
            gain = float(duals[which] @ times)
            column = inverse[:, which] @ times
            able = np.flatnonzero(column > _PIVOT)
            if gain <= _EPS * size or not len(able):
                continue
            ratio = solution[able] / column[able]
            tied = able[ratio <= ratio.min() + _EPS]
            out = int(tied[np.argmax(column[tied])])  # of rows that tie, the most stable one
            row = inverse[out] / column[out]
            step = solution[out] / column[out]
            change = np.flatnonzero(np.abs(column) > 1e-12)
            solution[change] -= step * column[change]
            inverse[change] -= np.outer(column[change], row)
            inverse[out], solution[out] = row, step
            duals -= gain * row
            basis[out] = (which, times)
            entered += 1
        np.maximum(solution, 0, out=solution)
        if not entered:
            break
    left, out = np.zeros(size + 1, np.int64), []
    left[lengths] = have.astype(np.int64)
    for (which, times), x in sorted(((b, x) for b, x in zip(basis, solution, strict=True) if b is not None and x > _EPS), key=lambda c: -c[1]):
        n = min(int(x + 1e-6), int(np.min(left[lengths[which]] // times)))
        if n:
            left[lengths[which]] -= n * times
            out.append(({int(lengths[i]): int(t) for i, t in zip(which, times, strict=True)}, n))
    return out + completed(left, size)


def completed(left: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """Patterns over what is left (counts by length, which are lowered): for each length, from the longest, the lengths
    that complete it to a sequence, as often as they are there."""
    out = []
    for length in range(min(size, len(left)) - 1, 0, -1):
        while left[length] > 0:
            left[length] -= 1
            rest = _complete(left, size - length, DEPTH)
            left[length] += 1
            if rest is None:
                break
            pattern = Counter([length, *rest])
            n = int(min(left[k] // t for k, t in pattern.items()))
            for k, t in pattern.items():
                left[k] -= n * t
            out.append((dict(pattern), n))
    return out


def _complete(left: np.ndarray, total: int, depth: int) -> list[int] | None:
    """Lengths that are left and sum up to total: one, a pair, or a long one and what completes it."""
    if total == 0:
        return []
    if left[total] > 0:
        return [total]
    half = total // 2
    both = np.flatnonzero((left[1 : half + 1] > 0) & (left[total - 1 : total - half - 1 : -1] > 0)) + 1
    if len(both) and 2 * both[-1] == total and left[half] < 2:
        both = both[:-1]
    if len(both):
        return [int(both[-1]), total - int(both[-1])]  # an even pair: short lengths are of most use later
    if depth:
        for k in (np.flatnonzero(left[1:total] > 0) + 1)[::-1][:TRIED].tolist():
            left[k] -= 1
            rest = _complete(left, total - k, depth - 1)
            left[k] += 1
            if rest is not None:
                return [k, *rest]
    return None


class Packer:
    """Packs a task's documents as they come. place: (document, start) pieces of sequences, in order.

    chosen: the corpus's patterns; total: its tokens beside whole blocks, of which a window takes its share.
    """

    def __init__(self, chosen: list[tuple[dict[int, int], int]], total: int, size: int, first: int):
        self.chosen, self.total, self.size, self.next = sorted(chosen, key=lambda c: -c[1]), total, size, first
        self.credit = np.zeros(len(chosen))
        self.count = np.array([n for _, n in self.chosen], np.float64)
        self.left = np.zeros(size + 1, np.int64)
        self.waiting: dict[int, list[object]] = {}
        self.tokens = self.fresh = self.by_patterns = 0

    def add(self, doc: object, length: int) -> None:
        """A document of fewer tokens than a sequence."""
        self.waiting.setdefault(length, []).append(doc)
        self.left[length] += 1
        self.tokens += length
        self.fresh += length

    def whole(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self) -> Iterator[tuple[object, int, int, int, int]]:
        """(document, tokens of it before, tokens, sequence, offset) of the documents that patterns take."""
        self.credit += self.count * (self.fresh / max(1, self.total))
        self.fresh = 0
        for k in np.flatnonzero(self.credit >= 1).tolist():
            pattern = self.chosen[k][0]
            n = int(min(self.credit[k], *(self.left[x] // t for x, t in pattern.items())))
            self.credit[k] -= int(self.credit[k])
            if n:
                for x, t in pattern.items():
                    self.left[x] -= n * t
                yield from self._fill(pattern, n)
        for pattern, n in completed(self.left, self.size):
            yield from self._fill(pattern, n)

    def _fill(self, pattern: dict[int, int], n: int) -> Iterator[tuple[object, int, int, int, int]]:
        for _ in range(n):
            at = 0
            for length, times in pattern.items():
                own = self.waiting[length]
                for _ in range(times):
                    yield own.pop(), 0, length, self.next, at
                    at += length
            self.next += 1
        self.tokens -= n * self.size
        self.by_patterns += n * self.size

    def cut(self) -> Iterator[tuple[object, int, int, int, int]]:
        """What waits, as a stream cut at sequence ends, and at the end into powers of two."""
        total = self.tokens
        whole = total // self.size * self.size
        ends = [*range(0, whole + 1, self.size)]
        for bit in range(self.size.bit_length() - 1, -1, -1):
            if (total - whole) >> bit & 1:
                ends.append(ends[-1] + (1 << bit))
        spans = pairwise(ends)
        at, (begin, end) = 0, next(spans, (0, 0))
        for length in sorted(self.waiting):
            for doc in self.waiting[length]:
                start = 0
                while start < length:
                    if at == end:
                        begin, end = next(spans)
                        self.next += 1
                    take = min(length - start, end - at)
                    yield doc, start, take, self.next, at - begin
                    start, at = start + take, at + take
        self.next += 1
        self.waiting, self.tokens = {}, 0
        self.left[:] = 0


def encoded(docs: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """A table of doc_id, ids (little-endian unsigned 32 bits), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(path)
        end = np.array([END_ID], "<u4").tobytes()
        for part in slices(batches, 1):
            ids = [words.encode(t) + end for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(np.array([len(x) // 4 for x in ids], np.int64))], names=["doc_id", "ids", "n"])

    kind = docs.schema[doc_id].dataType.simpleString()
    smaller_batches(docs.sparkSession)
    return materialize(docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("t")).mapInArrow(lambda batches: trimmed(run(batches)), f"doc_id {kind}, ids binary, n long"), "ids")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = encoded(docs, doc_id, text, path or tokenizer_path("word_bpe_49k.json"))
    # at most `size` rows
    histogram = {r["rest"]: r["n"] for r in rows.groupBy(F.expr(f"n % {size}").alias("rest")).agg(F.count("*").alias("n")).filter("rest > 0").collect()}
    chosen, total = patterns(histogram, size), sum(k * n for k, n in histogram.items())
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(chosen, total, size, TaskContext.get().partitionId() << 40)
        made: list[tuple] = []
        id_type = None

        def batch() -> pa.RecordBatch:
            columns = np.array([x[1:] for x in made], np.int64).reshape(-1, 6)
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], id_type), *[pa.array(columns[:, j]) for j in range(6)]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            made.clear()
            return out

        def put(pieces: Iterator[tuple[object, int, int, int, int]]) -> None:
            for (own, ids, n), start, length, sequence, offset in pieces:
                made.append((own, n - len(ids) // 4 + start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), n, sequence, offset))

        for part in slices(batches, 1):
            id_type = part.schema.field(0).type
            for own, ids, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                view = memoryview(ids)
                for k in range(n // size):
                    made.append((own, k * size, size, zlib.crc32(view[4 * k * size : 4 * (k + 1) * size]), n, packer.whole(), 0))
                if n % size:
                    packer.add((own, ids[4 * (n // size) * size :], n), n % size)
            if packer.fresh >= WINDOW:
                put(packer.place())
                if packer.tokens > WAITING:
                    put(packer.cut())
            if made:
                yield batch()
        if id_type is not None:
            put(packer.place())
            put(packer.cut())
            if made:
                yield batch()

    return rows.mapInArrow(lambda batches: trimmed(run(batches)), PIECES.format(id=kind.simpleString()))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
