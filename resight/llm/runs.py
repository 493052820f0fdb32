"""Periodic runs of words: aligned blocks of a power of two, searched across the document, seed exact extension.

A run is a stretch of consecutive words with smallest period q and a length of at least LEAST_LENGTH and LEAST_TIMES * q
that no neighbouring word extends. At scale b = 2^k, the runs with b <= q < 2b are sought: the first 3q words of such a
run hold an aligned block of b words whole, as 2b - 1 <= 3q, and that block stands again q words later. So the scale's
aligned blocks become integer-sequence keys of an Aho-Corasick automaton; an occurrence at s belongs to the one aligned
block at a distance in [b, 2b), and where that block has the same words, (block, distance) is a seed. A seed is extended
to both sides for as long as words agree at its distance.

What keeps it near-linear, and exact:
- In a run of period q every word after the first q stands at most q words behind its last occurrence. So a scale
  looks at stretches of at least 3b such words only (distance under 2b) and the 2b words before; common prose has
  none. The automaton holds windows of such a stretch, so its size is bounded by the scale and not by the text.
- Scales ascend. A seed within a known run of a smaller scale has a multiple of its period and so extends to the
  same run; a stretch within one holds no other run, as two runs of periods d < q share fewer than d + q words.
- A seed within what was extended at the same distance gives the same stretch again.

A text is one row and its runs never meet another's: no shuffle, and a hot source or a copied text is rows like others.

Defined results: null and empty texts and texts of white space have no words, no runs and the digests of the empty
string; a null doc_id has the crc32 of the empty string; repeated rows give repeated rows; very long texts are worked on
whole, in the task that holds the row; ties of exponent go to the smallest start, then period; an empty table gives an
empty result; further columns are left alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm.common import map_text, table, utf8

#: Least words of a run, and its least number of periods.
LEAST_LENGTH, LEAST_TIMES = 6, 4
#: Words whose blocks share an automaton, if the scale isn't larger.
WINDOW = 1 << 16

Run = tuple[int, int, int]


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, from 0."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def last_seen(ids: np.ndarray) -> np.ndarray:
    """How many words ago each word last stood; a distance beyond the text for a first one."""
    order = np.argsort(ids, kind="stable")
    gap = np.full(len(ids), len(ids) + 1, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    return gap


def stretches(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[start, end) of each stretch of at least `least` true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def agreeing(ids: np.ndarray, at: int, q: int, step: int) -> int:
    """How many words from `at` on, forwards or backwards, equal the word q behind them. Looks at doubling pieces."""
    n, piece = 0, 32
    while True:
        if step > 0:
            low, high = at + n, min(len(ids), at + n + piece)
        else:
            low, high = max(q, at - n - piece + 1), at - n + 1
        if low >= high:
            return n
        differ = np.flatnonzero(ids[low:high] != ids[low - q : high - q])
        if len(differ):
            return n + int(differ[0] if step > 0 else high - low - 1 - differ[-1])
        n += high - low
        piece *= 2


def seeds(ids: np.ndarray, low: int, high: int, b: int) -> Iterator[tuple[int, int]]:
    """(start of an aligned block of b words, start of a later occurrence, b to 2b - 1 words on) in ids[low:high]."""
    window = max(WINDOW, 4 * b)
    for first in range(-(-low // b) * b, high - b + 1, window):
        starts = range(first, min(first + window, high - b + 1), b)
        codes = tuple(ids[first : min(high, starts[-1] + 3 * b)].tolist())
        blocks = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        name: list[int] = []  # of each aligned block, that of the first equal one
        for i, p in enumerate(starts):
            key = codes[p - first : p - first + b]
            if not blocks.exists(key):
                blocks.add_word(key, i)
            name.append(blocks.get(key))
        blocks.make_automaton()
        for end, found in blocks.iter(codes):
            s = end + 1 - b
            i = s // b - 1
            if 0 <= i < len(name) and name[i] == found:
                yield first + i * b, first + s


def runs(ids: np.ndarray) -> list[Run]:
    """(start, length, period) of all runs, by start, then period."""
    n = len(ids)
    if n < LEAST_LENGTH:
        return []
    gap, covered, known = last_seen(ids), np.zeros(n, np.int64), {}
    b = 1
    while LEAST_TIMES * b <= n:
        found = []
        extended: dict[int, tuple[int, int]] = {}
        for x, y in stretches(gap < 2 * b, (LEAST_TIMES - 1) * b):
            if covered[x] >= y:
                continue
            for p, s in seeds(ids, max(0, x - 2 * b), y, b):
                q = s - p
                if covered[p] >= s + b:
                    continue
                start, end = extended.get(q, (0, 0))
                if not (start <= p and s + b <= end):
                    start = p - agreeing(ids, p + q - 1, q, -1)
                    end = s + agreeing(ids, s, q, 1)
                    extended[q] = start, end
                    if end - start >= max(LEAST_LENGTH, LEAST_TIMES * q) and (start, end) not in known:
                        known[start, end] = q
                        found.append((start, end))
        for start, end in found:
            np.maximum(covered[start:end], end, out=covered[start:end])
        b *= 2
    return sorted((start, end - start, q) for (start, end), q in known.items())


def repeated_words(found: list[Run], n: int) -> np.ndarray:
    """Whether each of n words is in a run, but not in its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        edges[start + q] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:-1] > 0


def best(found: list[Run]) -> Run | None:
    """The run of the greatest exact length / period; ties: smallest start, then period."""
    top = None
    for r in found:  # by start, then period
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


def looped(n: int, h: int) -> np.ndarray:
    """Which original word stands at each place of a text of n words whose id hashes to h: every tenth text loops."""
    at = np.arange(n)
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        at[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return at


def detected(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", loops: bool = False) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent (start, length, period, exponent_milli), runs_sha256 and
    collapsed_sha256 (the words that repeat nothing, joined by one space): a row for each row of docs.

    loops: texts whose id says so are first turned into loops of their own words (looped).
    """

    def kernel(rows: list[bytes]) -> dict[str, object]:
        out: dict[str, list] = {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
        for row in rows:
            key, _, body = row.partition(b"\n")
            words = body.split()
            ids = numbered(words)
            if loops and (h := zlib.crc32(key)) % 10 == 0 and words:
                at = looped(len(words), h)
                words, ids = [words[i] for i in at], ids[at]
            found = runs(ids)
            top = best(found)
            if found:
                gone = repeated_words(found, len(words))
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            out["n_runs"].append(len(found))
            for k, v in zip(("start", "length", "period"), top or (None,) * 3, strict=True):
                out[k].append(v)
            out["exponent_milli"].append(1000 * top[1] // top[2] if top else None)
            out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest())
            out["collapsed_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())
        longs = ("n_runs", "start", "length", "period", "exponent_milli")
        return {k: pa.array(v, pa.int64() if k in longs else pa.string()) for k, v in out.items()}

    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"), F.lit(b"\n"), utf8(text)).alias("row"))
    schema = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_text(keyed, "row", {"doc_id": F.col("doc_id")}, kernel, schema)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(table(spark, sf_dir, "documents"), loops=True)
