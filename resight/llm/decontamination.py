"""Benchmark decontamination by template canonicalisation.

Words become canonical tokens: numbers in digits and in words, units of measure and names turn into typed placeholders,
operators between numbers are tokens, other words lose case and the signs around them. Windows of WINDOW tokens are hashed
and joined with those of the benchmark, so a question whose numbers, names or units were exchanged meets its original.
Each meeting is then checked: the literals must agree, and the slots' values must map one to one (what stood for 3 twice
stands for one value twice). In texts every word with a capital may be a name. What begins a sentence of an item may be
one or not, so an item's windows are tried both ways for each of these. Windows of equal values meet as well, whatever
their kinds and however few literals they have: so a verbatim copy is found if it is all numbers. An item is found in a
document if the windows that pass cover LEAST_TOKENS of its tokens, or LEAST_SHARE of them in a shorter item. A window with
fewer than LEAST_LITERALS literals, which many texts may have by chance, counts only if the item agrees as a whole, in one
place; one with fewer than POOR_LITERALS says nothing but by its values.

Documents pass a Bloom filter of the benchmark's windows, so that only windows that may meet are shuffled to the
join; the meetings of a document with an item are checked in order in one place, which are as many as its windows.
The benchmark is a table like any other: only the filter is sent to tasks, and its size is bounded.

Defined results: null and empty texts hold and are no items; an item shorter than a window is one window; repeated
rows are judged row by row; an empty benchmark finds nothing; further columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from resight.llm.common import bits_of, materialize, remembered, slices, smaller_batches, table, text_names, trimmed, utf8, without_texts

WINDOW = 8
#: Literals from which a window says something by itself, and from which it does as part of a whole item.
LEAST_LITERALS, POOR_LITERALS = 4, 2
LEAST_TOKENS, LEAST_SHARE = 13, 0.5
#: Bits of the filter for each window of the benchmark; text that is turned into tokens at once.
PER_WINDOW, KERNEL_BYTES = 64, 1 << 20
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons oz lb lbs pound pounds ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kmh percent usd eur dollar dollars euro euros cent cents degree degrees".split()
)
#: Number words, by their numbers.
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBERS = {w: str(i) for i, w in enumerate(SMALL)} | {w: str(10 * i) for i, w in enumerate(TENS, 2)} | {"dozen": "12", "hundred": "100", "thousand": "1000", "million": "1000000"}
#: Operators that are tokens by themselves or between numbers; dashes and stars are not by themselves, as they are bullets too.
ALONE = frozenset("+ = × ÷ ^ < > ± ≤ ≥ ≠ −".split())
#: Words that a worker remembers, and the longest of them in bytes.
MOST_WORDS, LONGEST = 100_000, 64
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_TERMS = re.compile(r"(\d[\d.,]*|[-+*/=×÷^<>±≤≥≠−])")
_SUM = re.compile(r"[-+−]?\d[\d.,]*(?:[-+*/=×÷^<>±≤≥≠−]\d[\d.,]*)+=?")
_GLUED = re.compile(r"([+-]?[$€£]?\d[\d.,]*)([a-zA-Z]+)$")
_EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "“”„«»‘’¡¿…–—"
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "replace"), 7)


_SLOTS = {k: _hash(f"\0{k}") for k in (NUMBER, UNIT, NAME)}


def tokens_of(word: str) -> list[tuple[int, str, bool]]:
    """(kind, value, capital) of the tokens in one word; none for signs alone that are no operators."""
    core = word.strip(_EDGES)
    if not core:
        return [(LITERAL, word, False)] if word in ALONE else []
    if core.isalpha():
        low = core.lower()
        if low in NUMBERS:
            return [(NUMBER, NUMBERS[low], False)]
        return [(LITERAL, low, core[:1].isupper() and core[1:].islower())]
    if _NUMBER.fullmatch(core):
        return [(NUMBER, core, False)]
    if (glued := _GLUED.match(core)) and glued[2].lower() in UNITS:
        return [(NUMBER, glued[1], False), (UNIT, glued[2].lower(), False)]
    if _SUM.fullmatch(core):
        return [(LITERAL if t in "-+*/=×÷^<>±≤≥≠−" else NUMBER, t, False) for t in _TERMS.findall(core)]
    tens, dash, ones = core.lower().partition("-")
    if dash and tens in TENS and ones in SMALL[1:10]:
        return [(NUMBER, str(int(NUMBERS[tens]) + int(NUMBERS[ones])), False)]
    return [(LITERAL, core.lower(), core[:1].isupper() and core[1:].islower())]


class _Ids(dict):
    """Row numbers of words; a word that is missing is added, a long one by its digest."""

    def __init__(self, add):
        super().__init__()
        self.add = add

    def __missing__(self, word: bytes) -> int:
        key = word if len(word) <= LONGEST else b"\0" + xxhash.xxh3_128_digest(word)
        row = self.get(key) if key is not word else None
        return self.add(word, key) if row is None else row


class Canon:
    """Canonical tokens of words, remembered by each worker in columns, so that texts are gathered by whole arrays."""

    def __init__(self, most: int = MOST_WORDS):
        self.most = most
        self._reset(1 << 12)

    def _reset(self, room: int) -> None:
        self.ids, self.used, self.rows = _Ids(self._add), 0, 0
        self.start, self.count, self.ends = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros(room, bool)
        self.kind, self.canonical, self.value, self.capital = np.zeros(room, np.int8), np.zeros(room, np.uint64), np.zeros(room, np.uint64), np.zeros(room, bool)
        self.new_words, self.new_tokens = ([], []), ([], [], [], [])

    def _add(self, word: bytes, key: bytes) -> int:
        """A row for a word, which is in the columns after settle()."""
        found = tokens_of(word.decode("utf-8", "replace"))
        row = self.ids[key] = len(self.ids)
        self.new_words[0].append(len(found))
        self.new_words[1].append(word[-1:] in b".!?:")
        kinds, canonicals, values, capitals = self.new_tokens
        for kind, value, capital in found:
            h = _hash(value)
            kind = NAME if capital else kind
            kinds.append(kind)
            canonicals.append(h if kind == LITERAL else _SLOTS[kind])
            values.append(h)
            capitals.append(capital)
        return row

    def settle(self) -> None:
        """Puts the words that were added since into the columns, all at once."""
        if not self.new_words[0]:
            return
        count = np.array(self.new_words[0], np.int64)
        rows, used = self.rows + len(count), self.used + len(self.new_tokens[0])
        grown = lambda x, n: x if n <= len(x) else np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)])
        self.start, self.count, self.ends = (grown(x, rows) for x in (self.start, self.count, self.ends))
        self.kind, self.canonical, self.value, self.capital = (grown(x, used) for x in (self.kind, self.canonical, self.value, self.capital))
        new = slice(self.rows, rows)
        self.start[new], self.count[new], self.ends[new] = self.used + np.cumsum(count) - count, count, self.new_words[1]
        for column, values in zip((self.kind, self.canonical, self.value, self.capital), self.new_tokens, strict=True):
            column[self.used : used] = np.array(values, column.dtype)
        self.rows, self.used = rows, used
        self.new_words, self.new_tokens = ([], []), ([], [], [], [])

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(kind, canonical, value) arrays of a text."""
        return self.many([text])[:3]

    def beginnings(self, text: bytes) -> np.ndarray:
        """Places of the tokens of a text that are names or begin a sentence."""
        out, n, begins = [], 0, True
        rows = [self.ids[word] for word in text.split()]
        self.settle()
        for row in rows:
            if begins and self.count[row] and self.capital[self.start[row]]:
                out.append(n)
            n += int(self.count[row])
            begins = bool(self.ends[row]) or begins and not self.count[row]
        return np.array(out, np.int64)

    def many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(kind, canonical, value) arrays of texts, one after the other, and where each begins and the last ends. A word
        with a capital is a name, a unit needs a number before it; without, it is a literal."""
        words = [t.split() for t in texts]
        if len(self.ids) >= self.most:
            self._reset(1 << 12)
        n = np.array([len(x) for x in words], np.int64)
        row = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        self.settle()
        starts = np.concatenate([[0], np.cumsum(n)])
        at, count = self.start[row], self.count[row]
        if not (count == 1).all():
            shift = np.cumsum(count) - count
            at = np.repeat(at - shift, count) + np.arange(int(count.sum()))
            starts = np.concatenate([[0], np.cumsum(count)])[starts]
        kind, canonical, value = self.kind[at], self.canonical[at], self.value[at]
        after = np.flatnonzero(kind[:-1] == NUMBER) + 1
        after = after[kind[after] != NUMBER]
        if len(after) and len(after := after[np.isin(value[after], _UNIT_HASHES)]):
            after = after[~np.isin(after, starts)]  # the number is another text's
            kind[after] = UNIT
            canonical[after] = np.uint64(_SLOTS[UNIT])
        return kind, canonical, value, starts


_UNIT_HASHES = np.array(sorted(_hash(u) for u in UNITS), np.uint64)


def windows(canonical: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` tokens."""
    n = len(canonical) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= _MULTIPLIER
        out += canonical[j : j + n]
    return out ^ (out >> np.uint64(29))


Slots = tuple[dict, dict]


def agree(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], slots: Slots) -> bool:
    """Same kinds and literals, and a one-to-one map between the slots' values, which `slots` keeps over windows."""
    if not (np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])):
        return False
    there, back = {}, {}
    for k, x, y in zip(a[0].tolist(), a[2].tolist(), b[2].tolist(), strict=True):
        if k != LITERAL and (slots[0].get((k, x), there.setdefault((k, x), y)) != y or slots[1].get((k, y), back.setdefault((k, y), x)) != x or there[k, x] != y or back[k, y] != x):
            return False
    slots[0].update(there)
    slots[1].update(back)
    return True


def window_keys(hashes: np.ndarray, size: int, exact: bool) -> np.ndarray:
    """Keys that windows of one size and kind of comparison share."""
    return hashes ^ np.uint64((2 * size + exact) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def canon() -> Canon:
    """One for each worker."""
    return remembered("canon", Canon)


Tokens = tuple[np.ndarray, np.ndarray, np.ndarray]
_WINDOW = "kinds binary, canonical binary, vals binary"


def _packed(made: Tokens, at: int = 0, size: int | None = None) -> list[bytes]:
    return [x[at : None if size is None else at + size].tobytes() for x in made]


def _unpacked(kinds: bytes, canonical: bytes, values: bytes) -> Tokens:
    return np.frombuffer(kinds, np.int8), np.frombuffer(canonical, np.uint64), np.frombuffer(values, np.uint64)


def item_windows(made: Tokens, begins: np.ndarray) -> Iterator[tuple[int, int, int, bool, Tokens]]:
    """(key, place, size, whether values are compared, tokens) of an item's windows. Each of `begins`, the names that begin a
    sentence, is a name in one template and a word in another."""
    size = min(WINDOW, len(made[0]))
    if not size:
        return
    exact = window_keys(windows(made[2], size), size, True)
    for at in range(len(exact)):
        own = tuple(x[at : at + size] for x in made)
        yield int(exact[at]), at, size, True, own
        unsure = [int(b) - at for b in begins if at <= b < at + size and own[0][b - at] == NAME]
        for as_words in chain.from_iterable(combinations(unsure, n) for n in range(len(unsure) + 1)):
            kind, canonical = own[0].copy(), own[1].copy()
            for i in as_words:
                kind[i], canonical[i] = LITERAL, own[2][i]
            if (kind == LITERAL).sum() >= min(POOR_LITERALS, size):
                yield int(window_keys(windows(canonical, size), size, False)[0]), at, size, False, (kind, canonical, own[2])


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """A table of the items' windows: key, item (its row), item_id, n_item (its tokens), at, size, exact, and the tokens."""
    kind = benchmark.schema[item_id].dataType.simpleString()
    names = ["item", "item_id", "n_item", "key", "at", "size", "exact", "kinds", "canonical", "vals"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = canon(), TaskContext.get().partitionId() << 40
        for part in slices(batches, 1):
            rows: list[tuple] = []
            which: list[int] = []
            for i, t in enumerate(part.column(1).to_pylist()):
                made, n = known.of(t), n + 1
                for key, at, size, exact, own in item_windows(made, known.beginnings(t)):
                    which.append(i)
                    rows.append((n, len(made[0]), key - (1 << 64) if key >> 63 else key, at, size, exact, *_packed(own)))
            if rows:
                item, n_item, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(item), part.column(0).take(pa.array(which)), pa.array(n_item), *map(pa.array, rest)], names=names)

    schema = f"item long, item_id {kind}, n_item long, key long, at long, size long, exact boolean, {_WINDOW}"
    return materialize(benchmark.select(F.col(item_id).alias("item_id"), utf8(text).alias("t")).mapInArrow(run, schema), "items")


def meetings(docs: DataFrame, items: DataFrame, keep: dict[str, Column], text: str) -> DataFrame:
    """Windows of documents that meet an item's: row (of the document), `keep`, place, the tokens, and the item's as other_."""
    smaller_batches(docs.sparkSession)
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most WINDOW rows
    filter_ = docs.sparkSession.sparkContext.broadcast(bits_of(items.select("key").distinct(), "key", PER_WINDOW))
    bare = docs.select(*[c.alias(k) for k, c in keep.items()], utf8(text).alias("t"))
    n, names = len(keep), [*keep, "row", "key", "place", "kinds", "canonical", "vals"]
    schema = bare.select(*keep).schema.add("row", "long").add("key", "long").add("place", "long")
    for c in ("kinds", "canonical", "vals"):
        schema = schema.add(c, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits, row = canon(), filter_.value, TaskContext.get().partitionId() << 40
        for part in slices(batches, n, KERNEL_BYTES):
            which, rows = [], []
            *made, starts = known.many(part.column(n).to_pylist())
            for size in sizes:
                for exact in (False, True):
                    keys = window_keys(windows(made[2 if exact else 1], size), size, exact).view(np.int64)
                    at = bits.among(keys)
                    own = np.searchsorted(starts, at, "right") - 1
                    within = at + size <= starts[own + 1]  # not over the end of a text
                    for i, k in zip(own[within].tolist(), at[within].tolist(), strict=True):
                        which.append(i)
                        rows.append((row + i, int(keys[k]), k - int(starts[i]), *_packed(made, k, size)))
            row += part.num_rows
            if rows:
                at = pa.array(which)
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in part.columns[:n]], *map(pa.array, zip(*rows, strict=True))], names=names)

    hits = materialize(bare.mapInArrow(lambda batches: trimmed(run(batches)), schema), "hits")
    other = items.select("key", "item", "item_id", "n_item", "at", "size", "exact", *[F.col(c).alias(f"other_{c}") for c in ("kinds", "canonical", "vals")])
    return hits.join(other, "key")


def covers(meets: Iterator[tuple[int, int, int, bool, Tokens, Tokens]], n_item: int) -> set[int]:
    """The tokens of an item that a document covers, from their meetings (place in the document, in the item, size,
    whether values are compared, the item's tokens and the document's), those by values last."""
    covered: set[int] = set()
    whole: dict[int, set[int]] = {}  # by shift, what windows of few literals cover too
    slots: dict[int, Slots] = {}  # by shift: windows of one copy of a question share their slots
    for place, at, size, exact, theirs, mine in meets:
        if exact:
            # kinds are the item's; what the copy's slots stand for elsewhere must hold here too
            theirs, mine = (theirs[0], theirs[2], theirs[2]), (theirs[0], mine[2], mine[2])
        if agree(theirs, mine, slots.setdefault(place - at, ({}, {}))):
            if exact or (theirs[0] == LITERAL).sum() >= min(LEAST_LITERALS, size):
                covered.update(range(at, at + size))
            whole.setdefault(place - at, set()).update(range(at, at + size))
    return set(range(n_item)) if any(len(x) == n_item for x in whole.values()) else covered


def holds(n_covered: int, n_item: int) -> bool:
    return n_covered >= min(LEAST_TOKENS, LEAST_SHARE * n_item)


def found(docs: DataFrame, items: DataFrame, keep: dict[str, Column], text: str) -> DataFrame:
    """`keep`, item_id, n_covered, n_item: a row for each item (of benchmark_windows) that a row of docs holds."""
    order = ["row", "item", "exact", "size", "place", "at"]
    columns = [*order, "item_id", "n_item", "kinds", "canonical", "vals", "other_kinds", "other_canonical", "other_vals", *keep]
    met = meetings(docs, items, keep, text).select(*columns).repartition("row", "item").sortWithinPartitions(*order)
    schema = met.select(*keep, "item_id").schema.add("n_covered", "long").add("n_item", "long")
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = [], None

        def judged() -> list[tuple]:
            n = len(covers(((r[4], r[5], r[3], r[2], _unpacked(*r[11:14]), _unpacked(*r[8:11])) for r in group), group[0][7]))
            return [(*group[0][14:], group[0][6], n, group[0][7])] if holds(n, group[0][7]) else []

        for batch in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:2] != key:
                    out += judged() if group else []
                    group, key = [], r[:2]
                group.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)
        if group and (out := judged()):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    return met.mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_covered, n_item: a row for each item that a row of docs holds."""
    return found(docs, benchmark_windows(benchmark, item_id, item_text), {"doc_id": F.col(doc_id)}, text)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with their columns as they are.

    Texts are named by two 64-bit hashes; those that hold an item are few, and a filter of them lets nearly all other
    rows pass without a shuffle.
    """
    dirty = found(docs, benchmark_windows(benchmark, item_id, item_text), dict(zip("ab", text_names(text), strict=True)), text)
    return without_texts(docs, text, materialize(dirty.groupBy("a", "b").agg(F.count("*").alias("n")), "dirty"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
