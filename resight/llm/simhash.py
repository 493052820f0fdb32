"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2 * half bits share a variant within half of either. So each distinct
fingerprint emits every variant within that half radius, the variants are shuffled, and the fingerprints that
meet in a variant are linked to the smallest among them, each link verified by its Hamming distance. At a half
radius of one, 65 variants are emitted, a variant is met by at most 65 fingerprints, and all that meet are within
two bits of each other: so the star of links loses no link between components, whatever the groups' sizes.
Copies collapse before that, since only distinct fingerprints take part.

Texts at a similarity of 0.8 differ in about ten of 64 majority bits, which no ball of two bits reaches. The
pipeline's stage therefore takes fingerprints on which they lie within the radius: SIGNS signs, each the least hash
of the shingles by one order, so that two texts differ in a sign with one minus their similarity. The ball is the
same: a variant leaves ERASED signs out, and fingerprints that differ in no more than these meet in one. FAMILIES
fingerprints make it sure: one pair in ten thousand at 0.8 shares no variant. All that meet in a variant are held against
each other, pairs that agree in too few of all SKETCH signs go, and the exact similarity of the shingles decides the others.

Components come from alternating large-star and small-star steps over the links, in tables.

Defined results: null and empty texts have fingerprint zero, which links like any other; a text of fewer words
than a shingle is one shingle; repeated rows are in one component; a null doc_id never names a component unless
all ids in it are null; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resight.llm.common import Bits, bits_of, by_share, discard, free_name, map_text, materialize, may_be_in, mixed, remembered, slices, table, trim, trimmed, utf8

BITS = 64
#: Fingerprints within twice this many bits are linked.
HALF = 1
#: Words in a shingle, of the query and of the pipeline's stage.
SHINGLE, STAGE_SHINGLE = 3, 5
#: The stage's least similarity, as a fraction in whole numbers.
SIMILAR = (4, 5)
#: The stage's fingerprints, their signs, and those that a variant leaves out.
FAMILIES, SIGNS, ERASED = 4, 6, 2
#: Signs of a text in all, and the least number in which candidates agree (at 0.8 one pair in 30,000 is below).
SKETCH, LEAST_EQUAL = 48, 27
#: Of texts in variants that more than GROUP texts share, the second fingerprints: families, signs, and those left out.
SECOND = (6, 8, 2)
#: Texts of a variant that are all held against each other; those that are so as one matrix, and as pairs of many groups.
GROUP, WHOLE, FEW = 2048, 512, 8
#: Texts that are compared at once, and shingles of theirs.
BLOCK, MOST_SHINGLES = 256, 1 << 20
#: A pair is verified by itself where fewer than one in so many is.
PAIRWISE = 16
#: Signs by which the middle of a large group is found.
VOTES = 16
SEED = 42
#: Rows from which a key may count as hot in the links.
LEAST_HOT = 10_000
#: Words that a worker remembers, and their longest.
MOST_WORDS, LONGEST = 100_000, 64
_WORDS = [f"s{i}" for i in range(SKETCH // 16)]
_LANES = np.uint64(0x0101010101010101)
_BLOCK = 255
_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, SKETCH), np.uint64)
_ORDERS[0] |= np.uint64(1)
#: For each level the signs that its variants keep.
_LEVELS = [[[f * signs + i for i in kept] for f in range(families) for kept in combinations(range(signs), signs - erased)] for families, signs, erased in ((FAMILIES, SIGNS, ERASED), SECOND)]


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, lowest bit first. Sums bytes of eight bits' lanes, 255 at a time."""
    starts = np.arange(0, len(hashes), _BLOCK)
    out = np.empty(BITS, np.int64)
    for b in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(b)) & _LANES, starts)
        out[b::8] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return out


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of words, space-joined; of the whole sequence if it is shorter; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = map(join, zip(*(words[i : i + n] for i in range(shingle)), strict=False)) if len(words) >= shingle else [join(words)]
    return np.fromiter((digest(g, seed) for g in grams), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes, repeats included; no hashes: 0."""
    if not len(hashes):
        return 0
    return int(np.packbits(bit_sums(hashes) * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str, text: str, shingle: int, seed: int) -> DataFrame:
    """doc_id and the signed 64-bit fingerprint f0, a row for each row of docs."""

    def kernel(texts: list[bytes]) -> dict[str, object]:
        made = np.array([fingerprint(shingle_hashes(t.lower().split(), shingle, seed)) for t in texts], np.uint64)
        return {"f0": pa.array(made.view(np.int64))}

    return map_text(docs, text, {"doc_id": F.col(doc_id)}, kernel, "f0 long")


def ball_links(distinct: DataFrame, fp: str = "fp", half: int = HALF) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints, whose components are those of all pairs within 2 * half bits.

    Only half 1 keeps the proof that a variant's fingerprints are all linked through the smallest; others would
    need all pairs of a variant.
    """
    if half != 1:
        raise ValueError("only a half radius of one bit is supported")
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)])
    flipped = distinct.select(F.col(fp), F.posexplode(masks).alias("k", "mask"))
    # the flipped bit's number is shuffled instead of the fingerprint, which follows from it: it is small and compresses
    variants = flipped.select(F.col(fp).bitwiseXOR(F.col("mask")).alias("variant"), F.col("k").cast("byte").alias("k")).repartition("variant")
    met = variants.select("variant", F.expr("if(k = 0, variant, variant ^ shiftleft(1L, k - 1))").alias("b"))
    met = met.withColumn("a", F.min("b").over(Window.partitionBy("variant"))).filter("a < b")
    return met.select("a", "b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * half).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node reachable, for each node that has a link. links has two columns of one type.

    Large-star joins each node's larger neighbours to its smallest, small-star its smaller ones and itself; each
    keeps components and both together make them stars. Done when a round changes no link. A node of very many links
    is broadcast, so its links need not meet.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w"), F.count_if(F.col("v") > F.col("u")).alias("n")).filter("n > 0")
        least = materialize(least.select("u", "n", F.least("u", "w").alias("m")), "least")
        large = by_share(both.filter("v > u"), least, "u", "n", ["m"], LEAST_HOT).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large")
        discard(least, edges)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = by_share(large, least, "u", "n", ["m"], LEAST_HOT).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.*").filter("u <> v").distinct(), "small")
        discard(least, large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select("v", "v").distinct())
        state = now


def with_components(prints: DataFrame) -> DataFrame:
    """To doc_id, f0 add component_id: the smallest doc_id of its component (by f0 within two bits)."""
    heads = materialize(prints.groupBy(F.col("f0").alias("fp")).agg(F.min("doc_id").alias("head"), F.count("*").alias("n")), "heads")
    roots = components(ball_links(heads.select("fp")))
    named = heads.join(roots, heads.fp == roots.node, "left").select("fp", "head", "n", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "roots")
    least = materialize(named.groupBy("root").agg(F.min("head").alias("component_id"), F.count("*").alias("prints")), "least")
    best = materialize(by_share(named, least, "root", "prints", ["component_id"], LEAST_HOT).select(F.col("fp").alias("f0"), "n", "component_id"), "best")
    return by_share(prints, best, "f0", "n", ["component_id"], LEAST_HOT)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: a row for each row of docs."""
    prints = materialize(fingerprints(docs, doc_id, text, shingle, seed), "prints")
    return with_components(prints).select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


# ---- the pipeline's stage


class _Words(dict):
    """Hashes of words; those that are not too long are remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= LONGEST:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = h
        return h


def shingle_set(text: bytes, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's different shingles; of the whole sequence if it is shorter; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(remembered("words", _Words).__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(out)])
    return np.unique(out)


def signs_of(shingles: np.ndarray) -> np.ndarray:
    """The least hash by each of SKETCH orders, in 32 bits."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 256):
        least = np.minimum(least, (shingles[i : i + 256, None] * _ORDERS[0] + _ORDERS[1]).min(0))
    return (mixed(least) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def variants(signs: np.ndarray, level: int = 0) -> np.ndarray:
    """A key for each variant of each row's fingerprints: the signs that it keeps, and which these are."""
    wide = signs.astype(np.uint64)
    keys = np.empty((len(signs), len(_LEVELS[level])), np.uint64)
    for j, kept in enumerate(_LEVELS[level]):
        key = np.full(len(signs), j + 1000 * level, np.uint64)
        for i in kept:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, i])
        keys[:, j] = key
    return keys


def sketched(signs: np.ndarray) -> np.ndarray:
    """(rows, SKETCH / 16) words: four bits of each sign."""
    four = (signs & np.uint32(15)).astype(np.uint64).reshape(len(signs), -1, 16)
    return (four << (4 * np.arange(16, dtype=np.uint64))).sum(2, dtype=np.uint64)


def unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many signs sketches (..., words) differ."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)


def forest(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to): links that join what agrees in LEAST_EQUAL signs, directly or through others, one less than a component
    has members. In a large group what is reached is held against what isn't yet, so copies cost little more than a look."""
    n = len(sketches)
    if n <= WHOLE:
        label = reached(unequal(sketches[:, None], sketches[None]) <= SKETCH - LEAST_EQUAL)
        moved = np.flatnonzero(label != np.arange(n))
        return label[moved], moved
    start, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = np.arange(n)
    while len(left):
        edge, left = left[:1], left[1:]
        while len(edge) and len(left):
            some, edge = edge[:BLOCK], edge[BLOCK:]
            near = unequal(sketches[some, None], sketches[None, left]) <= SKETCH - LEAST_EQUAL
            found = near.any(0)
            start.append(some[near[:, found].argmax(0)])
            end.append(left[found])
            edge, left = np.concatenate([edge, left[found]]), left[~found]
    return np.concatenate(start), np.concatenate(end)


def reached(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the number of the first that it reaches."""
    label = np.arange(len(linked))
    if linked.sum() == len(linked):
        return label
    while True:
        now = np.where(linked, label, len(linked)).min(1)
        if (now == label).all():
            return label
        label = now


def _rows_of(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def shingle_sets(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """doc_id, cls (equal for equal sets of shingles), check (tells sets of one cls apart) and the signs, a row for each row of docs."""

    def kernel(texts: list[bytes]) -> dict[str, object]:
        cls, check, signs = np.empty(len(texts), np.uint64), np.empty(len(texts), np.uint64), np.empty((len(texts), SKETCH), np.uint32)
        for i, t in enumerate(texts):
            own = shingle_set(t, shingle)
            cls[i], check[i] = set_name(own), xxhash.xxh64_intdigest(own, SEED + 1)
            signs[i] = signs_of(own)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * SKETCH), pa.array(signs.reshape(-1).view(np.int32)))
        return {"cls": pa.array(cls.view(np.int64)), "check": pa.array(check.view(np.int64)), "signs": rows}

    return map_text(docs, text, {"doc_id": F.col(doc_id)}, kernel, "cls long, check long, signs array<int>")


def set_name(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles, SEED)


def _emit(classes: DataFrame, level: int, known: Bits | None = None) -> DataFrame:
    """key of each variant of each class (cls, signs); with `known`, of those that may be among it, with cls and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                signs = _rows_of(part.column(1), SKETCH).astype(np.int32).view(np.uint32)
                keys = variants(signs, level)
                flat = pa.array(keys.reshape(-1).view(np.int64))
                if known is None:
                    yield pa.RecordBatch.from_arrays([flat], names=["key"])
                    continue
                some = known.among(keys.reshape(-1))
                row = some // keys.shape[1]
                words = sketched(signs).view(np.int64)[row]
                yield pa.RecordBatch.from_arrays([flat.take(pa.array(some)), part.column(0).take(pa.array(row)), *[pa.array(w) for w in words.T]], names=["key", "cls", *_WORDS])

    schema = "key long" if known is None else f"key long, cls long, {', '.join(f'{w} long' for w in _WORDS)}"
    return classes.select("cls", "signs").mapInArrow(lambda batches: trimmed(run(batches)), schema)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) among the rows (key, cls, sketch) of each key; rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if last:
            yield _linked([*held, batch.slice(0, last)])
            held = []
        elif held and held[-1].column(0)[-1].as_py() != key[0]:
            yield _linked(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield _linked(held)


def _linked(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).combine_chunks()
    key, cls = rows.column("key").to_numpy(), rows.column("cls").to_numpy()
    words = np.stack([rows.column(w).to_numpy() for w in _WORDS], 1).view(np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    sizes = np.diff(np.append(starts, len(key)))
    a, b = [cls[:0]], [cls[:0]]
    for size in range(2, FEW + 1):
        first = starts[sizes == size]
        for i, j in combinations(range(size), 2) if len(first) else ():
            near = unequal(words[first + i], words[first + j]) <= SKETCH - LEAST_EQUAL
            a.append(cls[first[near] + i])
            b.append(cls[first[near] + j])
    for at, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        i, j = forest(words[at : at + size])
        a.append(cls[at + i])
        b.append(cls[at + j])
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def colliding(classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes (cls, signs) that join all pairs that meet in a variant and agree in LEAST_EQUAL signs.

    All classes of a variant are held against each other, by four bits of each sign, and the links that join them are
    kept. Only variants that two classes have are shuffled with sketches: a count and a Bloom filter tell them. Classes of
    a variant that more than GROUP share emit the variants of the second fingerprints instead, which keep more signs: two
    texts at 0.8 share none of these with a chance of one in ten thousand. In what more than GROUP share even so, all are
    held against the smallest, and those that aren't like it against all, block by block; these are groups of hundreds of
    thousands of texts that are alike by half, and quadratic in the number of those.
    """
    links, own = None, classes
    for level in range(len(_LEVELS)):
        met = materialize(_emit(own, level).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "met")
        rows = _emit(own, level, bits_of(met, "key"))
        rows = materialize(by_share(rows, met, "key", "n", ["n"], LEAST_HOT).filter("n is not null"), "meeting")
        found = rows.filter(F.col("n") <= GROUP).drop("n").repartition("key").sortWithinPartitions("key").mapInArrow(_met, "a long, b long").distinct()
        found = materialize(found, "colliding")
        links = found if links is None else links.unionByName(found)
        hot = rows.filter(F.col("n") > GROUP)
        if hot.isEmpty():
            break
        if level + 1 < len(_LEVELS):
            own = materialize(classes.join(hot.select("cls").distinct(), "cls", "left_semi"), "hot")
        else:
            first = hot.groupBy("key").agg(F.min(F.struct("cls", *_WORDS)).alias("least"), F.count("*").alias("n"))
            held = by_share(hot.drop("n"), materialize(first, "least"), "key", "n", ["least"], LEAST_HOT).filter("least.cls <> cls")
            equal = F.arrow_udf(_alike, "boolean")(F.array(*_WORDS), F.array(*[F.col(f"least.{w}") for w in _WORDS]))
            held = materialize(held.withColumn("equal", equal).select("key", "cls", *_WORDS, F.col("least.cls").alias("least"), "equal"), "held")
            links = links.unionByName(held.filter("equal").select(F.col("least").alias("a"), F.col("cls").alias("b")).distinct())
            links = links.unionByName(materialize(across(held.filter("not equal"), held), "colliding"))
    return links


def across(rest: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) that join what is alike, of the rows (key, cls, sketch) of `rest` with all `rows` of their key. Both are dealt
    into blocks of about GROUP rows by a hash, and each block of the rest meets each block of all."""
    parts = rows.groupBy("key").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    parts = materialize(rest.select("key").distinct().join(parts, "key"), "parts")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        dealt = df.select("key", F.struct("cls", *_WORDS).alias("row")).join(F.broadcast(parts), "key")  # a row for GROUP rows or more
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row.cls"), F.col("parts")).cast("int"))
        return dealt.groupBy("key", "parts", "block").agg(F.collect_list("row").alias(name))  # GROUP of them

    left = blocks(rest, "l").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = left.hint("merge").join(blocks(rows, "r").drop("parts"), ["key", "block"]).select("l", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = pa.concat_arrays([batch.column(k)[i].values for k in (0, 1)])
                cls = own.field("cls").to_numpy()
                start, end = forest(np.stack([own.field(w).to_numpy() for w in _WORDS], 1).view(np.uint64))
                a, b = np.minimum(cls[start], cls[end]), np.maximum(cls[start], cls[end])
                yield pa.RecordBatch.from_arrays([pa.array(a[a < b]), pa.array(b[a < b])], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    left, right = (_rows_of(x, len(_WORDS)).view(np.uint64) for x in (a, b))
    return pa.array(unequal(left, right) <= SKETCH - LEAST_EQUAL)


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """For each sorted set the number of the first that it reaches by steps of Jaccard similarity SIMILAR or more."""
    sizes = np.array([len(x) for x in sets])
    ends = np.linspace(0, 1, max(1, -(-int(sizes.sum()) // MOST_SHINGLES)) + 1)[1:-1]
    bounds = [np.uint64(int(e * (1 << 64))) for e in ends]
    cuts = [[0, *np.searchsorted(x, bounds).tolist(), len(x)] for x in sets]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(len(bounds) + 1):
        parts = [x[cut[c] : cut[c + 1]] for x, cut in zip(sets, cuts, strict=True)]
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in parts])
        _, column, often = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = often[column] > 1
        column, owner, n = np.cumsum(often > 1)[column[shared]] - 1, owner[shared], int((often > 1).sum())
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for start in range(0, n, 1024):  # small products, as each thread of a large one keeps its buffers
            i, j = np.searchsorted(column, [start, start + 1024])
            part = np.zeros((len(sets), min(1024, n - start)), np.float32)
            part[owner[i:j], column[i:j] - start] = 1
            common += part @ part.T
    above, below = SIMILAR
    linked = (above + below) * common >= above * (sizes[:, None] + sizes)
    np.fill_diagonal(linked, True)
    return reached(linked)


def _set(packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), np.uint64) if packed.is_valid else np.zeros(0, np.uint64)


def _compare(data: pa.Table) -> pa.Table:
    """Links (a, b) among the rows (cls, blob, set, signs) of each blob. Pairs that agree in too few signs aren't looked at;
    the others are verified one by one, or by a matrix product where they are most of all."""
    cls, blob, packed = data.column("cls").to_numpy(), data.column("blob").to_numpy(), data.column("set")
    words = sketched(_rows_of(data.column("signs").combine_chunks(), SKETCH).astype(np.int32).view(np.uint32))
    order = np.argsort(blob, kind="stable")
    a, b = [cls[:0]], [cls[:0]]
    for at in np.split(order, np.flatnonzero(np.diff(blob[order])) + 1):
        linked = np.triu(unequal(words[at, None], words[None, at]) <= SKETCH - LEAST_EQUAL, 1)
        left, right = np.nonzero(linked)
        if PAIRWISE * len(left) > len(at) ** 2:
            label = similar([_set(packed[int(i)]) for i in at])
        else:
            sets = {i: _set(packed[int(at[i])]) for i in np.unique([left, right]).tolist()}
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                linked[i, j] = linked[j, i] = _is_near(sets[i], sets[j])
            np.fill_diagonal(linked, True)
            label = reached(linked)
        moved = np.flatnonzero(label != np.arange(len(label)))
        a.append(cls[at[label[moved]]])
        b.append(cls[at[moved]])
    trim()
    return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})


def _is_near(x: np.ndarray, y: np.ndarray) -> bool:
    above, below = SIMILAR
    if above * max(len(x), len(y)) > below * min(len(x), len(y)):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
    return (above + below) * common >= above * (len(x) + len(y))


def _near(sets: pa.Array, others: pa.Array) -> pa.Array:
    return pa.array([_is_near(_set(x), _set(y)) for x, y in zip(sets, others, strict=True)], pa.bool_())


def _middles(rows: DataFrame) -> DataFrame:
    """blob, middle: of each blob the member (cls) that agrees best with the blob's most frequent signs."""
    vote = rows.select("blob", F.posexplode(F.slice("signs", 1, VOTES)).alias("i", "sign")).groupBy("blob", "i", "sign").agg(F.count("*").alias("votes"))
    mode = vote.groupBy("blob", "i").agg(F.max(F.struct("votes", "sign")).alias("best"))
    ideal = mode.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("i", "best.sign"))).alias("ideal"))  # VOTES entries
    ideal = materialize(ideal.join(rows.groupBy("blob").agg(F.count("*").alias("n")), "blob").select("blob", "n", F.col("ideal.sign").alias("ideal")), "ideal")
    agreed = F.aggregate(F.zip_with(F.slice("signs", 1, VOTES), "ideal", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    near = by_share(rows, ideal, "blob", "n", ["ideal"], LEAST_HOT).select("blob", "cls", agreed.alias("agreed"))
    return near.groupBy("blob").agg(F.max(F.struct("agreed", "cls")).alias("m")).select("blob", F.col("m.cls").alias("middle"))


def similar_links(members: DataFrame) -> DataFrame:
    """Links (a, b) that join what is SIMILAR among members (cls, blob, size of the blob, set, signs) of each blob.

    Blobs of up to BLOCK members share groups, in which all pairs are compared by matrix products. In a larger blob
    every member is first held against its middle; those that are not similar to that are dealt into blocks and
    compared with all members, block by block.
    """
    small, large = members.filter(F.col("size") <= BLOCK), members.filter(F.col("size") > BLOCK)
    parts = max(1, -(-small.count() // BLOCK))
    schema = "a long, b long"
    links = small.select("cls", "blob", "set", "signs", F.pmod(F.xxhash64("blob"), F.lit(parts)).alias("part")).groupBy("part").applyInArrow(_compare, schema)
    if large.isEmpty():
        return links
    middles = materialize(_middles(large.select("cls", "blob", "signs")), "middles")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    spread = large.withColumn("salt", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    middle = large.join(middles.select(F.col("middle").alias("cls")), "cls", "left_semi")
    middle = middle.select("blob", F.col("cls").alias("middle"), F.col("set").alias("middle_set"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("salt"))
    near = F.arrow_udf(_near, "boolean")
    tested = materialize(spread.join(middle, ["blob", "salt"]).select("cls", "blob", "middle", near("set", "middle_set").alias("near")), "tested")
    links = links.unionByName(tested.filter("near and cls <> middle").select(F.col("middle").alias("a"), F.col("cls").alias("b")))
    left = materialize(tested.groupBy("blob").agg(F.count_if(~F.col("near")).alias("open"), F.count("*").alias("n")).filter("open > 0"), "open")
    if left.isEmpty():
        return links
    rest = by_share(large, left, "blob", "n", ["open"], LEAST_HOT).filter("open is not null").join(tested.select("cls", "near"), "cls")
    mine, others = F.ceil(F.col("open") / BLOCK).cast("int"), F.ceil((F.col("size") - F.col("open")) / BLOCK).cast("int")
    rest = rest.withColumn("own", F.when(F.col("near"), mine + F.pmod(F.xxhash64("cls"), others)).otherwise(F.pmod(F.xxhash64("cls"), mine)).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("near"), mine).otherwise(mine + others) - 1)))
    rest = rest.select("cls", "blob", "set", "signs", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return links.unionByName(rest.groupBy("blob", "low", "high").applyInArrow(_compare, schema))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = STAGE_SHINGLE) -> DataFrame:
    """The rows of docs with the smallest doc_id of each group; of a group's rows that repeat this id one stays. Rows
    with a null id stay, as nothing names them; so do those of two sets whose 64-bit names are equal.

    Documents are grouped if the Jaccard similarity of their sets of shingles is SIMILAR or more, directly or through
    others. Texts are shuffled as sets of those that have a candidate, and as rows of those that may go.
    """
    prints = materialize(shingle_sets(docs, doc_id, text, shingle), "prints")
    classes = prints.groupBy("cls").agg(F.min("doc_id").alias("head"), F.count("*").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"), F.first("signs").alias("signs"))
    classes = materialize(classes.filter("low = high").drop("low", "high"), "classes")
    blobs = components(colliding(classes))
    blobs = materialize(blobs.select(F.col("node").alias("cls"), F.col("root").alias("blob")), "blobs")
    sizes = materialize(blobs.groupBy("blob").agg(F.count("*").alias("size")), "sizes")
    sized = by_share(blobs, sizes, "blob", "size", ["size"], LEAST_HOT).join(classes.select("cls", "signs"), "cls")

    def sets(texts: list[bytes]) -> dict[str, object]:
        made = [shingle_set(t, shingle) for t in texts]
        return {"cls": pa.array(np.array([set_name(x) for x in made], np.uint64).view(np.int64)), "set": pa.array([x.tobytes() for x in made], pa.binary())}

    # the text of each set's smallest id, and of any that has the same id or passes the filter by chance
    wanted = bits_of(classes.join(blobs, "cls", "left_semi").filter("head is not null").select(F.xxhash64("head").alias("h")), "h")
    own = docs.select(F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id)).alias("h"), utf8(text).alias("t"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            mine = np.asarray(part.column(0).is_null()).copy()
            mine[wanted.among(part.column(0).fill_null(0).to_numpy())] = True
            made = sets(part.column(1).filter(pa.array(mine)).to_pylist())
            yield pa.RecordBatch.from_arrays([made["cls"], made["set"]], names=["cls", "set"])

    # copies that passed by chance collapse before they meet
    picked = own.mapInArrow(lambda batches: trimmed(pick(batches)), "cls long, set binary").groupBy("cls").agg(F.first("set").alias("set"))
    members = materialize(picked.join(sized, "cls"), "members")
    roots = components(similar_links(members))
    # a component's smallest id stays, by one row of the smallest set that has it
    named = materialize(classes.join(roots, classes.cls == roots.node, "left").select("cls", "head", "n", F.coalesce("root", "cls").alias("root")), "named")
    discard(classes, members, blobs, sizes)
    heads = materialize(named.groupBy("root").agg(F.min(F.when(F.col("head").isNotNull(), F.struct("head", "cls"))).alias("h"), F.count("*").alias("sets")), "heads")
    heads = heads.select("root", "sets", F.col("h.head").alias("id"), F.col("h.cls").alias("set"))
    target = materialize(by_share(named.drop("head"), heads, "root", "sets", ["id", "set"], LEAST_HOT).select("cls", "n", "id", "set"), "target")
    judged = by_share(prints.select("doc_id", "cls"), target, "cls", "n", ["id", "set"], LEAST_HOT).filter("doc_id is not null and id is not null")
    key, mine = free_name(docs, "gone"), free_name(docs, "cls")
    repeated = materialize(prints.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(key)), "repeated")
    gone = materialize(judged.filter("doc_id <> id or cls <> set").select(F.col("doc_id").alias(key)).distinct(), "gone")
    several = None
    if not repeated.isEmpty():
        # rows that share an id are told apart by their sets
        several = docs.join(repeated, F.col(doc_id) == F.col(key), "left_semi").withColumn(mine, _set_of(shingle)(utf8(text)))
        stay = materialize(judged.filter("doc_id = id and cls = set").select(F.col("doc_id").alias(key), F.col("cls").alias(other := free_name(docs, "set"))).distinct(), "stay")
        known = target.select(F.col("cls").alias(other)).distinct()
        several = several.join(stay, (F.col(doc_id) == F.col(key)) & (F.col(mine) == F.col(other)), "left_semi").dropDuplicates([doc_id, mine]).unionByName(several.join(known, F.col(mine) == F.col(other), "left_anti")).drop(mine)
        gone = materialize(gone.unionByName(repeated).distinct(), "gone")
    doubtful = may_be_in(gone, key)(doc_id)
    kept = docs.filter(~doubtful).unionByName(docs.filter(doubtful).join(gone, F.col(doc_id) == F.col(key), "left_anti"))
    return kept if several is None else kept.unionByName(several)


def _set_of(shingle: int):
    @F.arrow_udf("long")
    def cls(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([set_name(shingle_set(t, shingle)) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return cls


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
