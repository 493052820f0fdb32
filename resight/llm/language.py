"""Language identification by language-bitmask n-gram filters.

One Bloom table serves all languages: a slot is a bitmask with a bit for each, so the conjunction of an n-gram's
slots gives all languages that hold it at once (bit-sliced filters). A text's n-grams are looked up, the languages'
bits counted, the counts corrected for each filter's rate of false positives, and the largest decides.

Learned from a sample of at most about `most` documents a language. An n-gram is kept if it has LEAST_SHARE of its
language's, so a language has 50,000 at most; the table has a slot for every SLOTS-th of them and a bit in it for each
language, set by an OR over the executors. Languages are as many as the labels name.

Defined results: `und` with score 0 if a text is null or has no letter, or if nothing was learned; ties go to the
language with more learned documents, then by name; repeated rows are judged row by row; an empty table gives an
empty result; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm.common import fold, map_text, materialize, slices, table, utf8

N = 3
#: Documents to learn from, for each language; least share of a language's n-grams.
MOST_DOCS, LEAST_SHARE = 10_000, 2e-5
#: Slots for each n-gram kept of the largest language, and slots looked up for one.
SLOTS, PROBES = 16, 3
FOLDS, HELD_OUT = 3, 1
_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For all code points: whether it is a letter, and its lower case."""
    if not _tables:
        alpha, low = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                alpha[i] = True
                low[i] = ord(c.lower()[0])
        _tables[:] = [alpha, low]
    return _tables[0], _tables[1]


def ngrams(text: bytes) -> np.ndarray:
    """The lower-cased letter n-grams of a text, packed in 64 bits, repeats included; one blank for each run of other signs."""
    alpha, low = _letters()
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    is_letter = alpha[points] if len(points) else np.zeros(0, bool)
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    signs = np.where(is_letter, low[points], 32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first sign after a letter
    signs = np.concatenate([[32], signs[keep], [] if not is_letter[-1] else [32]]).astype(np.uint64)
    return signs[:-2] | signs[1:-1] << np.uint64(21) | signs[2:] << np.uint64(42)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bits_of(words: np.ndarray, n: int) -> np.ndarray:
    """How many of the rows of bitmask words have each of n bits."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, :n].sum(0, dtype=np.int64)


@dataclass
class Filters:
    """langs in order of preference at ties; slots: bitmask words by slot; false: rate of false positives by language."""

    langs: list[str]
    slots: np.ndarray
    false: np.ndarray

    @classmethod
    def of(cls, order: list[str], slots: np.ndarray) -> Filters:
        filled = sum(_bits_of(slots[i : i + 4096], len(order)) for i in range(0, len(slots), 4096)) / len(slots)
        return cls(order, slots, np.asarray(filled, float) ** PROBES)

    @staticmethod
    def size(largest: int) -> int:
        return 1 << max(10, int(np.ceil(np.log2(max(1, SLOTS * largest)))))

    @staticmethod
    def at(grams: np.ndarray, size: int) -> list[np.ndarray]:
        first = _mix(grams + np.uint64(0x9E3779B97F4A7C15))
        second = _mix(first) | np.uint64(1)
        return [((first + np.uint64(k) * second) & np.uint64(size - 1)).astype(np.int64) for k in range(PROBES)]

    def languages(self, grams: np.ndarray) -> np.ndarray:
        """Bitmask words for each n-gram."""
        found = None
        for at in self.at(grams, len(self.slots)):
            found = self.slots[at] if found is None else found & self.slots[at]
        return found

    def decide(self, text: bytes) -> tuple[str, float]:
        grams = ngrams(text)
        if not len(grams) or not self.langs:
            return "und", 0.0
        found = self.languages(grams)
        counts = sum(_bits_of(found[i : i + 4096], len(self.langs)) for i in range(0, len(found), 4096))
        right = np.clip((counts - self.false * len(grams)) / (1 - np.minimum(self.false, 0.999)), 0, len(grams))
        best = int(np.argmax(right))
        return self.langs[best], float(right[best] / len(grams))


def learn(docs: DataFrame, lang: str, text: str, may: Column, by: Column, most: int = MOST_DOCS) -> Filters:
    """From the rows for which `may` holds and lang is not null: a share of each language by the hash `by` of a row."""
    known = docs.filter(may & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), by.alias("by"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    order = [r["lang"] for r in sizes]
    if not order:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0))
    shares = docs.sparkSession.createDataFrame([(r["lang"], i, min(1.0, most / r["count"])) for i, r in enumerate(sizes)], "lang string, number int, share double")
    sample = known.join(F.broadcast(shares), "lang").filter(F.pmod("by", F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            numbers = part.column(0).to_pylist()
            by: dict[int, list[np.ndarray]] = {}
            for x, t in zip(numbers, part.column(1).to_pylist(), strict=True):
                by.setdefault(x, []).append(ngrams(t))
            for x, found in by.items():
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), x, np.int32)), pa.array(grams.view(np.int64)), pa.array(n)], names=["number", "gram", "n"])

    counted = materialize(sample.select("number", utf8("text").alias("t")).mapInArrow(count, "number int, gram long, n long").groupBy("number", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counted.groupBy("number").agg(F.sum("n").alias("all"))  # a row for each language
    kept = counted.join(F.broadcast(totals), "number").filter(F.col("n") >= F.greatest(F.lit(2.0), LEAST_SHARE * F.col("all"))).select("number", "gram")
    largest = kept.groupBy("number").count().agg(F.max("count")).first()[0] or 0
    size, width = Filters.size(largest), -(-len(order) // 64)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                number = b.column(0).to_numpy().astype(np.int64)
                spots = np.concatenate([at * width + number // 64 for at in Filters.at(b.column(1).to_numpy().view(np.uint64), size)])
                masks = np.tile(np.uint64(1) << (number % 64).astype(np.uint64), PROBES)
                at, where = np.unique(spots, return_inverse=True)
                bits = np.zeros(len(at), np.uint64)
                np.bitwise_or.at(bits, where, masks)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], names=["at", "bits"])

    slots = np.zeros(size * width, np.uint64)
    # at most as many rows as the table has words
    rows = kept.mapInArrow(put, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    slots[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Filters.of(order, slots.reshape(size, width))


def identify(docs: DataFrame, filters: Filters, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: a row for each row of docs."""

    def kernel(texts: list[bytes]) -> dict[str, object]:
        found = [filters.decide(t) for t in texts]
        return {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([s for _, s in found], pa.float64())}

    return map_text(docs, text, {"doc_id": F.col(doc_id)}, kernel, "lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = learn(docs, "lang", "text", fold("doc_id", FOLDS) != HELD_OUT, F.xxhash64("doc_id", "text"))
    return identify(docs, filters).withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT)
