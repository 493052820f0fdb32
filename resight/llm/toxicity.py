"""Toxicity by a lexicon trie intersected with Levenshtein automata, and context windows.

The lexicon is learned: words and word beginnings whose documents are labelled toxic far more often than others'.
It forms a trie. The automata of all its terms (one edit for terms of MIN_ONE letters or more, two from MIN_TWO)
are run on the trie together: a state is the set of (node, edits) that a word's letters can have reached, built
when first met and kept, so that nearly all words leave the automaton after a few letters.

Each hit is judged in a window of words: inside quotation marks, or beside a word of reporting, it counts as
quoted. Words of reporting are some English ones and those, of any language, that the labelled texts teach: words that
stand beside hits far more often in texts that aren't toxic. A logistic model over the sums of hits (words, which count less if misspelled; beginnings; quoted ones
apart; misspelled ones once more, so that the weight of an edit is learned) gives the score.

Learned from at most about MOST_DOCS labelled documents of each class, with the intercept set for the classes' true
shares. Terms of any length are chosen by their support, log odds and significance alone. A term's support among toxic
documents is the number of different contexts that it stands in, one a document at most: so copies and near copies of a
text, and what many texts share, such as a header, are one witness, while all that a text says of its own counts; texts
of a few words are each their own witness. A term needs LEAST_DOCS contexts, so the number of terms is bounded by the
sample's. In the logistic model, documents whose hits all stand in the same contexts share one document's weight.

Defined results: null and empty texts have no hits and get the score of that; several equal labels of a document count
as one in what terms rest on, and both classes' count if they differ; without labels of both classes every score is the share of toxic labels (0 without labels); repeated rows
are scored alike; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm.common import fold, map_text, materialize, sampled, slices, table, utf8

#: Labelled documents of each class to learn from.
MOST_DOCS = 10_000
#: A term is in the lexicon from so many toxic documents of the sample, such log odds of toxic to other ones, and such a
#: likelihood ratio (twice its logarithm, as chi squared) against no difference: chance alone reaches it once in 10,000 terms.
LEAST_DOCS, LEAST_ODDS, LEAST_RATIO = 5, 2.5, 15.0
#: Each edit takes this share of a letter's worth.
PER_EDIT = 1.5
#: Letters of the beginnings that are tried, and of terms that may have one or two edits.
STEMS, MIN_ONE, MIN_TWO = (5, 6, 7, 8), 5, 8
#: Words to either side of a hit.
WINDOW = 6
#: Words to either side of a term that are its context, and words below which a text is a context of its own.
CONTEXT, SHORT = 3, 20
#: A learned word of reporting stands in so many different windows of hits of other documents, with such log odds of other to toxic ones.
BESIDE_DOCS, BESIDE_ODDS = 5, 1.5
#: English words of reporting, by which a hit counts as quoted before anything is learned.
REPORTING = frozenset("said says say wrote called calling quote quoted quotes quoting word words term reported alleged".split())
PAIRED = '"“”„«»'
QUOTES = PAIRED + "‘’"
#: Words that a worker remembers, and the longest of them.
MOST_WORDS, LONGEST = 150_000, 64
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
FEATURES = ["word", "stem", "quoted", "close", "edited", "any", "density"]
_EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + QUOTES + "¡¿…–—"


def bare(word: str) -> str:
    """A word without the signs around it, in lower case."""
    return word.strip(_EDGES).lower()


class Automaton:
    """Finds the lexicon term that a word is, begins with (terms ending in *), or misspells."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.most = [0 if t.endswith("*") else 2 if len(t) >= MIN_TWO else 1 if len(t) >= MIN_ONE else 0 for t in terms]
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.stems: list[int] = [-1]
        self.edits: list[int] = [0]  # most edits of the terms below a node
        for k, term in enumerate(terms):
            whole, node = term.rstrip("*"), 0
            allowed = self.most[k]
            self.edits[0] = max(self.edits[0], allowed)
            for c in whole:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.stems.append(-1)
                    self.edits.append(0)
                node = self.children[node][c]
                self.edits[node] = max(self.edits[node], allowed)
            (self.stems if term.endswith("*") else self.ends)[node] = k
        self.letters = {c for x in self.children for c in x}
        self.start = self._close({(0, 0)})
        self.steps: dict[frozenset, dict[str, frozenset | None]] = {}
        self.finals: dict[frozenset, tuple[int, int] | None] = {}

    def _close(self, states: set[tuple[int, int]]) -> frozenset:
        """With letters of terms left out; of a node's states, the one of fewest edits."""
        best: dict[int, int] = {}
        todo = list(states)
        while todo:
            node, e = todo.pop()
            if best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(n, e + 1) for n in self.children[node].values() if e + 1 <= self.edits[n]]
        return frozenset(best.items())

    def _step(self, state: frozenset, c: str) -> frozenset | None:
        out: set[tuple[int, int]] = set()
        for node, e in state:
            for letter, n in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.edits[n] or cost == 0:
                    out.add((n, cost))
            if e + 1 <= self.edits[node]:
                out.add((node, e + 1))
        return self._close(out) if out else None

    def _final(self, state: frozenset) -> tuple[int, int] | None:
        found = [(e, self.ends[n]) for n, e in state if self.ends[n] >= 0 and e <= self.most[self.ends[n]]]
        return min(found)[::-1] if found else None

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) or None: the whole word with fewest edits; else the longest beginning."""
        state, node, stem = self.start, 0, -1
        for c in word:
            if node is not None:
                node = self.children[node].get(c)
                if node is not None and self.stems[node] >= 0:
                    stem = self.stems[node]
            if state is not None:
                c = c if c in self.letters else ""
                steps = self.steps.setdefault(state, {})
                if c not in steps:
                    steps[c] = self._step(state, c)
                state = steps[c]
            if state is None and node is None:
                break
        if state is not None:
            if state not in self.finals:
                self.finals[state] = self._final(state)
            if self.finals[state] and (self.finals[state][1] == 0 or stem < 0):
                return self.finals[state]
        return (stem, 0) if stem >= 0 else None


@dataclass
class Model:
    terms: list[str]
    weights: list[float]
    coefficients: list[float] = field(default_factory=list)
    constant: float | None = None
    reporting: frozenset[str] = REPORTING
    _automaton: Automaton | None = None
    _known: dict[str, tuple[int, int] | None] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_known": {}}

    def hit(self, word: str) -> tuple[int, int] | None:
        """For a word as it stands in a text."""
        if word in self._known:
            return self._known[word]
        if self._automaton is None:
            self._automaton = Automaton(self.terms)
        found = self._automaton.find(bare(word))
        if len(word) <= LONGEST:
            if len(self._known) >= MOST_WORDS:
                self._known.clear()
            self._known[word] = found
        return found

    def hits(self, words: list[str]) -> list[tuple[int, tuple[int, int]]]:
        """(place, (term, edits)) of the words that are in the lexicon."""
        known, hit = self._known, self.hit
        return [(i, h) for i, w in enumerate(words) if (h := known[w] if w in known else hit(w))]

    def features(self, text: bytes) -> list[float]:
        """Sums of the hits' weights by kind, and how dense and close they are; in the order of FEATURES."""
        words = text.decode("utf-8", "replace").split()
        hits = self.hits(words)
        sums = dict.fromkeys(FEATURES, 0.0)
        opened = np.cumsum([sum(w.count(q) for q in PAIRED) for w in words]) if hits and any(q.encode() in text for q in PAIRED) else None
        last = -(10**9)
        for i, (term, edits) in hits:
            near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            inside = opened is not None and (opened[i] % 2 == 1 or any(c in QUOTES for c in words[i]))
            quoted = inside or any(bare(w) in self.reporting for w in near)
            kind = "quoted" if quoted else "stem" if self.terms[term].endswith("*") else "word"
            worth = self.weights[term] * (1 - PER_EDIT * edits / len(self.terms[term]))
            sums[kind] += worth
            sums["edited"] += worth * (edits > 0)
            sums["close"] += i - last <= 4 * WINDOW and not quoted
            last = i
        sums["any"] = float(bool(hits))
        return [*(math.log1p(sums[k]) for k in FEATURES[:5]), sums["any"], math.log1p(100.0 * len(hits) / (len(words) + 20))]

    def windows(self, text: bytes, own: int) -> int | None:
        """A hash of the contexts that a text's hits stand in; None without hits. own: the text's number."""
        words = text.decode("utf-8", "replace").split()
        hits = self.hits(words)
        return hash(tuple(sorted({around(words, i, CONTEXT, own) for i, _ in hits}))) if hits else None

    def score(self, text: bytes) -> float:
        if self.constant is not None:
            return self.constant
        z = self.coefficients[0] + sum(a * b for a, b in zip(self.coefficients[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients (first the intercept) of a weighted ridge logistic regression, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (y - p)) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def candidates(words: set[str]) -> set[str]:
    """The words and their beginnings (with *)."""
    return {w for w in words if w} | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


def around(words: list[str], i: int, reach: int, own: int) -> int:
    """A hash of the words beside a place, by which copies are told; in a short text that and its own number."""
    beside = "\0".join([*words[max(0, i - reach) : i], "", *words[i + 1 : i + 1 + reach]]).lower()
    return xxhash.xxh64_intdigest(beside, own & 0xFFFFFFFFFFFFFFFF if len(words) < SHORT else 0) >> 1


def contexts(text: str, wanted: set[str], own: int = 0) -> dict[str, int]:
    """For each wanted term of a text one of the contexts that it stands in, the same one in every copy. own: the text's number."""
    words, out = text.split(), {}
    seen: dict[str, list[str]] = {}
    for i, w in enumerate(words):
        if w not in seen:
            seen[w] = [c for c in candidates({bare(w)}) if c in wanted]
        for term in seen[w]:
            h = around(words, i, CONTEXT, own)
            if h < out.get(term, 1 << 63):
                out[term] = h
    return out


def likelihood_ratio(other: int, toxic: int, docs: list[int]) -> float:
    """Of a term's documents by class against the classes' shares of all."""
    n, share = other + toxic, docs[1] / (docs[0] + docs[1])
    return 2 * sum(k * math.log(k / (n * p)) for k, p in ((toxic, share), (other, 1 - share)) if k)


def choose(found: list[tuple[str, int, int]], docs: list[int]) -> tuple[list[str], list[float]]:
    """Terms and their log odds from (term, other documents, toxic documents); a beginning that a kept term covers or
    has is left out. Words stay beside their own beginning, as only they may be misspelled."""
    beside: dict[str, float] = {}
    kept: dict[str, float] = {}
    starts: set[str] = set()
    rated = []
    for term, other, toxic in found:
        odds = math.log((toxic + 0.5) / (docs[1] + 1)) - math.log((other + 0.5) / (docs[0] + 1))
        if toxic >= LEAST_DOCS and odds >= LEAST_ODDS and likelihood_ratio(other, toxic, docs) >= LEAST_RATIO:
            rated.append((odds * math.sqrt(toxic), not term.endswith("*"), term, odds))
    for _, _, term, odds in sorted(rated, reverse=True):
        whole = term.rstrip("*")
        if any(f"{whole[:k]}*" in kept for k in STEMS if k <= len(whole)):
            if not term.endswith("*"):
                beside[term] = odds
        elif not (term.endswith("*") and whole in starts):
            kept[term] = odds
            starts.update(whole[:k] for k in range(1, len(whole) + 1))
    return [*kept, *beside], [*kept.values(), *beside.values()]


def reporting(sample: DataFrame, model: Model) -> frozenset[str]:
    """Words of the sample (label, t, own) that stand beside hits far more often in other than in toxic documents; a window of
    words counts once, however many texts have it."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            label, name, near = [], [], []
            for y, t, own in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                words = t.decode("utf-8", "replace").split()
                for i, _ in model.hits(words):
                    beside = {bare(w) for w in words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]}
                    label.append(y)
                    name.append(around(words, i, WINDOW, own))
                    near.append(sorted({w for w in beside if w and len(w) <= LONGEST and model.hit(w) is None} | {""}))  # "" counts windows
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(name, pa.int64()), pa.array(near, pa.list_(pa.string()))], names=["label", "name", "near"])

    each = sample.mapInArrow(windows, "label int, name long, near array<string>").groupBy("label", "name").agg(F.first("near").alias("near"))
    number = lambda k: F.count_if(F.col("label") == k)
    counted = materialize(each.select("label", F.explode("near").alias("term")).groupBy("term").agg(number(0).alias("other"), number(1).alias("toxic")), "beside")
    docs = counted.filter("term = ''").first()
    if docs is None or not docs["other"]:
        return frozenset()
    odds = F.log((F.col("other") + 0.5) / (docs["other"] + 1)) - F.log((F.col("toxic") + 0.5) / (docs["toxic"] + 1))
    found = counted.filter((F.col("other") >= BESIDE_DOCS) & (odds >= BESIDE_ODDS) & (F.col("term") != "")).collect()  # of the sample
    return frozenset(r["term"] for r in found if likelihood_ratio(r["other"], r["toxic"], [docs["other"], docs["toxic"]]) >= LEAST_RATIO)


def lexicon(sample: DataFrame, sizes: dict[int, int]) -> tuple[list[str], list[float]]:
    """Terms and weights from the sample (label, t, own) with documents of both classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())
        for part in slices(batches, 1):
            for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by[y].update(candidates({bare(w) for w in t.decode("utf-8", "replace").split()}))
        # what is rare in a task may be frequent in all: everything is told
        terms = list(by[0] | by[1])
        for i in range(0, len(terms), 50_000):
            own = terms[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), *[pa.array([by[k][x] for x in own], pa.int64()) for k in (0, 1)]], names=["term", "other", "toxic"])

    counted = sample.mapInArrow(count, "term string, other long, toxic long").groupBy("term").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("other") + 0.5) / (sizes[0] + 1))
    found = counted.filter((F.col("toxic") >= LEAST_DOCS) & (odds >= LEAST_ODDS)).select("term", "other").collect()  # each in LEAST_DOCS of the sample's documents
    other = {r["term"]: r["other"] for r in found}
    wanted = set(other)

    def witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows = [x for t, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True) for x in contexts(t.decode("utf-8", "replace"), wanted, own).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "context"])

    seen = sample.filter("label = 1").mapInArrow(witnesses, "term string, context long").distinct().groupBy("term").count()
    return choose([(r["term"], other[r["term"]], r["count"]) for r in seen.collect()], [sizes[0], sizes[1]])


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_DOCS) -> Model:
    """From labelled documents outside the held-out fold: about `most` of each class, by a hash of the id."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & (fold(doc_id, FOLDS) != HELD_OUT)).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    docs_of = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(docs_of) < 2:
        return Model([], [], constant=float(1 in docs_of))
    share = {k: min(1.0, most / n) for k, n in docs_of.items()}
    some = sampled(known, F.xxhash64("id"), F.when(F.col("label") == 1, share[1]).otherwise(share[0]), 2 * most)
    sample = materialize(docs.select(F.col(doc_id).alias("id"), utf8(text).alias("t")).join(some, "id").select("label", "t", F.xxhash64("id").alias("own")), "labelled")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model([], [], constant=docs_of[1] / sum(docs_of.values()))
    model = Model(*lexicon(sample, sizes))
    model.reporting = REPORTING | reporting(sample, model)
    schema = "label int, windows long, " + ", ".join(f"{f} double" for f in FEATURES)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            texts = part.column(1).to_pylist()
            made = np.array([model.features(t) for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.windows(t, own) for t, own in zip(texts, part.column(2).to_pylist(), strict=True)], pa.int64()), *[pa.array(made[:, i]) for i in range(len(FEATURES))]], names=["label", "windows", *FEATURES])

    rows = sample.mapInArrow(describe, schema).toPandas()  # at most about 4 * most rows
    # texts whose hits stand in the same windows are one document of their class
    alike = rows.groupby(["label", "windows"])["label"].transform("count").to_numpy(float)
    weight = np.where(rows["windows"].isna(), 1.0, 1.0 / np.nan_to_num(alike, nan=1.0))
    y = rows["label"].to_numpy(float)
    true = docs_of[1] / sum(docs_of.values())
    weight *= np.where(y == 1, true / max(1e-9, weight[y == 1].sum()), (1 - true) / max(1e-9, weight[y == 0].sum())) * len(y)
    model.coefficients = [float(b) for b in logistic(rows[FEATURES].to_numpy(float), y, weight)]
    return model


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score: a row for each row of docs."""

    def kernel(texts: list[bytes]) -> dict[str, object]:
        return {"score": pa.array([model.score(t) for t in texts], pa.float64())}

    return map_text(docs, text, {"doc_id": F.col(doc_id)}, kernel, "score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = scored(docs, learn(docs, table(spark, sf_dir, "labels")))
    return made.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
