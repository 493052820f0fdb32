"""What the toxicity lexicon is learned from: texts that share much, copies, and terms of any length."""

import math

import numpy as np
import pytest

from resight.llm import toxicity
from resight.llm.common import fold

TERMS = ["blorgish", "snarfwit", "grumbo", "vextor", "mulkhead"]


def corpus(noise, n, terms, header, copies=0):
    """(doc_id, text, toxic): a header, thirty words of 800, and in every third text one or two of the terms."""
    plain = [f"{a}{b}" for a in "ba be bi bo bu da de di do du fa fe fi fo fu ga ge gi go".split() for b in "lan men rit sol tur vak wen xil yor zum nad pel qui jos hob cet dru fyn mag ket luv".split()]
    top = " ".join(f"head{i}" for i in range(header))
    rows = []
    for i in range(n):
        words = list(noise.choice(plain, 30))
        if i % 3 == 0:
            for term in noise.choice(terms, min(len(terms), 1 + i % 2), replace=False):
                words.insert(int(noise.integers(0, len(words))), str(term))
        rows.append((i, f"{top} {' '.join(words)}".strip(), int(i % 3 == 0)))
    return rows + [(n + k, "be kind to the one wodger that you all know well today my friend " + "and stay in for now " * 3, 1) for k in range(copies)]


def caught(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    held = {r["doc_id"] for r in docs.filter(fold("doc_id", 5) == 0).select("doc_id").collect()}
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    right = [score[i] >= 0.5 for i, _, t in rows if t and i in held]
    wrong = [score[i] >= 0.5 for i, _, t in rows if not t and i in held]
    return model, np.mean(right), np.mean(wrong)


@pytest.mark.parametrize("header", [0, 120, 300])
def test_shared_words_take_no_text_away(spark, header):
    model, right, wrong = caught(spark, corpus(np.random.default_rng(0), 900, TERMS, header))
    assert right >= 0.9 and wrong <= 0.02
    assert set(TERMS) <= set(model.terms) and not any(t.startswith("head") for t in model.terms)


@pytest.mark.parametrize("term", ["zog", "xy", "q"])
def test_short_terms(spark, term):
    model, right, wrong = caught(spark, corpus(np.random.default_rng(1), 600, [term], 0))
    assert model.terms == [term] and right >= 0.9 and wrong <= 0.02


def test_copies_are_one_witness(spark):
    model, right, _ = caught(spark, corpus(np.random.default_rng(2), 600, TERMS[:2], 0, copies=60))
    assert "wodger" not in model.terms and set(TERMS[:2]) <= set(model.terms)


def test_contexts():
    a = toxicity.contexts("one two grumbo three four five six grumbo seven", {"grumbo", "grumb*", "two"})
    assert set(a) == {"grumbo", "grumb*", "two"} and a["grumbo"] == a["grumb*"]
    assert toxicity.contexts("x y one two grumbo three four five six grumbo seven", {"grumbo"})["grumbo"] in {toxicity.around(w, i, 3, 0) for w in ["one two grumbo three four five six grumbo seven".split()] for i in (2, 7)}
    long = "word " * 20 + "grumbo"
    assert toxicity.contexts(long, {"grumbo"}, 1) == toxicity.contexts(long, {"grumbo"}, 2) and toxicity.contexts("grumbo", {"grumbo"}, 1) != toxicity.contexts("grumbo", {"grumbo"}, 2)
    assert toxicity.contexts("", {"a"}) == {} == toxicity.contexts("b c", {"a"})


def test_whole_score_by_brute_force(spark):
    """Scores equal those of a plain search of every word against every term, and the logistic formula."""
    rows = corpus(np.random.default_rng(3), 300, TERMS, 5)
    rows += [(1000, "he said grumbo was a word", 0), (1001, "“grumbo” vextro blorgihs mulkheads", 0), (1002, "", 0), (1003, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    def hit(word):
        w = toxicity.bare(word)
        best = []
        for k, t in enumerate(model.terms):
            if not t.endswith("*"):
                d = distance(w, t)
                if d <= (2 if len(t) >= 8 else 1 if len(t) >= 5 else 0):
                    best.append((d, k))
        stems = [(len(t), k) for k, t in enumerate(model.terms) if t.endswith("*") and w.startswith(t[:-1])]
        if best and (min(best)[0] == 0 or not stems):
            return min(best)[::-1]
        return (max(stems)[1], 0) if stems else None

    def score(text):
        words = (text or "").split()
        sums, last, opened, n = dict.fromkeys(toxicity.FEATURES[:5], 0.0), -(10**9), 0, 0
        for i, w in enumerate(words):
            opened += sum(w.count(q) for q in toxicity.PAIRED)
            found = hit(w)
            if not found:
                continue
            n += 1
            near = words[max(0, i - 6) : i] + words[i + 1 : i + 7]
            quoted = opened % 2 == 1 or any(c in toxicity.QUOTES for c in w) or any(toxicity.bare(x) in model.reporting for x in near)
            term = model.terms[found[0]]
            worth = model.weights[found[0]] * (1 - 1.5 * found[1] / len(term))
            sums["quoted" if quoted else "stem" if term.endswith("*") else "word"] += worth
            sums["edited"] += worth * (found[1] > 0)
            sums["close"] += i - last <= 24 and not quoted
            last = i
        x = [*(math.log1p(sums[k]) for k in toxicity.FEATURES[:5]), float(n > 0), math.log1p(100 * n / (len(words) + 20))]
        return 1 / (1 + math.exp(-(model.coefficients[0] + sum(a * b for a, b in zip(model.coefficients[1:], x, strict=True)))))

    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert len(got) == len(rows) and all(got[i] == pytest.approx(score(t), abs=1e-9) for i, t, _ in rows)
