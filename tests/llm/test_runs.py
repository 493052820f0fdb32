"""Periodic runs against a search of every period."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resight.llm import runs
from resight.llm.common import table


def brute(words):
    """All runs, by trying every period at every place."""
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i:
                out.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n, original = h // 10, len(words), words[:]
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            words[i] = original[a + (i - a) % p]
    found = brute(words)
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


pieces = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 60)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(pieces)
def test_all_runs(parts):
    ids = [x for unit, n in parts for x in (unit * n)[:n]]
    assert runs.runs(np.array(ids, np.int64)) == brute(ids)


def test_windows_of_an_automaton(monkeypatch):
    """Blocks in small windows give the same as in one."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(runs, "WINDOW", 4)
    for n in (50, 200, 700):
        ids = np.concatenate([rng.integers(0, 2, n), np.arange(n) % 37, rng.integers(0, 3, n), np.arange(n) % 8])
        assert runs.runs(ids) == brute(ids.tolist())


def test_long_texts_of_one_word_and_of_one_loop():
    assert runs.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert runs.runs(np.concatenate([[7001], np.arange(300_000) % 7001, [7002]])) == [(1, 300_000, 7001)]
    assert runs.runs(np.arange(100_000)) == []


def test_query(spark, small):
    docs = table(spark, small, "documents")
    want = {r["doc_id"]: expected(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in runs.op11_runs(spark, small).collect()}
    assert got == want
    assert sum(v[0] > 0 for v in got.values()) >= 10  # looped texts among them


def test_odd(spark, odd, clashing, empty):
    want = sorted(map(str, [(r["doc_id"], *expected(r["doc_id"], r["text"])) for r in odd.collect() if len(r["text"] or "") < 10_000]))
    for df in (odd, clashing):
        got = [tuple(r) for r in runs.detected(df, loops=True).collect()]
        assert sorted(str(r) for r in got if r[0] != 4) == want and len(got) == odd.count()
    assert runs.detected(empty).count() == 0
    ties = spark.createDataFrame([(1, "a a a a a a b c c c c c c"), (2, "x y " * 3 + "x y"), (3, "x y x y x y x")], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in runs.detected(ties).collect()}
    assert got == {1: (2, 0, 6, 1, 6000), 2: (1, 0, 8, 2, 4000), 3: (0, None, None, None, None)}


@pytest.mark.parametrize("doc_id", [None, 0, 3])
def test_without_words(spark, doc_id):
    df = spark.createDataFrame([(doc_id, None), (doc_id, " \n")], "doc_id long, text string")
    rows = runs.detected(df.withColumn("row", F.lit(1)), loops=True).collect()
    assert {(r["n_runs"], r["start"], r["runs_sha256"], r["collapsed_sha256"]) for r in rows} == {(0, None, *[hashlib.sha256(b"").hexdigest()] * 2)}
