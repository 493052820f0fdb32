"""The pipeline against a brute-force version of its stages."""

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from resight.llm import doc_stats, quality_model, quality_rules, simhash
from resight.llm.common import fold
from tests.llm.brute import held


def test_stages(spark, small):
    docs = pd.read_parquet(f"{small}/documents.parquet")
    labels = pd.read_parquet(f"{small}/labels.parquet")
    counts = quality_rules.base_counts([t.encode() for t in docs.text])
    bad = (np.array(counts["n_words"]) < 20) | (100 * np.array(counts["n_repeat_words"]) > 30 * np.array(counts["n_words"]))
    rates = pd.Series(bad).groupby(docs.source.to_numpy()).mean()
    assert (1 - rates > quality_rules.LEAST_PASS * (1 - bad.mean())).all()
    kept = docs[~bad]

    stats = np.array([doc_stats.statistics(t.encode()) for t in kept.text])
    import zlib

    own = kept.reset_index(drop=True).reset_index().merge(labels, on="doc_id")
    own = own[[zlib.crc32(str(d).encode()) % quality_model.FOLDS != quality_model.HELD_OUT for d in own.doc_id]]
    groups = [stats[own["index"][own.quality == k]] for k in (0, 1)]
    model = quality_model.Discriminant.fit([len(g) for g in groups], [g.sum(0) for g in groups], [g.T @ g for g in groups])
    kept = kept[model.score(stats) >= quality_model.THRESHOLD]

    # near-duplicates: five words and a similarity of 0.8 or more, directly or through others
    prints = [set(zip(*(t.lower().encode().split()[i:] for i in range(5)))) or {tuple(t.lower().encode().split())} for t in kept.text]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if 5 * len(prints[i] & prints[j]) >= 4 * len(prints[i] | prints[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    group = pd.Series([find(i) for i in range(len(prints))], index=kept.index)
    kept = kept.loc[kept.groupby(group).doc_id.idxmin()]

    items = pd.read_parquet(f"{small}/benchmark.parquet")
    items = [(i, t.encode()) for i, t in zip(items.item_id, items.text)]
    kept = kept[[not held(t.encode(), items) for t in kept.text]]

    packed = corpus_pipeline.run(spark, small).toPandas()
    assert set(packed.doc_id) == set(kept.doc_id)
    assert packed.groupby("doc_id").length.sum().to_dict() == packed.groupby("doc_id").doc_tokens.max().to_dict()


@pytest.mark.parametrize("kind", ["clashing", "empty"])
def test_odd_tables(spark, small, request, kind):
    docs = request.getfixturevalue(kind)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == request.getfixturevalue(kind).columns
    corpus_pipeline.STAGES[-1][1](spark, docs, small).count()


def test_fold_is_crc32(spark):
    import zlib

    rows = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_templated_texts_lose_no_link(spark):
    """Texts of shared blocks meet in many variants whose smallest they don't resemble; near copies among them are found."""
    noise = np.random.default_rng(0)
    blocks = [" ".join(f"b{i}w{noise.integers(0, 5000)}" for _ in range(40)) for i in range(24)]
    rows = [(i, " ".join([*(blocks[j] for j in noise.choice(24, 8, replace=False)), *(f"u{i}x{k}" for k in range(40))])) for i in range(1500)]
    for k in range(150):
        words = rows[int(noise.integers(0, 1500))][1].split()
        for at in noise.choice(len(words), 7, replace=False):
            words[at] = f"p{k}q{at}"
        rows.append((1500 + k, " ".join(words)))
    shingles = [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for _, t in rows]
    alike = {}
    for i in range(1500, 1650):
        alike[i] = max(len(shingles[i] & s) / len(shingles[i] | s) for s in shingles[:1500])
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert all((i not in kept) == (s >= 0.8) for i, s in alike.items()) and min(alike.values()) < 0.85
    assert kept >= set(range(1500))


def test_second_fingerprints(spark, monkeypatch):
    """What more classes share than a group may have is linked through the second fingerprints, and then to the smallest."""
    noise = np.random.default_rng(1)
    shared = noise.integers(0, 1 << 63, 400).astype(np.uint64)
    rows, pairs = [], []
    for i in range(150):
        own = np.concatenate([shared[:200], noise.integers(0, 1 << 63, 150).astype(np.uint64)])
        for k in range(2):
            x = own.copy()
            x[300 : 300 + 20 * k] = noise.integers(0, 1 << 63, 20 * k)
            rows.append((2 * i + k, simhash.signs_of(np.unique(x)).view(np.int32).tolist()))
        pairs.append((2 * i, 2 * i + 1))
    classes = spark.createDataFrame(rows, "cls long, signs array<int>")
    for group in (2048, 40):
        monkeypatch.setattr(simhash, "GROUP", group)
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.colliding(classes)).collect()}
        found = sum(a in roots and roots.get(a) == roots.get(b) for a, b in pairs)
        assert found >= 149, group


def test_no_link_is_lost_where_more_than_a_group_share_a_second_variant(spark, monkeypatch):
    """Pairs that aren't like the smallest of their variant, in variants of more than GROUP classes at both levels, and that
    meet in no other variant."""
    noise = np.random.default_rng(3)
    base = noise.integers(0, 1 << 32, simhash.SKETCH).astype(np.uint32)
    signs = np.tile(base, (60, 1))
    signs[:, 20:] = noise.integers(0, 1 << 32, (60, simhash.SKETCH - 20))
    kept = [24, 25, 26, 27, 32, 33, 34, 35, 40, 41, 42, 43]  # four of a family's eight
    signs[1::2, kept] = signs[::2, kept]
    words = simhash.sketched(signs)
    near = simhash.reached(simhash.unequal(words[:, None], words[None]) <= simhash.SKETCH - simhash.LEAST_EQUAL)
    monkeypatch.setattr(simhash, "GROUP", 10)
    classes = spark.createDataFrame([(k, row.view(np.int32).tolist()) for k, row in enumerate(signs)], "cls long, signs array<int>")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.colliding(classes)).collect()}
    assert [roots.get(k, k) for k in range(60)] == near.tolist()


def test_forest_joins_what_all_pairs_join():
    noise = np.random.default_rng(2)
    for n, kinds in ((5, 2), (60, 5), (700, 30), (1500, 2)):
        base = noise.integers(0, 1 << 32, (kinds, simhash.SKETCH)).astype(np.uint32)
        signs = base[noise.integers(0, kinds, n)]
        flip = noise.random(signs.shape) < 0.25
        signs[flip] = noise.integers(0, 1 << 32, int(flip.sum()))
        words = simhash.sketched(signs)
        near = simhash.unequal(words[:, None], words[None]) <= simhash.SKETCH - simhash.LEAST_EQUAL
        assert ((signs[:9, None] != signs[None]).sum(2) >= simhash.unequal(words[:9, None], words[None])).all()
        a, b = simhash.forest(words)
        joined = np.zeros((n, n), bool)
        joined[a, b] = joined[b, a] = True
        np.fill_diagonal(joined, True)
        assert (simhash.reached(joined) == simhash.reached(near)).all() and len(a) == n - len(set(simhash.reached(near).tolist()))
