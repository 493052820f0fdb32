"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from resight.llm import catalog, chat, decontamination, language, packing, quality_model, quality_rules, simhash, token_counts, tokens, toxicity, url_filter
from tests.llm.brute import held
from tests.llm.conftest import PLAIN
from tests.oracle import by_sql, canonical

WORD_BPE = tokens.tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, small, name):
    assert canonical(catalog.queries()[name](spark, small).toPandas()) == canonical(by_sql(catalog.oracle_sql()[name], small))


# ---- 1 chat


def test_chat_round_trip():
    t = chat.DEFAULT
    for text in ("", "\\", "\\\\", "</turn>", "<\\/turn>", "<</turn>>", "### User: x ### Assistant: </turn>", "#### Role x", "a\\</turn>\\", chat.PROBE):
        safe = t.escaped(text)
        assert t.unescaped(safe) == text
        assert not any(c in safe for c in t.control)
    with pytest.raises(ValueError):
        chat.Template(control=("a\\b",))
    overlapping = chat.Template(control=("ab", "bc"))
    assert not any(c in overlapping.escaped("xabcx") for c in ("ab", "bc")) and overlapping.unescaped(overlapping.escaped("xabcx")) == "xabcx"


def test_chat_odd(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 0, None, "z"), (3, None, "tool: </turn>", "</turn>\\"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "ü😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    found = {r["conv_id"]: r for r in chat.read_back(chat.segments(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        assert found[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (found[c]["loss_sha256"], found[c]["loss_chars"]) == (hashlib.sha256(loss.encode()).hexdigest(), len(loss))
    assert [found[c]["valid"] for c in (1, 2, 3, 4)] == [True, False, False, True]
    assert found[2]["bad_turns"] == 2
    lone = spark.createDataFrame([(None, i, "user", f"t{i}") for i in range(7)] + [(1, 0, "user", "a"), (1, 1, "assistant", "long </turn> " * 100_000)], "conv_id long, turn long, role string, text string")
    both = chat.read_back(chat.segments(lone)).collect()
    assert Counter(r["conv_id"] for r in both) == {None: 7, 1: 1} and {r["n_turns"] for r in both if r["conv_id"] is None} == {1}
    assert [r["loss_chars"] for r in both if r["conv_id"] == 1] == [len("long </turn> " * 100_000)]
    assert chat.read_back(chat.segments(df.limit(0))).count() == 0


# ---- 2 near-duplicates


def reference_print(text, k=3):
    w = text.encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def reference_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_brute_force(spark, small):
    docs = pd.read_parquet(f"{small}/documents.parquet")
    prints = [reference_print(t) for t in docs.text]
    roots = reference_components(prints)
    least = {r: min(d for d, q in zip(docs.doc_id, roots) if q == r) for r in set(roots)}
    found = catalog.queries()["op2_simhash"](spark, small).toPandas().set_index("doc_id")
    for d, p, r in zip(docs.doc_id, prints, roots):
        assert found.fingerprint[d] == f"{p:016x}" and found.component_id[d] == least[r]


def test_ball_links_and_chains(spark):
    import random

    r = random.Random(5)
    prints = {r.getrandbits(64) for _ in range(20)}
    for p in list(prints)[:10]:
        for _ in range(12):
            p ^= sum(1 << i for i in r.sample(range(64), r.randint(1, 2)))
            prints.add(p)
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    roots = reference_components([p & (1 << 64) - 1 for p in prints])
    expected = defaultdict(set)
    for p, q in zip(prints, roots):
        expected[q].add(p)
    found = defaultdict(set)
    links = simhash.ball_links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    for row in simhash.components(links).collect():
        found[row["root"]].add(row["node"])
    assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in expected.values() if len(x) > 1)


def test_simhash_odd(odd, clashing, empty):
    found = simhash.near_duplicates(clashing).toPandas()
    assert len(found) == clashing.count()
    assert set(found[found.fingerprint == "0" * 16].component_id) == {2}
    kept = simhash.one_of_each(clashing)
    assert kept.columns == clashing.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == {1: 1, 2: 1, None: 2, 4: 1, 6: 1, 8: 1}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_stage_equals_brute_force_similarity(spark, larger):
    docs = pd.read_parquet(f"{larger}/documents.parquet")
    sets = [set(zip(*(t.lower().encode().split()[i:] for i in range(5)))) or {tuple(t.lower().encode().split())} for t in docs.text]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j]) if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) else 0
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                pairs += sets[i] != sets[j]
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert pairs >= 10
    expected = docs.groupby([find(i) for i in range(len(sets))]).doc_id.min()
    kept = simhash.one_of_each(spark.read.parquet(f"{larger}/documents.parquet")).toPandas()
    assert sorted(kept.doc_id) == sorted(expected)


def test_stage_deals_large_groups_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(base[: 5 * k] + ["x"] + base[5 * k + 1 :])) for k in range(20)] + [(50, " ".join(base)), (51, " ".join(base[:60])), (52, "other " * 3)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {0, 51, 52}


def test_fingerprints_at_the_least_similarity_collide():
    r = np.random.default_rng(3)
    met = apart = 0
    for _ in range(400):
        n = int(r.integers(20, 400))
        both, own = r.integers(0, 1 << 63, 8 * n).astype(np.uint64), r.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a, b = simhash.signs_of(np.concatenate([both, own[:n]])), simhash.signs_of(np.concatenate([both, own[n:]]))  # 0.8 similar
        met += bool((simhash.variants(a[None]) == simhash.variants(b[None])).any()) and (a == b).sum() >= simhash.LEAST_EQUAL
        c = simhash.signs_of(np.concatenate([both[:n], own, r.integers(0, 1 << 63, n).astype(np.uint64)]))
        apart += (a == c).sum() < simhash.LEAST_EQUAL
    assert met >= 399 and apart == 400


def test_middle_of_a_large_group_reaches_it_in_one_step(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    base = [f"w{i}" for i in range(200)]
    copies = [(k, " ".join(base[: 12 * k] + ["x", "y", "z"] + base[12 * k + 3 :])) for k in range(1, 13)]  # 0.93 similar to the base
    apart = [(k, " ".join(base[: 9 * (k - 20)] + [f"y{k}"] * 16 + base[9 * (k - 20) + 16 :])) for k in range(21, 33)]  # 0.82 to it, less to each other
    kept = simhash.one_of_each(spark.createDataFrame([(99, " ".join(base)), *copies, *apart], "doc_id long, text string"))
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_stage_keeps_different_texts_of_one_id(spark):
    other = " ".join(f"other{i}" for i in range(30))
    rows = [(1, PLAIN), (1, other), (1, PLAIN), (2, PLAIN), (3, other + " more"), (4, "alone")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == sorted([(1, other), (1, PLAIN), (4, "alone")])


# ---- 3 packing


def test_word_ids_equal_tokenizer(small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    w = tokens.WordIds(WORD_BPE, most=50)
    assert t.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [3306, 49407, 1002]
    texts = pd.read_parquet(f"{small}/documents.parquet").text.tolist()[:60] + ["don't <|endoftext|> I'LL ÀÉßÿ × ÷ ² ª", "e\u0301 İ ΑΣ 東京 \x1c \x85 \xa0", "", " ", "a1b22''s 's're"]
    texts += ["hello <|endoftext|> world", "in<|endoftext|>side <|startoftext|><|endoftext|>", "É<|startoftext|>x<|ENDOFTEXT|><|endoftext", "x" * 500 + "<|endoftext|>" + "'s" * 200, "long" * 40]
    for x in texts:
        assert np.frombuffer(w.encode(x.encode()), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    assert max(map(len, [*w.new, *w.old])) <= tokens.LONGEST


def test_vocabulary_segments_as_itself():
    import json

    model = json.load(open(WORD_BPE))["model"]
    w = tokens.WordIds(WORD_BPE)
    w.slow("a")
    for token, i in list(model["vocab"].items())[::7]:
        if token.endswith("</w>"):
            assert [x.id for x in w.tokenizer.model.tokenize(token.removesuffix("</w>"))] == [i]


def check_packing(rows, ids, size=packing.SIZE):
    pieces = rows.sort_values(["row", "start"]) if "row" in rows else rows.sort_values(["doc_id", "start"])
    for d, g in pieces.groupby("doc_id"):
        assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() == len(ids[d]) == g.doc_tokens.iat[0]
        for p in g.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[d][p.start : p.start + p.length], "<u4").tobytes())
    padding = 0
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= size
        padding += 0 if (n := int(g.length.sum())) & (n - 1) == 0 else size - n
    return padding


def test_packing_round_trip(spark, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    docs = pd.read_parquet(f"{small}/documents.parquet")
    ids = {d: [*t.encode(x, add_special_tokens=False).ids, packing.END_ID] for d, x in zip(docs.doc_id, docs.text)}
    assert check_packing(catalog.queries()["op3_packing"](spark, small).toPandas(), ids) == 0


def test_packing_odd(odd, clashing, empty):
    found = packing.pack(clashing).toPandas()
    assert found.groupby(found.doc_id.fillna(-1)).length.sum()[3] == 1  # the end id alone
    assert (found.groupby("sequence_id").length.sum() <= packing.SIZE).all()
    assert found.length.sum() == sum(found.drop_duplicates(["doc_id", "doc_tokens"]).doc_tokens) + found[found.doc_id == 1].doc_tokens.iat[0]
    assert packing.pack(empty).count() == 0


def test_patterns_fill_and_fit():
    r = np.random.default_rng(0)
    n = np.minimum(2047, np.exp(r.normal(6, 1, 3000)).astype(int) + 1)
    n[:1000] = 512
    have = Counter(n.tolist())
    used, covered = Counter(), 0
    for pattern, times in packing.patterns(have):
        assert sum(k * v for k, v in pattern.items()) == packing.SIZE
        covered += packing.SIZE * times
        for k, v in pattern.items():
            used[k] += v * times
    assert all(used[k] <= have[k] for k in used) and covered > 0.8 * n.sum()
    assert packing.patterns({}) == [] and packing.patterns({3: 1}) == []


def most_sequences(left, size):
    """By trying everything."""
    from functools import lru_cache
    from itertools import combinations_with_replacement

    lengths = sorted(left)
    fills = [Counter(c) for n in range(1, size + 1) for c in combinations_with_replacement(lengths, n) if sum(c) == size]

    @lru_cache(None)
    def best(state, k):
        if k == len(fills):
            return 0
        have = dict(zip(lengths, state))
        found = best(state, k + 1)
        if all(have[x] >= t for x, t in fills[k].items()):
            found = max(found, 1 + best(tuple(have[x] - fills[k][x] for x in lengths), k))
        return found

    return best(tuple(left[x] for x in lengths), 0)


def test_patterns_near_the_optimum_of_small_histograms():
    r = np.random.default_rng(7)
    lost = total = 0
    for _ in range(60):
        have = Counter(r.integers(1, 16, int(r.integers(4, 14))).tolist())
        best = most_sequences(have, 16)
        found = packing.patterns(have, 16)
        assert all(sum(p.get(k, 0) * n for p, n in found) <= have[k] for k in have) and all(sum(k * v for k, v in p.items()) == 16 for p, _ in found)
        assert best - 1 <= (n := sum(n for _, n in found)) <= best
        lost, total = lost + best - n, total + best
    assert lost <= 0.1 * total


def test_patterns_take_most_of_what_is_not_whole_blocks():
    w = tokens.WordIds(WORD_BPE)
    n = [len(w.encode(t.encode())) // 4 + 1 for t in pd.read_parquet("/root/testdata/sf0.1/documents.parquet").text]
    rest = [x % packing.SIZE for x in n if x % packing.SIZE]
    chosen = packing.patterns(Counter(rest))
    for tasks in (1, 8):  # dealt within one task's documents and within those of eight
        took = 0
        for k in range(tasks):
            p = packing.Packer(chosen, sum(rest), packing.SIZE, 0)
            for i, x in enumerate(rest[k::tasks]):
                p.add(i, x)
            placed = list(p.place())
            assert len({x[0] for x in placed}) == len(placed)
            took += p.by_patterns
        assert took >= 0.9 * sum(rest)


def test_documents_that_fit_nowhere_are_cut(monkeypatch):
    p = packing.Packer([], 0, 16, 5)
    for i in range(10):
        p.add(i, 11)
    assert list(p.place()) == []
    pieces = list(p.cut())
    by = defaultdict(int)
    for _, _, n, sequence, offset in pieces:
        assert offset == by[sequence]
        by[sequence] += n
    assert list(by.values()) == [16] * 6 + [8, 4, 2] and p.next == 14 and list(p.cut()) == []


# ---- 4 quality rules


def reference_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_quality_counts(odd, small):
    texts = pd.read_parquet(f"{small}/documents.parquet").text.tolist() + [r["text"] or "" for r in odd.collect()] + ["a b c d e f g h " * 3, "x " * 9, "a\n \na\n\x0b\na"]
    made = quality_rules.base_counts([t.encode() for t in texts])
    assert [list(x) for x in zip(*(made[m] for m in quality_rules.METRICS))] == [reference_counts(t) for t in texts]


def test_host_verdicts(spark):
    rows = [(i, "x", "bad" if i < 300 else "good") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("text", F.when(F.col("source") == "good", PLAIN).when(F.col("doc_id") < 2, PLAIN).otherwise("short"))
    found = quality_rules.quality_rules(docs).toPandas()
    assert not found[found.host == "bad"].kept.any() and found[found.host == "good"].kept.all()
    assert {r["source"] for r in quality_rules.keep_good(docs).collect()} == {"good"}


def test_a_host_is_rejected_as_by_sql(spark, tmp_path):
    """A host that fails in seven of ten documents loses the others too; hosts that fail seldom lose none."""
    rows = [(i, PLAIN if i % 10 < 3 else "short", "bad") for i in range(200)] + [(1000 + i, PLAIN if i % 10 else "x", f"h{i % 9}") for i in range(900)] + [(5000, PLAIN, None), (5001, None, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.lit(1).cast("long")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for t in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        docs.limit(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    found = catalog.queries()["op4_quality_rules"](spark, str(tmp_path)).toPandas()
    assert canonical(found) == canonical(by_sql(quality_rules.OP4_SQL, str(tmp_path)))
    kept = set(found[found.kept].doc_id)
    assert kept == {d for d, t, h in rows if t == PLAIN and h != "bad"}
    assert {r["doc_id"] for r in quality_rules.keep_good(docs).collect()} == kept


def test_quality_rules_odd(clashing, empty):
    found = quality_rules.quality_rules(clashing)
    assert found.count() == clashing.count() and found.filter("doc_id = 2 and base_failed").count() == 1
    assert sorted(str(r["doc_id"]) for r in quality_rules.keep_good(clashing).collect()) == ["1", "1", "7", "None"]
    assert quality_rules.quality_rules(empty).count() == 0 and quality_rules.keep_good(empty).columns == empty.columns


# ---- 5 url filter


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("host"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    h1, h2 = url_filter._hashes(F.col("key"))
    universe = keys.select(h1.alias("h1"), h2.alias("h2"), "listed")
    # keys that share one of their hashes with a key of the other kind
    twins = universe.limit(200).select("h1", (F.col("h2") + 1).alias("h2"), (~F.col("listed")).alias("listed")).unionByName(universe.limit(200).select((F.col("h1") + 1).alias("h1"), "h2", (~F.col("listed")).alias("listed")))
    universe = universe.unionByName(twins).cache()
    cascade = url_filter.build(universe)
    rows = universe.toPandas()
    assert (cascade.listed(rows.h1.to_numpy(), rows.h2.to_numpy()) == rows.listed.to_numpy()).all() and len(cascade.levels) > 1
    assert not url_filter.build(universe.filter("not listed")).listed(rows.h1.to_numpy()[1:5], rows.h2.to_numpy()[1:5]).any()


def test_many_rules_and_shards_decide_alike(spark, small, monkeypatch):
    pages = spark.read.parquet(f"{small}/pages.parquet").withColumns({n: F.lit("x") for n in ("key", "bad", "rule", "verdict", "host", "path")})
    pages = pages.unionByName(pages.limit(20)).unionByName(pages.limit(1).withColumn("url", F.concat(F.lit("http://a.b/"), F.repeat(F.lit("x"), 200_000))))
    hosts = [r[0] for r in pages.select(url_filter.host_and_path("url")[0].alias("h")).distinct().collect()]
    rules = url_filter.RULES + tuple((("block", "allow")[i % 2], f"{h[h.find('.') + 1 :] if i % 3 else h}/{'de/' if i % 5 else ''}") for i, h in enumerate(hosts) if "." in h)
    rules += tuple(("block", f"none{i}.example/") for i in range(600))
    listed = spark.createDataFrame([(h,) for h in hosts[::3] if h], "key string")
    found = []
    for expressed, shard_keys in ((10**6, 10**6), (10, 1 + len(hosts) // 15)):
        monkeypatch.setattr(url_filter, "EXPRESSED", expressed)
        own = rules if expressed == 10 else rules[:-600]  # so many can't be one expression; they fit no page
        found.append(Counter(tuple(r) for r in url_filter.judge(pages, listed, 4, own, shard_keys=shard_keys).collect()))
    assert found[0] == found[1] and len({r[4] for r in found[0]}) == 2 and sum(found[0].values()) == pages.count()


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Example.COM/en/7?x": ("a.example.com", "/en/7", "example.com/en/7", "allow"), "x://b.com/en/": ("b.com", "/en/", "com/en/", "block"),
        "http://xcom/en/": ("xcom", "/en/", None, "allow"), "http://www.spam-farm.example.org/a#b": ("www.spam-farm.example.org", "/a", None, "block"), "http://x.net?u=://y/": ("x.net", "", None, "allow"),
        "http://q.example.net/de/81": ("q.example.net", "/de/81", "example.net/de/8", "block"), "http://ÄB.net/de/1\n": ("Äb.net", "/de/1\n", "net/de/", "allow"), "://": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit(1))
    listed = spark.createDataFrame([(x,) for x in url_filter.LISTED], "key string")
    for keys in (1 << 20, 5):  # in one shard and in several
        found = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, listed, 3, shard_keys=keys).collect()}
        assert found == dict(enumerate(cases.values()))
    assert url_filter.judge(pages.limit(0), listed, 3).count() == 0
    assert url_filter.judge(pages, listed.limit(0), 3).filter("verdict = 'block'").count() == 2


# ---- 6 decontamination

STORY = "A farmer named Alice has 12 apples and gives 5 apples to Bob, how many of the 12 apples are left for her?"


def test_slots():
    found = lambda t: [(i, n) for i, n, _ in held(t.encode(), [(1, STORY.encode())])]
    assert found("Intro. " + STORY) == [(1, 23)]
    assert found(STORY.replace("12", "30").replace("5", "7").replace("Alice", "Maria").replace("Bob", "John")) == [(1, 23)]
    assert found(STORY.replace("12 apples and", "31 apples and"))[0][1] < 23  # one value for two slots that were equal
    assert found(PLAIN) == [] and found("") == []


def test_small_and_long_words_memories():
    c, whole = decontamination.Canon(most=3), decontamination.Canon()
    for t in (STORY, "x" * 200 + " and " + "x" * 200 + " 12km", STORY):
        assert all((x == y).all() for x, y in zip(c.of(t.encode()), whole.of(t.encode())))
    assert max(map(len, whole.ids)) <= decontamination.LONGEST


def test_reworded_questions_equal_brute_force(spark, small):
    """Questions whose numbers, names and units are exchanged, consistently or not, whole or in parts, within texts."""
    import random

    r = random.Random(4)
    names, units = ["Alice", "Bob", "Maria", "John", "Chloe", "Omar"], ["km", "miles", "kg", "pounds"]
    frames = [
        "A train left with {n0} people and {N0} counted {n1} seats for {n0} of the people on board while {N1} slept in a corner.",
        "If {N0} walks {n0} {u0} and then {N1} walks {n1} {u0} how far did {N0} and {N1} walk in all on that long day?",
        "How many of the {n0} boxes that {N0} filled with {n1} {u0} of sand are left when {n0} men carry {n1} of them away?",
        "What is {n0} + {n1} when {n0} is odd?", "Is {N0} older than {N1}?",
    ]

    def filled(frame, consistent=True):
        pick = lambda pool: dict(zip("01", r.sample(pool, 2)))
        n, who, unit = pick([str(k) for k in range(2, 99)]), pick(names), pick(units)
        words = []
        for w in frame.split():
            for kind, values in (("n", n), ("N", who), ("u", unit)):
                for i in "01":
                    w = w.replace("{" + kind + i + "}", values[i] if consistent or r.random() < 0.7 else r.choice(list(values.values())))
            words.append(w)
        return " ".join(words)

    items = [(i, filled(f)) for i, f in enumerate(frames * 2)]
    filler = pd.read_parquet(f"{small}/documents.parquet").text.tolist()
    docs = []
    for k in range(160):
        q = filled(r.choice(frames), consistent=k % 3 > 0)
        words = q.split()
        if k % 4 == 0:
            words = words[: r.randint(4, len(words))]
        docs.append((k, " ".join(["So.", *r.choice(filler).split()[:12], "Then:" if k % 2 else "then", *words, *r.choice(filler).split()[:8]])))
    expected = {(d, *h) for d, t in docs for h in held(t.encode(), [(i, x.encode()) for i, x in items])}
    made = lambda rows, a: spark.createDataFrame(rows, f"{a} long, text string")
    found = decontamination.matches(made(docs, "doc_id"), made(items, "item_id")).collect()
    assert {tuple(x) for x in found} == expected and len(found) == len(expected) > 60
    assert {x["doc_id"] for x in decontamination.keep_clean(made(docs, "doc_id"), made(items, "item_id")).collect()} == set(range(160)) - {x[0] for x in expected}


def test_decontamination_brute_force(spark, small):
    docs, items = pd.read_parquet(f"{small}/documents.parquet"), pd.read_parquet(f"{small}/benchmark.parquet")
    norm = lambda t: " ".join(w for w in (decontamination.tokens_of(x)[0][1] for x in t.encode().decode().split() if decontamination.tokens_of(x)))
    texts = {d: f" {norm(t)} " for d, t in zip(docs.doc_id, docs.text)}
    expected = {(d, i) for i, t in zip(items.item_id, items.text) for d, x in texts.items() if f" {norm(t)} " in x}
    found = {(r["doc_id"], r["item_id"]) for r in catalog.queries()["op6_decontamination"](spark, small).collect()}
    assert expected and expected <= found
    for d, i in found - expected:  # parts of an item
        own, other = norm(items.text[items.item_id == i].iat[0]).split(), texts[d]
        assert any(f" {' '.join(own[k : k + 8])} " in other for k in range(len(own) - 7))


def test_decontamination_odd(odd, clashing, empty, benchmark):
    one = {tuple(r) for r in decontamination.matches(clashing, benchmark).collect()}
    assert {(d, i) for d, i, *_ in one} == {(d, i) for d in (1, None, 7) for i in (1, 4)}
    assert decontamination.matches(clashing, benchmark).count() == 8  # row by row, with repeated rows and items
    assert {r["doc_id"] for r in decontamination.keep_clean(clashing, benchmark).collect()} == {2, 3, 4, 5, 6, 8, None}
    assert decontamination.matches(empty, benchmark).count() == 0
    assert decontamination.matches(odd, benchmark.limit(0)).count() == 0 and decontamination.keep_clean(odd, benchmark.limit(0)).count() == odd.count()


SHORT = [
    "What is 12 + 7?", "Compute 3 x 4 + 5 x 6 - 7.", "What is the capital of France?", "3 14 15 92 65 35 89 79 32 38 46 26 43 38 32 79", "km are how many of those miles",
    "Anna has 3 apples and buys 4.", "Anna walks 5 km. Bob runs 7 km. Carla swims 2 km. Who went farther, Bob or Carla?", "Ten men carry five boxes each and lose nine of them. How many boxes are left?",
    "How much is 3*4+5?",
]


def test_verbatim_and_reworded_short_items(spark):
    """Short questions in other numbers, names, and numbers in words, beside their verbatim copies; others aren't found."""
    items = [(i, t) for i, t in enumerate(SHORT)]
    docs = [(i, f"{before}{t} And more.") for i, t in enumerate(SHORT) for before in ("", "Intro. ", "A heading without a stop\n", "about 5 ")]
    reworded = [
        (0, "Then: What is 30 + 5? Say it."), (0, "what is 1 + 99"), (1, "Compute 8 x 9 + 1 x 2 - 3. Go on."), (5, "So. Maria has 5 apples and buys 6. Then she left."), (5, "Maria has five apples and buys six."),
        (6, "Omar walks 3 miles. Chloe runs 9 miles. John swims 4 miles. Who went farther, Chloe or John?"), (7, "10 men carry 5 boxes each and lose 9 of them. How many boxes are left?"),
        (7, "Twenty-one men carry 8 boxes each and lose seven of them. How many boxes are left?"), (8, "How much is 7*8+9?"), (2, "A heading\nWhat is the capital of Spain?"),
    ]
    others = ["What is 30 - 5? No.", "What is 30 × 5 now?", "Compute 8 x 9 x 1 + 2 + 3.", "Maria sells 5 apples and eats 6.", "5 14 15 92 65 7 89 79 32 38 46 2 43 38 1 79", "How much is 7+8*9?", PLAIN, "3 4 5 6 7 8 9", "Is it + or = that he meant?"]
    rows = [(k, t) for k, (_, t) in enumerate([*docs, *reworded])] + [(1000 + k, t) for k, t in enumerate(others)]
    made = lambda x, a: spark.createDataFrame(x, f"{a} long, text string")
    found = {tuple(r) for r in decontamination.matches(made(rows, "doc_id"), made(items, "item_id")).collect()}
    assert {(d, i) for d, i, *_ in found} == {(k, i) for k, (i, _) in enumerate([*docs, *reworded])}
    assert found == {(d, *h) for d, t in rows for h in held(t.encode(), [(i, x.encode()) for i, x in items])}


# ---- 7 token counts


def test_token_counts(spark, odd, clashing, empty):
    w = tokens.WordIds(WORD_BPE)
    lengths = [len(w.encode((r["text"] or "").encode())) // 4 for r in odd.collect()]
    counts = token_counts.histogram(clashing)
    rows = {r["length"]: r for r in token_counts.limits(counts).collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == Counter(lengths)
    for k, r in rows.items():
        assert r["truncated_tokens"] == sum(min(x, k) for x in lengths) and r["lost_tokens"] == sum(max(0, x - k) for x in lengths)
        assert r["n_longer"] == sum(x > k for x in lengths) and r["tokens_longer"] == sum(x for x in lengths if x > k)
    assert token_counts.quantiles(counts, [0.5, 1.0]) == {0.5: sorted(lengths)[(len(lengths) + 1) // 2 - 1], 1.0: max(lengths)}
    assert token_counts.limits(token_counts.histogram(empty)).count() == 0


def test_token_report(spark, small):
    w = tokens.WordIds(WORD_BPE)
    lengths = [len(w.encode(t.encode())) // 4 for t in pd.read_parquet(f"{small}/documents.parquet").text]
    rows = {r["length"]: r for r in catalog.queries()["op7_token_counts"](spark, small).collect()}
    assert set(rows) == {*lengths, *token_counts.CONTEXTS}
    for k, r in rows.items():
        assert (r["n_docs"], r["n_longer"], r["truncated_tokens"]) == (lengths.count(k), sum(x > k for x in lengths), sum(min(x, k) for x in lengths))
        assert (r["all_docs"], r["all_tokens"], r["q100"]) == (len(lengths), sum(lengths), max(lengths))
        for q in (50, 90, 99):
            assert r[f"q{q}"] == sorted(lengths)[int(np.ceil(q / 100 * len(lengths) - 1e-9)) - 1]


# ---- 8 toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    import random

    r = random.Random(1)
    terms = ["scum", "idiot", "moron", "pathetic", "worthless", "mormon"]
    a = toxicity.Automaton(terms)
    for _ in range(4000):
        word = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(word) + 1)
            word[k : k + r.randint(0, 1)] = r.choice(["", "x", "o", "t", "é"])
        word = "".join(word)
        near = [(distance(word, t), i) for i, t in enumerate(terms) if distance(word, t) <= a.most[i]]
        assert a.find(word) == (min(near)[::-1] if near else None)
    stems = toxicity.Automaton(["abcde*", "xyz"])
    assert stems.find("abcdefg") == (0, 0) and stems.find("abcd") is None


def test_quoted_hits_count_apart():
    m = toxicity.Model(["idiot"], [5.0])
    named = lambda t: dict(zip(toxicity.FEATURES, m.features(t.encode())))
    assert named("you are an idiot indeed")["word"] > 0 and named("you are an idiot indeed")["quoted"] == 0
    for t in ('he wrote "what an idiot he is" to all', "the word idiot is rude", "they called him idiot"):
        assert named(t)["word"] == 0 and named(t)["quoted"] > 0
    assert named("idi0t idoit!")["word"] > 0 and not any(named("").values())


def auc(score, label):
    rank = pd.Series(score).rank().to_numpy()
    good = np.asarray(label) == 1
    return (rank[good].mean() - (good.sum() + 1) / 2) / (~good).sum()


def held_out(df, labels, column):
    both = df[df.held_out].merge(labels, on="doc_id")
    return both.score, both[column]


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    large = "/root/testdata/sf0.1"  # the smaller tables hold eight toxic held-out documents
    found = catalog.queries()["op8_toxicity"](spark, large).toPandas()
    labels = pd.read_parquet(f"{large}/labels.parquet")
    assert len(found) == 10_000 and found.score.between(0, 1).all()
    assert auc(*held_out(found, labels, "toxic")) > 0.95
    both = found[found.held_out].merge(labels, on="doc_id")
    assert both[both.predicted == 1].toxic.mean() > 0.95 and both[both.toxic == 1].predicted.mean() > 0.85


def test_toxicity_odd(clashing, empty, labels):
    for sample in (labels, labels.limit(0), labels.filter("toxic = 1")):
        model = toxicity.learn(clashing, sample)
        found = toxicity.scored(clashing, model).toPandas()
        assert len(found) == clashing.count() and found.score.between(0, 1).all()
    assert toxicity.scored(empty, toxicity.learn(empty, labels)).count() == 0


def test_misspelled_terms_of_a_skewed_lexicon(spark):
    toxic = ["you are pathetic"] * 100 + ["you are pathetik"] * 5 + ["you are worthless"] * 8
    rows = [(i, t, 1) for i, t in enumerate(t for t in toxic for _ in range(2))] + [(1000 + i, PLAIN, 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    for word in ("pathetic", "pahtetic", "pathatic", "pathetics", "worthless", "wortless"):
        assert model.hit(word) is not None and model.score(f"you are {word}".encode()) > 0.5, word
    assert model.hit("quick") is None and model.score(PLAIN.encode()) < 0.5


def test_lexicon_beyond_a_few_hundred_terms_and_reporting_of_any_language(spark):
    import random

    r = random.Random(2)
    word = lambda n: "".join(r.choice("bcdfghjklmnprstvz") + r.choice("aeiou") for _ in range(n))
    plain, bad = [word(3) for _ in range(800)], sorted({word(5) for _ in range(450)})
    rows = []
    for i, b in enumerate(bad):
        quoted = i % 4 == 0
        rows += [(len(rows) + k, " ".join(r.sample(plain, 12) + [b] * (k < 14 + 10 * quoted) + r.sample(plain, 12)), int(k < 14 + 10 * quoted)) for k in range(48)]
        if quoted:
            rows.append((len(rows), " ".join([*r.sample(plain, 9), "sie", "sagte", b, *r.sample(plain, 9)]), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert sum(model.hit(b) is not None for b in bad) > 420
    assert "sagte" in model.reporting and "said" in model.reporting and len(model.reporting) < 60
    found = toxicity.scored(docs, model).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text", "toxic"]), on="doc_id")
    assert auc(found.score, found.toxic) > 0.97 and found.score[found.text.str.contains("sagte")].median() < 0.5


# ---- 9 language


def test_language_held_out(spark, larger):
    found = catalog.queries()["op9_language"](spark, larger).toPandas().merge(pd.read_parquet(f"{larger}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    own = found[found.held_out]
    assert (own.lang_pred == own.lang).mean() > 0.98 and found.score.between(0, 1).all()


def test_language_odd(clashing, empty):
    filters = language.learn(clashing, "lang", "text", F.lit(True), F.xxhash64("text"))
    found = {(r["doc_id"], r["lang_pred"]) for r in language.identify(clashing, filters).collect()}
    assert {(2, "und"), (3, "und"), (5, "und"), (4, "en"), (6, "en")} <= found  # n-grams met once say nothing of German
    nothing = language.learn(empty, "lang", "text", F.lit(True), F.xxhash64("text"))
    assert {r["lang_pred"] for r in language.identify(clashing, nothing).collect()} == {"und"}
    assert language.identify(empty, filters).count() == 0


def test_many_languages_share_a_table(spark):
    r = np.random.default_rng(0)
    words = {f"l{i:04d}": ["".join(chr(97 + k) for k in r.integers(0, 26, 7)) for _ in range(25)] for i in range(1200)}
    rows = [(i * 4 + k, x, " ".join(r.permutation(w)[:20])) for i, (x, w) in enumerate(words.items()) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    filters = language.learn(docs, "lang", "text", F.col("doc_id") % 4 > 0, F.xxhash64("text"))
    assert len(filters.langs) == 1200 and filters.slots.shape[1] == 19 and filters.false.max() < 0.05
    found = {x["doc_id"]: x["lang_pred"] for x in language.identify(docs.filter("doc_id % 4 = 0"), filters).collect()}
    assert len(found) == 1200 and sum(found[d] == x for d, x, _ in rows if d % 4 == 0) >= 1190


def test_filters_hold_all_ngrams_and_few_others(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    filters = language.learn(docs, "lang", "text", F.col("doc_id") % 2 == 0, F.xxhash64("text"))
    own = docs.filter("doc_id % 2 = 0").select("lang", "text").toPandas()
    exact = {}
    for x, g in own.groupby("lang"):
        grams, n = np.unique(np.concatenate([language.ngrams(t.encode()) for t in g.text]), return_counts=True)
        exact[x] = set(grams[n >= max(2, language.LEAST_SHARE * n.sum())].tolist())
    every = np.array(sorted(set().union(*exact.values())), np.uint64)
    words = filters.languages(every)
    for i, x in enumerate(filters.langs):
        has = (words[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) == 1
        mine = np.isin(every, np.array(sorted(exact[x]), np.uint64))
        assert has[mine].all() and has[~mine].mean() <= filters.false[i] + 0.01
    # decisions are those of exact sets
    agreed = 0
    for t in own.text[:100]:
        g = language.ngrams(t.encode())
        best = max(filters.langs, key=lambda x: (sum(v in exact[x] for v in g.tolist()), -filters.langs.index(x)))
        agreed += filters.decide(t.encode())[0] == best
    assert agreed >= 99


def test_ngrams_reversible():
    unpack = lambda g: "".join(chr(int(g >> np.uint64(21 * k) & np.uint64((1 << 21) - 1))) for k in range(3))
    assert [unpack(g) for g in language.ngrams("Ab, 3ç😀".encode())] == [" ab", "ab ", "b ç", " ç "] or [unpack(g) for g in language.ngrams("Ab, 3ç".encode())] == [" ab", "ab ", "b ç", " ç "]
    assert len(language.ngrams(b"123 !")) == 0 and len(language.ngrams(b"")) == 0


# ---- 10 quality model


def test_quality_held_out(spark, larger):
    found = catalog.queries()["op10_quality"](spark, larger).toPandas()
    assert len(found) == 1000 and auc(*held_out(found, pd.read_parquet(f"{larger}/labels.parquet"), "quality")) > 0.97
    assert ((found.score >= 0.3) == (found.predicted == 1)).all()


def test_discriminant_equals_densities():
    r = np.random.default_rng(0)
    x = [r.normal(size=(300, 3)), r.normal(size=(500, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 0, 0.5]]) + 1]
    m = quality_model.Discriminant.fit([300, 500], [a.sum(0) for a in x], [a.T @ a for a in x], 0.0, 0.0)
    z = r.normal(size=(50, 3))

    def density(a, p):
        c, d = np.cov(a.T), z - a.mean(0)
        return np.log(p) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (d @ np.linalg.inv(c) * d).sum(1)

    logit = np.log(m.score(z) / (1 - m.score(z)))
    assert np.allclose(logit, density(x[1], 500 / 800) - density(x[0], 300 / 800), atol=1e-3)


def test_quality_odd(clashing, empty, labels):
    for sample in (labels, labels.limit(0), labels.filter("quality = 0")):
        found = quality_model.classify(clashing, sample).toPandas()
        assert len(found) == clashing.count() and found.score.between(0, 1).all()
    assert quality_model.keep_good(clashing, labels).columns == clashing.columns
    assert quality_model.classify(empty, labels).count() == 0 and quality_model.keep_good(empty, labels).count() == 0
