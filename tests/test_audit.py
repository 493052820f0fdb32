"""The near-duplicate audit that grows, against a full one."""

import numpy as np
import pytest

from resight.operators import gates, near_dup


def frames(spark, noise, n):
    base = noise.integers(0, 1 << 62, n // 4)
    rows = []
    for i in range(n):
        x = int(base[int(noise.integers(0, len(base)))])
        for bit in noise.integers(0, 64, int(noise.integers(0, 9))):
            x ^= 1 << int(bit)
        rows.append((f"c{i % 3}", f"p{i}", f"{x:016X}" if i % 2 else f"{x:016x}"))
    return [*rows, ("c0", "none", None), ("c0", "short", "12")]


def test_cohorts_one_by_one_equal_all_at_once(spark, tmp_path):
    rows = frames(spark, np.random.default_rng(0), 600)
    df = spark.createDataFrame(rows, "cohort string, path_rel string, phash string")
    want = {tuple(r) for r in near_dup.near_classes(df).collect()}
    audit = near_dup.Audit(spark, "audit_a", f"file://{tmp_path}/audit", buckets=8)
    new = 0
    for part in (rows[:250], rows[250:260], [], rows[260:], rows[:40]):
        new += audit.add(spark.createDataFrame(part, df.schema)).count()
    assert {tuple(r) for r in audit.pairs().collect()} == want and new == len(want) > 50
    again = near_dup.Audit(spark, "audit_a", f"file://{tmp_path}/audit", buckets=8)  # tables that are there are taken
    assert again.fresh(df).count() == 0 and again.pairs().count() == len(want)


def test_a_cohort_that_was_cut_off_is_added_again(spark, tmp_path, monkeypatch):
    rows = frames(spark, np.random.default_rng(1), 200)
    df = spark.createDataFrame(rows, "cohort string, path_rel string, phash string")
    audit = near_dup.Audit(spark, "audit_b", f"file://{tmp_path}/audit", buckets=4)
    audit.add(spark.createDataFrame(rows[:90], df.schema))
    whole = near_dup.Audit._append

    def cut(self, made, table):
        if table == "hashes":
            raise OSError
        whole(self, made, table)

    monkeypatch.setattr(near_dup.Audit, "_append", cut)
    with pytest.raises(OSError):
        audit.add(df)
    monkeypatch.undo()
    audit.add(df)
    assert {tuple(r) for r in audit.pairs().collect()} == {tuple(r) for r in near_dup.near_classes(df).collect()}


def test_old_keys_are_not_shuffled(spark, tmp_path):
    """The plan of a cohort's join has no exchange above the old table, whether the cohort is broadcast or shuffled."""
    df = spark.createDataFrame(frames(spark, np.random.default_rng(2), 300), "cohort string, path_rel string, phash string")
    audit = near_dup.Audit(spark, "audit_c", f"file://{tmp_path}/audit", buckets=8)
    audit.add(df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in ("10485760", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            keyed = spark.range(100).selectExpr("concat('c', id % 3) AS g", "id * 7919 AS x", "id * 31 AS key")
            joined = keyed.withColumnRenamed("x", "y").join(audit._table("keys"), ["key", "g"])
            plan = joined._jdf.queryExecution().executedPlan().toString()
            old = plan.splitlines()
            at = next(i for i, x in enumerate(old) if "audit_c_keys" in x)
            depth = lambda x: len(x) - len(x.lstrip(" :+-"))
            above, level = [], depth(old[at])
            for x in reversed(old[:at]):
                if depth(x) < level:
                    above.append(x)
                    level = depth(x)
            assert not any("Exchange" in x for x in above[: next(i for i, x in enumerate(above) if "Join" in x)]), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_nothing_is_broadcast(spark):
    """Keys and pairs are many for each hash, which Spark doesn't foresee: joins of theirs don't go through the driver."""
    rows = [(g, f"{p}.jpg", h, f"m{p}", "i") for g, p, h in frames(spark, np.random.default_rng(3), 100)]
    df = spark.createDataFrame(rows, "cohort string, path_rel string, phash string, md5 string, individual_id string")
    near = near_dup.near_pairs(df)
    registry = df.selectExpr("path_rel", "individual_id", "'2025-01' AS date", "path_rel AS session")
    for made in (near_dup.near_classes(df), near, gates.cross_session_pairs(registry, near)):
        assert "BroadcastExchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_heavy_buckets_equal_sorted_ones(spark, monkeypatch):
    """Hashes that share parts, so that some buckets are joined and others sorted."""
    noise = np.random.default_rng(4)
    rows = [(g, p, f"{int(h, 16) & 0xFFFFFFFF:016x}" if h and len(h) == 16 and noise.random() < 0.5 else h) for g, p, h in frames(spark, noise, 400)]
    df = spark.createDataFrame(rows, "cohort string, path_rel string, phash string")
    want = {tuple(r) for r in near_dup.near_classes(df).collect()}
    hashes = {(g, int(h, 16)) for g, _, h in rows if h and len(h) == 16}
    assert want == {(g, f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()) for g, a in hashes for h, b in hashes if g == h and a < b and (a ^ b).bit_count() <= 6}
    monkeypatch.setattr(near_dup, "HEAVY", 20)
    found = near_dup.near_classes(df)
    assert "choice" in found._jdf.queryExecution().analyzed().toString()
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_an_audit_keeps_a_row_for_each_first_part(spark, tmp_path):
    df = spark.createDataFrame(frames(spark, np.random.default_rng(5), 60), "cohort string, path_rel string, phash string")
    audit = near_dup.Audit(spark, "audit_d", f"file://{tmp_path}/audit", buckets=4)
    audit.add(df)
    assert audit._table("keys").count() == (near_dup.MOST + 1) * audit._table("hashes").count()


def test_frames_of_the_audit_are_made_once_and_without_recapture_figures(spark, small, monkeypatch):
    """The audit asks for cohorts and hashes only: frames aren't joined with their individuals' sessions, three times over."""
    from resight.plans import queries as plans

    def never(*_):
        raise AssertionError

    made = []
    whole = plans.frames
    monkeypatch.setattr(plans, "proxy_registry", never)
    monkeypatch.setattr(plans, "frames", lambda *a: made.append(1) or whole(*a))
    found = plans.near_dup_growing(spark, small)
    assert len(made) == 1 and {tuple(r) for r in found.collect()} == {tuple(r) for r in plans.near_dup_pairs_hamming(spark, small).collect()}


@pytest.mark.parametrize("spare", [1, 2, 3, 4])
def test_short_and_long_keys_find_the_same_pairs(spare):
    noise = np.random.default_rng(6)
    base = noise.integers(0, 1 << 62, 60)
    x = np.unique(np.array([int(b) ^ sum(1 << int(k) for k in set(noise.integers(0, 64, 4))) for b in np.repeat(base, 6)], np.uint64))
    cuts, first = near_dup._cuts(near_dup.MOST + spare), 0
    part = (x >> np.uint64(cuts[first][0])) & np.uint64((1 << cuts[first][1]) - 1)
    found, want = set(), set()
    for value in np.unique(part):
        own = x[part == value]
        found |= {tuple(sorted((int(a) & (1 << 64) - 1, int(b) & (1 << 64) - 1))) for p in near_dup._met(own, first, near_dup.MOST, spare) for a, b in zip(p[0], p[1], strict=True)}
        agree = lambda d: sum(not (d >> a) & ((1 << n) - 1) for a, n in cuts)
        want |= {(int(a), int(b)) for a in own for b in own if a < b and (int(a) ^ int(b)).bit_count() <= near_dup.MOST and agree(int(a) ^ int(b)) >= spare}
    assert found == want and len(found) > 20


@pytest.mark.parametrize("name", ["near_dup_report", "cross_session_near_dups"])
def test_reports_need_no_recapture_figures_and_no_broadcast(spark, small, monkeypatch, name):
    from resight.plans import queries as plans

    def never(*_):
        raise AssertionError

    monkeypatch.setattr(plans, "proxy_registry", never)
    plan = getattr(plans, name)(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "n_sessions" not in plan and plan.count("leftHint=(strategy=merge)") >= 2


def test_pairs_of_two_individuals_go_before_their_paths_are_joined(spark):
    near = spark.createDataFrame([("p", "q", True), ("p", "r", False), ("q", "s", None)], "a string, b string, same_individual boolean")
    registry = spark.createDataFrame([("p", "i", "1"), ("q", "i", "2"), ("r", "j", "3"), ("s", None, "4")], "path_rel string, individual_id string, session string").selectExpr("*", "CAST(NULL AS STRING) AS date")
    for pairs in (near, near.drop("same_individual")):
        assert [tuple(r) for r in gates.cross_session_pairs(registry, pairs).collect()] == [("p", "q")]
    assert "same_individual" in gates.cross_session_pairs(registry, near)._jdf.queryExecution().analyzed().toString().split("Project [a")[-1]


def test_hashes_of_one_frame_are_no_links(spark):
    rows = [("c", "p1", "00" * 8, "m1", "i"), ("c", "p2", "00" * 8, "m2", "i"), ("c", "p3", "ff" * 8, "m3", "i")]
    near = near_dup.near_pairs(spark.createDataFrame(rows, "cohort string, path_rel string, phash string, md5 string, individual_id string"))
    assert [tuple(r) for r in near.collect()] == [("c", 0, "p1", "p2", True)]
    assert "count" in near._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most_own", [1024, 20, 1])
def test_pairs_of_one_individual_equal_those_of_the_audit(spark, monkeypatch, most_own):
    monkeypatch.setattr(near_dup, "OWN", most_own)
    noise = np.random.default_rng(5)
    rows = [(g, p, h, f"m{i % 40}", None if i % 31 == 0 else f"i{int(noise.integers(0, 5))}", None, f"s{i % 3}") for i, (g, p, h) in enumerate(frames(spark, noise, 300))]
    rows += [("c0", f"copy{i}", "zz" * 8, f"m{i}", "i1", f"d{i % 2}", None) for i in range(4)]  # no hash, but equal
    df = spark.createDataFrame(rows, "cohort string, path_rel string, phash string, md5 string, individual_id string, date string, session string")
    own = near_dup.own_pairs(df)
    want = {tuple(r) for r in near_dup.near_pairs(df).filter("same_individual").collect()}
    assert {tuple(r)[:5] for r in own.collect()} == want and own.count() == len(want) > 20
    bare = [tuple(r) for r in gates.cross_session_pairs(df, near_dup.near_pairs(df)).collect()]
    found = [tuple(r) for r in gates.cross_session_pairs(df, own).collect()]
    assert sorted(found) == sorted(bare) and 0 < len(found) < len(want)


def test_registry_gates_do_without_the_audit_of_whole_cohorts(spark, small, monkeypatch):
    from resight.plans import queries as plans

    def never(*_, **__):
        raise AssertionError

    monkeypatch.setattr(near_dup, "near_classes", never)
    assert plans.gates_registry(spark, small).count() == 8
