"""The training-data operators: brute force, round trips, held-out accuracy, and awkward inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("bandlens.llm")
from bandlens.llm import cluster, cube, encode, language, mix, percentiles, varied  # noqa: E402

# ---- 1: varied subset ------------------------------------------------------------------------------

SIDES = {"a": 0.0105, "b": 0.00025}


def _points(n=400, seed=0):
    rng = np.random.default_rng(seed)
    a = np.round(np.concatenate([rng.normal(0.3, 0.003, n), rng.random(25)]), 4)
    b = np.round(np.concatenate([rng.normal(0.001, 0.0001, n), rng.random(25) * 0.003]), 4)
    return pd.DataFrame({"id": np.arange(n + 25), "g": rng.integers(0, 3, n + 25), "a": a, "b": b})


def _alone(p):
    return {int(r.id) for r in p.itertuples() if not ((p.g == r.g) & (p.id != r.id) & ((p.a - r.a).abs() < SIDES["a"]) & ((p.b - r.b).abs() < SIDES["b"])).any()}


@pytest.mark.parametrize("size", [60, 150, 1000])
def test_subset_finds_all_that_are_alone_and_has_its_size(spark, size):
    p = _points()
    s = varied.varied_subset(spark.createDataFrame(p).withColumn("kind_n", F.lit("clash")), size, "id", "g", SIDES).toPandas()
    assert len(s) == min(size, len(p)) and s.id.is_unique
    assert set(s[s.alone].id) == _alone(p)


def test_core_sets_are_farthest_points_and_compose(spark):
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"id": np.arange(900), "g": 1, "a": rng.random(900), "b": rng.random(900), "c0": np.int32(0), "c1": rng.integers(0, 2, 900).astype(np.int32)})
    core = varied.core_set(spark.createDataFrame(p).repartition(7), "id", "g", ["c0", "c1"], ["a", "b"], 6, [1.0, 1.0]).toPandas()
    assert (core.groupby("c1").size() == 6).all() and core.groupby("c1").kind_n.first().to_dict() == p.groupby("c1").size().to_dict()
    for k, own in core.groupby("c1"):
        x, kept = p[p.c1 == k][["a", "b"]].to_numpy(), own[["a", "b"]].to_numpy()
        near = np.sqrt(((x[:, None] - kept[None]) ** 2).sum(2)).min(1).max()
        apart = min(np.hypot(*(u - v)) for i, u in enumerate(kept) for v in kept[:i])
        assert near <= 3 * apart  # what a farthest-point selection of farthest-point selections keeps to
    turn = varied.farthest(np.array([[0.0], [1.0], [9.0], [5.0], [2.0]]), np.array([0, 0, 0, 0, 1]), 3)
    assert turn.tolist() == [0, 3, 1, 2, 0]


def test_groups_of_many_kinds_are_searched_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    p = pd.DataFrame({"id": np.arange(2000), "g": rng.integers(0, 2, 2000), "a": rng.random(2000), "b": rng.random(2000)})
    monkeypatch.setattr(varied, "CANDIDATES", 4)
    s = varied.varied_subset(spark.createDataFrame(p), 40, "id", "g", {"a": 0.01, "b": 0.01}).toPandas()
    monkeypatch.setattr(varied, "CANDIDATES", 10**6)
    t = varied.varied_subset(spark.createDataFrame(p), 40, "id", "g", {"a": 0.01, "b": 0.01}).toPandas()
    total = lambda q: sum(np.hypot(*(u - v)) for _, own in q.groupby("g") for i, u in enumerate(own[["a", "b"]].to_numpy()) for v in own[["a", "b"]].to_numpy()[:i])
    assert len(s) == len(t) == 40 and total(s) >= 0.97 * total(t)


def test_subset_smaller_than_the_alone(spark):
    s = varied.varied_subset(spark.createDataFrame(_points()), 5, "id", "g", SIDES).toPandas()
    assert len(s) == 5 and set(s.id) <= _alone(_points())


def test_alone_records_are_found_beyond_the_size_of_a_subset(spark, monkeypatch):
    from bandlens.llm import queries

    i = np.arange(4100)
    p = pd.DataFrame({"sample_id": i, "label": 1, "NIR": i % 45 * 0.022, "SWIR1": i // 45 * 0.001})
    p = pd.concat([p, p[:1].assign(sample_id=4100)])  # 0 isn't alone
    monkeypatch.setattr(queries, "water_records", lambda *a: spark.createDataFrame(p))
    assert {r["sample_id"] for r in queries.p1_found(spark, "").collect()} == set(range(1, 4100))


def test_subset_covers_kinds_evenly_and_swaps_raise_dispersion():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (300, 2)), rng.normal(3, 0.1, (5, 2))])
    kind = np.concatenate([np.zeros(300, int), np.ones(5, int)])
    none = np.zeros(305, bool)
    start, end = (varied.disperse(x, kind, none, 10, n) for n in (0, None))
    total = lambda c: np.sqrt(((x[c][:, None] - x[c][None]) ** 2).sum(2)).sum()
    assert start.sum() == end.sum() == 10 and (kind[end] == 1).sum() == 5 and total(end) > total(start)


def test_subset_of_more_kinds_than_its_size_is_a_local_optimum_over_kinds():
    rng = np.random.default_rng(2)
    x = rng.random((240, 2))
    kind = np.sort(rng.integers(0, 120, 240))
    kind = np.unique(kind, return_inverse=True)[1]
    none = np.zeros(240, bool)
    total = lambda c: np.sqrt(((x[c][:, None] - x[c][None]) ** 2).sum(2)).sum()
    x /= np.ptp(x, axis=0)
    for size in (30, 130):
        c = varied.disperse(x, kind, none, size)
        counts = np.bincount(kind[c], minlength=kind.max() + 1)
        assert c.sum() == size and (counts.max() == 1 if size == 30 else counts.min() == 1)
        for o in np.flatnonzero(c):  # no allowed swap raises the sum
            for i in np.flatnonzero(~c):
                if kind[i] == kind[o] or counts[kind[i]] < counts[kind[o]]:
                    d = c.copy()
                    d[o], d[i] = False, True
                    assert total(d) <= total(c) + 1e-6


def test_subset_awkward(spark):
    schema = "id long, g int, a double, b double"
    nan = float("nan")
    rows = [(1, 0, nan, 0.1), (2, None, 0.1, 0.1), (None, 0, 0.1, 0.1), (3, 0, None, 0.1), (4, 0, 0.5, 0.5), (5, 0, 0.9, 0.5)]
    s = varied.varied_subset(spark.createDataFrame(rows, schema), 10, "id", "g", SIDES).toPandas()
    assert set(s.id) == {4, 5} and s.alone.all()
    assert varied.varied_subset(spark.createDataFrame([], schema), 10, "id", "g", SIDES).count() == 0


# ---- 2: clusters -----------------------------------------------------------------------------------


def _linked(p, t):
    x, ids = p[["a", "b", "c"]].to_numpy(), p["id"].to_numpy()
    label = np.arange(len(p))
    adj = (np.abs(x[:, None] - x[None]) < t).all(2)
    while True:
        new = np.array([label[adj[i]].min() for i in range(len(p))])
        if (new == label).all():
            break
        label = new
    out = set()
    for k in np.unique(label):
        m = ids[label == k]
        out |= {(int(m.min()), len(m), int(i)) for i in m}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_linked_clusters(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.random((25, 3)) * 0.25
    x = np.round(np.concatenate([c + rng.normal(0, 0.006, (rng.integers(1, 30), 3)) for c in centres]), 4)
    p = pd.DataFrame(np.abs(x), columns=["a", "b", "c"]).assign(id=rng.permutation(len(x)))
    got = {tuple(r) for r in cluster.linked_clusters(spark.createDataFrame(p).withColumn("head", F.lit("x")), "id", ["a", "b", "c"], 0.0105, 1).collect()}
    assert got == _linked(p, 0.0105)


def test_linked_clusters_across_many_small_blocks_without_broadcasts(spark, monkeypatch):
    from bandlens.plans import stages

    monkeypatch.setattr(cluster, "BLOCK_LEAVES", 300)
    monkeypatch.setattr(cluster, "BLOCK", 3)
    monkeypatch.setattr(stages, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(7)
    p = pd.DataFrame(np.round(rng.random((700, 3)) * [0.2, 0.06, 0.05], 4), columns=["a", "b", "c"]).assign(id=rng.permutation(700))
    got = {tuple(r) for r in cluster.linked_clusters(spark.createDataFrame(p), "id", ["a", "b", "c"], 0.0105, 1).collect()}
    assert cluster.block_side(3) == 1 and got == _linked(p, 0.0105)


@pytest.mark.parametrize("gap", [0.0103, 0.0107])
def test_many_equal_records_in_two_leaves_that_stay_open(spark, gap):
    # Two leaves two apart whose bounds decide nothing: a hundred thousand equal records in each, and one more that widens the leaf.
    n = 50_000
    d = spark.range(2 * n + 2).select("id", F.when(F.col("id") < n, 0.0040).when(F.col("id") < 2 * n, 0.0040 + gap).when(F.col("id") == 2 * n, 0.0001).otherwise(0.0156).alias("a"), F.lit(0.5).alias("b"), F.lit(0.5).alias("c"))
    got = cluster.linked_clusters(d, "id", ["a", "b", "c"], 0.0105, 1).groupBy("head", "size").count().orderBy("head").collect()
    assert [tuple(r) for r in got] == ([(0, 2 * n + 2, 2 * n + 2)] if gap < 0.0105 else [(0, n + 1, n + 1), (n, n + 1, n + 1)])


def test_features_are_reduced_up_the_tree(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame(rng.random((3000, 2)), columns=["a", "b"]).assign(id=range(3000))
    rows = cluster.usable(spark.createDataFrame(p), "id", ["a", "b"])
    table = cluster.leaves(rows, "id", ["a", "b"], 0.01)
    few = cluster.reduced(table, 2, 100).toPandas()
    assert len(few) <= 100 and few.n.sum() == 3000 and np.isclose(few.s0.sum(), p.a.sum()) and np.isclose(few.q.sum(), (p[["a", "b"]] ** 2).to_numpy().sum())
    c = cluster.clusters(spark.createDataFrame(p), "id", ["a", "b"], 0.02, k=4, max_leaves=100).toPandas()
    assert c.drop_duplicates("cluster")["size"].sum() == 3000 and (c["spread"] > 0).all()


def test_links_at_the_leaves_edges(spark):
    # Chains of points just within and just beyond the tolerance, across leaves.
    v = np.cumsum([0.0] + [0.0104] * 6 + [0.0106] + [0.0104] * 4)
    p = pd.DataFrame({"a": v, "b": 0.5, "c": v[::-1].copy(), "id": range(len(v))})
    got = {tuple(r) for r in cluster.linked_clusters(spark.createDataFrame(p), "id", ["a", "b", "c"], 0.0105, 1).collect()}
    assert got == _linked(p, 0.0105) and {g[0] for g in got} == {0, 5, 7}


def test_ward_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.01, (100, 2)) for m in (0.2, 0.5, 0.8)])
    p = pd.DataFrame(x, columns=["a", "b"]).assign(id=range(300))
    c = cluster.clusters(spark.createDataFrame(p), "id", ["a", "b"], 0.02, k=3, typical=4).toPandas()
    assert len(c) == 12 and (c["size"] == 100).all() and sorted(c.c_a.round(1).unique()) == [0.2, 0.5, 0.8]
    for _, g in c.groupby("cluster"):
        m = p[(p.a - g.c_a.iloc[0]).abs() < 0.15]
        d = np.hypot(m.a - g.c_a.iloc[0], m.b - g.c_b.iloc[0])
        assert set(g.id) == set(m.id[d.sort_values().index[:4]])


def test_ward_is_wards_criterion():
    rng = np.random.default_rng(3)
    x, n = rng.random((40, 2)), rng.integers(1, 9, 40)
    label, alive = list(range(40)), {i: (float(n[i]), x[i]) for i in range(40)}
    while len(alive) > 5:
        i, j = min(((i, j) for i in alive for j in alive if i < j), key=lambda p: alive[p[0]][0] * alive[p[1]][0] / (alive[p[0]][0] + alive[p[1]][0]) * ((alive[p[0]][1] - alive[p[1]][1]) ** 2).sum())
        (a, c), (b, e) = alive.pop(i), alive.pop(j)
        alive[i] = (a + b, (a * c + b * e) / (a + b))
        label = [i if v == j else v for v in label]
    got = cluster.ward(n, x, 5)
    assert len({(a, b) for a, b in zip(label, got)}) == 5


def test_clusters_awkward(spark):
    schema = "id long, a double, b double, c double"
    rows = [(1, None, 0.1, 0.1), (None, 0.1, 0.1, 0.1), (2, float("nan"), 0.1, 0.1), (3, 0.1, 0.1, 0.1), (3, 0.1, 0.1, 0.1), (4, 0.1, 0.1, 0.1)]
    got = {tuple(r) for r in cluster.linked_clusters(spark.createDataFrame(rows, schema), "id", ["a", "b", "c"], 0.01, 1).collect()}
    assert got == {(3, 2, 3), (3, 2, 4)}
    empty = spark.createDataFrame([], schema)
    assert cluster.linked_clusters(empty, "id", ["a", "b", "c"], 0.01).count() == 0 and cluster.clusters(empty, "id", ["a", "b", "c"], 0.01).count() == 0


# ---- 3: percentiles --------------------------------------------------------------------------------


def test_sketches_merge_and_stay_within_their_bound(spark):
    rng = np.random.default_rng(0)
    n = 60_000
    p = pd.DataFrame({"g": np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abcdef"), n)), "v": rng.lognormal(size=n)})
    d = spark.createDataFrame(p)
    parts = [percentiles.merged(percentiles.sketched(x, ["g"], "v", 100), ["g"], 100) for x in d.repartition(5).randomSplit([0.5, 0.5], 1)]
    s = percentiles.merged(parts[0].unionByName(parts[1]), ["g"], 100)
    assert s.agg(F.sum("n")).first()[0] == n
    for r in percentiles.estimated(s, ["g"], [0.1, 0.5, 0.9]).collect():
        v = np.sort(p.v[p.g == r["g"]].to_numpy())
        rank = np.searchsorted(v, r["value"]) / len(v)
        assert abs(rank - r["q"]) <= r["rank_error"] + 2 / len(v) and r["rank_error"] < 0.1
        assert r["low"] <= np.quantile(v, r["q"]) <= r["high"]
    e = percentiles.exact(d, ["g"], "v", percentiles.estimated(s, ["g"], [0.1, 0.5, 0.9])).toPandas()
    assert len(e) == 21 and all(np.isclose(r.exact, np.quantile(p.v[p.g == r.g], r.q)) for r in e.itertuples())
    wrong = percentiles.estimated(s, ["g"], [0.5]).withColumn("low", F.lit(50.0)).withColumn("high", F.lit(60.0))
    e = percentiles.exact(d, ["g"], "v", wrong).toPandas()
    assert len(e) == 7 and all(np.isclose(r.exact, np.quantile(p.v[p.g == r.g], 0.5)) for r in e.itertuples())


def test_small_groups_are_exact(spark):
    rows = [("a", float(i)) for i in range(10)] + [("b", 1.0), (None, 2.0), (None, 4.0), ("a", None), ("c", float("nan"))]
    d = spark.createDataFrame(rows, "g string, v double")
    r = {x["g"]: x for x in percentiles.estimated(percentiles.merged(percentiles.sketched(d, ["g"], "v"), ["g"]), ["g"], [0.5]).collect()}
    assert set(r) == {"a", "b", None} and r["a"]["value"] == 4.5 and r["a"]["low"] == r["a"]["high"] == 4.5 and r[None]["value"] == 3.0
    assert percentiles.estimated(percentiles.merged(percentiles.sketched(d.limit(0), ["g"], "v"), ["g"]), ["g"], [0.5]).count() == 0


@pytest.mark.parametrize("k", [10, 400])
def test_unusual_medians(spark, k):
    rng = np.random.default_rng(1)
    rows, entry = [], 0
    for run in range(8):
        for name in ("Add node", "add-node ", "swap"):
            shift = 3.0 if run == 2 and name != "swap" else -4.0 if run == 5 and name == "swap" else 0.0
            for v in rng.normal(shift, 1, 40):
                rows += [(run, entry, name, float(v), int(rng.integers(-3, 3)))] * (1 + entry % 3 // 2)
                entry += 1
    rows += [(1, entry + 1, None, 99.0, 1), (1, entry + 2, "swap", float("inf"), None), (1, entry + 3, "swap", float("nan"), None), (1, entry + 4, "swap", None, None)]
    d = spark.createDataFrame(rows, "run_id long, entry_no long, operation_name string, fitness_delta double, complexity_delta int")
    got = {tuple(r) for r in percentiles.unusual_medians(d, k=k).collect() if r["field"] == "fitness_delta"}
    assert got == {(2, "add_node", "fitness_delta", "high"), (5, "swap", "fitness_delta", "low")}
    assert percentiles.log_percentiles(d, [0.5], k).filter("scope = 'log'").count() == 2


# ---- 4: balanced samples ---------------------------------------------------------------------------

PLANS = "plan_id long, scene_id long, sample_size int, label int, target_share double, min_count int"


def _records(spark, counts, scene=1, start=0):
    rows = [(start + i, scene, k) for i, k in enumerate(k for k, n in counts.items() for _ in range(n))]
    return spark.createDataFrame(rows, "sample_id long, scene_id long, label int")


def test_targets_are_met_and_short_ones_reported(spark):
    d = _records(spark, {0: 500, 1: 200, 2: 3}).repartition(6)
    plans = spark.createDataFrame([(7, 1, 100, 0, 0.6, None), (7, 1, 100, 1, 0.3, None), (7, 1, 100, 2, 0.1, None), (8, 9, 10, 0, 1.0, 2), (7, 1, 100, 0, 0.6, None), (None, 1, 5, 0, 1.0, 1)], PLANS)
    sample, report = cube.sample_to_targets(d, plans)
    s, r = sample.toPandas(), report.toPandas().set_index(["plan_id", "label"])
    assert s.sample_id.is_unique and s.groupby("label").size().to_dict() == {0: 60, 1: 30, 2: 3}
    assert r.short.to_dict() == {(7, 0): False, (7, 1): False, (7, 2): True, (8, 0): True} and r.drawn[(8, 0)] == 0


def test_minimum_counts_lower_the_others(spark):
    d = _records(spark, {0: 500, 1: 200, 2: 50})
    plans = spark.createDataFrame([(7, 1, 100, 0, 0.55, None), (7, 1, 100, 1, 0.4, None), (7, 1, 100, 2, 0.05, 21)], PLANS)
    r = cube.sample_to_targets(d, plans)[1].toPandas().set_index("label")
    assert r.drawn.sum() == 100 and r.drawn[2] == 21 and abs(r.drawn[0] - r.expected[0]) < 1 and abs(r.drawn[1] - r.expected[1]) < 1


def test_inclusion_is_fair(spark):
    d = _records(spark, {0: 40})
    plans = spark.createDataFrame([(p, 1, 10, 0, 1.0, None) for p in range(300)], PLANS)
    n = cube.sample_to_targets(d, plans)[0].groupBy("sample_id").count().toPandas()["count"]
    assert n.sum() == 3000 and n.min() > 40 and n.max() < 115


@pytest.mark.parametrize("seed", range(3))
def test_flights_keep_expected_values(seed):
    rng = np.random.default_rng(seed)
    m, runs = 14, 6000
    p = np.round(rng.random(m), 2)
    p[:3] = [1.0, 0.0, 0.5]
    one = np.concatenate([p, [0.25] * 8, [1 / 3] * 3, [0.9]])  # four groups; 8 / 4 and 3 / 3 end at whole numbers
    of = np.repeat([0, 1, 2, 3], [m, 8, 3, 1])
    group = np.concatenate([of + 4 * i for i in range(runs)])
    pi = np.tile(one, runs)
    order = rng.permutation(len(pi))
    taken, left, rest = cube.fly(group[order], pi[order], rng.random(len(pi)), rng.random(len(pi)))
    taken, left = order[taken], order[left]
    assert len(set(taken)) == len(taken) and not set(taken) & set(left) and len(set(group[left])) == len(left)
    n = np.bincount(group[taken], minlength=4 * runs).reshape(runs, 4)
    total = np.bincount(of, one)
    assert (n == np.floor(total + 1e-9)).all()
    value = np.zeros(len(pi))
    value[taken] = 1
    value[left] = rest
    assert np.allclose(value.reshape(runs, -1).mean(0), one, atol=4 * 0.5 / np.sqrt(runs))
    assert np.allclose(np.bincount(group, value), np.tile(total, runs))


def test_samples_of_empty_tables(spark):
    none = _records(spark, {0: 1}).limit(0)
    plans = spark.createDataFrame([(7, 1, 10, 0, 1.0, None)], PLANS)
    sample, report = cube.sample_to_targets(none, plans)
    assert sample.count() == 0 and report.first()["short"]
    assert cube.sample_to_targets(_records(spark, {0: 5}), plans.limit(0))[1].count() == 0


# ---- 6: encoding -----------------------------------------------------------------------------------

TEXTS = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "\n", " \n", "\n ", "a\n b", "a \nb", "\t x", "it's we'LL they're 's", "<|endoftext|> <s> [PAD]", "ÄÖÜ ß é é", "日本語 テスト 123", "👩‍🌾 🇺🇳 ❤️", "a b  c　d  e", "\x00\x01 \x1c\x1d\x1e\x1f x\x85y",
    "½ Ⅷ x² ٥٦٧ 1,234.50", "x" * 5000, "1" * 3000, " " * 500, "ab " * 2000, "﻿​‍", "_a__b _ _c", "tab\tsep\t\t\r\n\r\n  end ", "\n\n \n", "'s 't '", "don't  'ld",
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    import os

    path = encode.VOCABULARY.replace(".tiktoken", ".json")
    if not os.path.exists(path):
        pytest.skip("no tokenizer files")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def test_encoding_is_the_tokenizers_and_decodes(spark, reference):
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, "again", 1), (None, "no key", 1)], "doc_id long, text string, ids int")
    got = encode.encode_corpus(d.repartition(3))
    rows = got.collect()
    assert len(rows) == len(TEXTS) + 2
    by = {r["doc_id"]: r["ids"] for r in rows if r["doc_id"]}
    for i, t in enumerate(TEXTS[1:], 1):
        assert by[i] == (reference.encode(t, add_special_tokens=False).ids if t else []), repr(t)
    back = {r["doc_id"]: r["text"] for r in encode.decode_corpus(got).collect() if r["doc_id"]}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS[1:], 1))
    n = {r["doc_id"]: r["n_tokens"] for r in encode.count_tokens(d, ["doc_id"]).collect() if r["doc_id"]}
    assert all(n[i] == len(by[i]) for i in by)


def test_encoding_random_text(reference):
    e = encode.Encoder(encode.sentencepiece_model(encode.read_vocabulary(encode.VOCABULARY)))
    rng = np.random.default_rng(0)
    alphabet = list("ab cd  ef\n\tg1 2'sé ßñ日½.,!?_- \x1c\r") + ["'ll", " the", "ing"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(1500)]
    ids, offsets = e.encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == reference.encode(t, add_special_tokens=False).ids, repr(t)
    assert encode.encode_corpus is not None and len(e.codes) > 0


def test_encoding_an_empty_table(spark):
    assert encode.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- 7: mixing -------------------------------------------------------------------------------------

MIXES = "mix_id long, term int, total_tokens long, source string, target_share double, max_repeats int"


def test_mix_reaches_its_shares(spark):
    rng = np.random.default_rng(0)
    docs = [(i, 1, [" Big", "SMALL ", "tiny"][k], int(rng.integers(5, 60))) for i, k in enumerate(rng.choice(3, 3000, p=[0.9, 0.08, 0.02]))] + [(9999, 1, None, 50), (9998, None, "big", 50)]
    d = spark.createDataFrame(docs, "doc_id long, term int, source string, n_tokens int")
    plan = [(1, 1, 20000, "big", 0.5, 1), (1, 1, 20000, "small", 0.4, 3), (1, 1, 20000, "tiny", 0.1, 1), (1, 1, 20000, "none", 0.0, 2), (2, 1, 10000, "Big ", 0.9, 2), (2, 1, 10000, "absent", 0.1, 2)]
    sample, report = mix.mix_sources(d, spark.createDataFrame(plan + plan[:1], MIXES))
    s, r = sample.toPandas(), report.toPandas().set_index(["mix_id", "source"])
    assert len(r) == 6
    for (m, k), x in r.iterrows():
        total = sum(n for _, t, src, n in docs if t == 1 and src and src.strip().lower() == k)
        assert x.available_tokens == total and x.unmet == (x.max_repeats * total < x.target_tokens)
        own = s[(s.mix_id == m) & (s.source == k)]
        assert own.copies.max() <= x.max_repeats if len(own) else x.reached_tokens == 0
        assert (own.n_tokens * own.copies).sum() == x.reached_tokens
        if not x.unmet:
            assert abs(x.reached_tokens - x.target_tokens) <= 60
        else:
            assert x.reached_tokens == x.max_repeats * total
    assert np.isclose(r.xs(1, level="mix_id").reached_share.sum(), 1)


def test_inclusion_grows_with_size_and_large_documents_are_certain(spark):
    sizes = [10] * 60 + [20] * 30 + [40] * 15 + [2000]
    runs, m = 60, len(sizes)
    d = spark.createDataFrame([(t * m + i, t, "a", n) for t in range(runs) for i, n in enumerate(sizes)], "doc_id long, term int, source string, n_tokens int")
    mixes = spark.createDataFrame([(t, t, 2450, "a", 1.0, 1) for t in range(runs)], MIXES)
    s = mix.mix_sources(d, mixes)[0].toPandas()
    assert ((s.n_tokens * s.copies).groupby(s.mix_id).sum() - 2450).abs().max() <= 10 and (s[s.n_tokens == 2000].p == 1).sum() == runs
    for size in (10, 20, 40):
        own = s[s.n_tokens == size]
        want = 450 * size / sum(x * x for x in sizes[:-1])
        assert np.allclose(own.p, want) and abs(len(own) / runs / sizes.count(size) - want) < 0.06


def test_repeated_and_null_keys_in_a_mix(spark):
    docs = [(7, 1, "a", 30)] * 40 + [(None, 1, "a", 30)] * 40 + [(8, 1, "a", 0), (9, 1, "a", None)]
    d = spark.createDataFrame(docs, "doc_id long, term int, source string, n_tokens int")
    sample, report = mix.mix_sources(d, spark.createDataFrame([(1, 1, 1200, "a", 1.0, 1), (2, 1, 3000, "a", 1.0, 2)], MIXES))
    r = {x["mix_id"]: x for x in report.collect()}
    assert r[1]["reached_tokens"] == 1200 and r[2]["reached_tokens"] == 3000 and not r[2]["unmet"]
    assert sample.filter("mix_id = 1").count() == 40 and sample.filter("mix_id = 2").agg(F.max("copies")).first()[0] == 2


def test_mix_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, term int, source string, n_tokens int")
    sample, report = mix.mix_sources(d, spark.createDataFrame([(1, 1, 100, "a", 1.0, 2), (1, 1, 100, None, 0.5, 1)], MIXES))
    assert sample.count() == 0 and [r["unmet"] for r in report.collect()] == [True]


# ---- 8: languages ----------------------------------------------------------------------------------


def test_label_names(spark):
    names = {"en-GB": "en", " DEU ": "de", "fre": "fr", "Swedish": "sv", "es-419": "es", "pt_PT": "pt", "": None, "??": None, "und": None, "xx": None, None: None, "english": "en", "entish": None}
    d = spark.createDataFrame([(k, v) for k, v in names.items()], "lang string, want string")
    assert d.filter(~F.col("want").eqNullSafe(language.named_language("lang"))).count() == 0


@pytest.fixture(scope="module")
def model(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    sample = language.training_documents(docs, "doc_id", "text", "lang", 60).collect()
    return language.train([(r["text"], r["lang"]) for r in sample])


FOREIGN = {
    "en": "The members of the committee have asked for more time before they vote on the report of the minister.",
    "fr": "Les membres de la commission ont demandé plus de temps avant de voter sur le rapport du ministre.",
    "de": "Die Mitglieder des Ausschusses haben vor der Abstimmung über den Bericht der Ministerin mehr Zeit verlangt.",
    "es": "Los miembros de la comisión han pedido más tiempo antes de votar sobre el informe del ministro.",
    "pt": "Os membros da comissão pediram mais tempo antes de votar sobre o relatório do ministro.",
    "nl": "De leden van de commissie hebben meer tijd gevraagd voordat zij over het verslag van de minister stemmen.",
    "sv": "Ledamöterna i utskottet har begärt mer tid innan de röstar om ministerns rapport och förslag.",
    "pl": "Członkowie komisji poprosili o więcej czasu przed głosowaniem nad raportem minister i posłów.",
}


def test_unseen_sentences(model):
    d = language.Detector(model)
    texts = list(FOREIGN.values()) + [t.upper() for t in FOREIGN.values()]
    found = d.labelled(texts)
    got = [language.LANGUAGES[i] if i >= 0 else None for i in found["lang"]]
    assert sum(a == b for a, b in zip(got, [*FOREIGN, *FOREIGN])) >= 13


def test_passages(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    own = [(-1, "The vote will take place tomorrow at noon after the second reading. (La motion, mise aux voix, est adoptée sans que le scrutin soit demandé.)\n\n" + "Die Ministerin bezweifelt offen den Jahresabschluss des Wasserverbandes mit viel Geduld.\r", "en"), (-2, None, "en"), (-3, "", None), (-4, "👩 🌾 ½ Ⅷ\t1 2 3 4 5 6 7 8 9\n" + "Kor\t-\t5\n" * 3, None), (-5, "Der Antrag wird zur Abstimmung gestellt und ohne Gegenstimmen von diesem Hause angenommen.", "??"), (-5, "x" * 100_000, None)]
    d = docs.unionByName(spark.createDataFrame(own, "doc_id long, text string, lang string")).withColumn("confidence", F.lit("clash"))
    p = language.detect_languages(d, labelled=60).filter("doc_id < 0")
    rows = p.collect()
    assert {r["para_no"] for r in rows if r["doc_id"] == -1} == {0, 1, 2} and not [r for r in rows if r["doc_id"] == -2]
    assert [r["para_no"] for r in rows if r["doc_id"] == -3] == [0]
    w = {tuple(r) for r in language.wrong_languages(p).collect()}
    assert w == {(-1, 0, "fr"), (-1, 2, "de"), (-5, 0, "de")}
    assert all(0 <= r["confidence"] <= 1 for r in rows)


def test_without_labels_all_is_rejected(spark):
    d = spark.createDataFrame([(1, "The vote will take place tomorrow at noon after the second reading.", None)], "doc_id long, text string, lang string")
    assert [r["language"] for r in language.detect_languages(d).collect()] == [None]
    assert language.detect_languages(d.limit(0)).count() == 0


# ---- all queries -----------------------------------------------------------------------------------


def test_queries_agree_with_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    from bandlens.llm import queries

    c = duckdb.connect()
    for t in ("sentinel2_water", "sampling_plans", "evolution_log", "documents", "source_mixes"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        got = queries.QUERIES[name](spark, data)
        cols = sorted(got.columns)
        want = c.sql(sql)
        at = {k: i for i, k in enumerate(want.columns)}
        assert sorted(tuple(str(r[k]) for k in cols) for r in got.collect()) == sorted(tuple(str(r[at[k]]) for k in cols) for r in want.fetchall()), name


@pytest.mark.parametrize("name", ["p1_subset", "p2_clusters", "p3_percentiles", "p4_sample", "p4_shares", "p6_ids", "p7_found", "p7_sample", "p7_shares", "p8_passages"])
def test_other_queries_run(spark, data, name):
    from bandlens.llm import queries

    assert queries.QUERIES[name](spark, data).count() > 0


def test_temperature_is_found_in_spite_of_wrong_labels():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(20_000, 8))
    p = np.exp(3 * z)
    p /= p.sum(1, keepdims=True)
    y = (p.cumsum(1) > rng.random((20_000, 1))).argmax(1)
    y = np.where(rng.random(20_000) < 0.1, rng.integers(0, 8, 20_000), y)
    scale, wrong = language.temperature(z, y)
    assert 2.5 < scale < 3.6 and 0.07 < wrong < 0.13
    r = language.reliability(z, y, scale, 0.0)
    assert sum(b[2] for b in r["bins"]) == 20_000 and all(abs(b[4] - ((1 - wrong) * b[3] + wrong / 8)) < 0.03 for b in r["bins"] if b[2] > 1000)


def test_held_out_documents_keep_their_labels(model):
    m = model
    assert set(m.held["languages"]) == set(language.LANGUAGES) and 0 < m.margin < 2 and m.held["rejected"] < 0.02 and 0 < m.held["wrong_labels"] < 0.4
