"""Metrics against numpy, and the invariants of preparation, archive and log."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandlens.operators import archive, metrics, prep, runlog
from bandlens.search.losses import LOSSES


def _binary(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.4).astype(float)
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    return spark.createDataFrame(pd.DataFrame({"y": y, "p": p, "w": rng.random(n)})), y, p


@pytest.mark.parametrize("name", ["mae", "mse", "rmse", "cross_entropy", "focal_loss", "hinge_loss", "accuracy", "pearson"])
def test_row_metrics(spark, name):
    d, y, p = _binary(spark)
    w = d.toPandas()["w"].to_numpy()
    got = d.agg(metrics.METRICS[name].function(F.col("y"), F.col("p"), F.col("w")).alias("v")).first()["v"]
    assert np.isclose(got, LOSSES[name](y, p, w))


@pytest.mark.parametrize("name", ["cross_entropy", "nll_loss", "focal_loss", "hinge_loss", "accuracy"])
def test_multi_class_metrics(spark, name):
    rng = np.random.default_rng(2)
    s = rng.normal(size=(100, 3))
    p = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    y = rng.integers(0, 3, 100)
    v = {"nll_loss": np.log(p), "hinge_loss": s}.get(name, p)
    d = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, v)], "y int, p array<double>")
    got = d.agg(metrics.METRICS[name].function(F.col("y"), F.col("p"), None, True).alias("v")).first()["v"]
    assert np.isclose(got, LOSSES[name](y, v))


@pytest.mark.parametrize("name", [*metrics.TWO_CLASS, "earth_movers", "spearman", "silhouette", "davies_bouldin", "calinski_harabasz"])
def test_separability(spark, name):
    d, y, p = _binary(spark, seed=4)
    got = metrics.METRICS[name].function(d, "y", "p").first()[0]
    assert np.isclose(got, LOSSES[name](y, p), rtol=1e-7)


def test_separability_edges(spark):
    schema = "y double, p double"
    for rows in ([(0.0, 1.0), (1.0, 1.0)], [(0.0, 1.0), (0.0, 2.0)], [(2.0, 1.0), (1.0, 3.0)]):
        r = metrics.two_class(spark.createDataFrame(rows, schema), "y", "p", list(metrics.TWO_CLASS)).first()
        assert all(v == -np.inf for v in r), rows
    assert spark.createDataFrame([(1.0, 2.0, 0.0)], "y double, p double, w double").agg(metrics.hinge_loss(F.col("y"), F.col("p"), F.col("w")).alias("v")).first()["v"] == 0.0
    assert metrics.penalty([2.0, -1.0], "l1", 0.5) == 3.0 and metrics.penalty([2.0, -1.0], "l2", 0.5) == 5.0 and metrics.penalty([], "l2") == 0
    with pytest.raises(ValueError):
        metrics.metric("nothing")


def test_confusion(spark):
    r = {x["label"]: x for x in metrics.confusion(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int"), "y", "p").collect()}
    assert r[1]["precision"] == 1 / 3 and r[1]["recall"] == 1.0 and r[0]["recall"] == 0.5 and r[2]["f1"] == 0.0 and r[2]["support"] == 1


def test_splits(spark):
    d = spark.createDataFrame([(i, i % 3 if i < 90 else None) for i in range(100)], "id int, label int")
    s = prep.split(d, "id", "label", 10).toPandas()
    assert len(s) == 100 and (s[s.split == "train"].groupby("label").size() == 10).all() and s[s.label.isna()].split.isna().all()
    assert prep.split(d, "id", "label", 10).orderBy("id").collect() == prep.split(d.repartition(7), "id", "label", 10).orderBy("id").collect()
    p = prep.split(d, "id", "label", 40, "proportional").toPandas()
    assert (p.split == "train").sum() == 40
    assert (prep.split(d, "id", "label", 0.5, "random").toPandas().split == "train").sum() == 45
    with pytest.raises(ValueError):
        prep.split(d, "id", "label", 31).collect()
    both = prep.split(d, "id", "label", 31, insufficient="both").toPandas()
    assert len(both) == 190
    top = prep.split(d, "id", "label", 28, min_test=5).toPandas()
    assert (top[top.split == "test"].groupby("label").size() == 5).all() and (top[top.split == "train"].groupby("label").size() == 28).all()


def test_standardise(spark):
    d = spark.createDataFrame([(1.0, 5.0, True), (3.0, 5.0, True), (100.0, 5.0, False)], "x double, k double, t boolean")
    r = prep.standardise(d, ["x", "k"], F.col("t")).orderBy("x").collect()
    assert [x["x"] for x in r] == [-1.0, 1.0, 98.0] and all(x["k"] == 0 for x in r)
    with pytest.raises(ValueError):
        prep.standardise(d, ["x"], F.col("t"), F.col("x") < 2)


@pytest.mark.parametrize(("size", "buffer"), [(4, 1), (4, 3), (3, 5)])
def test_spatial_split(spark, size, buffer):
    n = 28
    d = spark.createDataFrame([(r, c, (r // 8 + c // 8) % 2 if (r + c) % 9 else None) for r in range(n) for c in range(n)], "row int, col int, label int")
    s = prep.spatial_split(d, "label", 20, size=size, buffer=buffer, neighbour_penalty=0.5).toPandas()
    assert len(s) == n * n and s[s.label.isna()].split.isna().all()
    train, test = s[s.split == "train"], s[s.split == "test"]
    assert (train.groupby("label").size() == 20).all() and set(test.label) == {0, 1}
    assert s.equals(prep.spatial_split(d.repartition(5), "label", 20, size=size, buffer=buffer, neighbour_penalty=0.5).toPandas().set_index(["row", "col"]).loc[list(zip(s.row, s.col))].reset_index()[s.columns])
    blocks = {(r // size, c // size) for r, c in zip(train.row, train.col)}
    gap = lambda x, b: max(b * size - x, x - b * size - size + 1, 0)
    assert all(max(gap(r, a), gap(c, b)) > buffer for r, c in zip(test.row, test.col) for a, b in blocks)
    p = prep.spatial_split(d, "label", 30, per_class=False, size=size, buffer=buffer).toPandas()
    assert (p.split == "train").sum() == 30


def test_spatial_split_of_small_classes(spark):
    d = spark.createDataFrame([(r, c, 1 if r < 2 and c < 3 else 0) for r in range(12) for c in range(12)], "row int, col int, label int")
    with pytest.raises(ValueError):
        prep.spatial_split(d, "label", 6, size=4, buffer=1)
    s = prep.spatial_split(d, "label", 6, size=4, buffer=1, insufficient=True, min_test=4).toPandas()
    one = s[s.label == 1]
    assert (one.split == "train").sum() == 6 and (one.split == "test").sum() == 4  # all of them train, four test again
    assert (s[s.label == 0].split == "train").sum() == 6


def test_many_classes(spark):
    d = spark.range(36_030).select("id", (F.col("id") % 12_010).alias("label"))
    s = prep.split(d, "id", "label", 2).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s} == {"train": 24_020, "test": 12_010}
    got, table = prep.encode_labels(d.withColumn("label", F.concat(F.lit("c"), F.lpad(F.col("label").cast("string"), 6, "0"))), "label", "k")
    assert table.count() == 12_010 and got.filter("k <> id % 12010").count() == 0


def test_exact_quantile(spark):
    from bandlens.plans.ordered import quantile

    x = np.round(np.random.default_rng(0).exponential(size=997), 2)
    d = spark.createDataFrame(pd.DataFrame({"x": x}))
    for q in (0.0, 0.25, 0.731, 1.0):
        assert np.isclose(quantile(d, "x", q).first()[0], np.quantile(x, q))
    assert quantile(d.limit(0), "x", 0.5).first()[0] is None


def test_moments_far_from_zero(spark):
    x = np.random.default_rng(0).normal(size=400)
    d = spark.createDataFrame(pd.DataFrame({"y": 1e9 + x, "p": 1e9 + 2 * x}))
    assert np.isclose(d.agg(metrics.pearson(F.col("y"), F.col("p")).alias("r")).first()["r"], 1, atol=1e-6)
    assert np.isclose(d.agg(metrics.r_squared(F.col("y"), F.col("y") + F.rint(F.col("y")) * 0).alias("r")).first()["r"], 1)


def test_otsu(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 500), rng.normal(8, 1, 500)])
    d = spark.createDataFrame(pd.DataFrame({"x": np.concatenate([x, [np.nan, np.inf]])}))
    h, e = np.histogram(x, 256)
    c, p = (e[1:] + e[:-1]) / 2, h / h.sum()
    v = [0.0] + [p[:i].sum() * p[i:].sum() * ((c[:i] * p[:i]).sum() / max(p[:i].sum(), 1e-300) - (c[i:] * p[i:]).sum() / max(p[i:].sum(), 1e-300)) ** 2 for i in range(1, 256)]
    assert np.isclose(prep.otsu(d, "x").first()["threshold"], c[int(np.argmax(np.round(v, 12)))])


def test_batches_and_rectangles(spark):
    b = prep.mini_batches(spark.range(103), "id", 10).groupBy("batch").count().toPandas()["count"]
    assert sorted(b) == [3] + [10] * 10
    assert len(prep.rectangles(10, 10, 8, 8)) == 9 and len(set(prep.rectangles(1500, 700, 8, 8))) == 100
    assert np.isclose(np.mean([prep.poisson(2.0, np.random.default_rng(i)) for i in range(2000)]), 2.0, atol=0.15)


def test_archive(spark):
    rows = [(1, 3.0, "a"), (1, 1.0, "b"), (2, 2.0, "c"), (3, 0.5, "d"), (4, 0.5, "e"), (5, float("nan"), "f"), (6, None, "g"), (7, 0.0, None)]
    d = spark.createDataFrame(rows, "complexity int, error double, expression string")
    f = archive.pareto_front(d)
    assert [r["expression"] for r in f.orderBy("complexity").collect()] == ["b", "d"]
    s = {r["complexity"]: r["score"] for r in archive.scores(f).collect()}
    assert s[1] == 0 and np.isclose(s[3], np.log(2) / 2)
    t = spark.createDataFrame([(1, 0.5, 0.8, "a"), (2, 0.3, 0.9, "b"), (3, 0.8, 0.6, "c"), (4, 0.1, 0.95, "d")], "complexity int, error double, score double, expression string")
    assert archive.select_model(t, "accuracy").first()["expression"] == "d" == archive.select_model(t, "score").first()["expression"] == archive.select_model(t, "best").first()["expression"]


def test_log_analyses(spark):
    n = 250
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"log_id": range(n), "run_id": rng.integers(0, 2, n), "generation": 1, "timestamp": rng.random(n).round(2), "operation_type": "mutation", "operation_name": rng.choice(["Add node", "add_node ", "swap-operands"], n), "accepted": rng.random(n) < 0.6, "fitness_delta": rng.normal(size=n), "complexity_delta": rng.integers(-7, 7, n), "order_delta": rng.integers(-2, 3, n).astype(float), "temperature": rng.random(n)})
    p.loc[0, "fitness_delta"] = np.nan
    p.loc[1, "fitness_delta"] = np.inf
    d = runlog.normalised(spark.createDataFrame(p))
    e = {r["operation_name"]: r for r in runlog.effectiveness(d).collect()}
    assert set(e) == {"add_node", "swap_operands"} and sum(r["total_attempts"] for r in e.values()) == n
    good = p.fitness_delta[np.isfinite(p.fitness_delta)]
    assert np.isclose(runlog.summary(d).first()["avg_fitness_delta"], good.mean())
    assert runlog.temperature_bins(d).count() == 10 and runlog.complexity_bins(d).count() == 6
    g = runlog.global_trends(d, 50).orderBy("place").toPandas()
    q = p.sort_values(["timestamp", "log_id"])
    f = q.fitness_delta.where(np.isfinite(q.fitness_delta)).rolling(50).mean()
    assert np.allclose(g.avg_fitness_delta, f.dropna())
    assert "Effectiveness" in runlog.report(d)
    const = spark.createDataFrame([(True, 1.0, 2), (True, 1.0, 3)], "accepted boolean, fitness_delta double, complexity_delta int")
    assert runlog.complexity_correlation(const).first()["correlation"] is None
