"""Generation, variation, local optimisation, islands, estimators, persistence, sources, streams."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandlens.estimators import Estimator, FormulaClassifier, FormulaRegressor, FormulaTransformer, duration
from bandlens.expr.ast import Constant, FormulaSet, Limits, Operation, places
from bandlens.expr.compile_spark import with_formula
from bandlens.expr.parse import parse
from bandlens.operators.metrics import METRICS, mse
from bandlens.search.generate import Space, count_shapes, random_shape
from bandlens.search.islands import Island, Judge, Settings
from bandlens.search.local import optimise_aggregations, optimise_constants
from bandlens.search.losses import LOSSES
from bandlens.search.train import Search, decode, encode, evaluate_batch, pareto
from bandlens.search.vary import SET_WEIGHTS, TREE_WEIGHTS, Variation
from bandlens.sources.formulas import load_formulas, write_archive

NAMES = ["x0", "x1", "x2"]


def test_shapes():
    assert [count_shapes(n, (1, 2)) for n in range(1, 7)] == [1, 1, 2, 4, 9, 21]
    assert random_shape(4, (2,), np.random.default_rng(0)) is None
    seen = {random_shape(4, (1, 2), np.random.default_rng(i)) for i in range(200)}
    assert len(seen) == 4


@pytest.mark.parametrize("kw", [{}, {"operators": ["add", "sqrt", "exp", "mul"], "limits": Limits(15, {"exp": 2.5, "variable": 0.5}, {"exp": 4}, {"exp": {"exp": 0}})}, {"stats": ["mean", "d1_slope"], "window_stats": ["max"]}, {"use_constants": False}])
def test_random_formulas_are_valid_and_reproducible(kw):
    space = Space(NAMES, max_complexity=15, **kw)
    a = [space.random(np.random.default_rng(i)) for i in range(80)]
    assert a == [Space(NAMES, max_complexity=15, **kw).random(np.random.default_rng(i)) for i in range(80)]
    for t in a:
        assert space.limits.valid(t)
        for _, n in places(t):
            if isinstance(n, Operation):
                assert not all(isinstance(c, Constant) for c in n.operands)
        assert decode(encode(t)) == t
    assert len(set(a)) > 20
    assert space.random_of_size(7, np.random.default_rng(0)).size == 7


@pytest.mark.parametrize("name", sorted(TREE_WEIGHTS))
def test_mutations(name):
    space = Space(NAMES, ["add", "sub", "mul", "sqrt"], max_complexity=15, stats=["mean", "std"], window_stats=["max"], halves=[1, 2, 3])
    v, rng, changed = Variation(space), np.random.default_rng(1), 0
    for _ in range(150):
        x = space.random(rng)
        new = getattr(v, name)(x, rng)
        changed += new is not None and new != x
        if new is not None:
            for _, n in places(new):
                if hasattr(n, "check"):
                    n.check(3)
    assert changed or name in ("do_nothing_tree", "simplify_tree")


def test_set_variation():
    space = Space(NAMES, max_complexity=30)
    v, rng = Variation(space, set_crossover_probability=0.5), np.random.default_rng(2)
    for kind in ("single_point", "two_point", "multi_point"):
        v.set_crossover = kind
        for _ in range(30):
            s, t = space.random_set(4, rng), space.random_set((1, 4), rng)
            assert s.order == 4 and 1 <= t.order <= 4
            for name in SET_WEIGHTS:
                new = getattr(v, name)(t, rng)
                assert new is None or (isinstance(new, FormulaSet) and len(new.slots) == 4)
            pair = v.crossover_sets(s, t, rng)
            assert pair is None or all(p.valid(space.limits) for p in pair)
            _, new = v.mutate_set(s, rng)
            assert new is None or new.order == 4


@pytest.mark.parametrize("method", ["L-BFGS-B", "Nelder-Mead"])
def test_constants_are_fitted(method):
    x = np.random.default_rng(0).normal(size=(80, 3))
    y = 3.5 * x[:, 0] - 1.25
    from bandlens.expr.compile_numpy import evaluate

    f, cost = optimise_constants(parse("x0 * 1 + 1", NAMES), lambda t: LOSSES["mse"](y, evaluate(t, x)), np.random.default_rng(1), method, 2, 60)
    assert cost < 1e-4


def test_aggregations_are_fitted():
    from bandlens.expr.compile_numpy import evaluate

    names = [f"b{i}" for i in range(12)]
    x = np.random.default_rng(0).normal(size=(60, 12))
    y = x[:, 4:9].mean(1)
    space = Space(names, stats=["mean"])
    f, cost = optimise_aggregations(parse("mean(v2-v5)", names), lambda t: LOSSES["mse"](y, evaluate(t, x)), space, np.random.default_rng(0))
    assert cost < 1e-12


def test_aggregations_of_a_set_are_fitted():
    names = [f"b{i}" for i in range(12)]
    x = np.random.default_rng(0).normal(size=(60, 12))
    y = np.stack([x[:, 4:9].mean(1), x[:, 1:4].mean(1)], 1)

    def loss(y, p, w):
        return float(((y - p) ** 2).mean())

    space = Space(names, stats=["mean"])
    start = FormulaSet((parse("mean(v2-v5)", names), parse("mean(v2-v5)", names)))
    island = Island(space, Settings(order=2, custom=loss, optimise_constants=False, optimiser_probability=1.0, population_size=1), Judge(x, y, None, Settings(custom=loss)), np.random.default_rng(0))
    island.start([start])
    island.polish(0)
    assert island.members[0].cost < 1e-12


def _table(spark, n=200, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    return spark.createDataFrame(pd.DataFrame(x, columns=NAMES).assign(id=range(n), y=x[:, 0] + 2 * x[:, 1], k=(x[:, 0] + x[:, 1] > 0).astype(int)))


SMALL = {"iterations": 2, "populations": 3, "population_size": 10, "cycles": 15, "max_complexity": 11, "tournament_n": 5}


def test_regressor(spark, tmp_path):
    d = _table(spark)
    e = FormulaRegressor(NAMES, logging=True, seed=1, **SMALL).fit(d, "y")
    rows = e.entries()
    assert all(a["complexity"] < b["complexity"] and a["error"] > b["error"] for a, b in zip(rows, rows[1:]))
    for r in rows:  # a stored error is what the compiled formula gives
        v = with_formula(d, decode(r["json"]), "v").agg(mse(F.col("y"), F.col("v")).alias("m")).first()["m"]
        assert np.isclose(v, r["error"], rtol=1e-5)
    assert rows[-1]["error"] < d.agg(F.var_pop("y")).first()[0]
    assert e.predict(d).count() == 200 and e.score(d, "y") > 0.3
    assert [x["expression"] for x in FormulaRegressor(NAMES, seed=1, **SMALL).fit(d, "y").entries()] == [x["expression"] for x in rows]
    log = e.log(spark)
    assert log.count() and log.columns[:23][-1] == "offspring2_order" and "operation_name" in log.columns
    e.save(spark, str(tmp_path / "m"), keep_populations=True, keep_log=True)
    f = Estimator.load(spark, str(tmp_path / "m"))
    assert f.predict(d).collect() == e.predict(d).collect() and f.warm_start
    assert f.fit(d, "y").search.generation == 2
    write_archive(e.archive(spark), str(tmp_path / "csv"))
    g = FormulaRegressor(NAMES, max_complexity=11).from_csv(spark, str(tmp_path / "csv"))
    assert [x["expression"] for x in g.entries()] == [x["expression"] for x in rows]
    with pytest.raises(ValueError):
        load_formulas(spark, str(tmp_path / "csv"), NAMES, "nothing")
    with pytest.raises(ValueError):
        e.predict(d.drop("x1"))
    assert "complexity" in repr(e) and "<table>" in e._repr_html_()


def test_classifier(spark):
    d = _table(spark)
    e = FormulaClassifier(NAMES, seed=2, **{**SMALL, "max_complexity": 20}).fit(d, "k")
    p = e.predict_proba(d).toPandas()["probability"]
    assert np.allclose(np.stack(p).sum(1), 1) and e.score(d, "k") > 0.6
    one = FormulaClassifier(NAMES, seed=2, out_func="sigmoid", **SMALL).fit(d, "k")
    assert not isinstance(one.best(), FormulaSet) and one.score(d, "k") > 0.6
    assert {r["label"] for r in one.report(d, "k").collect()} <= {0, 1}
    missing = d.withColumn("x0", F.when(F.col("id") > 0, F.col("x0")))
    assert e.predict(missing).filter("id = 0").first()["prediction"] is None
    words = d.withColumn("k", F.when(F.col("k") == 1, "yes").otherwise("no"))
    assert set(FormulaClassifier(NAMES, seed=2, **SMALL).fit(words, "k").predict(words).select("prediction").distinct().toPandas()["prediction"]) <= {"yes", "no"}


def test_transformer_and_stop(spark):
    d = _table(spark)
    seen = []
    e = FormulaTransformer(NAMES, seed=3, stop=0.2, callbacks=[lambda s: seen.append(s.generation)], **{**SMALL, "iterations": 4}).fit(d, "y")
    assert len(seen) == 1 and "feature" in e.transform(d).columns
    z = FormulaTransformer(NAMES, seed=3, out_func="zscore", **SMALL).fit(d, "y").transform(d)
    assert abs(z.agg(F.avg("feature")).first()[0]) < 1e-3
    with pytest.raises(ValueError):
        FormulaRegressor(NAMES, unknown=1)


def test_own_loss(spark):
    d = _table(spark)
    e = FormulaRegressor(NAMES, seed=4, custom=lambda y, p, w, power=2: float((np.abs(y - p) ** power).mean()), metric_params={"power": 4}, **SMALL).fit(d, "y")
    r = e.entries()[-1]
    assert np.isclose(with_formula(d, decode(r["json"]), "v").agg(F.avg(F.pow(F.col("y") - F.col("v"), F.lit(4)))).first()[0], r["error"], rtol=1e-4)


def test_batch_evaluation_over_partitions(spark):
    d = _table(spark).withColumn("w", F.col("id") % 3 + 0.0)
    for m in ("mse", "rmse", "mae", "pearson"):
        f = [parse("x0", NAMES), parse("x0 + x1", NAMES), Constant(1.0)]
        a = evaluate_batch(d.repartition(5), f, NAMES, "y", "w", m)
        p = d.toPandas()
        from bandlens.expr.compile_numpy import evaluate

        assert np.allclose(a, [LOSSES[m](p.y.to_numpy(), evaluate(t, p[NAMES].to_numpy()), p.w.to_numpy()) for t in f])
    with pytest.raises(ValueError):
        evaluate_batch(d, f, NAMES, "y", None, "silhouette")


def test_winners_are_chosen_over_all_rows(spark):
    d = _table(spark)
    search = Search(Space(NAMES, max_complexity=11), Settings(), 0)
    good, bad = parse("x0 + x1", NAMES), parse("x2 - x0", NAMES)  # equally complex; the bad one is better on the sample
    search.merge(d, NAMES, "y", None, [([1, 3], encode(bad), 0.1), ([1, 3], encode(good), 0.2)])
    (f, cost), = search.archive.values()
    assert f == good and np.isclose(cost, evaluate_batch(d, [good], NAMES, "y", None, "mse")[0], rtol=1e-5)


@pytest.mark.parametrize("kw", [{"metric": "spearman"}, {"metric": "fisher"}, {"metric": "silhouette"}, {"metric": "davies_bouldin"}, {"metric": "calinski_harabasz"}, {"metric": "mse", "penalty": "l2"}, {"metric": "pearson", "penalty": "l1"}, {"metric": "mse", "out_func": "zscore"}, {"metric": "separability", "out_func": "zscore"}])
def test_archive_errors_are_those_of_all_rows(spark, kw):
    d = _table(spark)
    p, settings = d.toPandas(), Settings(**kw)
    y = "k" if METRICS[settings.metric].kind == "table" else "y"
    search = Search(Space(NAMES, max_complexity=11), settings, 0)
    formulas = [parse("x0 * 2.5", NAMES), parse("x0 + x1 * 1.5", NAMES)]
    search.merge(d.repartition(5), NAMES, y, None, [([1, 3], encode(f), 0.123) for f in formulas])
    judge = Judge(p[NAMES].to_numpy(), p[y].to_numpy(float), None, settings)
    assert len(search.archive) == 2
    for f, cost in search.archive.values():
        assert np.isclose(cost, judge.cost(f), rtol=1e-4)


@pytest.mark.parametrize("name", ["search_regression", "search_classification"])
def test_registered_searches_have_the_default_parameters(spark, data, name, monkeypatch):
    from bandlens import catalog

    seen = []

    def run(self, df, features, y, weight=None, iterations=None, stop=None, callbacks=None, every=1, sample_rows=None, place=None):
        seen.append((iterations, sample_rows, self.s.populations, self.s.population_size, self.s.cycles))
        raise InterruptedError

    monkeypatch.setattr(Search, "run", run)
    with pytest.raises(InterruptedError):
        catalog.QUERIES[name](spark, data)
    assert seen == [(100, 20_000, 31, 27, 380)]


def _raster(spark, n=14):
    g = np.random.default_rng(4).normal(size=(n, n, 3))
    g[2, 3, 1] = np.nan
    p = np.pad(g[..., 0], 1, constant_values=np.nan)
    y = np.nanmax(np.stack([p[i : i + n, j : j + n] for i in range(3) for j in range(3)]), 0)
    rows = [(1, r, c, *map(float, g[r, c]), float(y[r, c]) if (r + c) % 3 else None) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "scene int, row int, col int, x0 double, x1 double, x2 double, y double")


def test_search_on_a_raster(spark, tmp_path):
    d = _raster(spark)
    e = FormulaRegressor(NAMES, window_stats=["max", "mean"], halves=[1, 2], by=["scene"], seed=1, **{**SMALL, "max_complexity": 5, "iterations": 2, "cycles": 60, "mean_share": 0.3}).fit(d, "y")
    rows = e.entries()
    assert any("_sp(" in r["expression"] for r in rows)
    for r in rows:  # the stored error is that of the formula on the whole raster
        got = e.scored(d, "v", [x["expression"] for x in e.entries()].index(r["expression"])).filter("y is not null and not isnan(x1)")
        assert np.isclose(got.agg(mse(F.col("y"), F.col("v")).alias("m")).first()["m"], r["error"], rtol=1e-4)
    assert rows[-1]["error"] < 0.05
    e.save(spark, str(tmp_path / "m"))
    assert Estimator.load(spark, str(tmp_path / "m")).predict(d).count() == 196
    c = FormulaClassifier(NAMES, stats=["mean"], window_stats=["mean"], by=["scene"], seed=1, **{**SMALL, "max_complexity": 20, "iterations": 1}).fit(d.withColumn("k", (F.col("y") > 0.9).cast("int")), "k")
    assert c.predict(d).filter("prediction is not null").count() == 195


@pytest.mark.parametrize("stat", ["mean", "max", "min", "sum", "median", "range"])
def test_windows_of_patches_are_those_of_the_raster(spark, stat):
    from bandlens.expr.ast import Aggregation
    from bandlens.expr.compile_numpy import Memo
    from bandlens.search.train import training_patches

    d = _raster(spark, 7)
    x, t, w, patches = training_patches(d, NAMES, "y", None, 100, 0, 2, "row", "col", ["scene"])
    for f in (Aggregation(spatial=stat, half=2, band=1), Aggregation("mean", 0, 2, stat, 1)):
        e = FormulaRegressor(NAMES, by=["scene"])
        got = e._with_value(d, f, "v").filter("y is not null and not isnan(x1)").select("x0", "v").toPandas()
        assert np.allclose(np.sort(got["v"]), np.sort(Memo(x, patches)(f))) and len(got) == len(x)


def test_odds_of_mutations_are_used(spark):
    d = _table(spark)
    none = dict.fromkeys(TREE_WEIGHTS, 0.0)
    e = FormulaRegressor(NAMES, logging=True, seed=1, **SMALL, **{**none, "randomize_tree": 1.0}, perturbation_factor=0.5, set_crossover_method="two_point").fit(d, "y")
    names = {r["operation_name"] for r in e.log(spark).filter("operation_type = 'mutation'").collect()}
    assert names == {"randomize_tree"}
    with pytest.raises(ValueError):
        FormulaRegressor(NAMES, set_crossover_method="other")


def test_log_names_and_second_parents(spark):
    e = FormulaRegressor(NAMES, logging=True, seed=1, crossover_probability=0.5, optimiser_probability=0.5, stats=["mean", "max"], verbose=True, **SMALL).fit(_table(spark), "y")
    log = e.log(spark).toPandas()
    assert set(log["operation_type"]) >= {"mutation", "crossover", "optimize_constants"}
    assert log.loc[log["operation_type"] == "crossover", "offspring2_fitness"].notna().all()
    assert set(log.loc[log["operation_type"] == "optimize_constants", "operation_name"]) == {"constant_optimization"}
    assert len({json.dumps(p) for p in e.search.pools}) > 1


def test_constraints_are_met_by_counting():
    limits = Limits(15, None, {"exp": 4, "mul": (3, -1)}, {"exp": {"exp": 0, "sqrt": 1}, "sqrt": {"sqrt": 0}})
    space = Space(NAMES, ["exp", "sqrt", "mul"], max_complexity=15, limits=limits)
    rng = np.random.default_rng(0)
    drawn = [space._draw(int(space.complexities[-1]), rng) for _ in range(300)]
    assert all(limits.valid(t) for t in drawn) and len(set(drawn)) > 200
    # Small sizes against all trees: as many as counted.
    tiny = Space(["x0"], ["exp", "mul"], max_complexity=5, use_constants=False, limits=Limits(5, None, {"mul": (2, -1)}, {"exp": {"exp": 0}}))

    def trees(n):
        if n == 1:
            yield parse("x0", ["x0"])
        for t in trees(n - 1) if n > 1 else ():
            yield Operation("exp", (t,))
        for i in range(1, n - 1):
            for a in trees(i):
                for b in trees(n - 1 - i):
                    yield Operation("mul", (a, b))

    for n in range(1, 6):
        assert sum(c[10 * n] for c in tiny.counts.values()) == sum(tiny.limits.valid(t) for t in trees(n))


def test_pareto_of_sets():
    a = {(1, 5.0): (None, 1.0), (2, 3.0): (None, 2.0), (2, 6.0): (None, 1.0), (1, 7.0): (None, 0.5)}
    assert pareto(a) == {(1, 5.0), (2, 3.0), (1, 7.0)}
    assert duration(93784) == "1d:2h:3m:4s" and duration(60) == "1m" and duration(0) == "0s"


@pytest.mark.parametrize("windows", [False, True])
def test_command_line(spark, tmp_path, windows):
    from bandlens.train import main

    d = _raster(spark, 24).withColumn("k", F.when(F.col("y").isNotNull(), (F.col("y") > 1).cast("int"))).withColumn("id", F.monotonically_increasing_id())
    d.write.parquet(str(tmp_path / "t"))
    arguments = ["--table", str(tmp_path / "t"), "--out", str(tmp_path / "o"), "--key", "id", "--label", "k", "--features", *NAMES, "--train-size", "20", "--iterations", "2", "--populations", "2", "--population-size", "8", "--cycles", "5"]
    if windows:
        arguments += ["--spatial", "--block-size", "4", "--buffer", "1", "--by", "scene", "--window-stats", "max", "--save-every", "1", "--verbose"]
    r = main(arguments, spark)
    assert 0 <= r["test_accuracy"] <= 1 and spark.read.csv(str(tmp_path / "o" / "archive"), header=True).count() > 0
    if windows:
        assert (tmp_path / "o" / "generation=1").exists() and (tmp_path / "o" / "generation=2").exists()
