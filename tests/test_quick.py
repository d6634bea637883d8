"""Quick ways of the search: they give the values of the plain ones."""

import numpy as np
import pytest

from bandlens.expr.ast import FormulaSet, with_constants
from bandlens.expr.compile_numpy import evaluate
from bandlens.expr.parse import parse
from bandlens.functions.guards import operator
from bandlens.search import train
from bandlens.search.generate import Space
from bandlens.search.islands import Judge, Settings, out
from bandlens.search.losses import LOSSES
from bandlens.search.train import Search


def test_quick_costs_agree_with_the_losses():
    """Kept exponentials, values too large for them, constants everywhere, and costs as functions of constants."""
    rng = np.random.default_rng(0)
    x, y = rng.uniform(-2, 2, (1000, 3)), rng.integers(0, 3, 1000).astype(float)
    names = ["a", "b", "c"]
    for w in (None, rng.uniform(0, 2, 1000)):
        s = Settings(metric="cross_entropy", out_func="softmax", order=3)
        judge = Judge(x, y, w, s)
        for texts in (("a", "b * 2.5", "c + a"), ("a * 1000", "b", "c * 0.5"), ("3.5", "a", "b / c"), ("400.0", "500.0", "a")):
            f = FormulaSet(tuple(parse(t, names) for t in texts))
            p = np.stack([np.broadcast_to(v, 1000) for v in evaluate(f, x).T], 1)
            wanted = LOSSES["cross_entropy"](y, out(p, "softmax"), w)
            assert judge.quick([judge.values.value(g) for g in f.formulas]) == pytest.approx(wanted, rel=1e-12)
            assert judge.error(f) == np.float32(wanted)
            v = np.array(f.constants()) * 1.5
            assert judge.of_constants(f)(v) == judge.cost(f.with_constants(v.tolist()))
        f = parse("(a * 2.5 + b) / (c - 0.25)", names)
        judge = Judge(x, y, w, Settings())
        assert judge.error(f) == np.float32(LOSSES["mse"](y, evaluate(f, x), w))
        v = np.array([1.5, 0.75])
        assert judge.of_constants(f)(v) == judge.cost(with_constants(f, v.tolist()))


def test_guards_where_a_sum_of_squares_leaves_it_open():
    for name, a, b, wanted in (("add", 9e9, 0.0, 9e9), ("add", 1e10, 0.0, 0.0), ("mul", 2e10, 0.1, 0.0), ("mul", 9e9, 1.0, 9e9), ("div", 9e9, 1.0, 9e9), ("div", 1e10, 1.0, 1.0), ("div", 1.0, -1e-11, 1.0)):
        assert (operator(name).numpy(np.full(5, a), np.full(5, b)) == wanted).all(), (name, a, b)


def test_generations_read_the_staged_columns(spark, monkeypatch):
    """The source is computed once for all generations' judging, however many there are."""
    judged = []
    monkeypatch.setattr(train, "evaluate_batch", lambda df, formulas, *rest: judged.append(df) or [1.0] * len(formulas))
    df = spark.range(200).selectExpr("id / 100.0 as a", "id % 7 / 7.0 as b", "id / 50.0 as y")
    Search(Space(["a", "b"]), Settings(populations=1, population_size=5, cycles=2)).run(df, ["a", "b"], "y", iterations=2)
    assert len({id(d) for d in judged}) == 1 and "FileScan parquet" in judged[0]._jdf.queryExecution().toString()
