"""Problem 1: the alone records come out of the varied subset's search."""

import numpy as np
import pandas as pd

from bandlens.llm import queries, varied

SIDES = {"a": 0.1, "b": 0.1}


def _points():
    """Two groups of crowded records, and some far from all others."""
    rng = np.random.default_rng(8)
    a, b = np.concatenate([rng.normal(0, 0.2, (300, 2)), rng.uniform(1, 40, (60, 2))]).T
    return pd.DataFrame({"id": np.arange(360), "g": rng.integers(0, 2, 360), "a": a, "b": b})


def _alone(p):
    return {int(r.id) for r in p.itertuples() if not ((p.g == r.g) & (p.id != r.id) & ((p.a - r.a).abs() < 0.1) & ((p.b - r.b).abs() < 0.1)).any()}


def test_a_subset_that_grows_has_all_alone_records_and_no_more_than_its_size_else(spark):
    p = _points()
    wanted, df = _alone(p), spark.createDataFrame(p)
    for size in (5, 150):
        s = varied.varied_subset(df, size, "id", "g", SIDES, grow=True).toPandas()
        assert set(s[s.alone].id) == wanted and len(s) == max(size, len(wanted))


def test_p1_found_is_the_alone_part_of_the_subset(spark, monkeypatch):
    p = _points().rename(columns={"id": "sample_id", "g": "label", "a": "NIR", "b": "SWIR1"})
    df, seen, subset = spark.createDataFrame(p), [], varied.varied_subset

    def spied(*a, **k):
        seen.append(subset(*a, **k))
        return seen[-1]

    monkeypatch.setattr(queries, "_pixels", lambda *a: df)
    monkeypatch.setattr(queries, "_SIDES", {"NIR": 0.1, "SWIR1": 0.1})
    monkeypatch.setattr(varied, "varied_subset", spied)
    got = {r["sample_id"] for r in queries.p1_found(spark, "").collect()}
    assert len(seen) == 1 and {r["sample_id"] for r in seen[0].filter("alone").collect()} == got == _alone(_points())


def test_nothing_is_searched_where_the_fixed_records_fill_the_size():
    n = 30_000
    fixed = np.arange(n) < n - 1
    assert (varied.disperse(np.random.default_rng(0).random((n, 2)), np.arange(n), fixed, n - 1) == fixed).all()
