"""Band reductions and two-dimensional windows against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandlens.expr.compile_numpy import reduce_bands
from bandlens.functions import bands
from bandlens.operators import windows


@pytest.mark.parametrize("name", ["mean", "sum", "max", "min", "median", "std", "var", "range", "slope", "percentile25", "percentile97.5", "d1_mean", "d1_min", "d2_slope", "d3_median", "d1_percentile50"])
def test_reductions(spark, name):
    x = np.random.default_rng(3).normal(size=(40, 9))
    x[3, 4] = np.nan
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, b array<double>")
    got = d.select("id", bands.reduce(F.col("b"), name, 1, 7).alias("v")).orderBy("id").toPandas()["v"]
    assert np.allclose(got, reduce_bands(x[:, 1:8], name), equal_nan=True)


def test_reduction_checks():
    bands.check("mean", 0, 1, 3)
    for bad in (("mean", 1, 1, 3), ("mean", 0, 3, 3), ("d2_mean", 0, 1, 3), ("slope", 0, 5, 3), ("d1_slope", 0, 1, 3), ("percentile101", 0, 1, 3), ("other", 0, 1, 3)):
        with pytest.raises(ValueError):
            bands.check(*bad)
    assert bands.label("mean", 1, 4) == "mean(v2-v5)" and len(bands.listed()) == 13


def test_valid_mask(spark):
    d = spark.createDataFrame([([1.0, 2.0],), ([1.0, float("nan")],), ([None, 1.0],), (None,)], "b array<double>")
    assert [r["m"] for r in d.select(bands.valid(F.col("b")).alias("m")).collect()] == [True, False, False, False]


def _grid(h=7, w=6, seed=0):
    x = np.random.default_rng(seed).normal(size=(h, w))
    x[0, 0] = x[3, 2] = np.nan
    x[5:, 4:] = np.nan
    return x


F_NAN = {"mean": np.nanmean, "max": np.nanmax, "min": np.nanmin, "sum": np.nansum, "median": np.nanmedian, "range": lambda a: np.nanmax(a) - np.nanmin(a), "std": np.nanstd}


def _frame(spark, x):
    return spark.createDataFrame(pd.DataFrame([(r, c, x[r, c]) for r in range(x.shape[0]) for c in range(x.shape[1])], columns=["row", "col", "v"]))


def _array(df, shape):
    out = np.full(shape, -9e9)
    for r in df.collect():
        out[r["row"], r["col"]] = r["out"]
    return out


@pytest.mark.parametrize("stat", windows.WINDOW_STATISTICS)
@pytest.mark.parametrize("half", [1, 2])
def test_windows(spark, stat, half):
    x = _grid()
    want = np.full(x.shape, np.nan)
    for r in range(x.shape[0]):
        for c in range(x.shape[1]):
            a = x[max(0, r - half) : r + half + 1, max(0, c - half) : c + half + 1]
            if not np.isnan(a).all():
                want[r, c] = F_NAN[stat](a)
    got = _array(windows.window(_frame(spark, x), stat, half, "v", "out"), x.shape)
    assert np.allclose(got, want, equal_nan=True)
    masked = windows.window(_frame(spark, x), stat, half, "v", "out", where="row % 2 = 0 and col > 1")
    assert all(np.isclose(r["out"], want[r["row"], r["col"]], equal_nan=True) for r in masked.collect())


@pytest.mark.parametrize("method", sorted(F_NAN))
@pytest.mark.parametrize("pad", ["reflect", "edge"])
def test_patches(spark, method, pad):
    x = _grid(6, 5)
    p = np.pad(x, 1, mode=pad)
    want = np.full(x.shape, np.nan)
    for r in range(x.shape[0]):
        for c in range(x.shape[1]):
            a = p[r : r + 3, c : c + 3]
            if not np.isnan(a).all():
                want[r, c] = F_NAN[method](a)
    got = _array(windows.patches(_frame(spark, x), 3, method, "v", "out", pad=pad), x.shape)
    assert np.allclose(got, want, equal_nan=True)
    strict = _array(windows.patches(_frame(spark, x), 3, method, "v", "out", pad=pad, skip_nan=False), x.shape)
    has = np.array([[np.isnan(p[r : r + 3, c : c + 3]).any() for c in range(x.shape[1])] for r in range(x.shape[0])])
    assert np.isnan(strict[has]).all() and np.allclose(strict[~has], want[~has])


def test_patch_sizes(spark):
    x = np.arange(25.0).reshape(5, 5)
    assert _array(windows.patches(_frame(spark, x), 3, "mean", "v", "out"), x.shape)[2, 2] == 12
    assert (_array(windows.patches(_frame(spark, x), 1, "mean", "v", "out"), x.shape) == x).all()
    for bad in (lambda: windows.patches(_frame(spark, x), 4, "mean", "v", "out"), lambda: windows.window(_frame(spark, x), "mode", 1, "v", "out"), lambda: windows.window(_frame(spark, x), "mean", 0, "v", "out")):
        with pytest.raises(ValueError):
            bad()


def test_windows_of_bands_and_exclusion(spark):
    x = np.random.default_rng(5).normal(size=(4, 5, 6))
    d = spark.createDataFrame([(r, c, x[r, c].tolist()) for r in range(4) for c in range(5)], "row int, col int, b array<double>")
    got = {(r["row"], r["col"]): r["out"] for r in windows.bands_window(d, "mean", 1, "b", "out", 1, 3).collect()}
    for (r, c), v in got.items():
        assert np.allclose(v, x[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2, 1:4].mean((0, 1)))
    left = {(r["row"], r["col"]) for r in windows.exclude_near(d, d.filter("row = 0 and col = 0"), 1).collect()}
    assert left == {(r, c) for r in range(4) for c in range(5) if max(r, c) > 1}
