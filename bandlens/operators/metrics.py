"""Losses and separability measures of a prediction, as aggregates.

Losses and accuracies are one weighted mean over the rows: a column that any ``groupBy().agg()`` can
use. Measures of separability need class moments, ranks or histograms; they are DataFrames with one
row for each group of ``by``. Rank-based ones first aggregate equal values, so their windows run
over distinct values, range-partitioned (:mod:`bandlens.plans.ordered`).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandlens.functions.guards import INF, argmax, finite
from bandlens.plans.ordered import cumulated
from bandlens.plans.stages import small, staged

CLIP = 1e-9
BINS, BIN_FLOOR = 50, 1e-10


# ---- weighted means over rows ------------------------------------------------------------------


def weighted_mean(loss: Column, weight: Column | None = None, empty: float | None = 0.0) -> Column:
    """Sum of weight x loss by the sum of weights; ``empty`` where the weights add up to 0."""
    w = F.lit(1.0) if weight is None else weight
    total = F.sum(w)
    mean = F.try_divide(F.sum(w * loss), total)
    return F.when(total == 0, F.lit(empty)).otherwise(mean) if empty is not None else mean


def mae(y: Column, p: Column, w: Column | None = None) -> Column:
    return weighted_mean(F.abs(p - y), w, None)


def mse(y: Column, p: Column, w: Column | None = None) -> Column:
    return weighted_mean((p - y) * (p - y), w, None)


def rmse(y: Column, p: Column, w: Column | None = None) -> Column:
    return F.sqrt(mse(y, p, w))


def r_squared(y: Column, p: Column) -> Column:
    """1 - residual by total sum of squares; 0 where y is constant and missed, 1 where it is met."""
    rest, total = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)
    return F.when(total > 0, 1 - F.try_divide(rest, total)).otherwise(F.when(rest == 0, 1.0).otherwise(0.0))


def _clipped(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))


def _own(p: Column, y: Column) -> Column:
    return F.get(p, y.cast("int"))


def cross_entropy(y: Column, p: Column, w: Column | None = None, multi: bool = False) -> Column:
    """``p``: the probability of class 1, or an array of all classes' probabilities; clipped to [1e-9, 1 - 1e-9]."""
    if multi:
        return weighted_mean(-F.ln(_clipped(_own(p, y))), w)
    q = _clipped(p)
    return weighted_mean(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)), w)


def nll_loss(y: Column, logp: Column, w: Column | None = None, multi: bool = False) -> Column:
    """``logp``: log-probabilities; the binary one is held at or below 0."""
    if multi:
        return weighted_mean(-_own(logp, y), w)
    q = F.least(logp, F.lit(0.0))
    other = F.when(q >= 0, F.lit(-INF)).otherwise(F.log1p(-F.exp(q)))
    return weighted_mean(F.when(y == 1, -q).otherwise(-other), w)


def focal_loss(y: Column, p: Column, w: Column | None = None, multi: bool = False, gamma: float = 2.0, alpha: float | list[float] | None = None) -> Column:
    """Cross-entropy times (1 - p_t)^gamma, times alpha of the class (binary: alpha for 1, 1 - alpha for 0)."""
    if gamma < 0 or (not multi and alpha is not None and not 0 < alpha < 1):
        raise ValueError("gamma must not be negative, and alpha must lie between 0 and 1")
    if multi:
        pt = _clipped(_own(p, y))
        a = F.lit(1.0) if alpha is None else F.get(F.array(*[F.lit(float(x)) for x in alpha]), y.cast("int"))
    else:
        pt = F.when(y == 1, _clipped(p)).otherwise(1 - _clipped(p))
        a = F.lit(1.0) if alpha is None else F.when(y == 1, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return weighted_mean(-a * F.pow(1 - pt, F.lit(gamma)) * F.ln(pt), w)


def hinge_loss(y: Column, s: Column, w: Column | None = None, multi: bool = False) -> Column:
    """``s``: the score of class 1, or an array of scores (mean margin loss against the other classes)."""
    if multi:
        own = _own(s, y)
        margins = F.aggregate(F.transform(s, lambda v, i: F.when(i == y.cast("int"), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - (own - v)))), F.lit(0.0), lambda a, v: a + v)
        return weighted_mean(margins / (F.size(s) - 1), w)
    return weighted_mean(F.greatest(F.lit(0.0), 1 - (2 * y - 1) * s), w)


def accuracy(y: Column, p: Column, w: Column | None = None, multi: bool = False) -> Column:
    """Share of right classes: p >= 0.5 is class 1, or the first largest element of an array."""
    got = argmax(p) if multi else F.when(p >= 0.5, 1).otherwise(0)
    return weighted_mean(F.when(got == y.cast("int"), 1.0).otherwise(0.0), w)


def pearson(y: Column, p: Column, w: Column | None = None) -> Column:
    """Weighted absolute correlation from moments (centred ones without weights); 0 where a side is constant or the result isn't finite."""
    if w is None:
        flat = (F.min(p) == F.max(p)) | (F.min(y) == F.max(y))
        r = F.abs(F.try_divide(F.covar_pop(p, y), F.sqrt(F.var_pop(p) * F.var_pop(y))))
        return F.when(F.coalesce(~flat, F.lit(False)) & finite(r), r).otherwise(0.0)
    n = F.sum(w)
    mp, my = F.try_divide(F.sum(w * p), n), F.try_divide(F.sum(w * y), n)
    cov = F.try_divide(F.sum(w * p * y), n) - mp * my
    vp, vy = F.try_divide(F.sum(w * p * p), n) - mp * mp, F.try_divide(F.sum(w * y * y), n) - my * my
    flat = (F.min(p) == F.max(p)) | (F.min(y) == F.max(y)) | (vp <= 0) | (vy <= 0)
    r = F.abs(F.try_divide(cov, F.sqrt(F.abs(vp * vy))))
    return F.when(F.coalesce(~flat, F.lit(False)) & finite(r), r).otherwise(0.0)


# ---- separability of two classes ---------------------------------------------------------------


def average_ranks(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with the tie-averaged rank (from 1) of ``value``."""
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = cumulated(counts, value, ["_n"], by).select(*by, value, (F.col("before__n") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, value])


def spearman(df: DataFrame, y: str, p: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """The absolute correlation of average ranks: ``by``, ``spearman``. Equal pairs are one row before anything is ranked."""
    by = by or []
    pairs = df.groupBy(*by, y, p).agg(F.count(F.lit(1)).alias("_c"), (F.sum(weight) if weight else F.count(F.lit(1))).cast("double").alias("_w"))
    pairs = staged(pairs, "pairs")
    for c in (y, p):
        ranks = cumulated(pairs.groupBy(*by, c).agg(F.sum("_c").alias("_n")), c, ["_n"], by).select(*by, c, (F.col("before__n") + (F.col("_n") + 1) / 2).alias(f"_r_{c}"))
        pairs = pairs.join(ranks, [*by, c])
    return pairs.groupBy(*by).agg(pearson(F.col(f"_r_{y}"), F.col(f"_r_{p}"), F.col("_w")).alias("spearman"))


def scaled(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """``by``, ``y`` (double), ``z``: the prediction scaled to [0, 1] by its range (a constant one gives 0), ``flat``."""
    ends = df.groupBy(*by).agg(F.min(p).alias("_lo"), F.max(p).alias("_hi"))
    d = df.select(*by, F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("_p"))
    d = d.join(small(ends), by) if by else d.crossJoin(F.broadcast(ends))  # one row
    return d.select(*by, "y", F.coalesce(F.try_divide(F.col("_p") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)).alias("z"), (F.col("_lo") == F.col("_hi")).alias("flat"))


def class_moments(d: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group: n, mean, sample variance of each class and of all, whether labels are just 0 and 1."""
    c = lambda k: F.when(F.col("y") == k, F.col("z"))
    return d.groupBy(*by).agg(
        *[f.alias(f"{n}{k}") for k in (0, 1) for n, f in (("n", F.count(c(k))), ("m", F.avg(c(k))), ("v", F.coalesce(F.var_samp(c(k)), F.lit(0.0))))],
        F.count("z").alias("n"), F.avg("z").alias("m"), F.coalesce(F.var_samp("z"), F.lit(0.0)).alias("v"), F.coalesce(F.var_pop("z"), F.lit(0.0)).alias("vp"),
        F.max(F.when(~F.col("y").isin(0.0, 1.0), 1).otherwise(0)).alias("other"), F.max(F.col("flat").cast("int")).alias("flat"),
        F.max(F.when(finite(F.col("z")), 0).otherwise(1)).alias("bad"),
    )


def class_counts(d: DataFrame, by: list[str]) -> DataFrame:
    """``by``, each value ``z`` once with the numbers of both classes (``_c0``, ``_c1``), those below it (``before_...``) and the ``next_value``."""
    values = d.groupBy(*by, "z").agg(*[F.sum(F.when(F.col("y") == k, 1).otherwise(0)).alias(f"_c{k}") for k in (0, 1)])
    return cumulated(values, "z", ["_c0", "_c1"], by, following=True)


def auc_direction(d: DataFrame, by: list[str], counts: DataFrame | None = None) -> DataFrame:
    """``by``, ``s_dir``: 2 (AUC - 1/2) from tie-averaged ranks; 1 where a class is empty."""
    cum = class_counts(d, by) if counts is None else counts
    sums = cum.groupBy(*by).agg(F.sum(F.col("_c1") * (F.col("before__c0") + F.col("_c0") / 2)).alias("_u"), F.sum("_c1").alias("_n1"), F.sum("_c0").alias("_n0"))
    auc = F.try_divide(F.col("_u"), F.col("_n1") * F.col("_n0"))
    return sums.select(*by, F.when((F.col("_n1") == 0) | (F.col("_n0") == 0), 1.0).otherwise(2 * (auc - 0.5)).alias("s_dir"))


def _js(d: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``js``: Jensen-Shannon divergence (bits) of 50-bin histograms over [0, 1] with the right edge closed."""
    bins = d.withColumn("_b", F.least(F.floor(F.col("z") * BINS), F.lit(BINS - 1))).groupBy(*by, "_b").agg(*[F.sum(F.when(F.col("y") == k, 1).otherwise(0)).alias(f"_h{k}") for k in (0, 1)])
    w = Window.partitionBy(*by)
    p = [(F.coalesce(F.try_divide(F.col(f"_h{k}"), F.sum(f"_h{k}").over(w)), F.lit(0.0)) + BIN_FLOOR) / (1 + BINS * BIN_FLOOR) for k in (0, 1)]
    q = bins.select(*by, p[0].alias("_p0"), p[1].alias("_p1"))
    term = lambda c: F.col(c) * F.log2(2 * F.col(c) / (F.col("_p0") + F.col("_p1")))
    # Bins that hold nothing have equal floors on both sides and add nothing.
    return q.groupBy(*by).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(term("_p0") + term("_p1")) / 2)).alias("js"))


def _emd(cum: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``emd``: the area between the two classes' distribution functions; each value holds the level reached until the next one."""
    totals = cum.groupBy(*by).agg(F.sum("_c0").alias("_n0"), F.sum("_c1").alias("_n1"))
    cum = cum.join(small(totals), by) if by else cum.crossJoin(F.broadcast(totals))  # one row
    gap = F.abs(F.try_divide(F.col("before__c0") + F.col("_c0"), F.col("_n0")) - F.try_divide(F.col("before__c1") + F.col("_c1"), F.col("_n1")))
    return cum.groupBy(*by).agg(F.coalesce(F.sum(gap * (F.col("next_value") - F.col("z"))), F.lit(0.0)).alias("emd"))


TWO_CLASS = ("bhattacharyya", "hellinger", "js_divergence", "wasserstein", "fisher", "f_statistic", "compactness", "separability", "eta_separability")


def two_class(df: DataFrame, y: str, p: str, names: list[str], by: list[str] | None = None) -> DataFrame:
    """``by`` and one column for each of ``names`` (see TWO_CLASS; earth_movers is wasserstein), computed together.

    -inf where labels are not exactly 0 and 1, a class is empty or the prediction is constant. Rows with
    a null label or prediction are left out.
    """
    by = by or []
    names = ["wasserstein" if n == "earth_movers" else n for n in names]
    d = scaled(df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()), y, p, by)
    m = class_moments(d, by)

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(small(right), by, "left") if by else left.crossJoin(F.broadcast(right))  # one row

    if set(names) - {"eta_separability"}:
        counts = staged(class_counts(d, by), "class-counts")
        m = attach(m, auc_direction(d, by, counts))
    if "js_divergence" in names:
        m = attach(m, _js(d, by))
    if "wasserstein" in names:
        m = attach(m, _emd(counts, by))
    c = F.col
    usable = (c("other") == 0) & (c("n0") > 0) & (c("n1") > 0) & (c("flat") == 0)
    two = (c("m0") - c("m1")) * (c("m0") - c("m1"))
    ssb = c("n0") * F.pow(c("m0") - c("m"), 2) + c("n1") * F.pow(c("m1") - c("m"), 2)
    ssw = (c("n0") - 1) * c("v0") + (c("n1") - 1) * c("v1")
    var = c("v0") + c("v1")
    ratio = F.try_divide(c("v0"), c("v1")) + F.try_divide(c("v1"), c("v0"))
    bhatt = 0.25 * F.try_divide(two, var) + 0.25 * F.ln(0.25 * (ratio + 2.0))
    bc = F.sqrt(F.try_divide(2 * F.sqrt(c("v0") * c("v1")), var)) * F.exp(-0.25 * F.try_divide(two, var))
    between = F.try_divide(c("n0") * c("n1") * two, c("n") * c("n"))
    enough = (c("n0") >= 2) & (c("n1") >= 2) & (c("bad") == 0) & (c("vp") > 0)
    spread = 0.5 * (F.sqrt("v0") + F.sqrt("v1"))
    s = c("s_dir") if "s_dir" in m.columns else F.lit(1.0)
    low = F.lit(-INF)
    formulas = {
        "bhattacharyya": lambda: F.when((c("v0") > 0) & (c("v1") > 0) & (bhatt > 0), bhatt * s).otherwise(low),
        "hellinger": lambda: F.when(var > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - bc)) * s).otherwise(low),
        "js_divergence": lambda: c("js") * s,
        "wasserstein": lambda: c("emd") * s,
        "fisher": lambda: F.when(ssw > 0, F.try_divide(ssb, ssw) * s).otherwise(F.when(ssb > 0, F.lit(INF)).otherwise(low)),
        "f_statistic": lambda: F.when((c("n") > 2) & (ssw > 0), F.try_divide(ssb * (c("n") - 2), ssw) * s).otherwise(low),
        "compactness": lambda: F.when(c("v") > 0, F.coalesce(F.try_divide(F.sqrt("v"), spread), F.lit(INF)) * s).otherwise(s),
        "separability": lambda: F.when(enough, s * F.try_divide(between, c("vp"))).otherwise(low),
        "eta_separability": lambda: F.when(enough, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(between, c("vp"))))).otherwise(low),
    }
    return m.select(*by, *[F.when(usable, formulas[n]()).otherwise(low).alias(n) for n in names])


# ---- cluster measures of any number of classes ---------------------------------------------------


def davies_bouldin(df: DataFrame, y: str, p: str) -> DataFrame:
    """``davies_bouldin`` of the scaled prediction by class: mean over classes of the worst (s_i + s_j) / |c_i - c_j|."""
    d = scaled(df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()), y, p, [])
    centres = d.groupBy("y").agg(F.avg("z").alias("c"))
    scatter = d.join(small(centres), "y").groupBy("y").agg(F.avg(F.abs(F.col("z") - F.col("c"))).alias("s"), F.first("c").alias("c"))
    a, b = scatter.toDF("ya", "sa", "ca"), scatter.toDF("yb", "sb", "cb")
    if scatter.limit(10_001).count() > 10_000:
        raise ValueError("davies_bouldin compares all classes with each other: at most 10000")
    pairs = a.join(F.broadcast(b), F.col("ya") != F.col("yb"))  # classes by classes
    worst = pairs.groupBy("ya").agg(F.max(F.coalesce(F.try_divide(F.col("sa") + F.col("sb"), F.abs(F.col("ca") - F.col("cb"))), F.lit(0.0))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, y: str, p: str) -> DataFrame:
    """``calinski_harabasz``: between- by within-class variance, each by its degrees of freedom; 1 without any within-class scatter."""
    d = scaled(df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()), y, p, [])
    g = d.groupBy("y").agg(F.count("z").alias("n"), F.avg("z").alias("m"), F.coalesce(F.var_pop("z"), F.lit(0.0)).alias("v"))
    total = g.agg(F.sum("n").alias("_all"), F.count("y").alias("_k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_mean"))
    t = g.crossJoin(F.broadcast(total)).agg(F.first("_all").alias("_all"), F.first("_k").alias("_k"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("_mean"), 2)).alias("_b"), F.sum(F.col("n") * F.col("v")).alias("_w"))  # one row
    return t.select(F.when(F.col("_w") == 0, 1.0).otherwise(F.try_divide(F.col("_b") * (F.col("_all") - F.col("_k")), F.col("_w") * (F.col("_k") - 1))).alias("calinski_harabasz"))


def silhouette(df: DataFrame, y: str, p: str) -> DataFrame:
    """``silhouette``: the mean over rows of (b - a) / max(a, b) on the scaled prediction; 0 for the only row of a class.

    In one dimension a row's summed distance to a class follows from the number and sum of the class's
    values below it, so no pairs are formed. Equal values are one row; classes are few and become columns.
    """
    d = staged(scaled(df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()), y, p, []), "silhouette")
    classes = [r["y"] for r in d.select("y").distinct().orderBy("y").limit(1001).collect()]
    if len(classes) < 2 or len(classes) > 1000:
        raise ValueError("silhouette needs 2 to 1000 classes")
    values = d.groupBy("z").agg(*[F.sum(F.when(F.col("y") == k, 1).otherwise(0)).alias(f"n{i}") for i, k in enumerate(classes)], *[F.sum(F.when(F.col("y") == k, F.col("z")).otherwise(0.0)).alias(f"s{i}") for i, k in enumerate(classes)])
    cols = [f"{c}{i}" for c in "ns" for i in range(len(classes))]
    totals = values.agg(*[F.sum(c).alias(f"t_{c}") for c in cols])
    cum = cumulated(values, "z", cols).crossJoin(F.broadcast(totals))  # one row
    k, dist = len(classes), []
    for i in range(len(classes)):
        below, sum_below = F.col(f"before_n{i}"), F.col(f"before_s{i}")
        above, sum_above = F.col(f"t_n{i}") - below - F.col(f"n{i}"), F.col(f"t_s{i}") - sum_below - F.col(f"s{i}")
        dist.append(((F.col("z") * below - sum_below) + (sum_above - F.col("z") * above)).alias(f"d{i}"))
    # One projection for the distances and one for each step after it: operands stay plain columns.
    counts = [F.col(f"{c}n{i}") for c in ("", "t_") for i in range(k)]
    d = cum.select(*counts, *dist)
    d = d.select(*counts, *[F.try_divide(F.col(f"d{i}"), F.col(f"t_n{i}") - 1).alias(f"a{i}") for i in range(k)], *[F.least(*[F.try_divide(F.col(f"d{j}"), F.col(f"t_n{j}")) for j in range(k) if j != i], F.lit(INF)).alias(f"b{i}") for i in range(k)])
    d = d.select(*counts, *[F.coalesce(F.try_divide(F.col(f"b{i}") - F.col(f"a{i}"), F.greatest(f"a{i}", f"b{i}")), F.lit(0.0)).alias(f"w{i}") for i in range(k)])
    parts = d.agg(*[F.sum(F.when((F.col(f"n{i}") > 0) & (F.col(f"t_n{i}") > 1), F.col(f"n{i}") * F.col(f"w{i}")).otherwise(0.0)).alias(f"p{i}") for i in range(k)], *[F.first(f"t_n{i}").alias(f"t{i}") for i in range(k)])
    add = lambda c: sum((F.col(f"{c}{i}") for i in range(1, k)), F.col(f"{c}0"))
    return parts.select((add("p") / add("t")).alias("silhouette"))


# ---- registry and penalties ----------------------------------------------------------------------


@dataclass(frozen=True)
class Metric:
    """``greater``: more is better. ``kind``: 'row' (a weighted mean as a column) or 'table' (a function of a DataFrame)."""

    name: str
    greater: bool
    kind: str
    function: Callable


METRICS: dict[str, Metric] = {
    **{n: Metric(n, False, "row", f) for n, f in (("mae", mae), ("mse", mse), ("rmse", rmse), ("cross_entropy", cross_entropy), ("nll_loss", nll_loss), ("focal_loss", focal_loss), ("hinge_loss", hinge_loss))},
    "accuracy": Metric("accuracy", True, "row", accuracy),
    "pearson": Metric("pearson", True, "row", pearson),
    "spearman": Metric("spearman", True, "table", spearman),
    "silhouette": Metric("silhouette", True, "table", silhouette),
    "davies_bouldin": Metric("davies_bouldin", False, "table", davies_bouldin),
    "calinski_harabasz": Metric("calinski_harabasz", True, "table", calinski_harabasz),
    **{n: Metric(n, True, "table", lambda df, y, p, n=n: two_class(df, y, p, [n])) for n in (*TWO_CLASS, "earth_movers")},
}


def metric(name: str | Metric) -> Metric:
    """A registered metric or the one given; ValueError for an unknown name."""
    if isinstance(name, Metric):
        return name
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}")
    return METRICS[name]


def penalty(constants: list[float], kind: str | None, c: float = 1.0) -> float:
    """l1, l2 or elasticnet (half of each) term of the constants, by ``c`` times their number; 0 without constants."""
    if kind is None or not constants:
        return 0.0
    l1, l2 = math.fsum(map(abs, constants)), math.fsum(x * x for x in constants)
    if kind not in ("l1", "l2", "elasticnet"):
        raise ValueError(f"unknown penalty {kind!r}")
    return {"l1": l1, "l2": l2, "elasticnet": 0.5 * l1 + 0.5 * l2}[kind] / (c * len(constants))


def penalised(value: float, greater: bool, term: float) -> float:
    return value - term if greater else value + term


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """``label``, ``precision``, ``recall``, ``f1``, ``support``: one row for each label that occurs on either side; 0 where undefined."""
    counts = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select(F.col("y").alias("label"), F.lit(0).alias("got"), F.col("n").alias("support"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")).unionByName(counts.select(F.col("p").alias("label"), F.col("n").alias("got"), F.lit(0).alias("support"), F.lit(0).alias("hit")))
    g = sides.groupBy("label").agg(F.sum("got").alias("got"), F.sum("support").alias("support"), F.sum("hit").alias("hit"))
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return g.select("label", z(F.col("hit"), F.col("got")).alias("precision"), z(F.col("hit"), F.col("support")).alias("recall"), z(2 * F.col("hit"), F.col("got") + F.col("support")).alias("f1"), "support")


