"""The archive of best formulas: dominance, scores, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def best_by_complexity(df: DataFrame, greater: bool = False, by: list[str] | None = None) -> DataFrame:
    """The best row of each complexity (ties: the smallest expression); rows with a null or NaN error or a null expression are no candidates."""
    d = df.filter(F.col("error").isNotNull() & ~F.isnan("error") & F.col("expression").isNotNull())
    order = F.col("error").desc() if greater else F.col("error").asc()
    w = Window.partitionBy(*(by or []), "complexity").orderBy(order, "expression")
    return d.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def pareto_front(df: DataFrame, greater: bool = False, by: list[str] | None = None) -> DataFrame:
    """Rows that no simpler (or as complex) row matches or beats: the best of each complexity, better than all simpler ones.

    A running minimum over complexities; an archive has as many rows as there are complexities.
    """
    d = best_by_complexity(df, greater, by)
    w = Window.partitionBy(*(by or [])).orderBy("complexity").rowsBetween(Window.unboundedPreceding, -1)
    best = (F.max("error") if greater else F.min("error")).over(w)
    d = d.withColumn("_best", best)
    better = F.col("error") > F.col("_best") if greater else F.col("error") < F.col("_best")
    return d.filter(F.col("_best").isNull() | better).drop("_best")


def pareto_sets(df: DataFrame, greater: bool = False) -> DataFrame:
    """The front over three objectives (``order``, ``complexity``, ``error``): rows that no other row is at least as good as in all and better in one."""
    d = best_by_complexity(df, greater, ["order"]).withColumn("_id", F.monotonically_increasing_id())
    a, b = d.alias("a"), F.broadcast(d.alias("b")) if d.limit(5001).count() <= 5000 else d.alias("b")
    ea, eb = F.col("a.error"), F.col("b.error")
    as_good, better = (eb >= ea, eb > ea) if greater else (eb <= ea, eb < ea)
    beaten = (F.col("b.order") <= F.col("a.order")) & (F.col("b.complexity") <= F.col("a.complexity")) & as_good & ((F.col("b.order") < F.col("a.order")) | (F.col("b.complexity") < F.col("a.complexity")) | better)
    return a.join(b, beaten, "left_anti").drop("_id")


def scores(df: DataFrame, greater: bool = False, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``score``: the gain in log error for each step of complexity against the row before (by complexity, then error).

    0 for the first row, without an improvement or at equal complexity; infinite when an error of 0 (or,
    greater being better, a start at or below 0) is left.
    """
    w = Window.partitionBy(*(by or [])).orderBy("complexity", "error")
    e, c = F.col("error"), F.col("complexity")
    pe, pc = F.lag("error").over(w), F.lag("complexity").over(w)
    d = df.withColumn("_pe", pe).withColumn("_pc", pc)
    pe, pc = F.col("_pe"), F.col("_pc")
    ratio = F.ln(F.try_divide(e, pe)) if greater else -F.ln(F.try_divide(e, pe))
    improved, ends = (e > pe, pe <= 0) if greater else (e < pe, e <= 0)
    s = F.when(pe.isNull() | (c <= pc) | ~improved, 0.0).when(ends, INF).otherwise(F.try_divide(ratio, c - pc))
    return d.withColumn("score", F.coalesce(s, F.lit(0.0))).drop("_pe", "_pc")


def select_model(df: DataFrame, how: str = "best", greater: bool = False) -> DataFrame:
    """One row of a scored archive: 'accuracy' (best error), 'score' (best score) or 'best' (best score among errors within 1.5 times of the best)."""
    error = F.col("error").desc() if greater else F.col("error").asc()
    order = [F.col("complexity").asc(), F.col("expression").asc()]
    if how == "accuracy":
        return df.orderBy(error, *order).limit(1)
    if how == "score":
        return df.orderBy(F.col("score").desc(), *order).limit(1)
    if how != "best":
        raise ValueError(f"unknown model selection {how!r}")
    top = df.agg((F.max("error") if greater else F.min("error")).alias("_top"))  # one row
    near = F.col("error") * 1.5 >= F.col("_top") if greater else F.col("error") <= F.col("_top") * 1.5
    return df.crossJoin(F.broadcast(top)).filter(near).drop("_top").orderBy(F.col("score").desc(), *order).limit(1)
