"""Cumulative sums along the order of a column, over the whole table, without one task holding it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandlens.plans.stages import staged


def cumulated(df: DataFrame, value: str, sums: list[str], by: list[str] | None = None, following: bool = False) -> DataFrame:
    """``df`` with ``before_<s>`` for each of ``sums``: its sum over all rows with a smaller ``value`` (within ``by``).

    ``value`` must be distinct within ``by``; aggregate first. Rows are range-partitioned by it; each
    partition's totals (a row for each partition and group) give the offsets of the partitions, and
    a window inside each partition does the rest. ``following`` adds ``next_value``, the next larger
    value, null for the last one.
    """
    by = by or []
    placed = staged(df.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = placed.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums], F.min(value).alias("_first"))
    parts = Window.partitionBy(*by).orderBy("_part")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums], F.lead("_first").over(parts).alias("_later"))
    order = Window.partitionBy(*by, "_part").orderBy(value)
    inside = order.rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(offsets, [*by, "_part"])
    if following:
        out = out.withColumn("next_value", F.coalesce(F.lead(value).over(order), "_later"))
    for s in sums:
        out = out.withColumn(f"before_{s}", F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)))
    return out.drop("_part", "_later", *[f"_o_{s}" for s in sums])


def quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """``quantile``: one row, the exact ``q``-quantile of the non-null values (linear interpolation between ranks; null for none)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    placed = cumulated(counts, value, ["_n"])
    placed = placed.crossJoin(F.broadcast(placed.agg(F.sum("_n").alias("_all"))))  # one row
    rank = (F.col("_all") - 1) * F.lit(float(q))
    at = lambda r: F.max(F.when((F.col("before__n") <= r) & (r < F.col("before__n") + F.col("_n")), F.col(value)))
    ends = placed.agg(at(F.floor(rank)).alias("lo"), at(F.ceil(rank)).alias("hi"), F.max(rank - F.floor(rank)).alias("w"))
    return ends.select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")).alias("quantile"))
