"""Analyses of an operation log: one row for each operation, fields as in :data:`FIELDS`.

Averages are over finite values (null, NaN and infinite ones are left out); deviations divide by
n - 1. ``accepted`` null counts as not accepted in conditions and is left out of rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandlens.functions.guards import finite
from bandlens.plans.ordered import cumulated, quantile
from bandlens.plans.stages import staged
from bandlens.sources.tables import latest_by

#: The fields of a log record, in order (fixed values).
FIELDS = T.StructType([
    T.StructField("generation", T.IntegerType()), T.StructField("timestamp", T.DoubleType()),
    T.StructField("operation_type", T.StringType()), T.StructField("operation_name", T.StringType()),
    T.StructField("parent_fitness", T.DoubleType()), T.StructField("parent_complexity", T.IntegerType()),
    T.StructField("offspring_fitness", T.DoubleType()), T.StructField("offspring_complexity", T.IntegerType()),
    T.StructField("fitness_delta", T.DoubleType()), T.StructField("complexity_delta", T.IntegerType()),
    T.StructField("accepted", T.BooleanType()), T.StructField("temperature", T.DoubleType()),
    T.StructField("probability", T.DoubleType()), T.StructField("parent2_fitness", T.DoubleType()),
    T.StructField("parent2_complexity", T.IntegerType()), T.StructField("offspring2_fitness", T.DoubleType()),
    T.StructField("offspring2_complexity", T.IntegerType()), T.StructField("batch_used", T.BooleanType()),
    T.StructField("parent_order", T.IntegerType()), T.StructField("offspring_order", T.IntegerType()),
    T.StructField("order_delta", T.IntegerType()), T.StructField("parent2_order", T.IntegerType()),
    T.StructField("offspring2_order", T.IntegerType()),
])


def _v(name: str) -> Column:
    x = F.col(name).cast("double")
    return F.when(finite(x), x)


def _yes() -> Column:
    return F.coalesce(F.col("accepted"), F.lit(False))


def _rate() -> Column:
    return F.avg(F.col("accepted").cast("double"))


def normalised(log: DataFrame, entry: list[str] | None = None) -> DataFrame:
    """Names trimmed, in lower case and with underscores; with ``entry``, one row for each entry: its delivery with the latest ingested_at, then log_id."""
    if entry is not None:
        log = latest_by(log, entry, "ingested_at", "log_id", [c for c in log.columns if c not in entry])
    return log.withColumn("operation_name", F.regexp_replace(F.lower(F.trim("operation_name")), "[ -]", "_"))


def merge(*logs: DataFrame) -> DataFrame:
    """All logs by name of field, ordered by timestamp; the order of equal timestamps is by generation and name."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.orderBy("timestamp", "generation", "operation_name")


def summary(log: DataFrame) -> DataFrame:
    """One row: counts, acceptance rate, mean deltas of all and of accepted operations, the largest timestamp."""
    return log.agg(
        F.count(F.lit(1)).alias("total_operations"), F.sum(_yes().cast("long")).alias("accepted_operations"), _rate().alias("acceptance_rate"),
        F.avg(_v("fitness_delta")).alias("avg_fitness_delta"), F.avg(_v("complexity_delta")).alias("avg_complexity_delta"),
        F.avg(F.when(_yes(), _v("fitness_delta"))).alias("avg_fitness_delta_accepted"), F.avg(F.when(_yes(), _v("complexity_delta"))).alias("avg_complexity_delta_accepted"),
        F.max("timestamp").alias("total_runtime"),
    )


def counts(log: DataFrame, field: str) -> DataFrame:
    """``value``, ``n``: operations by a field (nulls left out)."""
    return log.filter(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def effectiveness(log: DataFrame) -> DataFrame:
    """By operation name: attempts, accepted, rate, and the moments of both deltas, of all and of accepted operations; one aggregate."""
    moments = [f(_v(c)).alias(f"{n}_{c}") for c in ("fitness_delta", "complexity_delta") for n, f in (("avg", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    accepted = [F.avg(F.when(_yes(), _v(c))).alias(f"avg_{c}_accepted") for c in ("fitness_delta", "complexity_delta", "order_delta")]
    g = log.filter(F.col("operation_name").isNotNull()).groupBy("operation_name")
    return g.agg(F.count("accepted").alias("total_attempts"), F.sum(_yes().cast("long")).alias("total_accepted"), _rate().alias("acceptance_rate"), *moments, *accepted, F.stddev_samp(F.when(_yes(), _v("order_delta"))).alias("std_order_delta_accepted"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation over pairs of finite values, from moments; null where a side is constant (never an error)."""
    ok = x.isNotNull() & y.isNotNull()
    a, b = F.when(ok, x), F.when(ok, y)
    va, vb = F.var_pop(a), F.var_pop(b)
    return F.when((va > 0) & (vb > 0), F.try_divide(F.covar_pop(a, b), F.sqrt(F.abs(va * vb))))


def order_changes(log: DataFrame) -> DataFrame:
    """By kind of change (increase, decrease, no_change): count, accepted, rate, mean fitness delta."""
    kind = F.when(F.col("order_delta") > 0, "increase").when(F.col("order_delta") < 0, "decrease").otherwise("no_change")
    return log.filter(F.col("order_delta").isNotNull()).groupBy(kind.alias("change")).agg(F.count("accepted").alias("n"), F.sum(_yes().cast("long")).alias("accepted"), _rate().alias("rate"), F.avg(_v("fitness_delta")).alias("avg_fitness_delta"))


def order_summary(log: DataFrame) -> DataFrame:
    """One row: operations with an order, accepted ones, rate, moments of the order's change and its correlation with fitness."""
    d = log.filter(F.col("order_delta").isNotNull())
    acc = lambda c: F.when(_yes(), _v(c))
    return d.agg(
        F.count(F.lit(1)).alias("n"), F.sum(_yes().cast("long")).alias("accepted"), _rate().alias("rate"),
        F.avg(_v("order_delta")).alias("avg_order_delta"), F.stddev_samp(_v("order_delta")).alias("std_order_delta"),
        F.avg(acc("order_delta")).alias("avg_order_delta_accepted"), F.stddev_samp(acc("order_delta")).alias("std_order_delta_accepted"),
        correlation(acc("order_delta"), acc("fitness_delta")).alias("order_fitness_correlation"),
        correlation(acc("order_delta"), acc("complexity_delta")).alias("order_complexity_correlation"),
    )


def order_by_operation(log: DataFrame) -> DataFrame:
    """Accepted operations with an order, by name: moments of the order's change, mean fitness delta."""
    d = log.filter(F.col("order_delta").isNotNull() & _yes() & F.col("operation_name").isNotNull())
    return d.groupBy("operation_name").agg(F.avg(_v("order_delta")).alias("avg_order_delta"), F.stddev_samp(_v("order_delta")).alias("std_order_delta"), F.min("order_delta").alias("min_order_delta"), F.max("order_delta").alias("max_order_delta"), F.avg(_v("fitness_delta")).alias("avg_fitness_delta"))


def order_bins(log: DataFrame) -> DataFrame:
    """Accepted operations by the order's change (bins closed on the right at -1, 0, 1): moments of both deltas."""
    o = F.col("order_delta")
    # Names of the bins: fixed values.
    name = F.when(o <= -1, "decrease").when(o <= 0, "no_change_neg").when(o <= 1, "no_change_pos").otherwise("increase")
    return log.filter(o.isNotNull() & _yes()).groupBy(name.alias("bin")).agg(F.count(F.lit(1)).alias("n"), *[f(_v(c)).alias(f"{n}_{c}") for c in ("complexity_delta", "fitness_delta") for n, f in (("avg", F.avg), ("std", F.stddev_samp))])


def trends(log: DataFrame, size: int = 100, by: str | None = "run_id", order: str = "place") -> DataFrame:
    """Trailing means over ``size`` operations in the order of their timestamps (then log_id), within ``by`` or over the whole log (full windows without missing values only).

    Operations are numbered by range-partitioned offsets and put into blocks of ``size``; a window reads
    its own block and the one before, so no task holds a run. Operations without a timestamp have no
    place and are left out.
    """
    keys = [by] if by else []
    d = log.filter(F.col("timestamp").isNotNull()).select(*keys, "log_id", "generation", "timestamp", F.col("accepted").cast("double").alias("a"), _v("fitness_delta").alias("f"), _v("complexity_delta").alias("c"))
    d = staged(d.withColumn("_at", F.struct("timestamp", "log_id")).withColumn("_one", F.lit(1)), "trends")
    d = cumulated(d, "_at", ["_one"], keys).withColumn(order, (F.col("before__one") + 1).cast("long")).drop("before__one", "_one", "_at")
    own = F.floor((F.col(order) - 1) / size)
    d = d.withColumn("_own", own).withColumn("_block", F.explode(F.array(own, own + 1)))
    last = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(1 - size, 0)
    names = {"acceptance_rate": "a", "avg_fitness_delta": "f", "avg_complexity_delta": "c"}
    d = d.withColumns({n: F.when(F.count(c).over(last) == size, F.avg(c).over(last)) for n, c in names.items()})
    return d.filter(F.col("_own") == F.col("_block")).filter(" and ".join(f"{n} is not null" for n in names)).select(*keys, order, "log_id", "generation", "timestamp", *names)


def global_trends(log: DataFrame, size: int = 100, order: str = "place") -> DataFrame:
    """The same over the whole log."""
    return trends(log, size, None, order)


def improvements(log: DataFrame, percentile: float = 75.0, least: float | None = None) -> DataFrame:
    """Accepted operations whose gain exceeds a threshold, by name: count, total, mean and largest gain, mean change of complexity, and the threshold.

    The threshold is the percentile of the positive gains; without any, 0.9 of the largest (negative) gain, or 1e-6 where that is 0.
    """
    acc = log.filter(_yes() & _v("fitness_delta").isNotNull())
    f = F.col("fitness_delta")
    if least is None:
        acc = staged(acc.select("operation_name", "fitness_delta", "complexity_delta"), "accepted")
        p = acc.agg(F.max(f).alias("m")).crossJoin(F.broadcast(quantile(acc.filter(f > 0).select(f), "fitness_delta", percentile / 100).withColumnRenamed("quantile", "p")))  # one row each
        t = F.coalesce(F.col("p"), F.col("m") * 0.9)
        limit = p.select(F.when(F.abs(t) < 1e-10, 1e-6).otherwise(t).alias("threshold"))
    else:
        limit = log.sparkSession.createDataFrame([(float(least),)], "threshold double")
    d = acc.crossJoin(F.broadcast(limit)).filter(f > F.col("threshold")).filter(F.col("operation_name").isNotNull())  # one row
    return d.groupBy("operation_name").agg(F.count(f).alias("n"), F.sum(f).alias("total_improvement"), F.avg(f).alias("avg_improvement"), F.max(f).alias("max_improvement"), F.avg(_v("complexity_delta")).alias("avg_complexity_change"), F.first("threshold").alias("threshold"))


def complexity_bins(log: DataFrame) -> DataFrame:
    """Accepted operations by the change of complexity (bins closed on the right at -5, -1, 0, 1, 5): count and moments of the gain."""
    c = F.col("complexity_delta")
    # Names of the bins: fixed values.
    name = F.when(c <= -5, "large_decrease").when(c <= -1, "small_decrease").when(c <= 0, "no_change_neg").when(c <= 1, "no_change_pos").when(c <= 5, "small_increase").otherwise("large_increase")
    return log.filter(_yes() & c.isNotNull()).groupBy(name.alias("bin")).agg(F.count(_v("fitness_delta")).alias("n"), F.avg(_v("fitness_delta")).alias("avg_fitness_delta"), F.stddev_samp(_v("fitness_delta")).alias("std_fitness_delta"))


def complexity_correlation(log: DataFrame) -> DataFrame:
    """One row: the correlation of both deltas over accepted operations."""
    return log.filter(_yes()).agg(correlation(_v("fitness_delta"), _v("complexity_delta")).alias("correlation"))


def temperature_bins(log: DataFrame, bins: int = 10) -> DataFrame:
    """Operations with a temperature in equal-width bins, closed on the right (the lowest value belongs to the first): count, rate, means."""
    t = _v("temperature")
    d = log.filter(t.isNotNull())
    ends = d.agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    step = F.try_divide(t - F.col("lo"), F.col("hi") - F.col("lo"))
    b = F.greatest(F.ceil(F.coalesce(step, F.lit(0.5)) * bins) - 1, F.lit(0)).cast("int")
    g = d.crossJoin(F.broadcast(ends)).groupBy(b.alias("bin"))  # one row
    return g.agg(F.count("accepted").alias("n"), _rate().alias("acceptance_rate"), F.avg(_v("fitness_delta")).alias("avg_fitness_delta"), F.avg(t).alias("avg_temperature"))


def report(log: DataFrame) -> str:
    """The analyses as text: the summary, the 15 most effective operations, the 10 best paths of improvement, bins."""
    s = summary(log).first()
    lines = ["Operation log", f"  operations {s['total_operations']}, accepted {s['accepted_operations']} ({(s['acceptance_rate'] or 0) * 100:.1f} %), seconds {s['total_runtime'] or 0:.1f}"]
    for title, table, order in (
        ("Effectiveness", effectiveness(log), ["acceptance_rate", "avg_fitness_delta_accepted"]),
        ("Improvement", improvements(log), ["avg_improvement"]),
        ("Change of complexity", complexity_bins(log), ["n"]),
        ("Temperature", temperature_bins(log), ["n"]),
    ):
        rows = table.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(15 if title == "Effectiveness" else 10).collect()
        lines += ["", title, *("  " + ", ".join(f"{k} {v:.4f}" if isinstance(v, float) else f"{k} {v}" for k, v in r.asDict().items()) for r in rows)]
    return "\n".join(lines) + "\n"


