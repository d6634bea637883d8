"""Formulas and log analyses over streams: the same projections, and windowed aggregates with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandlens.expr.ast import FormulaSet, Node
from bandlens.expr.compile_spark import with_formula


def score_stream(stream: DataFrame, formula: Node | FormulaSet, out: str) -> DataFrame:
    """A stateless projection; works for batches too."""
    return with_formula(stream, formula, out)


def windowed_summary(stream: DataFrame, at: str, value: str, by: str, length: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """``by``, ``start``, ``n``, ``mean``, ``high``: tumbling or sliding windows of event time; rows later than the watermark are dropped by a stream.

    Times without a zone are taken in the session's zone.
    """
    stream = stream.withColumn(at, F.col(at).cast("timestamp"))
    d = stream.withWatermark(at, late) if stream.isStreaming else stream
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return d.groupBy(w.alias("w"), by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("high")).select(by, F.col("w.start").alias("start"), "n", "mean", "high")


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """One row for each key; a stream keeps keys only as long as the watermark allows."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)
