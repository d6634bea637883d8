"""Parquet tables by name, and the current state of tables that are delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlens.plans.ship import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder of Parquet files or directories."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest_by(df: DataFrame, key: str | list[str], at: str, tie: str, columns: list[str]) -> DataFrame:
    """One row for each ``key`` (one column or several): the values of ``columns`` in its row with the greatest ``at``, then ``tie``.

    A null ``at`` counts as the earliest, a null ``tie`` as 0; rows with a null key are left out.
    The order is one decimal, and each value has its own max_by, so all aggregation buffers are of
    fixed size: a hash aggregate with a map-side combine, and no sort, window or hot-key problem.
    A column may be null in the latest row and then stays null.
    """
    t = F.col(at)  # by its fields: a time without zone must not pass through a session's zone
    clock = F.hour(t) * F.lit(3600) + F.minute(t) * F.lit(60)
    micros = F.unix_date(t.cast("date")).cast("long") * 86_400_000_000 + clock.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
    micros = F.coalesce(micros, F.lit(-(2**62)))
    order: Column = micros.cast("decimal(38,0)") * F.lit(10**18).cast("decimal(19,0)") + F.coalesce(F.col(tie), F.lit(0)).cast("decimal(19,0)")
    keys = [key] if isinstance(key, str) else key
    return (
        df.dropna(subset=keys)
        .withColumn("_order", order.cast("decimal(38,0)"))
        .groupBy(*keys)
        .agg(*[F.max_by(F.col(c), F.col("_order")).alias(c) for c in columns])
    )


def water_records(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """sentinel2_water's records: of each sample_id the row with the latest ingested_at."""
    return latest_by(table(spark, folder, "sentinel2_water"), "sample_id", "ingested_at", "row_id", columns)
