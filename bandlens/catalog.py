"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bandlens.queries import exchange, formulas, grids, nearby, search, tables  # noqa: F401 - they register their queries
from bandlens.queries.registry import QUERIES, SQL


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return formulas.flagship_normalised_difference(spark, folder)


__all__ = ["QUERIES", "SQL", "flagship"]
