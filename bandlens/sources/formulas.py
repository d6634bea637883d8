"""CSV and Parquet sources and sinks of samples, pixels, formulas and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlens.expr.ast import FormulaSet, Node
from bandlens.expr.parse import parse_any

#: The columns of a file of labelled samples (fixed values).
SAMPLE_SCHEMA = "label int, Blue double, Green double, Red double, NIR double, SWIR1 double, SWIR2 double, longitude double, latitude double"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled samples from CSV with a header, by a declared schema (nothing is inferred)."""
    return spark.read.csv(path, header=True, schema=SAMPLE_SCHEMA)


def read_pixels(spark: SparkSession, path: str, label: str = "label") -> DataFrame:
    """A pixel table (row, col, bands, label) with ``valid``: labelled above 0; other labels become null."""
    return spark.read.parquet(path).withColumn("valid", F.coalesce(F.col(label) > 0, F.lit(False))).withColumn(label, F.when(F.col("valid"), F.col(label)))


def load_formulas(spark: SparkSession, path: str, variables: list[str], expression: str = "expression", error: str | None = None) -> list[tuple[Node | FormulaSet | None, float]]:
    """(formula or None, error) of each row of a CSV; a missing column raises ValueError. Archives are small."""
    d = spark.read.csv(path, header=True, quote='"', escape='"')
    for c in [expression, *([error] if error else [])]:
        if c not in d.columns:
            raise ValueError(f"no column {c!r} in {path}")
    rows = d.select(F.col(expression).alias("x"), (F.col(error).try_cast("double") if error else F.lit(None).cast("double")).alias("e")).collect()
    return [(None if r["x"] is None or r["x"].strip().lower() in ("", "nan", "none") else parse_any(r["x"], variables), r["e"] if r["e"] is not None else float("nan")) for r in rows]


def write_archive(archive: DataFrame, path: str, form: str = "csv") -> None:
    """An archive as CSV (one file with a header) or Parquet."""
    if form == "csv":
        archive.drop("json").coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
    else:
        archive.write.mode("overwrite").parquet(path)


def write_log(log: DataFrame, path: str, form: str = "parquet") -> None:
    w = log.write.mode("overwrite")
    w.csv(path, header=True) if form == "csv" else w.parquet(path)
