"""Getting this package to the Python workers of a cluster on which it is not installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add a zip of the package to the context's Python files, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_bandlens_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    if package.is_dir():  # otherwise it was itself loaded from a zip that the workers have
        target = Path(tempfile.mkdtemp(prefix="bandlens-py-")) / "bandlens.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(target))
    sc._bandlens_shipped = True
