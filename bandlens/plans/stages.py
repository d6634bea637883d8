"""Cutting a plan at a written table, and broadcasting only what was measured to be small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlens.plans.ship import ship

#: A side of a join may be broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (where unset, as in tests) a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="bandlens-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage beyond the files, so losing an executor costs at most the running
    stage, and several readers share one computation. Parquet keeps pruning and pushdown.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/bandlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


_written: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again (its own DataFrame, as :func:`staged` gave it)."""
    path = getattr(df, "_staged_at", None)
    if path in _written:
        _written.remove(path)
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> int:
    """Delete all tables this process has staged, once their results have been used; how many there were."""
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n


def small(df: DataFrame, rows: int | None = None, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else without.

    ``rows`` is its count where the caller knows it; otherwise at most ``limit`` + 1 rows are counted.
    Beyond the limit the join shuffles, which AQE can split where a key is hot.
    """
    limit = BROADCAST_ROWS if limit is None else limit
    n = df.limit(limit + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df
