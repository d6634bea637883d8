"""Neighbourhood windows and patches on a grid of the embeddings (25 pixels to a row)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlens.operators import prep, windows
from bandlens.queries.registry import add, query, rounded
from bandlens.sources.tables import table

_GRID = "SELECT CAST(vec_id // 25 AS INT) AS r, CAST(vec_id % 25 AS INT) AS c, CASE WHEN vec_id % 17 = 3 THEN NULL ELSE CAST(embedding[1] AS DOUBLE) END AS v, label FROM embeddings"


def grid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    value = F.when(F.col("vec_id") % 17 == 3, F.lit(float("nan"))).otherwise(F.get("embedding", F.lit(0)).cast("double"))
    return e.select(F.floor(F.col("vec_id") / 25).cast("int").alias("row"), (F.col("vec_id") % 25).cast("int").alias("col"), value.alias("v"), "label", "embedding")


_STAT = {"mean": "avg(b.v)", "max": "max(b.v)", "min": "min(b.v)", "sum": "sum(b.v)", "median": "quantile_cont(b.v, 0.5)", "range": "max(b.v) - min(b.v)"}
for _stat, _f in _STAT.items():
    add(
        f"win_{_stat}",
        lambda spark, d, s=_stat: windows.window(grid(spark, d).drop("embedding"), s, 2, "v", "out").select("row", "col", rounded(F.nanvl("out", F.lit(None))).alias("value")),
        f'WITH g AS ({_GRID}) SELECT a.r AS "row", a.c AS col, round({_f}, 6) + 0.0 AS value FROM g AS a JOIN g AS b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY 1, 2',
    )

add(
    "win_mean_masked",
    lambda spark, d: windows.window(grid(spark, d).drop("embedding"), "mean", 1, "v", "out", where="label >= 5").select("row", "col", rounded(F.nanvl("out", F.lit(None))).alias("value")),
    f'WITH g AS ({_GRID}) SELECT a.r AS "row", a.c AS col, round(avg(b.v), 6) + 0.0 AS value FROM g AS a JOIN g AS b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 WHERE a.label >= 5 GROUP BY 1, 2',
)
add(
    "win_bands_then_mean",
    lambda spark, d: windows.bands_window(grid(spark, d), "max", 1, "embedding", "w", 1, 4).select("row", "col", rounded(F.aggregate("w", F.lit(0.0), lambda a, v: a + v) / 4).alias("value")),
    """WITH g AS (SELECT CAST(vec_id // 25 AS INT) AS r, CAST(vec_id % 25 AS INT) AS c, embedding AS e FROM embeddings)
       SELECT a.r AS "row", a.c AS col, round((max(CAST(b.e[2] AS DOUBLE)) + max(CAST(b.e[3] AS DOUBLE)) + max(CAST(b.e[4] AS DOUBLE)) + max(CAST(b.e[5] AS DOUBLE))) / 4, 6) + 0.0 AS value
       FROM g AS a JOIN g AS b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY 1, 2""",
)

# Each neighbour's place is mirrored at the grid's edges before it is looked up.
_PATCH = f"""WITH g AS ({_GRID}), e AS (SELECT max(r) AS rm, max(c) AS cm FROM g), o AS (SELECT i.range AS i, j.range AS j FROM range(-1, 2) AS i, range(-1, 2) AS j),
    n AS (SELECT a.r, a.c, abs(a.r + i) AS r1, abs(a.c + j) AS c1, rm, cm FROM g AS a, o, e),
    m AS (SELECT r, c, CASE WHEN r1 > rm THEN 2 * rm - r1 ELSE r1 END AS r2, CASE WHEN c1 > cm THEN 2 * cm - c1 ELSE c1 END AS c2 FROM n)
    SELECT m.r AS "row", m.c AS col, round(FUNCTION, 6) + 0.0 AS value FROM m JOIN g AS b ON b.r = m.r2 AND b.c = m.c2 GROUP BY 1, 2"""
for _stat, _f in {**_STAT, "std": "stddev_pop(b.v)"}.items():
    add(
        f"patch_{_stat}_reflect",
        lambda spark, d, s=_stat: windows.patches(grid(spark, d).drop("embedding"), 3, s, "v", "out").select("row", "col", rounded(F.nanvl("out", F.lit(None))).alias("value")),
        _PATCH.replace("FUNCTION", _f),
    )


@query(f'WITH g AS ({_GRID}) SELECT a.r AS "row", a.c AS col FROM g AS a WHERE NOT EXISTS (SELECT 1 FROM g AS b WHERE b.label = 3 AND greatest(abs(b.r - a.r), abs(b.c - a.c)) <= 1)')
def block_buffer_exclusion(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d).select("row", "col", "label")
    return windows.exclude_near(g, g.filter("label = 3"), 1).select("row", "col")


@query(f"WITH g AS ({_GRID}) SELECT r // 5 AS block_row, c // 5 AS block_col, label, count(*) AS n FROM g GROUP BY 1, 2, 3")
def split_block_counts(spark: SparkSession, d: str) -> DataFrame:
    return prep.blocks(grid(spark, d), "label", 5)


@query("SELECT CAST(label % 2 AS INT) AS label, CAST(40 AS BIGINT) AS train, true AS some_test, true AS apart FROM embeddings GROUP BY 1")
def split_spatial_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Whole blocks are drawn by chance; the quotas, test pixels on both sides and the distance between the sides are not."""
    g = grid(spark, d).select("row", "col", (F.col("label") % 2).cast("int").alias("label"))
    s = prep.spatial_split(g, "label", 40, size=4, buffer=1, seed=1).filter("split is not null")
    near = windows.exclude_near(s.filter("split = 'test'"), s.filter("split = 'train'"), 1).withColumn("far", F.lit(1))
    s = s.join(near.select("row", "col", "far"), ["row", "col"], "left")
    return s.groupBy("label").agg(F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).alias("train"), (F.sum(F.when(F.col("split") == "test", 1).otherwise(0)) > 0).alias("some_test"), F.min((F.col("split") == "train") | (F.col("far") == 1)).alias("apart"))
