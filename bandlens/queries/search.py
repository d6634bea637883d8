"""Queries of the formula language, the search and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlens.estimators import FormulaClassifier, FormulaRegressor
from bandlens.expr.ast import Limits
from bandlens.expr.compile_spark import with_formula
from bandlens.expr.parse import parse
from bandlens.expr.simplify import simplify
from bandlens.expr.text import show
from bandlens.operators import archive
from bandlens.plans.stages import shared_dir
from bandlens.queries.registry import query, rounded
from bandlens.search.train import evaluate_batch
from bandlens.sources.tables import table, water_records
from bandlens.streaming.score import deduplicated, score_stream, windowed_summary

_BANDS = ["Blue", "Green", "Red", "NIR", "SWIR1", "SWIR2"]
_CANDIDATES = {"x0": "x0", "(x0 + x1)": "x0 + x1", "(x0 * x1)": "x0 * x1", "(x0 / (x1 + 1.5))": "x0 / (x1 + 1.5)", "sqrt((x0 - x1))": "sqrt(abs(x0 - x1))", "exp((x1 * x2))": "exp(x1 * x2)"}


def _tabular(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("x0"), (F.col("l_discount") * 10).alias("x1"), (F.col("l_tax") * 10).alias("x2"), (F.col("l_extendedprice") / 100_000).alias("y"), F.col("l_quantity").cast("double").alias("w"))


@query(
    "WITH t AS (SELECT l_quantity / 50 AS x0, l_discount * 10 AS x1, l_tax * 10 AS x2, l_extendedprice / 100000 AS y, l_quantity AS w FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{k}' AS expression, round(sum(w * pow({v} - y, 2)) / sum(w), 6) + 0.0 AS mse FROM t" for k, v in _CANDIDATES.items())
)
def search_batch_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Several candidates over all rows in one pass of partial sums."""
    names = ["x0", "x1", "x2"]
    errors = evaluate_batch(_tabular(spark, d), [parse(t, names) for t in _CANDIDATES], names, "y", "w", "mse")
    return spark.createDataFrame(list(zip(_CANDIDATES, errors, strict=True)), "expression string, mse double").select("expression", rounded(F.col("mse")).alias("mse"))


@query()
def search_regression(spark: SparkSession, d: str) -> DataFrame:
    """A search with the default parameters; its archive. Random, so its invariants are checked in the tests."""
    e = FormulaRegressor(["x0", "x1", "x2"], seed=7)
    return e.fit(_tabular(spark, d), "y", "w").archive(spark, True).drop("json")


@query()
def search_classification(spark: SparkSession, d: str) -> DataFrame:
    """A search with the default parameters for the classes of labelled pixels; predicted by true class."""
    rows = water_records(spark, d, ["label", *_BANDS]).filter(F.col("label").between(0, 4))
    for c in _BANDS:
        rows = rows.filter(F.col(c).between(0, 1))
    e = FormulaClassifier(_BANDS, seed=3)
    return e.fit(rows, "label").predict(rows).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT label, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(min(v), 6) + 0.0 AS low, round(max(v), 6) + 0.0 AS high FROM (
        SELECT label, CASE WHEN abs(b) > 1e-10 AND abs(a / nullif(b, 0)) < 1e10 THEN a / nullif(b, 0) ELSE 1 END AS v FROM (
            SELECT label, Green - NIR AS a, Green + NIR AS b FROM (SELECT * FROM sentinel2_water WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC, row_id DESC) = 1) WHERE Green BETWEEN 0 AND 1 AND NIR BETWEEN 0 AND 1)) GROUP BY 1
""")
def transform_water_index(spark: SparkSession, d: str) -> DataFrame:
    """A formula as a new column of a table, by class."""
    rows = water_records(spark, d, ["label", "Green", "NIR"]).filter(F.col("Green").between(0, 1) & F.col("NIR").between(0, 1))
    rows = with_formula(rows, parse("(Green - NIR) / (Green + NIR)", ["Green", "NIR"]), "v")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("v")).alias("mean"), rounded(F.min("v")).alias("low"), rounded(F.max("v")).alias("high"))


@query()
def formula_archive_simplified(spark: SparkSession, d: str) -> DataFrame:
    """Each archived expression parsed, simplified and counted; a row for each row of the archive that has an expression."""
    rows = table(spark, d, "hall_of_fame").filter("expression is not null")

    def run(batches):
        limits = Limits()
        for b in batches:
            trees = [parse(t, _BANDS) for t in b["expression"]]
            simple = [simplify(t) for t in trees]
            yield b.assign(nodes=[limits.complexity(t) for t in trees], simplified=[show(t) for t in simple], nodes_simplified=[limits.complexity(t) for t in simple])

    return rows.select("run_id", "complexity", "expression").mapInPandas(run, "run_id long, complexity int, expression string, nodes double, simplified string, nodes_simplified double")


@query()
def predict_archive_best(spark: SparkSession, d: str) -> DataFrame:
    """The most accurate archived expression, compiled and applied to all pixels with valid bands: moments by class."""
    best = archive.select_model(archive.best_by_complexity(table(spark, d, "hall_of_fame"), by=["run_id"]), "accuracy").first()
    rows = water_records(spark, d, ["label", *_BANDS])
    for c in _BANDS:
        rows = rows.filter(F.col(c).between(0, 1))
    return with_formula(rows, parse(best["expression"], _BANDS), "v").groupBy("label").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{d}/{name}.parquet"
    schema = table(spark, d, name).schema
    j = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = j.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(j).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _drained(stream: DataFrame, spark: SparkSession, name: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what there is into files of the shared folder.

    Rows are appended; with ``keys``, a batch hands over the groups that it changed, the watermark drops
    old ones from the state, and of each group the last batch's row is read back.
    """
    at = f"{shared_dir(spark)}/bandlens/stream-{name}-{uuid.uuid4().hex}"
    w = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if keys is None:
        w.outputMode("append").format("parquet").option("path", f"{at}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")

    def keep(batch: DataFrame, number: int) -> None:
        # A repeated batch writes its own folder again.
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    w.outputMode("update").foreachBatch(keep).start().awaitTermination()
    out = spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out")
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, max(value) AS high FROM events GROUP BY 1, 2")
def stream_windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling hours of event time over the event stream, with a watermark."""
    out = _drained(windowed_summary(_stream(spark, d, "events"), "ts", "value", "event_type"), spark, "events", ["event_type", "start"])
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", rounded(F.col("mean")).alias("mean"), "high")


@query("SELECT event_id, round(CASE WHEN abs(value) > 0.001 THEN ln(abs(value)) ELSE 0 END, 6) + 0.0 AS v FROM events")
def stream_scored_events(spark: SparkSession, d: str) -> DataFrame:
    """A formula applied to a stream, row by row."""
    scored = score_stream(_stream(spark, d, "events").select("event_id", "value"), parse("log(value)", ["value"]), "v")
    return _drained(scored.select("event_id", "v"), spark, "scored").select("event_id", rounded(F.col("v")).alias("v"))


@query("SELECT run_id, count(*) AS entries FROM (SELECT DISTINCT run_id, entry_no FROM evolution_log) GROUP BY 1")
def stream_deduplicated_log(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the log's stream, each once though delivered again within a year."""
    log = _stream(spark, d, "evolution_log").select("run_id", "entry_no", F.col("ingested_at").cast("timestamp").alias("ingested_at"))
    once = _drained(deduplicated(log, ["run_id", "entry_no"], "ingested_at", "365 days"), spark, "log")
    return once.groupBy("run_id").agg(F.count(F.lit(1)).alias("entries"))
