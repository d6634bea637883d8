"""Sources, sinks, models and texts: what is written, read back and printed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlens.estimators import Estimator, FormulaClassifier, FormulaRegressor, FormulaTransformer
from bandlens.expr.ast import FormulaSet, Limits, constants, preorder, with_constants
from bandlens.expr.parse import parse
from bandlens.expr.simplify import simplify
from bandlens.expr.text import from_json, show, to_json
from bandlens.operators import runlog
from bandlens.plans.stages import shared_dir
from bandlens.queries.grids import grid
from bandlens.queries.registry import add, query, rounded
from bandlens.search.train import evaluate_batch, windowed
from bandlens.sources import formulas
from bandlens.sources.tables import table

_BANDS = ["Blue", "Green", "Red", "NIR", "SWIR1", "SWIR2"]
_VALID = " AND ".join(f"{b} BETWEEN 0 AND 1" for b in _BANDS)
_LABELLED = f"(SELECT * FROM sentinel2_vegetation WHERE label IN (0, 1) AND {_VALID})"
_INDEX = "CASE WHEN abs(Green + NIR) > 1e-10 AND abs((Green - NIR) / nullif(Green + NIR, 0)) < 1e10 THEN (Green - NIR) / nullif(Green + NIR, 0) ELSE 1 END"


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/bandlens/{name}-{uuid.uuid4().hex}"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sentinel2_vegetation").filter(F.col("label").isin(0, 1)).select("label", *_BANDS, "longitude", "latitude")
    for b in _BANDS:
        rows = rows.filter(F.col(b).between(0, 1))
    return rows


@query(f"SELECT label, count(*) AS n, round(avg(NIR), 6) + 0.0 AS nir, round(max(SWIR2), 6) + 0.0 AS swir2 FROM {_LABELLED} GROUP BY 1")
def source_samples_csv(spark: SparkSession, d: str) -> DataFrame:
    """Labelled samples written as CSV and read back by the declared schema."""
    at = _place(spark, "samples")
    _labelled(spark, d).write.csv(at, header=True)
    return formulas.read_samples(spark, at).groupBy("label").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("NIR")).alias("nir"), rounded(F.max("SWIR2")).alias("swir2"))


@query("SELECT label > 0 AS valid, CASE WHEN label > 0 THEN label END AS label, count(*) AS n FROM embeddings GROUP BY 1, 2")
def source_pixels(spark: SparkSession, d: str) -> DataFrame:
    """A cube with its label raster as a pixel table; labels of 0 and below are background."""
    at = _place(spark, "pixels")
    grid(spark, d).select("row", "col", F.col("embedding").alias("bands"), "label").write.parquet(at)
    return formulas.read_pixels(spark, at).groupBy("valid", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT run_id, count(*) AS n, count(DISTINCT expression) AS expressions FROM hall_of_fame WHERE expression IS NOT NULL GROUP BY 1")
def sink_archive_csv(spark: SparkSession, d: str) -> DataFrame:
    """Archives written as CSV and read back: expressions are parsed again, and those without one are left out."""
    at = _place(spark, "archive")
    rows = table(spark, d, "hall_of_fame").select("run_id", "complexity", "expression", "error")
    formulas.write_archive(rows, at)
    back = spark.read.csv(at, header=True, quote='"', escape='"', schema="run_id long, complexity int, expression string, error double").filter("expression is not null")

    def run(batches):
        for b in batches:
            yield b.assign(again=[show(parse(t, _BANDS)) for t in b["expression"]])[["run_id", "expression", "again"]]

    parsed = back.mapInPandas(run, "run_id long, expression string, again string")
    return parsed.filter("again is not null").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("expression").alias("expressions"))


for _form in ("csv", "parquet"):

    def _log_sink(spark: SparkSession, d: str, form: str = _form) -> DataFrame:
        at = _place(spark, "log")
        formulas.write_log(table(spark, d, "evolution_log").select(*runlog.FIELDS.names), at, form)
        back = spark.read.schema(runlog.FIELDS).csv(at, header=True) if form == "csv" else spark.read.parquet(at)
        return back.groupBy("operation_type").agg(F.count(F.lit(1)).alias("n"), F.sum("generation").alias("generations"), F.count("temperature").alias("with_temperature"), rounded(F.max("timestamp")).alias("last"))

    add(f"sink_log_{_form}", _log_sink, "SELECT operation_type, count(*) AS n, CAST(sum(generation) AS BIGINT) AS generations, count(temperature) AS with_temperature, round(max(timestamp), 6) + 0.0 AS last FROM evolution_log GROUP BY 1")


def _saved(spark: SparkSession, e: Estimator, expression: str) -> Estimator:
    """The estimator with an archive of one formula, read from a CSV, saved and loaded."""
    at = _place(spark, "model")
    spark.createDataFrame([(expression, 0.25)], "expression string, error double").coalesce(1).write.csv(f"{at}/archive", header=True, quote='"', escape='"')
    e.from_csv(spark, f"{at}/archive").save(spark, f"{at}/model")
    return Estimator.load(spark, f"{at}/model")


@query(f"SELECT label, count(*) AS n, round(avg({_INDEX}), 6) + 0.0 AS mean FROM {_LABELLED} GROUP BY 1")
def model_transform(spark: SparkSession, d: str) -> DataFrame:
    """A transformer rebuilt from a CSV, saved, loaded and applied."""
    e = _saved(spark, FormulaTransformer(_BANDS), "(Green - NIR) / (Green + NIR)")
    return e.transform(_labelled(spark, d)).groupBy("label").agg(F.count("feature").alias("n"), rounded(F.avg("feature")).alias("mean"))


@query(f"SELECT round(1 - sum(pow(NIR - 2 * Red, 2)) / sum(pow(NIR - m, 2)), 6) + 0.0 AS r_squared, count(*) AS n FROM (SELECT *, avg(NIR) OVER () AS m FROM {_LABELLED})")
def model_regressor_score(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    e = _saved(spark, FormulaRegressor(["Red"]), "2.0 * Red")
    return spark.createDataFrame([(e.score(rows, "NIR"), rows.count())], "r double, n long").select(rounded(F.col("r")).alias("r_squared"), "n")


_SET = f"(SELECT label, exp(Green * 10) / (exp(Green * 10) + exp(NIR * 10)) AS p0, CASE WHEN NIR > Green THEN 1 ELSE 0 END AS class FROM {_LABELLED})"


def _classifier(spark: SparkSession, **kw) -> Estimator:
    e = _saved(spark, FormulaClassifier(_BANDS, order=2, **kw), "[Green * 10.0; NIR * 10.0]")
    e.classes = [0, 1]
    return e


@query(f"SELECT label, class AS prediction, count(*) AS n, round(avg(p0), 6) + 0.0 AS p0 FROM {_SET} GROUP BY 1, 2")
def model_classes_and_probabilities(spark: SparkSession, d: str) -> DataFrame:
    e = _classifier(spark)
    rows = e.predict_proba(e.predict(_labelled(spark, d)))
    return rows.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.get("probability", F.lit(0)))).alias("p0"))


@query(f"SELECT round(avg(CASE WHEN class = label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM {_SET}")
def model_classifier_score(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(_classifier(spark).score(_labelled(spark, d), "label"),)], "a double").select(rounded(F.col("a")).alias("accuracy"))


@query(f"""SELECT l.label, round(coalesce(count(*) FILTER (s.label = l.label AND class = l.label) / nullif(count(*) FILTER (class = l.label), 0), 0), 6) + 0.0 AS precision,
    round(count(*) FILTER (s.label = l.label AND class = l.label) / count(*) FILTER (s.label = l.label), 6) + 0.0 AS recall, count(*) FILTER (s.label = l.label) AS support FROM {_SET} AS s, (VALUES (0), (1)) AS l(label) GROUP BY 1""")
def model_classifier_report(spark: SparkSession, d: str) -> DataFrame:
    r = _classifier(spark).report(_labelled(spark, d), "label")
    return r.select("label", rounded(F.col("precision")).alias("precision"), rounded(F.col("recall")).alias("recall"), "support")


# ---- trees as text, simplified, counted ------------------------------------------------------------

_NAMES = ["a", "b", "c"]
#: Text, as it is printed, simplified, nodes, depth, constants.
_TREES = [
    ("a + b * c", "(a + (b * c))", "(a + (b * c))", 5, 3, 0), ("-(a - 2)", "(-(a - 2.0))", "(-(a - 2.0))", 4, 3, 1), ("1 / a", "(1 / a)", "(1 / a)", 2, 2, 0),
    ("max(a, b) - min(a, 0.5)", "(maximum(a, b) - minimum(a, 0.5))", "(maximum(a, b) - minimum(a, 0.5))", 7, 3, 1), ("2 * 3 + a", "((2.0 * 3.0) + a)", "(6.0 + a)", 5, 3, 2),
    ("sqrt(abs(a)) ^ 2", "power(sqrt(abs(a)), 2.0)", None, 5, 4, 1), ("(a + b) - (a + b)", "((a + b) - (a + b))", None, 7, 3, 0), ("neg(neg(a))", "(-(-a))", "a", 3, 3, 0),
    ("mean(v1-v3) + d1_max(v1-v2)", "(mean(v1-v3) + d1_max(v1-v2))", "(mean(v1-v3) + d1_max(v1-v2))", 3, 2, 0),
]


def _tree_rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def _values(rows: list[tuple], names: list[str]) -> str:
    q = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + ") AS t(" + ", ".join(names) + ")"


@query(_values([(t, p, n, d, k) for t, p, _, n, d, k in _TREES], ["text", "printed", "nodes", "depth", "constants"]))
def tree_printed(spark: SparkSession, d: str) -> DataFrame:
    """Parsed, printed, parsed again, sent through JSON, counted."""
    out = []
    for text, *_ in _TREES:
        x = parse(text, _NAMES)
        again = parse(show(x), _NAMES)
        assert again == x and from_json(to_json(x)) == x and hash(again) == hash(x) and len(list(preorder(x))) == x.size
        out.append((text, show(x), x.size, x.depth, len(constants(x))))
    return _tree_rows(spark, out, "text string, printed string, nodes int, depth int, constants int")


@query(_values([(t, s) for t, _, s, *_ in _TREES if s is not None], ["text", "simplified"]))
def tree_simplified(spark: SparkSession, d: str) -> DataFrame:
    return _tree_rows(spark, [(t, show(simplify(parse(t, _NAMES)))) for t, _, s, *_ in _TREES if s is not None], "text string, simplified string")


@query(_values([("2 * a + 3", "((5.0 * a) + 7.0)"), ("a", "a"), ("exp(1.5)", "exp(5.0)")], ["text", "replaced"]))
def tree_constants(spark: SparkSession, d: str) -> DataFrame:
    """Constants read and put back in their order."""
    out = []
    for text in ("2 * a + 3", "a", "exp(1.5)"):
        x = parse(text, _NAMES)
        out.append((text, show(with_constants(x, [5.0, 7.0][: len(constants(x))]))))
    return _tree_rows(spark, out, "text string, replaced string")


_LIMITS = [
    ("exp(exp(a))", 9, False), ("exp(a + exp(b))", 9, True), ("exp(a * b * c)", 9, False), ("a * (b * (c * a))", 9, False), ("a + (b + (c + a))", 9, True), ("exp(a)", 9, True), ("a + b + c + a + b + c", 9, False), ("a * b", 9, True),
]


@query(_values([(t, v) for t, _, v in _LIMITS], ["text", "valid"]))
def tree_constraints(spark: SparkSession, d: str) -> DataFrame:
    """The largest complexity, limits of operands and of nesting."""
    limits = Limits(9, None, {"exp": 4}, {"exp": {"exp": 0}, "mul": {"mul": 1}})
    return _tree_rows(spark, [(t, limits.valid(parse(t, _NAMES))) for t, *_ in _LIMITS], "text string, valid boolean")


@query(_values([("a + b * 2", 1, 5.5), ("exp(a)", 1, 3.0), ("[a; b + 1]", 2, 4.0)], ["text", "formulas", "complexity"]))
def tree_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Complexity by weights of operators and leaves, of formulas and of sets."""
    limits = Limits(None, {"exp": 2.5, "mul": 1.5, "variable": 0.5, "constant": 2.0})
    out = [(t, 1, limits.complexity(parse(t, _NAMES))) for t in ("a + b * 2", "exp(a)")]
    s = FormulaSet((parse("a", _NAMES), None, parse("b + 1", _NAMES)))
    return _tree_rows(spark, [*out, ("[a; b + 1]", s.order, s.complexity(limits))], "text string, formulas int, complexity double")


# ---- a batch with windows --------------------------------------------------------------------------

_WINDOWS = ["e0", "max_sp(w1,f1)", "(mean_sp(w2,f2) + e0)", "max_sp(w1)_mean(v1-v3)"]
_AROUND = "FROM g AS b WHERE b.r BETWEEN a.r - {h} AND a.r + {h} AND b.c BETWEEN a.c - {h} AND a.c + {h}"


@query(f"""WITH g AS (SELECT CAST(vec_id // 25 AS INT) AS r, CAST(vec_id % 25 AS INT) AS c, label / 10.0 AS y, CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1, CAST(embedding[3] AS DOUBLE) AS e2 FROM embeddings),
    w AS (SELECT y, e0, (SELECT max(b.e0) {_AROUND.format(h=1)}) AS m, (SELECT avg(b.e1) {_AROUND.format(h=2)}) + e0 AS s,
          (SELECT (max(b.e0) + max(b.e1) + max(b.e2)) / 3 {_AROUND.format(h=1)}) AS t FROM g AS a)
    SELECT unnest(['{"', '".join(_WINDOWS)}']) AS expression, unnest([round(avg(pow(e0 - y, 2)), 6) + 0.0, round(avg(pow(m - y, 2)), 6) + 0.0, round(avg(pow(s - y, 2)), 6) + 0.0, round(avg(pow(t - y, 2)), 6) + 0.0]) AS mse FROM w""")
def search_window_batch(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with windows on one band and below a reduction, over a whole raster: two shuffles for all windows, one pass for all errors."""
    names = ["e0", "e1", "e2"]
    g = grid(spark, d).select("row", "col", (F.col("label") / 10).alias("y"), *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    rows, candidates, features = windowed(g, [parse(t, names) for t in _WINDOWS], names, "row", "col", [])
    errors = evaluate_batch(rows, candidates, features, "y", None, "mse")
    return spark.createDataFrame(list(zip(_WINDOWS, errors, strict=True)), "expression string, mse double").select("expression", rounded(F.col("mse")).alias("mse"))
