"""Guarded operators, band reductions, output functions and compiled formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlens.functions import bands, guards
from bandlens.queries.registry import add, query, rounded
from bandlens.sources.tables import table

# Operands by operator: SQL text that both sides read the same way.
_OPERANDS = {
    "add": ("l_extendedprice * 1e5", "l_quantity"), "sub": ("l_quantity", "l_extendedprice * 1e5"), "mul": ("l_extendedprice * 1e4", "l_quantity"),
    "div": ("l_extendedprice", "l_discount"), "power": ("l_quantity - 25", "l_discount * 100"), "maximum": ("l_tax", "l_discount"), "minimum": ("l_tax", "l_discount"),
    "sqrt": ("l_discount - 0.05",), "log": ("l_discount - l_tax",), "exp": ("l_quantity / 10",), "abs": ("l_discount - l_tax",), "neg": ("l_quantity",),
    "inv": ("l_discount",), "sin": ("l_quantity",), "cos": ("l_quantity",), "tan": ("l_tax",), "sinh": ("l_discount * 10",), "cosh": ("l_discount * 10",),
    "tanh": ("l_discount * 10",), "identity": ("l_quantity",), "sigmoid": ("l_extendedprice / 100 - l_quantity * 10",), "softplus": ("l_quantity * 4 - 100",), "expsq": ("l_discount * 10",),
}
_SQL = {
    "add": "CASE WHEN abs(x + y) < 1e10 THEN x + y ELSE 0 END", "sub": "CASE WHEN abs(x - y) < 1e10 THEN x - y ELSE 0 END",
    "mul": "CASE WHEN abs(x) < 1e10 AND abs(y) < 1e10 AND abs(x * y) < 1e10 THEN x * y ELSE 0 END",
    "div": "CASE WHEN abs(y) > 1e-10 AND abs(x / nullif(y, 0)) < 1e10 THEN x / nullif(y, 0) ELSE 1 END",
    "power": "CASE WHEN (x >= 0 OR abs(y - round_even(y, 0)) <= 1e-10) AND NOT (x = 0 AND y < 0) AND abs(x) < 1e5 AND abs(y) < 100 AND abs(pow(x, y)) < 1e10 THEN pow(x, y) ELSE 1 END",
    "maximum": "greatest(x, y)", "minimum": "least(x, y)", "sqrt": "sqrt(abs(x))", "log": "CASE WHEN abs(x) > 0.001 THEN ln(abs(x)) ELSE 0 END",
    "exp": "exp(least(x, 700))", "abs": "abs(x)", "neg": "-x", "inv": "CASE WHEN abs(x) > 0.001 THEN 1 / nullif(x, 0) ELSE 0 END", "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)",
    "sinh": "(exp(x) - exp(-x)) / 2", "cosh": "(exp(x) + exp(-x)) / 2", "tanh": "(exp(x) - exp(-x)) / (exp(x) + exp(-x))", "identity": "x",
    "sigmoid": "CAST(CAST(CASE WHEN x <= -88 THEN 0 WHEN x >= 88 THEN 1 ELSE 1 / (1 + exp(-x)) END AS FLOAT) AS DOUBLE)",
    "softplus": "ln(1 + exp(greatest(least(x, 88), -88)))", "expsq": "exp(-pow(greatest(least(x, 30), -30), 2))",
}


def _operator_query(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        operands = [F.expr(f"cast({x} as double)") for x in _OPERANDS[name]]
        rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", *[x.alias(f"o{i}") for i, x in enumerate(operands)])
        columns = [F.col(f"o{i}") for i in range(len(operands))]
        op = guards.operator(name)
        rows = rows.withColumn("r", op.raw(*columns))
        rows = rows.withColumn("v", F.col("r") if op.guard is None else op.guard(F.col("r"), *columns))
        return rows.groupBy("l_returnflag", "l_linestatus").agg(rounded(F.avg("v"), 4).alias("mean"), rounded(F.min("v"), 4).alias("low"), rounded(F.max("v"), 4).alias("high"), F.count("v").alias("n"))

    return run


for _name, _operands in _OPERANDS.items():
    _cols = ", ".join(f"CAST({x} AS DOUBLE) AS {c}" for x, c in zip(_operands, "xy", strict=False))
    add(
        f"op_{_name}", _operator_query(_name),
        f"WITH o AS (SELECT l_returnflag, l_linestatus, {_cols} FROM lineitem), v AS (SELECT *, {_SQL[_name]} AS v FROM o) "
        "SELECT l_returnflag, l_linestatus, round(avg(v), 4) + 0.0 AS mean, round(min(v), 4) + 0.0 AS low, round(max(v), 4) + 0.0 AS high, count(v) AS n FROM v GROUP BY 1, 2",
    )


@query("""
    SELECT l_returnflag, l_linestatus, round(avg(v), 6) + 0.0 AS mean, count(*) AS n FROM (
        SELECT l_returnflag, l_linestatus, CASE WHEN abs(b) > 1e-10 AND abs(a / nullif(b, 0)) < 1e10 THEN a / nullif(b, 0) ELSE 1 END AS v
        FROM (SELECT l_returnflag, l_linestatus, l_tax - l_discount AS a, l_tax + l_discount AS b FROM lineitem)) GROUP BY 1, 2
""")
def flagship_normalised_difference(spark: SparkSession, d: str) -> DataFrame:
    """The guarded normalised difference of two columns, mean by class, through the formula compiler."""
    from bandlens.expr.compile_spark import with_formula
    from bandlens.expr.parse import parse

    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_tax").alias("x0"), F.col("l_discount").alias("x1"))
    rows = with_formula(rows, parse("(x0 - x1) / (x0 + x1)", ["x0", "x1"]), "v")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(rounded(F.avg("v")).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("""
    WITH RECURSIVE g(i, id, v) AS (
        SELECT 0, row_number() OVER (), l_quantity FROM lineitem
        UNION ALL SELECT i + 1, id, CASE WHEN i % 2 = 0 THEN CASE WHEN abs(v + 0.5) < 1e10 THEN v + 0.5 ELSE 0 END ELSE CASE WHEN abs(v) < 1e10 AND abs(v * 1.25) < 1e10 THEN v * 1.25 ELSE 0 END END FROM g WHERE i < 20)
    SELECT round(avg(v), 4) + 0.0 AS mean, round(min(v), 4) + 0.0 AS low, round(max(v), 4) + 0.0 AS high, count(*) AS n FROM g WHERE i = 20
""")
def formula_deep_chain(spark: SparkSession, d: str) -> DataFrame:
    """A chain of 20 guarded operators, compiled level by level."""
    from bandlens.expr.compile_spark import with_formula
    from bandlens.expr.parse import parse

    text = "x0"
    for i in range(20):
        text = f"({text} + 0.5)" if i % 2 == 0 else f"({text} * 1.25)"
    rows = with_formula(table(spark, d, "lineitem").select(F.col("l_quantity").alias("x0")), parse(text, ["x0"]), "v")
    return rows.agg(rounded(F.avg("v"), 4).alias("mean"), rounded(F.min("v"), 4).alias("low"), rounded(F.max("v"), 4).alias("high"), F.count(F.lit(1)).alias("n"))


# ---- operators at the edges of their guards ---------------------------------------------------------

_NAN, _INF = float("nan"), float("inf")
#: Operator, operands, value: missing, infinite and signed zero operands, and both sides of each limit.
_EDGES = [
    ("add", 9999999999.0, 0.5, 9999999999.5), ("add", 1e10, 0.0, 0.0), ("add", 5e9, 5e9, 0.0), ("add", _NAN, 1.0, 0.0), ("add", _INF, 1.0, 0.0), ("add", None, 1.0, 0.0), ("add", -0.0, 0.0, 0.0),
    ("sub", 3.0, 1.0, 2.0), ("sub", -1e10, 0.0, 0.0), ("sub", _INF, _INF, 0.0), ("sub", None, None, 0.0),
    ("mul", 1e5, 9e4, 9e9), ("mul", 1e5, 1e5, 0.0), ("mul", 1e10, 0.0, 0.0), ("mul", _INF, 0.0, 0.0), ("mul", _NAN, 2.0, 0.0),
    ("div", 1.0, 0.0, 1.0), ("div", 1.0, -0.0, 1.0), ("div", 1.0, 1e-10, 1.0), ("div", 1.0, 2e-10, 5e9), ("div", 1e10, 1.0, 1.0), ("div", _NAN, 1.0, 1.0), ("div", 1.0, _INF, 0.0), ("div", None, 2.0, 1.0),
    ("power", -2.0, 3.0, -8.0), ("power", -8.0, 0.5, 1.0), ("power", 0.0, -1.0, 1.0), ("power", 1e5, 1.0, 1.0), ("power", 2.0, 100.0, 1.0), ("power", 2.0, 10.0, 1024.0), ("power", _NAN, 1.0, 1.0), ("power", 1000.0, 4.0, 1.0),
    ("log", 0.001, None, 0.0), ("log", 0.0011, None, -6.812445), ("log", -2.0, None, 0.693147), ("log", _NAN, None, 0.0), ("log", None, None, 0.0),
    ("inv", 0.001, None, 0.0), ("inv", 0.002, None, 500.0), ("inv", -0.0, None, 0.0), ("inv", _NAN, None, 0.0), ("inv", _INF, None, 0.0),
    ("sqrt", -4.0, None, 2.0), ("exp", 0.0, None, 1.0), ("exp", _NAN, None, _NAN), ("abs", -0.0, None, 0.0), ("neg", 0.0, None, 0.0),
    ("maximum", _NAN, 1.0, _NAN), ("maximum", -1.0, 1.0, 1.0), ("minimum", _NAN, 1.0, _NAN), ("minimum", -1.0, 1.0, -1.0),
    ("sigmoid", 88.0, None, 1.0), ("sigmoid", -88.0, None, 0.0), ("sigmoid", 0.0, None, 0.5), ("sigmoid", _INF, None, 1.0), ("softplus", 1000.0, None, 88.0), ("softplus", _NAN, None, _NAN), ("expsq", 100.0, None, 0.0), ("expsq", 0.0, None, 1.0),
]


def _sql_number(v: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if v is None else f"CAST('{v!r}' AS DOUBLE)"


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{o}', {_sql_number(w)})" for i, (o, _, _, w) in enumerate(_EDGES)) + ") AS t(case_no, operator, value)")
def op_edges(spark: SparkSession, d: str) -> DataFrame:
    """The guards at NaN, infinities, nulls, signed zeros and on both sides of each limit."""
    rows = spark.createDataFrame([(i, o, x, y) for i, (o, x, y, _) in enumerate(_EDGES)], "case_no int, operator string, x double, y double")
    value = F.lit(None).cast("double")
    for name in dict.fromkeys(e[0] for e in _EDGES):
        operands = [F.col("x"), F.col("y")][: guards.operator(name).arity]
        value = F.when(F.col("operator") == name, guards.apply(name, *operands)).otherwise(value)
    return rows.select("case_no", "operator", rounded(value).alias("value"))


# ---- bands ---------------------------------------------------------------------------------------

_START, _END = 4, 35


def _band_query(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "embeddings").select("vec_id", rounded(bands.reduce(F.col("embedding"), name, _START, _END)).alias("value"))

    return run


_BAND_SQL = {
    "mean": "list_sum(a) / len(a)", "sum": "list_sum(a)", "max": "list_max(a)", "min": "list_min(a)", "range": "list_max(a) - list_min(a)", "median": "list_aggregate(a, 'quantile_cont', 0.5)",
    "std": "list_aggregate(a, 'stddev_pop')", "var": "list_aggregate(a, 'var_pop')", **{f"percentile{q}": f"list_aggregate(a, 'quantile_cont', {int(q) / 100})" for q in ("5", "25", "50", "75", "95")},
    "slope": "list_sum([(i - 1 - (len(a) - 1) / 2.0) * a[i] for i in range(1, len(a) + 1)]) / (len(a) * (len(a) * len(a) - 1) / 12.0)",
}
_DIFF = "[{a}[i + 1] - {a}[i] for i in range(1, len({a}))]"
for _name in [*_BAND_SQL, "d1_mean", "d1_max", "d1_std", "d1_slope", "d2_mean", "d2_slope", "d2_percentile75"]:
    _order, _stat, _q = bands.parse(_name)
    _a = f"CAST(embedding[{_START + 1}:{_END + 1}] AS DOUBLE[])"
    _steps = [f"SELECT vec_id, {_a} AS a FROM embeddings"]
    for _ in range(_order):
        _steps.append(f"SELECT vec_id, {_DIFF.format(a='a')} AS a FROM ({_steps[-1]})")
    add(f"band_{_name}", _band_query(_name), f"SELECT vec_id, round({_BAND_SQL[_name.split('_', 1)[-1] if _order else _name]}, 6) + 0.0 AS value FROM ({_steps[-1]})")


@query("SELECT vec_id, NOT list_contains([isnan(v) OR v IS NULL for v in embedding], true) AS valid FROM embeddings")
def data_mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", bands.valid(F.col("embedding")).alias("valid"))


@query("SELECT vec_id, round(CAST(embedding[3] AS DOUBLE), 6) + 0.0 AS value FROM embeddings")
def variable_of_array(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", rounded(F.get("embedding", F.lit(2)).cast("double")).alias("value"))


# ---- output functions ------------------------------------------------------------------------------

_SCORES = "SELECT vec_id, label, [CAST(embedding[1] AS DOUBLE) * 10, CAST(embedding[2] AS DOUBLE) * 10, CAST(embedding[3] AS DOUBLE) * 10] AS s FROM embeddings"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double") * 10).alias("s"))


@query(f"SELECT vec_id, [round(exp(v - list_max(s)) / list_sum([exp(w - list_max(s)) for w in s]), 6) + 0.0 for v in s] AS p FROM ({_SCORES})")
def out_softmax(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("vec_id", F.transform(guards.softmax(F.col("s")), lambda v: rounded(v)).alias("p"))


@query(f"SELECT vec_id, list_position(s, list_max(s)) - 1 AS class FROM ({_SCORES})")
def predict_argmax(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("vec_id", guards.argmax(F.col("s")).alias("class"))


@query(f"SELECT vec_id, round(1 / (1 + exp(-s[1])), 6) + 0.0 AS p1, s[1] > 0 AS hinge_class, 1 / (1 + exp(-s[1])) > 0.5 AS proba_class FROM ({_SCORES})")
def predict_binary(spark: SparkSession, d: str) -> DataFrame:
    s = F.get("s", F.lit(0))
    return _scores(spark, d).select("vec_id", rounded(guards.expit(s)).alias("p1"), (s > 0).alias("hinge_class"), (guards.expit(s) > 0.5).alias("proba_class"))


@query("""
    WITH m AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem WHERE l_orderkey % 4 <> 0)
    SELECT l_returnflag, round(avg(z), 4) + 0.0 AS mean, round(max(z), 4) + 0.0 AS high, count(*) AS n FROM (
        SELECT l_returnflag, CAST(CAST(greatest(least((l_extendedprice - m) / s, 1000), -1000) AS FLOAT) AS DOUBLE) AS z FROM lineitem, m) GROUP BY 1
""")
def out_zscore(spark: SparkSession, d: str) -> DataFrame:
    """Moments of the training rows only (a split by key), applied to all rows."""
    from bandlens.operators.prep import zscore

    rows = zscore(table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_extendedprice"), ["l_extendedprice"], F.col("l_orderkey") % 4 != 0)
    z = F.col("l_extendedprice").cast("double")
    return rows.groupBy("l_returnflag").agg(rounded(F.avg(z), 4).alias("mean"), rounded(F.max(z), 4).alias("high"), F.count(F.lit(1)).alias("n"))
