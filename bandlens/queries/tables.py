"""Metrics, preparation, archive and log analyses over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlens.operators import archive, metrics, prep, runlog
from bandlens.queries.registry import add, query, rounded
from bandlens.sources.tables import table

# ---- weighted means: y = returned, prediction from discount and tax, weight = quantity ---------------

_ROWS = "SELECT l_linestatus, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, (l_discount * 5 + l_tax * 4) AS p, l_quantity AS w, l_discount * 40 - l_tax * 30 - 0.5 AS s FROM lineitem"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.select("l_linestatus", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), (F.col("l_discount") * 5 + F.col("l_tax") * 4).alias("p"), F.col("l_quantity").cast("double").alias("w"), (F.col("l_discount") * 40 - F.col("l_tax") * 30 - 0.5).alias("s"))


_Q = "greatest(least(p, 1 - 1e-9), 1e-9)"
_BINARY = {
    "mae": ("p", metrics.mae, "sum(w * abs(p - y)) / sum(w)"),
    "mse": ("p", metrics.mse, "sum(w * (p - y) * (p - y)) / sum(w)"),
    "rmse": ("p", metrics.rmse, "sqrt(sum(w * (p - y) * (p - y)) / sum(w))"),
    "cross_entropy": ("p", metrics.cross_entropy, f"sum(w * -(y * ln({_Q}) + (1 - y) * ln(1 - {_Q}))) / sum(w)"),
    "nll_loss": ("lp", metrics.nll_loss, "sum(w * CASE WHEN y = 1 THEN -lp ELSE -ln(1 - exp(lp)) END) / sum(w)"),
    "focal_loss": ("p", metrics.focal_loss, f"sum(w * -pow(1 - CASE WHEN y = 1 THEN {_Q} ELSE 1 - {_Q} END, 2) * ln(CASE WHEN y = 1 THEN {_Q} ELSE 1 - {_Q} END)) / sum(w)"),
    "hinge_loss": ("s", metrics.hinge_loss, "sum(w * greatest(0, 1 - (2 * y - 1) * s)) / sum(w)"),
    "accuracy": ("p", metrics.accuracy, "sum(w * CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) / sum(w)"),
    "pearson": ("p", metrics.pearson, "abs((sum(w * p * y) / sum(w) - sum(w * p) / sum(w) * sum(w * y) / sum(w)) / sqrt((sum(w * p * p) / sum(w) - pow(sum(w * p) / sum(w), 2)) * (sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2))))"),
}


def _binary_query(name: str):
    column, f, _ = _BINARY[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _rows(spark, d).withColumn("lp", -F.abs("s") - 0.01)
        return rows.groupBy("l_linestatus").agg(rounded(f(F.col("y"), F.col(column), F.col("w"))).alias("value"))

    return run


for _name, (_c, _f, _s) in _BINARY.items():
    add(f"metric_{_name}", _binary_query(_name), f"SELECT l_linestatus, round({_s}, 6) + 0.0 AS value FROM (SELECT *, -abs(s) - 0.01 AS lp FROM ({_ROWS})) GROUP BY 1")

_MULTI = "SELECT label % 3 AS y, [CAST(v AS DOUBLE) * 10 for v in embedding[1:3]] AS s FROM embeddings"
_PROBA = f"SELECT y, s, [exp(v) / list_sum([exp(u) for u in s]) for v in s] AS p FROM ({_MULTI})"
_OWN = "greatest(least(p[y + 1], 1 - 1e-9), 1e-9)"
_MULTI_SQL = {
    "cross_entropy": ("p", metrics.cross_entropy, f"avg(-ln({_OWN}))"),
    "nll_loss": ("lp", metrics.nll_loss, "avg(-ln(p[y + 1]))"),
    "focal_loss": ("p", metrics.focal_loss, f"avg(-pow(1 - {_OWN}, 2) * ln({_OWN}))"),
    "hinge_loss": ("s", metrics.hinge_loss, "avg((greatest(0, 1 - s[y + 1] + s[(y + 1) % 3 + 1]) + greatest(0, 1 - s[y + 1] + s[(y + 2) % 3 + 1])) / 2)"),
    "accuracy": ("p", metrics.accuracy, "avg(CASE WHEN list_position(p, list_max(p)) = y + 1 THEN 1.0 ELSE 0.0 END)"),
}


def _multi_query(name: str):
    column, f, _ = _MULTI_SQL[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        from bandlens.functions.guards import softmax

        e = table(spark, d, "embeddings").select((F.col("label") % 3).alias("y"), F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double") * 10).alias("s"))
        e = e.withColumn("p", softmax(F.col("s"))).withColumn("lp", F.transform("p", F.ln))
        return e.agg(rounded(f(F.col("y"), F.col(column), None, True)).alias("value"), F.count(F.lit(1)).alias("n"))

    return run


for _name, (_c, _f, _s) in _MULTI_SQL.items():
    add(f"metric_{_name}_multi", _multi_query(_name), f"SELECT round({_s}, 6) + 0.0 AS value, count(*) AS n FROM ({_PROBA})")


@query("SELECT round(1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) + 0.0 AS value FROM (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)")
def metric_r_squared(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(rounded(metrics.r_squared(F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double") * 1500)).alias("value"))


@query("""
    WITH r AS (SELECT l_quantity AS y, l_discount + l_tax AS p FROM lineitem),
    k AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS b FROM r)
    SELECT round(abs(corr(a, b)), 6) + 0.0 AS value FROM k
""")
def metric_spearman(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("y"), (F.col("l_discount") + F.col("l_tax")).alias("p"))
    return metrics.spearman(rows, "y", "p").select(rounded(F.col("spearman")).alias("value"))


# Two classes of the embeddings by parity of the label, the first band as the prediction; scaled by its range.
_TWO = """e AS (SELECT label % 2 AS y, CAST(embedding[1] AS DOUBLE) AS p FROM embeddings),
    z AS (SELECT y, (p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ()) AS z FROM e),
    m AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, avg(z) FILTER (y = 0) AS m0, avg(z) FILTER (y = 1) AS m1, var_samp(z) FILTER (y = 0) AS v0, var_samp(z) FILTER (y = 1) AS v1,
          count(*) AS n, avg(z) AS mm, var_samp(z) AS v, var_pop(z) AS vp FROM z),
    k AS (SELECT y, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0 AS r FROM z),
    s AS (SELECT 2 * ((sum(r) FILTER (y = 1) - any_value(n1) * (any_value(n1) + 1) / 2.0) / (any_value(n0) * any_value(n1)) - 0.5) AS s FROM k, m)"""
_SSB, _SSW = "(n0 * pow(m0 - mm, 2) + n1 * pow(m1 - mm, 2))", "((n0 - 1) * v0 + (n1 - 1) * v1)"
_TWO_SQL = {
    "bhattacharyya": "CASE WHEN 0.25 * pow(m0 - m1, 2) / (v0 + v1) + 0.25 * ln(0.25 * (v0 / v1 + v1 / v0 + 2)) > 0 THEN (0.25 * pow(m0 - m1, 2) / (v0 + v1) + 0.25 * ln(0.25 * (v0 / v1 + v1 / v0 + 2))) * s ELSE CAST('-inf' AS DOUBLE) END",
    "hellinger": "sqrt(greatest(0, 1 - sqrt(2 * sqrt(v0 * v1) / (v0 + v1)) * exp(-0.25 * pow(m0 - m1, 2) / (v0 + v1)))) * s",
    "fisher": f"{_SSB} / {_SSW} * s",
    "f_statistic": f"{_SSB} / ({_SSW} / (n - 2)) * s",
    "compactness": "sqrt(v) / (0.5 * (sqrt(v0) + sqrt(v1))) * s",
    "separability": "s * (n0 * n1 * pow(m0 - m1, 2) / (n * n)) / vp",
    "eta_separability": "greatest(0, least(1, (n0 * n1 * pow(m0 - m1, 2) / (n * n)) / vp))",
}
_JS = """, h AS (SELECT least(CAST(floor(z * 50) AS INT), 49) AS b, count(*) FILTER (y = 0) AS h0, count(*) FILTER (y = 1) AS h1 FROM z GROUP BY 1),
    q AS (SELECT (h0 / n0 + 1e-10) / (1 + 50 * 1e-10) AS p0, (h1 / n1 + 1e-10) / (1 + 50 * 1e-10) AS p1 FROM h, m)
    SELECT round(greatest(0, least(1, sum(p0 * log2(2 * p0 / (p0 + p1)) + p1 * log2(2 * p1 / (p0 + p1))) / 2)) * any_value(s), 6) + 0.0 AS value FROM q, s"""
_EMD = """, c AS (SELECT z, count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM z GROUP BY 1),
    d AS (SELECT abs(sum(c0) OVER w / n0 - sum(c1) OVER w / n1) * (lead(z) OVER (ORDER BY z) - z) AS g FROM c, m WINDOW w AS (ORDER BY z))
    SELECT round(sum(g) * any_value(s), 6) + 0.0 AS value FROM d, s"""


def _two(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select((F.col("label") % 2).alias("y"), F.get("embedding", F.lit(0)).cast("double").alias("p"))


def _two_query(name: str):
    return lambda spark, d: metrics.two_class(_two(spark, d), "y", "p", [name]).select(rounded(F.col(name)).alias("value"))


for _name, _s in _TWO_SQL.items():
    add(f"metric_{_name}", _two_query(_name), f"WITH {_TWO} SELECT round({_s}, 6) + 0.0 AS value FROM m, s")
add("metric_js_divergence", _two_query("js_divergence"), f"WITH {_TWO}{_JS}")
add("metric_wasserstein", _two_query("wasserstein"), f"WITH {_TWO}{_EMD}")
add("metric_earth_movers", lambda spark, d: metrics.two_class(_two(spark, d), "y", "p", ["earth_movers"]).select(rounded(F.col("wasserstein")).alias("value")), f"WITH {_TWO}{_EMD}")
add("metric_auc_direction", lambda spark, d: metrics.auc_direction(metrics.scaled(_two(spark, d), "y", "p", []), []).select(rounded(F.col("s_dir")).alias("value")), f"WITH {_TWO} SELECT round(s, 6) + 0.0 AS value FROM s")

_CLASSES = "e AS (SELECT label AS y, CAST(embedding[1] AS DOUBLE) AS p FROM embeddings), z AS (SELECT y, (p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ()) AS z FROM e)"


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("y"), F.get("embedding", F.lit(0)).cast("double").alias("p"))


@query(f"""WITH {_CLASSES}, i AS (SELECT y, z, row_number() OVER () AS id FROM z),
    d AS (SELECT a.id, a.y AS ya, b.y AS yb, sum(abs(a.z - b.z)) AS t, count(*) AS n FROM i AS a JOIN i AS b ON true GROUP BY 1, 2, 3),
    ab AS (SELECT id, max(CASE WHEN ya = yb THEN t / (n - 1) END) AS a, min(CASE WHEN ya <> yb THEN t / n END) AS b FROM d GROUP BY 1)
    SELECT round(avg((b - a) / greatest(a, b)), 6) + 0.0 AS value FROM ab""")
def metric_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return metrics.silhouette(_classes(spark, d), "y", "p").select(rounded(F.col("silhouette")).alias("value"))


@query(f"""WITH {_CLASSES}, c AS (SELECT y, avg(z) AS c FROM z GROUP BY 1), g AS (SELECT z.y, avg(abs(z - c)) AS s, any_value(c) AS c FROM z JOIN c ON c.y = z.y GROUP BY 1)
    SELECT round(avg(r), 4) + 0.0 AS value FROM (SELECT a.y, max((a.s + b.s) / abs(a.c - b.c)) AS r FROM g AS a JOIN g AS b ON a.y <> b.y GROUP BY 1)""")
def metric_davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    return metrics.davies_bouldin(_classes(spark, d), "y", "p").select(rounded(F.col("davies_bouldin"), 4).alias("value"))


@query(f"""WITH {_CLASSES}, g AS (SELECT y, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY 1), t AS (SELECT avg(z) AS mm, count(*) AS nn FROM z)
    SELECT round(sum(n * pow(m - mm, 2)) * (any_value(nn) - count(*)) / (sum(n * v) * (count(*) - 1)), 6) + 0.0 AS value FROM g, t""")
def metric_calinski_harabasz(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calinski_harabasz(_classes(spark, d), "y", "p").select(rounded(F.col("calinski_harabasz")).alias("value"))


_CONFUSION = "SELECT l_linestatus AS y, CASE WHEN l_shipdate > TIMESTAMP '1996-01-01' THEN 'O' ELSE 'F' END AS p FROM lineitem"


@query(f"""WITH c AS ({_CONFUSION}), l AS (SELECT y AS label FROM c UNION SELECT p FROM c)
    SELECT label, round(coalesce(count(*) FILTER (y = label AND p = label) / nullif(count(*) FILTER (p = label), 0), 0), 6) + 0.0 AS precision,
    round(coalesce(count(*) FILTER (y = label AND p = label) / nullif(count(*) FILTER (y = label), 0), 0), 6) + 0.0 AS recall,
    round(coalesce(2 * count(*) FILTER (y = label AND p = label) / nullif(count(*) FILTER (p = label) + count(*) FILTER (y = label), 0), 0), 6) + 0.0 AS f1,
    count(*) FILTER (y = label) AS support FROM c, l GROUP BY 1""")
def report_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("y"), F.when(F.col("l_shipdate") > F.expr("timestamp'1996-01-01'"), "O").otherwise("F").alias("p"))
    return metrics.confusion(rows, "y", "p").select("label", *[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH v AS ({_ROWS}) SELECT round(sum((p - y) * (p - y)) / count(*) + (0.5 * (abs(2.0) + abs(-0.5)) + 0.5 * (4.0 + 0.25)) / (0.1 * 2), 6) + 0.0 AS value FROM v")
def metric_penalty_elasticnet(spark: SparkSession, d: str) -> DataFrame:
    term = metrics.penalty([2.0, -0.5], "elasticnet", 0.1)
    return _rows(spark, d).agg(rounded(metrics.penalised(metrics.mse(F.col("y"), F.col("p")), False, term)).alias("value"))


# ---- preparation -------------------------------------------------------------------------------------


@query("""
    WITH m AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem WHERE l_orderkey % 5 <> 0)
    SELECT l_returnflag, round(avg((l_quantity - mq) / sq), 6) + 0.0 AS q, round(avg((l_discount - md) / sd), 6) + 0.0 AS x, round(max((l_quantity - mq) / sq), 6) + 0.0 AS q_max FROM lineitem, m GROUP BY 1
""")
def standardize_train_only(spark: SparkSession, d: str) -> DataFrame:
    rows = prep.standardise(table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity", "l_discount"), ["l_quantity", "l_discount"], F.col("l_orderkey") % 5 != 0)
    return rows.groupBy("l_returnflag").agg(rounded(F.avg("l_quantity")).alias("q"), rounded(F.avg("l_discount")).alias("x"), rounded(F.max("l_quantity")).alias("q_max"))


@query("SELECT label, CAST(30 AS BIGINT) AS train, count(*) - 30 AS test FROM embeddings GROUP BY 1")
def split_per_class(spark: SparkSession, d: str) -> DataFrame:
    return _sides(prep.split(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 30))


@query("""
    WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), t AS (SELECT sum(n) AS total, CAST(floor(sum(n) * 0.4) AS BIGINT) AS want FROM c),
    q AS (SELECT label, n, CAST(floor(want * n / total) AS BIGINT) AS base, want * n / total - floor(want * n / total) AS rest, want FROM c, t),
    k AS (SELECT *, row_number() OVER (ORDER BY rest DESC, CAST(label AS VARCHAR)) AS rn, sum(base) OVER () AS bases FROM q)
    SELECT label, CAST(base + CASE WHEN rn <= want - bases THEN 1 ELSE 0 END AS BIGINT) AS train, CAST(n - base - CASE WHEN rn <= want - bases THEN 1 ELSE 0 END AS BIGINT) AS test FROM k
""")
def split_proportional(spark: SparkSession, d: str) -> DataFrame:
    return _sides(prep.split(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 0.4, "proportional"))


def _sides(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).alias("train"), F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).alias("test"))


@query("SELECT CAST(floor(count(*) * 0.25) AS BIGINT) AS train, count(*) - CAST(floor(count(*) * 0.25) AS BIGINT) AS test, count(*) AS keys FROM lineitem")
def split_random(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("key"), F.lit(1).alias("label"))
    rows = prep.split(rows, "key", "label", 0.25, "random")
    return rows.agg(F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).alias("train"), F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).alias("test"), F.count("key").alias("keys"))


_HIST = """x AS (SELECT l_extendedprice AS x FROM lineitem), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
    h AS (SELECT least(CAST(floor((x - lo) / (hi - lo) * 256) AS INT), 255) AS b, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM x, e GROUP BY 1)"""


@query(f"WITH {_HIST} SELECT b AS bin, n, round(lo + (b + 0.5) * (hi - lo) / 256, 4) + 0.0 AS centre FROM h")
def histogram_equal_width(spark: SparkSession, d: str) -> DataFrame:
    return prep.histogram(table(spark, d, "lineitem"), "l_extendedprice").select("bin", "n", rounded(F.col("centre"), 4).alias("centre"))


@query(f"""WITH {_HIST}, g AS (SELECT CAST(r.range AS INT) AS b, coalesce(h.n, 0) AS n, e.lo + (r.range + 0.5) * (e.hi - e.lo) / 256 AS c FROM range(256) AS r CROSS JOIN e LEFT JOIN h ON h.b = r.range),
    w AS (SELECT b, c, coalesce(sum(n) OVER p, 0) AS n0, coalesce(sum(n * c) OVER p, 0) AS s0, sum(n) OVER () AS nn, sum(n * c) OVER () AS ss FROM g WINDOW p AS (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    v AS (SELECT b, c, coalesce(n0 / nn * (1 - n0 / nn) * pow(s0 / nullif(n0, 0) - (ss - s0) / nullif(nn - n0, 0), 2), 0) AS v FROM w)
    SELECT round(c, 4) + 0.0 AS threshold, round(v, 2) + 0.0 AS variance FROM v ORDER BY round(v, 12) DESC, b LIMIT 1""")
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return prep.otsu(table(spark, d, "lineitem"), "l_extendedprice").select(rounded(F.col("threshold"), 4).alias("threshold"), rounded(F.col("variance"), 2).alias("variance"))


@query("SELECT CAST((n - 1) // 512 + 1 AS BIGINT) AS batches, n AS rows, least(n, 512) AS largest FROM (SELECT count(*) AS n FROM orders)")
def mini_batch_pool(spark: SparkSession, d: str) -> DataFrame:
    b = prep.mini_batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 512).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    return b.agg(F.count("batch").alias("batches"), F.sum("n").alias("rows"), F.max("n").alias("largest"))


@query("SELECT l_returnflag, CAST(rank - 1 AS INT) AS class, count(*) AS n FROM (SELECT l_returnflag, dense_rank() OVER (ORDER BY l_returnflag) AS rank FROM lineitem) GROUP BY 1, 2")
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    return prep.encode_labels(table(spark, d, "lineitem").select("l_returnflag"), "l_returnflag", "class")[0].groupBy("l_returnflag", "class").agg(F.count(F.lit(1)).alias("n"))


# ---- archive -------------------------------------------------------------------------------------------

_BEST = "b AS (SELECT * FROM hall_of_fame WHERE error IS NOT NULL AND isfinite(error) AND expression IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, complexity ORDER BY error, expression) = 1)"
_FRONT = f"{_BEST}, f AS (SELECT *, min(error) OVER (PARTITION BY run_id ORDER BY complexity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM b)"


@query(f"WITH {_FRONT} SELECT run_id, complexity, expression, error FROM f WHERE best IS NULL OR error < best")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    return archive.pareto_front(table(spark, d, "hall_of_fame"), by=["run_id"]).select("run_id", "complexity", "expression", "error")


@query(f"""WITH {_FRONT}, p AS (SELECT run_id, complexity, error, lag(error) OVER w AS pe, lag(complexity) OVER w AS pc FROM f WHERE best IS NULL OR error < best WINDOW w AS (PARTITION BY run_id ORDER BY complexity))
    SELECT run_id, complexity, round(CASE WHEN pe IS NULL OR complexity <= pc OR NOT error < pe THEN 0 WHEN error <= 0 THEN CAST('inf' AS DOUBLE) ELSE -ln(error / pe) / (complexity - pc) END, 6) + 0.0 AS score FROM p""")
def archive_score(spark: SparkSession, d: str) -> DataFrame:
    front = archive.pareto_front(table(spark, d, "hall_of_fame"), by=["run_id"]).drop("score")
    return archive.scores(front, by=["run_id"]).select("run_id", "complexity", rounded(F.col("score")).alias("score"))


@query(f"WITH {_BEST} SELECT run_id, complexity, expression FROM b ORDER BY error, complexity, expression LIMIT 1")
def select_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return archive.select_model(archive.best_by_complexity(table(spark, d, "hall_of_fame"), by=["run_id"]), "accuracy").select("run_id", "complexity", "expression")


@query("SELECT run_id, complexity, expression FROM hall_of_fame WHERE score IS NOT NULL AND isfinite(score) AND expression IS NOT NULL ORDER BY score DESC, complexity, expression LIMIT 1")
def select_score(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hall_of_fame").filter("score is not null and not isnan(score) and expression is not null")
    return archive.select_model(rows, "score").select("run_id", "complexity", "expression")


@query("""WITH h AS (SELECT * FROM hall_of_fame WHERE score IS NOT NULL AND isfinite(score) AND expression IS NOT NULL AND error IS NOT NULL AND isfinite(error))
    SELECT run_id, complexity, expression FROM h WHERE error <= (SELECT min(error) FROM h) * 1.5 ORDER BY score DESC, complexity, expression LIMIT 1""")
def select_best(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hall_of_fame").filter("score is not null and not isnan(score) and expression is not null and error is not null and not isnan(error)")
    return archive.select_model(rows, "best").select("run_id", "complexity", "expression")


# Sets of formulas have an order (their number); the run's parity stands for it here.
@query("""WITH h AS (SELECT run_id % 3 AS "order", complexity, error, expression FROM hall_of_fame WHERE error IS NOT NULL AND isfinite(error) AND expression IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY run_id % 3, complexity ORDER BY error, expression) = 1)
    SELECT "order", complexity, error FROM h AS a WHERE NOT EXISTS (SELECT 1 FROM h AS b WHERE b."order" <= a."order" AND b.complexity <= a.complexity AND b.error <= a.error
        AND (b."order" < a."order" OR b.complexity < a.complexity OR b.error < a.error))""")
def pareto_front_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hall_of_fame").select((F.col("run_id") % 3).alias("order"), "complexity", "error", "expression")
    return archive.pareto_sets(rows).select("order", "complexity", "error")


# ---- log -----------------------------------------------------------------------------------------------

_LOG = """l AS (SELECT *, regexp_replace(lower(trim(operation_name)), '[ -]', '_', 'g') AS op, coalesce(accepted, false) AS yes,
    CASE WHEN isfinite(fitness_delta) THEN fitness_delta END AS f, CAST(complexity_delta AS DOUBLE) AS c, CAST(order_delta AS DOUBLE) AS o
    FROM (SELECT * FROM evolution_log QUALIFY row_number() OVER (PARTITION BY run_id, entry_no ORDER BY ingested_at DESC, log_id DESC) = 1))"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Each entry once, as it was delivered last."""
    return runlog.normalised(table(spark, d, "evolution_log"), ["run_id", "entry_no"])


def _all_rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


@query(f"""WITH {_LOG} SELECT count(*) AS total_operations, CAST(sum(CAST(yes AS INT)) AS BIGINT) AS accepted_operations, {_r('avg(CAST(accepted AS DOUBLE))', 'acceptance_rate')}, {_r('avg(f)', 'avg_fitness_delta')}, {_r('avg(c)', 'avg_complexity_delta')},
    {_r('avg(f) FILTER (yes)', 'avg_fitness_delta_accepted')}, {_r('avg(c) FILTER (yes)', 'avg_complexity_delta_accepted')}, {_r('max(timestamp)', 'total_runtime')} FROM l""")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    return _all_rounded(runlog.summary(_log(spark, d)))


@query(f"WITH {_LOG} SELECT operation_type AS value, count(*) AS n FROM l WHERE operation_type IS NOT NULL GROUP BY 1")
def log_counts_by_type(spark: SparkSession, d: str) -> DataFrame:
    return runlog.counts(_log(spark, d), "operation_type")


@query(f"WITH {_LOG} SELECT op AS value, count(*) AS n FROM l WHERE op IS NOT NULL GROUP BY 1")
def log_counts_by_name(spark: SparkSession, d: str) -> DataFrame:
    return runlog.counts(_log(spark, d), "operation_name")


def _moments(x: str, name: str) -> str:
    return ", ".join(_r(f"{f}({x})", f"{n}_{name}") for n, f in (("avg", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))


@query(f"""WITH {_LOG} SELECT op AS operation_name, count(accepted) AS total_attempts, CAST(sum(CAST(yes AS INT)) AS BIGINT) AS total_accepted, {_r('avg(CAST(accepted AS DOUBLE))', 'acceptance_rate')},
    {_moments('f', 'fitness_delta')}, {_moments('c', 'complexity_delta')}, {_r('avg(f) FILTER (yes)', 'avg_fitness_delta_accepted')}, {_r('avg(c) FILTER (yes)', 'avg_complexity_delta_accepted')},
    {_r('avg(o) FILTER (yes)', 'avg_order_delta_accepted')}, {_r('stddev_samp(o) FILTER (yes)', 'std_order_delta_accepted')} FROM l WHERE op IS NOT NULL GROUP BY 1""")
def log_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    return _all_rounded(runlog.effectiveness(_log(spark, d)))


@query(f"""WITH {_LOG} SELECT CASE WHEN o > 0 THEN 'increase' WHEN o < 0 THEN 'decrease' ELSE 'no_change' END AS change, count(accepted) AS n, CAST(sum(CAST(yes AS INT)) AS BIGINT) AS accepted,
    {_r('avg(CAST(accepted AS DOUBLE))', 'rate')}, {_r('avg(f)', 'avg_fitness_delta')} FROM l WHERE o IS NOT NULL GROUP BY 1""")
def log_order_changes(spark: SparkSession, d: str) -> DataFrame:
    return _all_rounded(runlog.order_changes(_log(spark, d)))


@query(f"""WITH {_LOG} SELECT count(*) AS n, CAST(sum(CAST(yes AS INT)) AS BIGINT) AS accepted, {_r('avg(CAST(accepted AS DOUBLE))', 'rate')}, {_r('avg(o)', 'avg_order_delta')}, {_r('stddev_samp(o)', 'std_order_delta')},
    {_r('avg(o) FILTER (yes)', 'avg_order_delta_accepted')}, {_r('stddev_samp(o) FILTER (yes)', 'std_order_delta_accepted')},
    {_r('corr(o, f) FILTER (yes AND f IS NOT NULL)', 'order_fitness_correlation')}, {_r('corr(o, c) FILTER (yes AND c IS NOT NULL)', 'order_complexity_correlation')} FROM l WHERE o IS NOT NULL""")
def log_order_summary(spark: SparkSession, d: str) -> DataFrame:
    return _all_rounded(runlog.order_summary(_log(spark, d)))


@query(f"""WITH {_LOG} SELECT op AS operation_name, {_r('avg(o)', 'avg_order_delta')}, {_r('stddev_samp(o)', 'std_order_delta')}, min(order_delta) AS min_order_delta, max(order_delta) AS max_order_delta, {_r('avg(f)', 'avg_fitness_delta')}
    FROM l WHERE o IS NOT NULL AND yes AND op IS NOT NULL GROUP BY 1""")
def log_order_by_operation(spark: SparkSession, d: str) -> DataFrame:
    return _all_rounded(runlog.order_by_operation(_log(spark, d)))


@query(f"""WITH {_LOG} SELECT CASE WHEN o <= -1 THEN 'decrease' WHEN o <= 0 THEN 'no_change_neg' WHEN o <= 1 THEN 'no_change_pos' ELSE 'increase' END AS bin, count(*) AS n,
    {_r('avg(c)', 'avg_complexity_delta')}, {_r('stddev_samp(c)', 'std_complexity_delta')}, {_r('avg(f)', 'avg_fitness_delta')}, {_r('stddev_samp(f)', 'std_fitness_delta')} FROM l WHERE o IS NOT NULL AND yes GROUP BY 1""")
def log_order_bins(spark: SparkSession, d: str) -> DataFrame:
    return _all_rounded(runlog.order_bins(_log(spark, d)))


_ROLL = "avg(CAST(accepted AS DOUBLE)) OVER w AS acceptance_rate, avg(f) OVER w AS avg_fitness_delta, avg(c) OVER w AS avg_complexity_delta, count(accepted) OVER w AS na, count(f) OVER w AS nf, count(c) OVER w AS nc"
_ROLLED = f"{_r('acceptance_rate', 'acceptance_rate', 9)}, {_r('avg_fitness_delta', 'avg_fitness_delta', 9)}, {_r('avg_complexity_delta', 'avg_complexity_delta', 9)}"


@query(f"""WITH {_LOG}, r AS (SELECT run_id, log_id, generation, timestamp, {_ROLL} FROM l WINDOW w AS (PARTITION BY run_id ORDER BY timestamp, log_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
    SELECT run_id, log_id, generation, timestamp, {_ROLLED} FROM r WHERE na = 100 AND nf = 100 AND nc = 100""")
def log_rolling(spark: SparkSession, d: str) -> DataFrame:
    return runlog.trends(_log(spark, d)).select("run_id", "log_id", "generation", "timestamp", *[rounded(F.col(c), 9).alias(c) for c in ("acceptance_rate", "avg_fitness_delta", "avg_complexity_delta")])


@query(f"""WITH {_LOG}, r AS (SELECT row_number() OVER (ORDER BY timestamp, log_id) AS place, log_id, timestamp, {_ROLL} FROM l WINDOW w AS (ORDER BY timestamp, log_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
    SELECT place, log_id, timestamp, {_ROLLED} FROM r WHERE na = 100 AND nf = 100 AND nc = 100""")
def log_rolling_global(spark: SparkSession, d: str) -> DataFrame:
    return runlog.global_trends(_log(spark, d)).select("place", "log_id", "timestamp", *[rounded(F.col(c), 9).alias(c) for c in ("acceptance_rate", "avg_fitness_delta", "avg_complexity_delta")])


@query(f"""WITH {_LOG}, t AS (SELECT quantile_cont(f, 0.75) FILTER (f > 0) AS t FROM l WHERE yes)
    SELECT op AS operation_name, count(*) AS n, {_r('sum(f)', 'total_improvement', 4)}, {_r('avg(f)', 'avg_improvement')}, {_r('max(f)', 'max_improvement')}, {_r('avg(c)', 'avg_complexity_change')}, {_r('any_value(t)', 'threshold')}
    FROM l, t WHERE yes AND f > t AND op IS NOT NULL GROUP BY 1""")
def log_improvement(spark: SparkSession, d: str) -> DataFrame:
    return _all_rounded(runlog.improvements(_log(spark, d)).withColumn("total_improvement", F.round("total_improvement", 4)))


@query(f"""WITH {_LOG} SELECT CASE WHEN c <= -5 THEN 'large_decrease' WHEN c <= -1 THEN 'small_decrease' WHEN c <= 0 THEN 'no_change_neg' WHEN c <= 1 THEN 'no_change_pos' WHEN c <= 5 THEN 'small_increase' ELSE 'large_increase' END AS bin,
    count(f) AS n, {_r('avg(f)', 'avg_fitness_delta')}, {_r('stddev_samp(f)', 'std_fitness_delta')} FROM l WHERE yes AND c IS NOT NULL GROUP BY 1""")
def log_complexity_bins(spark: SparkSession, d: str) -> DataFrame:
    return _all_rounded(runlog.complexity_bins(_log(spark, d)))


@query(f"WITH {_LOG} SELECT {_r('corr(f, c)', 'correlation')} FROM l WHERE yes AND f IS NOT NULL AND c IS NOT NULL")
def log_complexity_correlation(spark: SparkSession, d: str) -> DataFrame:
    return _all_rounded(runlog.complexity_correlation(_log(spark, d)))


@query(f"""WITH {_LOG}, e AS (SELECT min(temperature) AS lo, max(temperature) AS hi FROM l WHERE temperature IS NOT NULL)
    SELECT CAST(greatest(ceil((temperature - lo) / (hi - lo) * 10) - 1, 0) AS INT) AS bin, count(accepted) AS n, {_r('avg(CAST(accepted AS DOUBLE))', 'acceptance_rate')}, {_r('avg(f)', 'avg_fitness_delta')}, {_r('avg(temperature)', 'avg_temperature')}
    FROM l, e WHERE temperature IS NOT NULL GROUP BY 1""")
def log_temperature_bins(spark: SparkSession, d: str) -> DataFrame:
    return _all_rounded(runlog.temperature_bins(_log(spark, d)))


@query(f"WITH {_LOG} SELECT generation % 2 AS part, count(*) AS n, {_r('min(timestamp)', 'first')}, {_r('max(timestamp)', 'last')} FROM l GROUP BY 1")
def log_merge(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    both = runlog.merge(log.filter("generation % 2 = 0"), log.filter("generation % 2 = 1"))
    return both.groupBy((F.col("generation") % 2).alias("part")).agg(F.count(F.lit(1)).alias("n"), rounded(F.min("timestamp")).alias("first"), rounded(F.max("timestamp")).alias("last"))
