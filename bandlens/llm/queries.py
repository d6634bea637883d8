"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlens.llm import cluster, cube, encode, language, mix, percentiles, varied
from bandlens.sources.tables import table, water_records


#: Records of a varied subset.
SUBSET = 4000
_SIDES = {"NIR": 0.0105, "SWIR1": 0.00025}


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    records = water_records(spark, d, ["label", "NIR", "SWIR1"])
    return records.filter(F.col("label").between(0, 4) & F.col("NIR").between(0, 1) & F.col("SWIR1").between(0, 1))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return varied.alone_records(_pixels(spark, d), SUBSET, "sample_id", "label", _SIDES)


def p1_subset(spark: SparkSession, d: str) -> DataFrame:
    return varied.varied_subset(_pixels(spark, d), SUBSET, "sample_id", "label", _SIDES)


_BANDS = ["Blue", "Green", "Red", "SWIR2"]


def _banded(spark: SparkSession, d: str) -> DataFrame:
    records = water_records(spark, d, _BANDS)
    for c in _BANDS:
        records = records.filter(F.col(c).between(0, 1))
    return records


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = cluster.linked_clusters(_banded(spark, d), "sample_id", _BANDS, 0.0105, 2, 40)
    return found.filter("sample_id <> head").select(F.col("head").alias("head_id"), "sample_id")


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.clusters(_banded(spark, d), "sample_id", _BANDS, 0.0105)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.unusual_medians(table(spark, d, "evolution_log"))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.log_percentiles(table(spark, d, "evolution_log"), [0.1, 0.25, 0.5, 0.75, 0.9])


def _targets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return cube.sample_to_targets(water_records(spark, d, ["scene_id", "label"]), table(spark, d, "sampling_plans"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d)[1].filter("short").select("plan_id", "label")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d)[0]


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d)[1]


def p4_targets(spark: SparkSession, d: str) -> DataFrame:
    """What SQL can say of the samples: needs, records, expected counts, and that each count is next to the expected one."""
    r = _targets(spark, d)[1]
    return r.select("plan_id", "label", "need", "available", (F.round("expected", 6) + 0.0).alias("expected"), (F.abs(F.col("drawn") - F.col("expected")) < 1).alias("near"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = encode.count_tokens(table(spark, d, "documents"), ["doc_id", "term", "source"])
    return mix.mix_sources(sizes, table(spark, d, "source_mixes"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1].filter("unmet").select("mix_id", "source")


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_languages(language.detect_languages(table(spark, d, "documents")))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return language.detect_languages(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_subset, p2_found, p2_clusters, p3_found, p3_percentiles, p4_found, p4_sample, p4_shares, p4_targets, p6_ids, p7_found, p7_sample, p7_shares, p8_found, p8_passages)}

_RECORDS = "WITH r AS (SELECT * FROM sentinel2_water WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC, row_id DESC) = 1)"

SQL = {
    "p1_found": _RECORDS
    + """
        , v AS (SELECT sample_id, label, NIR, SWIR1, CAST(floor(NIR / 0.0105) AS INT) AS a, CAST(floor(SWIR1 / 0.00025) AS INT) AS b
                FROM r WHERE label BETWEEN 0 AND 4 AND NIR BETWEEN 0 AND 1 AND SWIR1 BETWEEN 0 AND 1)
        SELECT sample_id FROM v AS x WHERE NOT EXISTS (
            SELECT 1 FROM v AS y WHERE y.label = x.label AND y.a BETWEEN x.a - 2 AND x.a + 2 AND y.b BETWEEN x.b - 2 AND x.b + 2
            AND y.sample_id <> x.sample_id AND abs(y.NIR - x.NIR) < 0.0105 AND abs(y.SWIR1 - x.SWIR1) < 0.00025)
    """,
    # Links by cells of one tolerance; components by carrying the smallest sample along the links.
    "p2_found": _RECORDS.replace("WITH", "WITH RECURSIVE")
    + """
        , v AS (SELECT sample_id AS id, Blue AS a, Green AS b, Red AS c, SWIR2 AS d, CAST(floor(Blue / 0.0105) AS INT) AS i, CAST(floor(Green / 0.0105) AS INT) AS j, CAST(floor(Red / 0.0105) AS INT) AS k
                FROM r WHERE Blue BETWEEN 0 AND 1 AND Green BETWEEN 0 AND 1 AND Red BETWEEN 0 AND 1 AND SWIR2 BETWEEN 0 AND 1),
        w AS (SELECT id, min(id) OVER (PARTITION BY a, b, c, d) AS rep, a, b, c, d, i, j, k FROM v),
        u AS (SELECT DISTINCT rep AS id, a, b, c, d, i, j, k FROM w),
        e AS MATERIALIZED (SELECT x.id AS x, y.id AS y FROM u AS x JOIN (SELECT u.*, i + p.range AS i2, j + q.range AS j2, k + s.range AS k2 FROM u, range(-1, 2) AS p, range(-1, 2) AS q, range(-1, 2) AS s) AS y
              ON x.i = y.i2 AND x.j = y.j2 AND x.k = y.k2
              WHERE x.id <> y.id AND abs(x.a - y.a) < 0.0105 AND abs(x.b - y.b) < 0.0105 AND abs(x.c - y.c) < 0.0105 AND abs(x.d - y.d) < 0.0105),
        g(id, head) USING KEY (id) AS (SELECT id, id FROM u
              UNION SELECT n.id, n.head FROM (SELECT e.x AS id, min(g.head) AS head FROM g JOIN e ON e.y = g.id GROUP BY e.x) AS n JOIN recurring.g AS o ON o.id = n.id WHERE n.head < o.head),
        m AS (SELECT w.id, g.head FROM w JOIN g ON g.id = w.rep),
        n AS (SELECT head, count(*) AS size FROM m GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40)
        SELECT m.head AS head_id, m.id AS sample_id FROM m JOIN n ON n.head = m.head WHERE m.id <> m.head
    """,
    "p4_found": _RECORDS
    + """
        SELECT p.plan_id, p.label FROM sampling_plans AS p
        LEFT JOIN (SELECT scene_id, label, count(*) AS n FROM r GROUP BY 1, 2) AS c ON c.scene_id = p.scene_id AND c.label = p.label
        WHERE coalesce(c.n, 0) < greatest(coalesce(p.min_count, 0), CAST(floor(p.sample_size * p.target_share + 0.5) AS INT))
    """,
    "p4_targets": _RECORDS
    + """
        , n AS (SELECT p.plan_id, p.label, p.sample_size, p.sample_size * p.target_share AS target, coalesce(p.min_count, 0) AS least, coalesce(c.n, 0) AS available,
                       greatest(coalesce(p.min_count, 0), CAST(floor(p.sample_size * p.target_share + 0.5) AS INT)) AS need
                FROM sampling_plans AS p LEFT JOIN (SELECT scene_id, label, count(*) AS n FROM r GROUP BY 1, 2) AS c ON c.scene_id = p.scene_id AND c.label = p.label),
        t AS (SELECT *, least(need, available) AS take, least(need, available) - least(least, need, available) AS spare FROM n),
        w AS (SELECT *, greatest(sum(take) OVER p - sample_size, 0) AS over, sum(spare) OVER p AS spares, max(CASE WHEN least > floor(target + 0.5) THEN 1 ELSE 0 END) OVER p AS forced FROM t WINDOW p AS (PARTITION BY plan_id))
        SELECT plan_id, label, need, available, round(CASE WHEN forced = 1 AND over > 0 AND spares > 0 THEN take - least(over, spares) * spare / spares ELSE CAST(take AS DOUBLE) END, 6) + 0.0 AS expected, true AS near FROM w
    """,
    "p3_found": """
        WITH entries AS (
            SELECT DISTINCT run_id, entry_no, regexp_replace(lower(trim(operation_name)), '[ -]', '_', 'g') AS operation_name,
                   fitness_delta, CAST(complexity_delta AS DOUBLE) AS complexity_delta
            FROM evolution_log WHERE operation_name IS NOT NULL),
        v AS (
            SELECT run_id, operation_name, 'fitness_delta' AS field, fitness_delta AS v FROM entries
            WHERE fitness_delta IS NOT NULL AND NOT isnan(fitness_delta) AND NOT isinf(fitness_delta)
            UNION ALL
            SELECT run_id, operation_name, 'complexity_delta', complexity_delta FROM entries WHERE complexity_delta IS NOT NULL),
        ends AS (SELECT operation_name, field, quantile_cont(v, 0.9) AS hi, quantile_cont(v, 0.1) AS lo FROM v GROUP BY 1, 2),
        mid AS (SELECT run_id, operation_name, field, quantile_cont(v, 0.5) AS m FROM v GROUP BY 1, 2, 3 HAVING count(*) >= 25)
        SELECT run_id, operation_name, field, CASE WHEN m > hi THEN 'high' ELSE 'low' END AS side
        FROM mid JOIN ends USING (operation_name, field) WHERE m > hi OR m < lo
    """,
}
