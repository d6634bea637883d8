"""Points near other points and within regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bandlens.operators.nearby import near_and_inside
from bandlens.queries.registry import query
from bandlens.sources.tables import table, water_records


@query("""
        WITH r AS (SELECT * FROM sentinel2_water WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC, row_id DESC) = 1),
        p AS (SELECT sample_id, longitude AS x, latitude AS y, CAST(floor(latitude / 0.0002) AS BIGINT) AS band FROM r
              WHERE abs(longitude) <= 180 AND abs(latitude) <= 90 AND NOT isnan(longitude) AND NOT isnan(latitude) AND NOT (longitude = 0 AND latitude = 0)),
        q AS (SELECT sample_id, x, y, band + o AS band FROM p, (VALUES (-1), (0), (1)) AS t(o)),
        near AS (SELECT a.sample_id, b.sample_id AS other_id FROM p AS a JOIN q AS b ON a.band = b.band AND a.sample_id < b.sample_id
                 WHERE 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) <= 15),
        v AS (SELECT zone_id, unnest(ring_lon) AS x, unnest(ring_lat) AS y, unnest(range(1, len(ring_lon) + 1)) AS i, len(ring_lon) AS n FROM lake_zones),
        e AS (SELECT v.zone_id, v.x AS x1, v.y AS y1, w.x AS x2, w.y AS y2 FROM v JOIN v AS w ON w.zone_id = v.zone_id AND w.i = v.i % v.n + 1),
        z AS (SELECT zone_id, list_min(ring_lon) AS x0, list_max(ring_lon) AS x1, list_min(ring_lat) AS y0, list_max(ring_lat) AS y1 FROM lake_zones),
        c AS (SELECT p.sample_id, p.x, p.y, z.zone_id FROM p JOIN z ON p.x BETWEEN z.x0 AND z.x1 AND p.y BETWEEN z.y0 AND z.y1),
        inside AS (SELECT c.sample_id, c.zone_id AS other_id FROM c JOIN e ON e.zone_id = c.zone_id
                   WHERE (e.y1 > c.y) <> (e.y2 > c.y) AND c.x < e.x1 + (c.y - e.y1) / nullif(e.y2 - e.y1, 0) * (e.x2 - e.x1)
                   GROUP BY 1, 2 HAVING count(*) % 2 = 1)
        SELECT 'near' AS kind, sample_id, other_id FROM near UNION ALL SELECT 'inside', sample_id, other_id FROM inside
""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records at most 15 m apart, and records within lake zones."""
    return near_and_inside(water_records(spark, d, ["longitude", "latitude"]), table(spark, d, "lake_zones"), "sample_id", "zone_id", "longitude", "latitude", "ring_lon", "ring_lat", 15.0)
