"""The queries of the general data problems, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencase.operators import hierarchy, nested_records, places, timestamps
from lumencase.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return nested_records.vic_children(table(spark, root, "vic_raw"))


def p1_media(spark: SparkSession, root: str) -> DataFrame:
    return nested_records.vic_media(table(spark, root, "vic_raw"))


def p1_sharing(spark: SparkSession, root: str) -> DataFrame:
    return nested_records.sharing_report(table(spark, root, "vic_raw"))


def p3_near(spark: SparkSession, root: str) -> DataFrame:
    return places.near(places.locations(table(spark, root, "files")))


def p3_inside(spark: SparkSession, root: str) -> DataFrame:
    return places.inside(places.locations(table(spark, root, "files")), table(spark, root, "areas"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    near = p3_near(spark, root).select(F.lit("near").alias("rel"), "id_a", "id_b")
    return near.unionByName(p3_inside(spark, root).select(F.lit("inside").alias("rel"), F.col("id").alias("id_a"), F.col("area_id").alias("id_b")))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_readings(spark, root).where("status = 'settled'").select("raw_id", "case_seq", "media_seq", "file_seq", "field", "utc_us")


def p4_readings(spark: SparkSession, root: str) -> DataFrame:
    return timestamps.instants(table(spark, root, "vic_raw"), table(spark, root, "vic_exports"))


def p4_format_mixtures(spark: SparkSession, root: str) -> DataFrame:
    exports = table(spark, root, "vic_exports")
    return timestamps.format_mixtures(timestamps.interpretations(table(spark, root, "vic_raw"), exports), exports)


def p4_undeclared(spark: SparkSession, root: str) -> DataFrame:
    exports = table(spark, root, "vic_exports")
    return timestamps.undeclared_agreement(timestamps.interpretations(table(spark, root, "vic_raw"), exports), exports)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, root, "files"))


def p6_holdings(spark: SparkSession, root: str) -> DataFrame:
    return hierarchy.holdings(table(spark, root, "files"))


def p6_descendants(spark: SparkSession, root: str) -> DataFrame:
    return hierarchy.descendants(table(spark, root, "files"))


QUERIES = {f.__name__: f for f in (p1_found, p1_media, p1_sharing, p3_found, p3_near, p3_inside, p4_found, p4_readings, p4_format_mixtures, p4_undeclared, p6_found, p6_holdings, p6_descendants)}
SQL: dict[str, str] = {
    "p3_near": """
WITH p AS (SELECT id, gps_lat AS lat, gps_lon AS lon FROM files WHERE gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180 AND NOT (gps_lat = 0 AND gps_lon = 0))
SELECT a.id AS id_a, b.id AS id_b FROM p a JOIN p b ON a.id < b.id AND abs(a.lat - b.lat) < 0.001
WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) <= 30""",
    "p6_found": """
WITH RECURSIVE t AS (
  SELECT id, id AS root_id, 0 AS depth, CAST(id AS VARCHAR) AS id_path FROM files WHERE container_id IS NULL OR container_id NOT IN (SELECT id FROM files)
  UNION ALL SELECT f.id, t.root_id, t.depth + 1, t.id_path || '/' || f.id FROM t JOIN files f ON f.container_id = t.id)
SELECT f.id, coalesce(t.root_id, -1) AS root_id, CAST(coalesce(t.depth, -1) AS INT) AS depth, coalesce(t.id_path, '') AS id_path
FROM files f LEFT JOIN t ON t.id = f.id WHERE f.container_id IS NOT NULL""",
    "p6_holdings": """
WITH RECURSIVE known AS (SELECT id FROM files), below AS (
  SELECT container_id AS a, id FROM files WHERE container_id IN (FROM known) UNION SELECT f.container_id, b.id FROM below b JOIN files f ON f.id = b.a WHERE f.container_id IN (FROM known)),
circle AS (SELECT a FROM below WHERE a = id), inner_ids AS (SELECT DISTINCT a FROM below),
high AS (
  SELECT a AS id, 1 AS h FROM inner_ids WHERE a NOT IN (FROM circle)
  UNION SELECT f.container_id, h + 1 FROM high JOIN files f ON f.id = high.id WHERE f.container_id IN (FROM known) AND f.container_id NOT IN (FROM circle)),
level AS (SELECT id, max(h) AS h FROM high GROUP BY 1), held AS (SELECT a, count(*) AS n FROM below GROUP BY 1),
lost AS (SELECT a FROM circle UNION SELECT id FROM below WHERE a IN (FROM circle))
SELECT i.a AS id, CASE WHEN l.h IS NOT NULL THEN held.n END AS n_held, CAST(l.h AS INT) AS peel_level, i.a IN (FROM lost) AS is_circular
FROM inner_ids i JOIN held ON held.a = i.a LEFT JOIN level l ON l.id = i.a""",
    "p6_descendants": """
WITH RECURSIVE t AS (
  SELECT id, [id] AS way FROM files WHERE container_id IS NULL OR container_id NOT IN (SELECT id FROM files)
  UNION ALL SELECT f.id, list_append(t.way, f.id) FROM t JOIN files f ON f.container_id = t.id)
SELECT way[i] AS ancestor_id, id, CAST(len(way) - i AS INT) AS steps FROM t, range(1, 1000) r(i) WHERE i < len(way)""",
}
