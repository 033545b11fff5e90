"""The queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencase.llm import groups, leakage, mixing, seen, subjects, vectors
from lumencase.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, root, "faces"))


def p2_recall(spark: SparkSession, root: str) -> DataFrame:
    return vectors.recall_report(table(spark, root, "faces"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return groups.match_groups(table(spark, root, "files"), table(spark, root, "phash_pairs"))


def _known_md5(spark: SparkSession, root: str) -> list[DataFrame]:
    entries = table(spark, root, "hashset_entries").where(F.lower(F.regexp_replace("algo", r"^\s+|\s+$", "")) == "md5")
    return [entries.select(seen.md5_key("value").alias("key")), table(spark, root, "stash").select(seen.md5_key("md5").alias("key"))]


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return seen.found_ids(table(spark, root, "files"), _known_md5(spark, root), seen.md5_key("md5"))


def p7_error_rate(spark: SparkSession, root: str) -> DataFrame:
    return seen.error_report(table(spark, root, "files"), _known_md5(spark, root), seen.md5_key("md5"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_leaks(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leak_report(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_items(spark: SparkSession, root: str) -> DataFrame:
    return leakage.item_report(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mixture(table(spark, root, "documents"), table(spark, root, "mix_targets"))["rows"]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mixture(table(spark, root, "documents"), table(spark, root, "mix_targets"))["shares"]


def _corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, root, "documents"), table(spark, root, "subject_examples"), table(spark, root, "subject_areas")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return subjects.document_subjects(*_corpus(spark, root)).select("doc_id", "subject")


def p10_composition(spark: SparkSession, root: str) -> DataFrame:
    return subjects.composition(*_corpus(spark, root))


QUERIES = {f.__name__: f for f in (p2_found, p2_recall, p5_found, p7_found, p7_error_rate, p8_found, p8_leaks, p8_items, p9_mixture, p9_shares, p10_found, p10_composition)}
SQL = {
    "p5_found": """
WITH RECURSIVE own AS (
  SELECT id, CASE WHEN regexp_full_match(trim(phash), '[0-9a-fA-F]{16}') THEN CAST('0x' || trim(phash) AS UBIGINT) END AS h, vstack_id FROM files),
links AS (
  SELECT p.id_a AS a, p.id_b AS b FROM phash_pairs p JOIN own x ON x.id = p.id_a JOIN own y ON y.id = p.id_b WHERE p.id_a <> p.id_b AND bit_count(xor(x.h, y.h)) <= 6
  UNION SELECT x.id, x.vstack_id FROM own x JOIN own y ON y.id = x.vstack_id WHERE x.id <> y.id),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS other FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT id, min(other) AS group_id FROM reach GROUP BY id""",
    "p7_found": r"""
WITH own AS (
  SELECT id, ingested_at, lower(regexp_replace(md5, '^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$|\x{FEFF}', '', 'g')) AS k FROM files),
keyed AS (SELECT * FROM own WHERE regexp_full_match(k, '[0-9a-f]{32}') AND k <> 'd41d8cd98f00b204e9800998ecf8427e'),
known AS (
  SELECT lower(regexp_replace(md5, '^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$|\x{FEFF}', '', 'g')) AS k FROM stash
  UNION SELECT lower(regexp_replace(value, '^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$|\x{FEFF}', '', 'g')) FROM hashset_entries WHERE lower(trim(algo)) = 'md5'),
ranked AS (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY ingested_at NULLS LAST, id) AS n FROM keyed)
SELECT id FROM ranked WHERE n > 1 OR k IN (SELECT k FROM known WHERE k IS NOT NULL)""",
}
