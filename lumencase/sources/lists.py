"""Reading hash lists: text, CSV, TSV, JSON of several shapes, and relational tables of hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencase.functions.scalars import algorithm_of, storable

#: Fields of a JSON record that hold a hash, lower case -> its kind; fields that hold a category; keys that hold the records.
HASH_FIELDS = {"md5": "md5", "md5hash": "md5", "sha1": "sha1", "sha1hash": "sha1", "sha256": "sha256", "phash": "phash", "photodna": "photodna", "pdna": "photodna"}
CATEGORY_FIELDS = ("category", "mediacategory", "vicscategory")
RECORD_KEYS = ("value", "media", "Media", "objects", "data")


class Refused(ValueError):
    """A list that must not be imported, with the reason; nothing has been written."""


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line: UTF-8 with or without a byte-order mark, or UTF-16 with one; decoded by the file's first bytes."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    head = F.hex(F.substring("content", 1, 3))
    text = (
        F.when(head.startswith("FFFE"), F.decode(F.expr("substring(content, 3)"), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(F.expr("substring(content, 3)"), "UTF-16BE"))
        .when(head == "EFBBBF", F.decode(F.expr("substring(content, 4)"), "UTF-8"))
        .otherwise(F.decode("content", "UTF-8"))
    )
    return raw.select("path", F.explode(F.split(text, "\r\n|\n|\r")).alias("line"))


def _entries_of_lines(lines: DataFrame, hashset_id: int) -> DataFrame:
    fields = F.transform(F.split("line", "[,;\t]"), lambda x: F.trim(F.regexp_replace(x, '^\\s*"|"\\s*$', "")))
    f = lines.select(fields.alias("f"))
    digits = F.regexp_extract(F.coalesce(F.try_element_at("f", F.lit(2)), F.lit("")), r"^(\d+)$", 1).try_cast("int")
    return f.select(F.lit(hashset_id).alias("hashset_id"), algorithm_of(F.col("f")[0]).alias("algo"), F.col("f")[0].alias("value"), digits.alias("category"), F.lit(None).cast("long").alias("media_id"))


def hash_lines(spark: SparkSession, path: str, hashset_id: int = 0) -> DataFrame:
    """Entries of a text, CSV or TSV list: the first field by its length, an optional second as category.

    Lines without a hash keep a null algo, so they can be counted.
    """
    return _entries_of_lines(text_lines(spark, path), hashset_id)


def hash_json(spark: SparkSession, path: str, hashset_id: int = 0) -> DataFrame:
    """Entries of a JSON list: an array of records, or an object holding one; field names in any case, 0 is a category."""
    docs = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("j"))
    inner = F.coalesce(*[F.get_json_object("j", f"$.{k}") for k in RECORD_KEYS])
    array = F.when(F.trim("j").startswith("["), F.col("j")).otherwise(F.coalesce(inner, F.concat(F.lit("["), "j", F.lit("]"))))
    records = docs.select(F.explode(F.from_json(array, "array<map<string,string>>")).alias("r")).where("r is not null")
    low = records.select(F.map_from_entries(F.array_distinct(F.transform(F.map_entries("r"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))).alias("r"))
    category = F.coalesce(*[F.col("r")[c] for c in CATEGORY_FIELDS]).try_cast("int")
    parts = F.array(*[F.struct(F.lit(a).alias("algo"), F.col("r")[k].alias("value")) for k, a in HASH_FIELDS.items()])
    rows = low.select(category.alias("category"), F.col("r")["mediaid"].try_cast("long").alias("media_id"), F.explode(parts).alias("p")).where("p.value is not null")
    return rows.select(F.lit(hashset_id).alias("hashset_id"), "p.algo", "p.value", "category", "media_id")


def hash_table(rows: DataFrame, hashset_id: int = 0) -> DataFrame:
    """Entries of a table with columns md5, sha1, sha256 in any case and optionally a size; rows of no size are left out."""
    low = {c.lower(): c for c in rows.columns}
    size = next((low[c] for c in ("bytes", "file_size", "size") if c in low), None)
    if size:
        rows = rows.where(F.col(size) > 0)
    parts = [F.struct(F.lit(a).alias("algo"), F.col(low[a]).cast("string").alias("value")) for a in ("md5", "sha1", "sha256") if a in low]
    if not parts:
        raise Refused("the table has no column with hashes")
    out = rows.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where("value is not null").distinct()
    return out.select(F.lit(hashset_id).alias("hashset_id"), "algo", "value", F.lit(None).cast("int").alias("category"), F.lit(None).cast("long").alias("media_id"))


def checked(entries: DataFrame, kind: str, is_vic: bool = False) -> DataFrame:
    """The entries if the list may be imported: it has at least one storable hash, and a VIC set is not known-good."""
    if is_vic and kind == "known-good":
        raise Refused("a Project VIC set lists notable media and cannot be known-good")
    if entries.where(storable(F.col("algo"), F.col("value")).isNotNull()).isEmpty():
        raise Refused("the list has no hash in it")
    return entries


def apply_delta(base: DataFrame, deletes: DataFrame, upserts: DataFrame, key: list[str]) -> DataFrame:
    """A table after a delta: rows deleted by key, then rows added or replaced by key."""
    kept = base.join(deletes.select(key).distinct(), key, "left_anti").join(upserts.select(key).distinct(), key, "left_anti")
    return kept.unionByName(upserts, allowMissingColumns=True)


