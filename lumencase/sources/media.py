"""Registering media: folders, indexes of other tools, job descriptions."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencase.functions.scalars import kind_of_ext, kind_of_mime, sniff_kind
from lumencase.operators.nested_records import media, shred

#: Names of plug-in readers of pixels, faces and the like: name -> (function of a pandas Series of bytes, type of its result).
ENRICHERS: dict[str, tuple[Callable[[pd.Series], pd.Series], str]] = {}


def folder(spark: SparkSession, path: str, source: str, include_other: bool = False, max_mb: float | None = None) -> DataFrame:
    """source, path, rel_path, ext, kind, size, mtime of the files below a folder.

    The kind is that of the name, or of the first bytes where the name says nothing. Sidecars of other file
    systems (names beginning with ``._``) are left out, as are files over ``max_mb``.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.when(name.rlike(r"[^.]\.[A-Za-z0-9]+$"), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))).otherwise("")
    rows = raw.where(~name.startswith("._"))
    if max_mb is not None:
        rows = rows.where(F.col("length") <= int(max_mb * 1024 * 1024))
    by_name = kind_of_ext(ext)
    kind = F.when(by_name != "other", by_name).otherwise(sniff_kind("content"))
    root = "/".join(p for p in path.rstrip("/").split("/"))
    out = rows.select(F.lit(source).alias("source"), "path", F.element_at(F.split("path", F.concat(F.lit("\\Q"), F.lit(root), F.lit("/\\E"))), -1).alias("rel_path"), ext.alias("ext"), kind.alias("kind"), F.col("length").alias("size"), F.unix_micros("modificationTime").cast("double").alias("mtime_us"))
    out = out.withColumn("mtime", F.col("mtime_us") / 1e6).drop("mtime_us")
    return out if include_other else out.where("kind != 'other'")


def vic_index(chunks: DataFrame) -> DataFrame:
    """raw_id, case_seq, media_seq, media_id, md5, sha1, size, mime, kind, rel_path, category of a Project VIC export's media."""
    s = F.col("scalars")
    plain = lambda k: F.get_json_object(F.concat(F.lit('{"v":'), s[k], F.lit("}")), "$.v")
    rel = F.replace(plain("RelativeFilePath"), F.lit("\\"), F.lit("/"))
    ext = F.regexp_extract(F.coalesce(rel, F.lit("")), r"\.([A-Za-z0-9]+)$", 1)
    return media(shred(chunks, "raw_id", "payload")).select(
        F.col("key").cast("long").alias("raw_id"), "case_seq", "media_seq", plain("MediaID").try_cast("long").alias("media_id"), F.lower(plain("MD5")).alias("md5"), F.lower(plain("SHA1")).alias("sha1"),
        plain("MediaSize").try_cast("long").alias("size"), plain("MimeType").alias("mime"), kind_of_mime(ext, plain("MimeType")).alias("kind"), rel.alias("rel_path"), plain("Category").try_cast("int").alias("category"),
    )


def c4all_index(spark: SparkSession, path: str) -> DataFrame:
    """md5, sha1, rel_path, size, category of an XML index of Image and Movie entries; category 0 is uncategorized (5)."""
    rows = None
    for tag, kind in (("Image", "image"), ("Movie", "video")):
        part = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "").schema("MD5 string, SHA1 string, Path string, Size long, Category int").load(path)
        part = part.select(F.lit(kind).alias("kind"), F.lower(F.trim("MD5")).alias("md5"), F.lower(F.trim("SHA1")).alias("sha1"), F.replace("Path", F.lit("\\"), F.lit("/")).alias("rel_path"), F.col("Size").alias("size"), F.when(F.coalesce("Category", F.lit(0)) == 0, 5).otherwise(F.col("Category")).alias("category"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def job(spec: str | dict[str, Any], base: str = ".") -> list[dict[str, Any]]:
    """The sources a job names: a folder's path, or JSON with ``folder``, ``folders`` or ``sources``; keys in any case, paths relative to ``base``."""
    if isinstance(spec, str):
        if not spec.lstrip().startswith("{"):
            return [{"name": Path(spec).name, "path": spec}]
        spec = json.loads(spec)
    low = {k.lower(): v for k, v in spec.items()}
    raw = low.get("sources") or [{"path": p} for p in [*low.get("folders", []), *([low["folder"]] if "folder" in low else [])]]
    out = []
    for item in raw:
        one = {k.lower(): v for k, v in ({"path": item} if isinstance(item, str) else item).items()}
        one["path"] = str(one["path"]) if "://" in str(one["path"]) else str(Path(base) / one["path"])
        one.setdefault("name", Path(one["path"]).name)
        out.append(one)
    return out


def enrich(rows: DataFrame, name: str, content: str = "content") -> DataFrame:
    """A column ``name`` made by a registered reader of file contents, in Arrow batches."""
    function, kind = ENRICHERS[name]
    return rows.withColumn(name, F.pandas_udf(function, kind)(content))


def unread(rows: DataFrame, done: DataFrame, id: str = "id") -> DataFrame:
    """Rows that a pass has not read yet: what makes a pass resumable."""
    return rows.join(done.select(id).distinct(), id, "left_anti")
