"""Writing results: lists, tables, documents; and a case as a folder of tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencase.operators.reports import exported, located, md5_list


def write_csv(files: DataFrame, path: str) -> None:
    exported(files).write.mode("overwrite").option("header", "true").csv(path)


def write_json(files: DataFrame, path: str) -> None:
    files.drop("path").write.mode("overwrite").json(path)


def write_md5(files: DataFrame, path: str) -> None:
    """One hash a line, sorted; the sort is distributed by range."""
    md5_list(files).orderBy("md5").write.mode("overwrite").text(path)


def placemarks(files: DataFrame) -> DataFrame:
    """One KML placemark a located file, as text rows."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return located(files).select(F.format_string("<Placemark><name>%s</name><Point><coordinates>%.7f,%.7f</coordinates></Point></Placemark>", safe(F.col("rel_path")), "gps_lon", "gps_lat").alias("value"))


def vic_export(originals: DataFrame, decided: DataFrame) -> DataFrame:
    """An export's media with what was decided of them: by media_id, else by MD5 in any case; codes over 5 are not Project VIC's and become null.

    ``originals`` has media_id, md5, category; ``decided`` media_id, md5, category, comments. The lowest category decides if there are several.
    """
    by_id = decided.where("media_id is not null").groupBy("media_id").agg(F.min(F.struct("category", "comments")).alias("i"))
    by_md5 = decided.where("md5 is not null").groupBy(F.lower(F.trim("md5")).alias("k")).agg(F.min(F.struct("category", "comments")).alias("m"))
    joined = originals.join(by_id, "media_id", "left").withColumn("k", F.lower(F.trim("md5"))).join(by_md5, "k", "left")
    pick = F.coalesce("i", "m")
    category = F.when(pick.isNull(), F.col("category")).when(pick["category"].between(0, 5), pick["category"])
    return joined.select("media_id", "md5", category.alias("category"), pick["comments"].alias("comments"))


class Case:
    """A case: a folder with one parquet dataset per table, each change a new version that a small pointer file names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/current.json"

    def versions(self, name: str) -> list[str]:
        """Versions of a table, the oldest first."""
        try:
            rows = self.spark.read.text(self._pointer(name)).collect()  # one short line
        except Exception:
            return []
        return json.loads(rows[0][0]) if rows else []

    def read(self, name: str, version: str | None = None) -> DataFrame:
        known = self.versions(name)
        if not known:
            raise FileNotFoundError(f"{self.root}: no table {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/{version or known[-1]}")

    def write(self, name: str, rows: DataFrame, keep: int = 20) -> str:
        """Writes a new version and then points to it; versions beyond the newest ``keep`` are deleted."""
        known = self.versions(name)
        version = f"v{len(known):06d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.root}/{name}/{version}")
        known.append(version)
        for old in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/{name}/{old}"), True)
        out = self._fs.create(self._path(self._pointer(name)), True)
        out.write(bytearray(json.dumps(known[-keep:]), "utf-8"))
        out.close()
        return version
