"""Reading the tables of a case directory (one parquet dataset per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``; a single parquet file and a directory of parts read alike."""
    return spark.read.parquet(f"{root}/{name}.parquet")
