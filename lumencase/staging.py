"""Cutting lineage through tables written to the folder all executors share.

Iterative operators write each round's state to the folder named by ``spark.checkpoint.dir``
and read it back. A lost executor then costs a re-read of that table, never the whole chain of
rounds. Parquet is used rather than ``checkpoint()`` because it keeps only the columns needed
and compresses them, which halves the disk a round takes.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; on a local master without one, a folder of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = folder = tempfile.mkdtemp(prefix="lumencase-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + _own[sc.applicationId]


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written to the shared folder and read again: same rows and columns, no lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lumencase/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._staged_at = path
    return again


def release(*frames: DataFrame | None) -> None:
    """Delete what ``cut`` wrote for these frames; they cannot be read afterwards."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small_enough(rows: int, bytes_per_row: int, limit: int = 16 << 20) -> bool:
    """Whether a table of so many rows may be broadcast: its size is counted, not guessed."""
    return rows * bytes_per_row <= limit
