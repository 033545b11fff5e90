"""Incremental ingest as a stream: new rows of a folder of tables are merged in micro-batches, each once.

An extension: rows that arrived since the last run are taken up when it starts and the stream then ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def take_up(spark: SparkSession, folder: str, schema: StructType | str, target: str, progress: str, key: str) -> None:
    """Appends the rows of new files below ``folder`` to ``target``, each key once within a batch; ends when all are taken.

    ``progress`` is the stream's checkpoint folder; a batch that is run again after a failure replaces its own output.
    """

    def merge(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    (stream.writeStream.foreachBatch(merge).option("checkpointLocation", progress).trigger(availableNow=True).start()).awaitTermination()


def activity(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total of a stream or table of events (ts, event_type, value); later rows than ``late`` are dropped in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
