"""Interval algebra by window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unclaimed(spans: DataFrame, whole: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """by, start, end: what of each whole span (by, start, end) none of its parts covers; touching parts join.

    A whole without parts is unclaimed entirely; parts outside the whole are cut off.
    """
    s = whole.select(by, F.col(start).alias("w0"), F.col(end).alias("w1"))
    inner = s.join(spans.select(by, F.col(start).alias("p0"), F.col(end).alias("p1")).where("p0 is not null and p1 is not null"), by)
    inner = inner.select(by, "w0", "w1", F.greatest("p0", "w0").alias("p0"), F.least("p1", "w1").alias("p1"))
    # a closing part of no length at the end makes the tail an ordinary gap
    rows = inner.where("p0 < p1").unionByName(s.select(by, "w0", "w1", F.col("w1").alias("p0"), F.col("w1").alias("p1")))
    w = Window.partitionBy(by).orderBy("p0", "p1").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("p1").over(w), F.col("w0"))
    return rows.withColumn("covered", covered).where("p0 > covered").select(by, F.col("covered").alias(start), F.col("p0").alias(end))


def joined_runs(spans: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """by, run, start, end, pieces: overlapping or touching spans of each key as one run."""
    order = Window.partitionBy(by).orderBy(start, end)
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_new", F.when(reached.isNull() | (F.col(start) > reached), 1).otherwise(0))
    run = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("run", run).groupBy(by, "run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("pieces"))


def first_run(spans: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """by, end, pieces, state: how far the pieces from position 0 reach: complete (all pieces), gap, or missing (none at 0)."""
    runs = joined_runs(spans, by, start, end)
    whole = runs.groupBy(by).agg(
        F.min_by(end, "run").alias("reach"), F.min_by("pieces", "run").alias("pieces"), F.min(start).alias("begin"), F.count("*").alias("runs")
    )
    state = F.when(F.col("begin") != 0, "missing").when(F.col("runs") > 1, "gap").otherwise("complete")
    return whole.select(by, F.when(F.col("begin") == 0, F.col("reach")).otherwise(F.lit(0)).alias("reach"), F.when(F.col("begin") == 0, F.col("pieces")).otherwise(0).alias("pieces"), state.alias("state"))


def until_full(rows: DataFrame, by: str, order: str, tie: str, size: str, cap: float, span: float = 86_400.0) -> DataFrame:
    """The newest rows of each key whose sizes (not negative; null counts as nothing) fit under ``cap`` together; the others are evicted oldest first.

    Sizes are summed by spans of ``order`` first: spans wholly under or over the cap are decided as such, and
    only the rows of the one span of each key in which the cap is reached are put in order.
    """
    spanned = rows.withColumn("_span", F.col(order) - F.pmod(F.col(order), F.lit(span)))
    per = spanned.groupBy(by, "_span").agg(F.coalesce(F.sum(size), F.lit(0)).alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy(by).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("_after", so_far).withColumn("_before", F.col("_after") - F.col("_n")).where(F.col("_before") <= cap).select(F.col(by).alias("_by"), F.col("_span").alias("_s"), "_before", "_after")
    kept = spanned.join(per, F.col(by).eqNullSafe(F.col("_by")) & F.col("_span").eqNullSafe(F.col("_s")))
    whole = kept.where(F.col("_after") <= cap).select(rows.columns)
    w = Window.partitionBy(by).orderBy(F.desc(order), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    split = kept.where(F.col("_after") > cap).withColumn("_sum", F.col("_before") + F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("_sum") <= cap)
    return whole.unionByName(split.select(rows.columns))
