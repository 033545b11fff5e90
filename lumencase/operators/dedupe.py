"""Exact stacks, near-duplicate pairs and groups of the catalog."""

from __future__ import annotations

from itertools import combinations, pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumencase.functions.scalars import hexbits, meaningful
from lumencase.operators.components import min_labels

#: Bands of a 64-bit hash; blocks that near pairs are looked up by, at least; distinct hashes for each task of their join.
BANDS, LEAST_BLOCKS, TASK_HASHES = 8, 4, 1000


def stack_key() -> Column:
    """SHA-256, else MD5 marked as such; null without either."""
    present = lambda c: F.when(F.length(F.trim(c)) > 0, F.lower(F.trim(c)))
    return F.coalesce(present("sha256"), F.concat(F.lit("md5:"), present("md5")))


def stack_exact(files: DataFrame) -> DataFrame:
    """id, stack_id of every hashed file: the lowest id with the same content, itself if there is no other.

    The head is found by partial aggregation and joined back, so a hash on very many rows is no single task.
    """
    keyed = files.select("id", stack_key().alias("k")).where("k is not null")
    heads = keyed.groupBy("k").agg(F.min("id").alias("stack_id"))
    return keyed.join(heads, "k").select("id", "stack_id")


def redundant(files: DataFrame) -> DataFrame:
    """One row: stacks, redundant (copies beyond the first)."""
    per = files.select(stack_key().alias("k")).where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("stacks"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"))


def comparable(files: DataFrame) -> DataFrame:
    """id, p, d: heads of stacks with a telling perceptual hash; d is null without a usable second hash."""
    head = F.col("stack_id").isNull() | (F.col("stack_id") == F.col("id"))
    return files.where(head).select("id", hexbits("phash").alias("p"), hexbits("dhash").alias("d")).where(meaningful(F.col("p")))


def band_buckets(hashes: DataFrame) -> DataFrame:
    """band, value, n: buckets of hashes that share a band of 8 bits, with their size."""
    return _banded(hashes).groupBy("band", "value").agg(F.count("*").alias("n"))


def _banded(hashes: DataFrame) -> DataFrame:
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("p", 56 - 8 * i).bitwiseAND(255).alias("value")) for i in range(BANDS)])
    return hashes.select("*", F.explode(bands).alias("b")).select(*hashes.columns, "b.band", "b.value")


def _blocks(hashes: DataFrame, count: int, radius: int) -> DataFrame:
    """A row for each block of a hash and each value within ``radius`` bits of that block; ``key`` is block and value as one number."""
    edges = [round(i * 64 / count) for i in range(count + 1)]
    widest = max(b - a for a, b in pairwise(edges))
    masks = [sum(1 << k for k in bits) for r in range(radius + 1) for bits in combinations(range(widest), r)]
    parts = [F.shiftrightunsigned("p", 64 - high).bitwiseAND((1 << (high - low)) - 1).bitwiseOR(i << 32) for i, (low, high) in enumerate(pairwise(edges))]
    each = hashes.select("*", F.explode(F.array(*parts)).alias("b")).select("*", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m"))
    return each.select(*hashes.columns, F.col("b").bitwiseXOR(F.col("m")).alias("key"))


def near_pairs(hashes: DataFrame, threshold: int) -> DataFrame:
    """a, b (a < b): all pairs that differ in at most ``threshold`` bits, and ``threshold + 2`` of the second hash.

    Equal hashes are collapsed first: copies are linked to the smallest id, and only distinct hashes are
    paired, so a hash on very many rows costs one comparison. The 64 bits are cut into so many blocks that of a
    pair within the threshold at least one block differs in two bits at most. Each side is laid out with the values within half of
    those errors of its blocks, so an equi-join on block and value meets every such pair: none is lost and no
    bucket is capped; a bucket of very many hashes is a skewed join key, which adaptive execution splits.
    """
    distinct = hashes.groupBy("p", "d").agg(F.min("id").alias("id"))
    copies = hashes.join(distinct.withColumnRenamed("id", "a"), (hashes["p"] == distinct["p"]) & hashes["d"].eqNullSafe(distinct["d"])).select("a", hashes["id"].alias("b")).where("a < b")
    count = max(LEAST_BLOCKS, (threshold + 3) // 3)
    errors = threshold // count
    # the join emits far more candidates than it reads, so its tasks are counted by hashes and not merged by bytes
    tasks = max(hashes.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // TASK_HASHES))
    x, y = (_blocks(distinct, count, radius).repartition(tasks, "key").alias(side) for side, radius in (("x", errors // 2), ("y", errors - errors // 2)))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    close = F.bit_count(F.col("x.p").bitwiseXOR(F.col("y.p"))) <= threshold
    agree = F.coalesce(F.bit_count(F.col("x.d").bitwiseXOR(F.col("y.d"))) <= threshold + 2, F.lit(True))
    return met.where(close & agree).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().unionByName(copies)


def groups(files: DataFrame, threshold: int) -> DataFrame:
    """id, group_id of every file in a group of two or more near-duplicates; group_id is the lowest id.

    Exact copies follow their head.
    """
    labels = min_labels(near_pairs(comparable(files), threshold))
    return spread_to_copies(files, labels.select(F.col("node").alias("id"), F.col("label").alias("group_id")))


def spread_to_copies(files: DataFrame, labels: DataFrame) -> DataFrame:
    """The groups of stack heads given to all files of their stacks."""
    heads = files.select("id", F.coalesce("stack_id", "id").alias("head"))
    return heads.join(labels.withColumnRenamed("id", "head"), "head").select("id", "group_id")


def middle_of(rows: DataFrame, partition: str, order: str, tie: str) -> DataFrame:
    """The middle row (number n // 2 from 0) of each partition in order."""
    w = Window.partitionBy(partition)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(F.asc_nulls_first(order), tie))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).drop("_r", "_n")
