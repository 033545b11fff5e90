"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's documents are put in a seeded order and cut into blocks of ``BLOCK_TOKENS`` tokens. The mix is
a number of blocks: Sainte-Laguë gives them to the sources by highest quotients ``share / (2 * had + 1)``
until a source has used all repeats it may, which gives integer quotas that no rounding can spoil. A quota is some whole
passes over the source and a rest; the rest is apportioned to the source's shards in the same way, and
a shard takes its blocks in seeded order. Only counts per source and per shard are handled outside the
table of documents.

The size of the mix is, unless given, the largest for which every source that has documents can still
reach its share within its repeats. Actual shares are counted from the documents chosen.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumencase.staging import cut, small_enough

#: A public tokenizer's ranks; the path is a parameter of every function that counts tokens.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens of a block; tokens of a shard, whose documents one task puts in order; seed of the order.
BLOCK_TOKENS, SHARD_TOKENS, SEED = 256, 4_000_000, 20_240_501


def source_key(column: Column | str) -> Column:
    """A source's name with white space round it and letter case ignored; blank is null."""
    text = F.lower(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(text != "", text)


def with_tokens(rows: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The rows (doc_id, source, text) as doc_id, source, tokens: ordinary tokens of the whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        for batch in batches:
            n = [len(coder.encode_ordinary(t)) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return rows.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "doc_id long, source string, tokens long")


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients weight / (2 * had + 1), none above its cap; ties go to the earlier.

    The divisor that gives almost all seats is found by bisection, the last few by quotients, so the
    work does not grow with the number of seats.
    """
    w, c = np.array(weights, dtype=np.float64), np.array(caps, dtype=np.int64)
    c = np.where(w > 0, np.maximum(c, 0), 0)
    seats = int(min(seats, c.sum()))
    if seats <= 0 or not len(w):
        return [0] * len(w)
    at = lambda x: np.minimum(np.floor(w * x + 0.5), c)
    low, high = 0.0, (seats + 1) / w[w > 0].min() + 1
    while at(high).sum() < seats:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if at(middle).sum() <= seats:
            low = middle
        else:
            high = middle
    got = at(low).astype(np.int64)
    queue = [(-w[i] / (2 * got[i] + 1), i) for i in range(len(w)) if got[i] < c[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < c[i]:
            heapq.heappush(queue, (-w[i] / (2 * got[i] + 1), i))
    return got.tolist()


def _targets(targets: DataFrame) -> pd.DataFrame:
    """The target table, one row per source: a table of sources, small by nature; a repeated source adds its shares."""
    rows = targets.select(source_key("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("repeats"))
    return rows.where("source is not null and share > 0 and not isnan(share)").groupBy("source").agg(F.sum("share").alias("share"), F.max(F.coalesce("repeats", F.lit(1))).alias("repeats")).toPandas().sort_values("source", ignore_index=True)


def _map(table: pd.DataFrame, column: str) -> Column:
    """The small table's source -> column as a map literal."""
    return F.create_map(*[F.lit(x) for s, v in zip(table["source"], table[column], strict=True) for x in (s, int(v))])


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, ranks: str = RANKS, seed: int = SEED) -> dict[str, DataFrame]:
    """``rows``: doc_id, source, tokens, repeats of every document in the mix; ``shares``: the report per source.

    shares has source, target_share, available_tokens, quota (in blocks), mixed_tokens, actual_share, repeats_used and
    max_repeats. Documents of other sources or without a source are left out; empty texts have no
    tokens and ride along with their block; a repeated row counts as a document of its own. A source
    without documents gets nothing, and its share falls to the others in proportion.
    """
    spark = documents.sparkSession
    wanted = _targets(targets)
    names = spark.createDataFrame(wanted[["source"]], "source string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key("source").alias("source"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(names) if small_enough(len(wanted), 64) else names, "source", "left_semi")
    sized = cut(with_tokens(rows, ranks))
    totals = {r["source"]: r["t"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # one number per target source
    shards = {s: max(1, -(-t // SHARD_TOKENS)) for s, t in totals.items()}
    n_shards = F.element_at(F.create_map(*[F.lit(x) for p in shards.items() for x in p]), F.col("source")) if shards else F.lit(1)
    order = F.xxhash64(F.lit(seed), "doc_id", "tokens")
    placed = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), n_shards).cast("int")).withColumn("order", order)
    before = F.sum("tokens").over(Window.partitionBy("source", "shard").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = cut(placed.withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / BLOCK_TOKENS).cast("long")).select("doc_id", "source", "tokens", "shard", "block"))
    blocks = cut(placed.groupBy("source", "shard", "block").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    wanted["tokens"] = [int(totals.get(s) or 0) for s in wanted["source"]]
    wanted["caps"] = -(-wanted["tokens"] * wanted["repeats"].clip(lower=0) // BLOCK_TOKENS)  # a source of less than a block still has one
    if total_tokens is not None:
        seats = round(total_tokens / BLOCK_TOKENS)
    else:
        there = wanted[wanted["caps"] > 0]
        seats = math.floor((there["caps"] / there["share"]).min() * there["share"].sum()) if len(there) else 0
    wanted["quota"] = sainte_lague(wanted["share"].tolist(), seats, wanted["caps"].tolist())
    quotas = spark.createDataFrame(wanted[["source", "share", "repeats", "quota", "tokens"]], "source string, share double, max_repeats long, quota long, available_tokens long")
    quota_map = F.broadcast(quotas) if small_enough(len(wanted), 96) else quotas
    # the rest of a quota after whole passes, apportioned to the shards of the source
    per_shard = blocks.groupBy("source", "shard").agg(F.sum("tokens").alias("n")).join(quota_map, "source")

    def rest_of(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("shard", ignore_index=True)
        n = table["n"].tolist()
        passes, rest = divmod(int(table["quota"].iloc[0]) * BLOCK_TOKENS, sum(n))
        given = sainte_lague([float(x) for x in n], round(rest / BLOCK_TOKENS), [-(-x // BLOCK_TOKENS) for x in n])
        return pd.DataFrame({"source": table["source"], "shard": table["shard"], "passes": passes, "rest": given})

    rests = per_shard.groupBy("source").applyInPandas(rest_of, "source string, shard int, passes long, rest long")
    # a shard takes blocks in seeded order while more than half of the next one is within its quota
    so_far = F.sum("tokens").over(Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "block"), "block").rowsBetween(Window.unboundedPreceding, 0))
    chosen = blocks.withColumn("so_far", so_far).join(rests, ["source", "shard"])
    taken = (F.col("so_far") - F.col("tokens") / 2 <= F.col("rest") * BLOCK_TOKENS).cast("long")
    repeats = F.least(F.col("passes") + taken, F.element_at(_map(wanted, "repeats"), F.col("source")))
    chosen = chosen.select("source", "shard", "block", repeats.alias("repeats")).where("repeats > 0")
    mixed = cut(placed.join(chosen, ["source", "shard", "block"]).select("doc_id", "source", "tokens", "repeats"))
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("repeats_used"))
    whole = used.agg(F.sum("mixed_tokens").alias("whole"))
    shares = quotas.join(used, "source", "left").crossJoin(whole).select(
        "source", F.col("share").alias("target_share"), "available_tokens", "quota", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        (F.coalesce("mixed_tokens", F.lit(0)) / F.col("whole")).alias("actual_share"), F.coalesce("repeats_used", F.lit(0)).alias("repeats_used"), "max_repeats",
    )
    return {"rows": mixed, "shares": shares}
