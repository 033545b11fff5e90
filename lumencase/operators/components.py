"""Connected components of an edge table by alternating star rounds of minimum propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumencase.staging import cut, release


def _staged(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written to the shared folder, and their number and checksum, counted while they are written."""
    seen = Observation()
    counted = edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("check"))
    out = cut(counted)
    got = seen.get
    return out, (got["n"], got["check"])


def min_labels(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for every node of an edge (a, b).

    Edges may be repeated, reversed, reflexive or hold nulls (those are ignored). Each large-star
    round links every larger neighbour of a node to the node's smallest neighbour, each small-star
    round does so for the smaller ones; the edge set becomes one star per component in a number of
    rounds that grows with the logarithm of the longest path. A node with very many edges is summed by
    partial aggregation and joined one to many, so adaptive skew handling can split it.
    """
    clean = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    now, state = _staged(clean)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least.select("a", F.least("a", "m").alias("m")), "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        starred = cut(large)
        # small star: (a, b) with a < b; the smaller neighbours of b, and b itself, go to the smallest of them
        m = starred.groupBy("b").agg(F.min("a").alias("m"))
        small = starred.join(m, "b").select("m", F.explode(F.array("a", "b")).alias("x")).where("m < x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        after, new = _staged(small)
        release(now, starred)
        was, now, state = state, after, new
        if was == state:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
