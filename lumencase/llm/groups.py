"""Consolidating pairwise matches into groups.

Peel the giant component: breadth-first search by frontier joins from the vertex of highest degree,
anti-join what it reached out of the edge table, then label the many small components that are
left by minimum propagation. If the search's frontier dwindles long before it ends (a giant with a long
tail), the rest is not walked step by step: what was reached is contracted to one vertex and its
tail is labelled with the small components, so the number of rounds stays logarithmic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumencase.operators.components import min_labels
from lumencase.staging import cut, release

#: The search stops when a step adds less than this share of what has been reached.
DWINDLED = 1 / 16


def hash64(column: Column | str) -> Column:
    """16 hex digits (either case, white space round them ignored) as a BIGINT bit pattern, else null."""
    text = F.trim(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""))
    return F.when(text.rlike("^[0-9a-fA-F]{16}$"), F.conv(text, 16, -10).cast("long"))


def verified_links(files: DataFrame, pairs: DataFrame, max_bits: int = 6) -> DataFrame:
    """a, b (a < b) of every proven link: a proposed pair of files whose phash differ in at most ``max_bits``
    bits, or a file and the file its vstack_id names. Each link once; pairs naming no file, unusable
    hashes, null ids and reflexive pairs give none."""
    own = files.select(F.col("id").cast("long").alias("v"), hash64("phash").alias("h"), F.col("vstack_id").cast("long").alias("stack")).where("v is not null")
    hashed = own.where("h is not null")
    proposed = pairs.where("id_a is not null and id_b is not null and id_a != id_b").select(F.least("id_a", "id_b").cast("long").alias("a"), F.greatest("id_a", "id_b").cast("long").alias("b")).distinct()
    proven = (
        proposed.join(hashed.select(F.col("v").alias("a"), F.col("h").alias("ha")), "a")
        .join(hashed.select(F.col("v").alias("b"), F.col("h").alias("hb")), "b")
        .where(F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) <= max_bits)
        .select("a", "b")
    )
    stacked = own.where("stack is not null and stack != v").select("v", "stack")
    stacked = stacked.join(own.select(F.col("v").alias("stack")), "stack", "left_semi")
    stacked = stacked.select(F.least("v", "stack").alias("a"), F.greatest("v", "stack").alias("b"))
    return proven.unionByName(stacked).distinct()


def group_labels(edges: DataFrame) -> DataFrame:
    """node, label of every node of an edge (a, b): label is the smallest node it is linked to, directly or not.

    Edges may be repeated, reversed or reflexive, and may hold nulls; a node with only
    reflexive edges is in no group. An empty table gives no rows.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a < b").distinct())
    ends = edges.select(F.explode(F.array("a", "b")).alias("v"))
    hub = ends.groupBy("v").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", -F.col("v"))).alias("m")).first()["m"]
    if hub is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    root = -hub[1]
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    layers = [cut(edges.sparkSession.createDataFrame([(root,)], "v long"))]
    reached, total, walked_out = layers[0], 1, False
    while True:
        step = both.join(layers[-1].withColumnRenamed("v", "a"), "a").select(F.col("b").alias("v")).distinct().join(reached, "v", "left_anti")
        layers.append(cut(step))
        n = layers[-1].count()
        reached, total = reduce(DataFrame.unionByName, layers), total + n
        if not n:
            walked_out = True
            break
        if n < DWINDLED * total and len(layers) > 2:
            break
    giant = cut(reached)
    release(*layers)
    least = giant.agg(F.min("v")).first()[0]
    seen_a, seen_b = giant.select(F.col("v").alias("a")), giant.select(F.col("v").alias("b"))
    if walked_out:
        rest = edges.join(seen_a, "a", "left_anti")
        labels = cut(min_labels(rest))
        return labels.unionByName(giant.select(F.col("v").alias("node"), F.lit(least).alias("label")))
    # contract what was reached to its smallest node; edges inside it vanish
    rest = edges.join(seen_a.withColumn("in_a", F.lit(True)), "a", "left").join(seen_b.withColumn("in_b", F.lit(True)), "b", "left")
    rest = rest.where("in_a is null or in_b is null").select(F.expr(f"case when in_a then {least}L else a end").alias("a"), F.expr(f"case when in_b then {least}L else b end").alias("b"))
    labels = cut(min_labels(rest))
    own = labels.where(F.col("node") == least).agg(F.min("label")).first()[0]
    own = least if own is None else own
    return labels.where(F.col("node") != least).unionByName(giant.select(F.col("v").alias("node"), F.lit(own).alias("label")))


def match_groups(files: DataFrame, pairs: DataFrame, max_bits: int = 6) -> DataFrame:
    """id, group_id of every file linked to another; group_id is the smallest id of its group."""
    return group_labels(verified_links(files, pairs, max_bits)).select(F.col("node").alias("id"), F.col("label").alias("group_id"))
