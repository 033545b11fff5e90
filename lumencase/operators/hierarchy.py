"""Parent-child links to full hierarchies, by leaf peeling.

``containers``: every row that is a parent of another row gets its tree position.
``hierarchy``: every row with a parent gets root, depth and path.
``holdings``: every container gets the size of its subtree.
``descendants``: one row per (ancestor, descendant).

Method. Rows that contain nothing are leaves and leave in the first peel, all at once, as one
pre-aggregated count per parent; only the containers take part in the rounds after it. In each
round the containers without unpeeled children send their subtree size to their parent and
leave; what never leaves lies on a circle. Then the peel is run backwards in bands of rounds: a container
gets its root, depth and path from an ancestor that was peeled in a later band. Containers that no
root reaches lie on a circle or below one.

A parent with any number of children is safe: children are summed by partial aggregation
upwards and joined one to one downwards, never gathered in a list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumencase.staging import cut, release

#: Rounds planned as one job, a band; the state is written to the shared folder between jobs.
ROUNDS_PER_JOB = 8


def _links(rows: DataFrame, id: str, parent: str) -> DataFrame:
    return rows.select(F.col(id).cast("long").alias("node"), F.col(parent).cast("long").alias("up")).where("node is not null")


def _inner(links: DataFrame) -> DataFrame:
    """Rows that are the parent of some row: node, up (null where no row has that id), kids, inner_kids."""
    kids = links.where("up is not null").groupBy("up").agg(F.count("*").alias("kids"))
    inner = cut(links.join(kids.withColumnRenamed("up", "node"), "node"))
    known = inner.select(F.col("node").alias("up"), F.lit(True).alias("there"))
    inner_kids = inner.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("inner_kids"))
    made = (
        inner.join(known, "up", "left")
        .withColumn("up", F.expr("case when there then up end"))
        .join(inner_kids, "node", "left")
        .select("node", "up", "kids", F.coalesce("inner_kids", F.lit(0)).alias("inner_kids"))
    )
    out = cut(made)
    release(inner)
    return out


def _peel_round(state: DataFrame, level: Column) -> DataFrame:
    """One round: those with nothing pending get their level and pass their size up; one shuffle."""
    ready = F.expr("level is null and pending = 0")
    own = F.struct(
        F.col("node"), F.col("up"), F.col("pending"), F.col("held"), F.when(ready, level).otherwise(F.col("level")).alias("level")
    )
    sent = F.struct(
        F.col("up").alias("node"), F.lit(None).cast("long").alias("up"), F.lit(-1).cast("long").alias("pending"),
        (F.col("held") + 1).alias("held"), F.lit(None).cast("int").alias("level"),
    )
    rows = state.select(F.explode(F.when(ready & F.col("up").isNotNull(), F.array(own, sent)).otherwise(F.array(own))).alias("r")).select("r.*")
    return rows.groupBy("node").agg(F.max("up").alias("up"), F.sum("pending").alias("pending"), F.sum("held").alias("held"), F.max("level").alias("level"))


def _peel(inner: DataFrame) -> tuple[DataFrame, int]:
    """(node, up, held (rows below it, at any depth), level (its peel round; null on a circle); the number of rounds)."""
    state = inner.select(
        "node", "up", F.col("inner_kids").cast("long").alias("pending"),
        (F.col("kids") - F.col("inner_kids")).cast("long").alias("held"), F.lit(None).cast("int").alias("level"),
    )
    done, level = [], 0
    while True:
        for _ in range(ROUNDS_PER_JOB):
            level += 1
            state = _peel_round(state, F.lit(level))
        staged = cut(state)
        last, left = staged.agg(F.max("level"), F.count_if(F.col("level").isNull())).first()
        done.append(staged.where("level is not null"))
        state = staged.where("level is null")
        # a round in which nothing left is the last: what is there still lies on circles
        if not left or last is None or last < level:
            out = cut(reduce(DataFrame.unionByName, [*done, state]))
            release(*done)
            return out, level


def _ways(peeled: DataFrame, separator: str) -> DataFrame:
    """node, band, top, hops, way of every peeled node with a parent: its nearest ancestor that is a root or was peeled in a later band.

    A band is ROUNDS_PER_JOB peel rounds. A parent is always peeled after its children, so within a band
    there are at most ROUNDS_PER_JOB steps, and doubling them covers all in their logarithm of joins.
    """
    band = F.floor((F.col("level") - 1) / ROUNDS_PER_JOB).cast("int")
    tops = peeled.select(F.col("node").alias("top"), band.alias("top_band"))
    now = peeled.where("up is not null and level is not null").select(F.col("up").alias("top"), "node", band.alias("band"), F.lit(1).alias("hops"), F.col("node").cast("string").alias("way"))
    now = now.join(tops, "top").select("node", "band", "top", "top_band", "hops", "way")
    for _ in range((ROUNDS_PER_JOB - 1).bit_length()):
        higher = now.select(F.col("node").alias("top"), F.col("top").alias("t"), F.col("top_band").alias("tb"), F.col("hops").alias("h"), F.col("way").alias("w"))
        same = F.col("t").isNotNull() & (F.col("top_band") == F.col("band"))
        pick = lambda a, b: F.when(same, a).otherwise(b)
        now = cut(now.join(higher, "top", "left").select(
            "node", "band", pick(F.col("t"), F.col("top")).alias("top"), pick(F.col("tb"), F.col("top_band")).alias("top_band"),
            pick(F.col("hops") + F.col("h"), F.col("hops")).alias("hops"), pick(F.concat_ws(separator, "w", "way"), F.col("way")).alias("way"),
        ))
    return now.select("node", "band", "top", "hops", "way")


def containers(rows: DataFrame, id: str = "id", parent: str = "container_id", separator: str = "/") -> DataFrame:
    """node, up, held, level, root, depth, path of every row that is the parent of another.

    Roots are peeled nodes without a parent; the bands of the peel are then run backwards, each taking root, depth and path
    from the bands after it. On or below a circle, which no root reaches, root and depth are -1 and path is ''.
    """
    inner = _inner(_links(rows, id, parent))
    peeled, levels = _peel(inner)
    release(inner)
    ways = _ways(peeled, separator)
    placed = peeled.where("up is null and level is not null").select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.col("node").cast("string").alias("path"))
    for band in range((levels - 1) // ROUNDS_PER_JOB, -1, -1):
        above = placed.select(F.col("node").alias("top"), "root", F.col("depth").alias("above"), "path")
        found = ways.where(F.col("band") == band).join(above, "top")
        placed = placed.unionByName(cut(found.select("node", "root", (F.col("above") + F.col("hops")).alias("depth"), F.concat_ws(separator, "path", "way").alias("path"))))
    return peeled.join(placed, "node", "left").select(
        "node", "up", "held", "level", F.coalesce("root", F.lit(-1)).alias("root"), F.coalesce("depth", F.lit(-1)).alias("depth"), F.coalesce("path", F.lit("")).alias("path")
    )


def hierarchy(rows: DataFrame, id: str = "id", parent: str = "container_id", separator: str = "/") -> DataFrame:
    """id, root_id, depth, id_path of every row with a parent.

    A parent that no row has ends the way: such a row is its own root at depth 0. A row whose
    way never ends has -1, -1 and ''. Rows without an id or a parent are left out; an empty
    table gives no rows; other columns of ``rows`` are ignored, so their names cannot clash.
    """
    links = _links(rows, id, parent).where("up is not null")
    above = containers(rows, id, parent, separator).select(F.col("node").alias("up"), "root", "depth", "path")
    ended, lost = F.col("root").isNull(), F.col("root") == -1
    return links.join(above, "up", "left").select(
        F.col("node").alias("id"),
        F.when(ended, F.col("node")).otherwise(F.col("root")).alias("root_id"),
        F.when(ended, 0).when(lost, -1).otherwise(F.col("depth") + 1).cast("int").alias("depth"),
        F.when(ended, F.col("node").cast("string")).when(lost, "").otherwise(F.concat_ws(separator, "path", F.col("node").cast("string"))).alias("id_path"),
    )


def holdings(rows: DataFrame, id: str = "id", parent: str = "container_id") -> DataFrame:
    """id, n_held, peel_level, is_circular of every container; n_held counts all rows below it.

    On a circle nothing is counted (n_held null): there is no 'below'.
    """
    return containers(rows, id, parent).select(
        F.col("node").alias("id"), F.when(F.col("level").isNotNull(), F.col("held")).alias("n_held"),
        F.col("level").alias("peel_level"), (F.col("root") == -1).alias("is_circular"),
    )


def descendants(rows: DataFrame, id: str = "id", parent: str = "container_id") -> DataFrame:
    """ancestor_id, id, steps: one row for each container above each row, circles left out."""
    way = hierarchy(rows, id, parent).where("depth > 0").select("id", F.split("id_path", "/").alias("way"))
    return way.select("id", F.posexplode(F.expr("slice(way, 1, size(way) - 1)")).alias("pos", "a"), F.size("way").alias("n")).select(
        F.col("a").cast("long").alias("ancestor_id"), "id", (F.col("n") - 1 - F.col("pos")).alias("steps")
    )
