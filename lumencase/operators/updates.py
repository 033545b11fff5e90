"""Changes to the catalog as merges: a new version of a table from the old one and what changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumencase.functions.scalars import storage_view
from lumencase.operators.gallery import expand_to_groups


def upsert(rows: DataFrame, changes: DataFrame, key: str = "path", id: str = "id") -> DataFrame:
    """``rows`` with ``changes`` merged by ``key``: given values win, missing ones keep the old; new rows get ids after the highest.

    A key that ``changes`` has twice counts once, by its last row in the order of all its columns.
    """
    columns = [c for c in rows.columns if c not in (key, id)]
    given = [c for c in columns if c in changes.columns]
    last = changes.groupBy(key).agg(F.max(F.struct(*given)).alias("n")) if given else changes.select(key).distinct().withColumn("n", F.struct(F.lit(1)))
    merged = rows.alias("o").join(last.alias("c"), F.col(f"o.{key}") == F.col(f"c.{key}"), "full")
    picked = merged.select(
        F.col(f"o.{id}").alias(id), F.coalesce(F.col(f"o.{key}"), F.col(f"c.{key}")).alias(key),
        *[F.coalesce(F.col(f"c.n.{c}"), F.col(f"o.{c}")).alias(c) if c in given else F.col(f"o.{c}").alias(c) for c in columns],
    )
    # new ids: numbered within ranges of the key, so that no task sorts all new rows
    fresh = picked.where(F.col(id).isNull())
    top = rows.agg(F.coalesce(F.max(id), F.lit(0)).alias("top"))
    part = fresh.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(1024)))
    counts = part.groupBy("_b").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("off", F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", F.coalesce("off", F.lit(0)).alias("off"))
    numbered = part.join(offsets, "_b").crossJoin(top).withColumn(id, (F.col("top") + F.col("off") + F.row_number().over(Window.partitionBy("_b").orderBy(key))).cast(rows.schema[id].dataType))
    return picked.where(F.col(id).isNotNull()).select(rows.columns).unionByName(numbered.select(rows.columns))


def set_values(rows: DataFrame, changes: DataFrame, id: str = "id") -> DataFrame:
    """``rows`` with the non-null values of ``changes`` (id and some columns) set."""
    given = [c for c in changes.columns if c != id and c in rows.columns]
    new = changes.select(id, *[F.col(c).alias(f"_{c}") for c in given])
    joined = rows.join(new, id, "left")
    return joined.select([F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in rows.columns])


def categorize(files: DataFrame, selected: DataFrame, category: int, whole_group: bool = False) -> DataFrame:
    """``files`` with the category set on the selected ids, or on all of their groups."""
    ids = expand_to_groups(files, selected) if whole_group else selected.select("id")
    return set_values(files, ids.distinct().withColumn("category", F.lit(category)))


def put(rows: DataFrame, changes: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """A small table (categories, flags, saved sets) after rows were added or replaced and others removed by key."""
    kept = rows.join(changes.select(key).unionByName(removed.select(key)).distinct(), key, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True).select(rows.columns)


def collapse_views(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """kept, spellings, agree: one row for each stored file that stands under two or more spellings of its path.

    ``kept`` is the preferred spelling. Copies of different sizes do not agree and are all left (agree false).
    """
    v = files.select(storage_view(F.col(path)).alias("v"), F.col(path).alias("p"), F.col(size).alias("s")).where("v is not null")
    per = v.groupBy("v.prefix", "v.storage", "v.user", "v.rest").agg(
        F.min_by("p", F.struct("v.rank", "p")).alias("kept"), F.countDistinct("p").alias("spellings"), (F.countDistinct("s") + F.max(F.col("s").isNull().cast("int")) == 1).alias("agree")
    )
    return per.where("spellings > 1").select("kept", "spellings", "agree")


def relink_problems(registered: DataFrame, listed: DataFrame) -> DataFrame:
    """rel_path, problem: registered rows that a new listing does not have ('missing') or has with another size or MD5."""
    j = registered.select("rel_path", "size", "md5").join(listed.select("rel_path", F.col("size").alias("new_size"), F.col("md5").alias("new_md5"), F.lit(True).alias("there")), "rel_path", "left")
    problem = F.when(F.col("there").isNull(), "missing").when(~F.col("size").eqNullSafe(F.col("new_size")), "size").when(~F.col("md5").eqNullSafe(F.col("new_md5")), "md5")
    return j.select("rel_path", problem.alias("problem")).where("problem is not null")


def folder_root(files: DataFrame) -> DataFrame:
    """source, root: the longest folder that holds all of a source's paths: what the least and greatest path share.

    Both are found by partial aggregation; the common beginning of the two is that of all between them.
    """
    ends = files.where("path is not null").groupBy("source").agg(F.min("path").alias("a"), F.max("path").alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    pairs = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    same = F.coalesce(F.array_position(pairs, F.lit(False)) - 1, F.size(a))
    n = F.least(F.when(same < 0, F.size(a)).otherwise(same), F.size(a) - 1)
    return ends.select("source", F.array_join(F.slice(a, F.lit(1), n.cast("int")), "/").alias("root"))
