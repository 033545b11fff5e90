"""Reports and artifacts: each is one aggregation or projection over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumencase.functions.scalars import base_name, text_of_duration, text_of_size, valid_place

#: Columns of the file list export, in order.
CSV_FIELDS = "id source rel_path kind ext size md5 sha1 sha256 phash width height duration created_dt gps_lat gps_lon camera category error".split()


def exported(files: DataFrame) -> DataFrame:
    """The rows of the file list export; numbers that are not finite become null, as no reader of CSV or JSON knows them."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c)
    kinds = dict(files.dtypes)
    return files.select([finite(c) if kinds[c] in ("double", "float") else F.col(c) for c in CSV_FIELDS if c in kinds])


def verdicts(stated: DataFrame, id: str = "file_id", value: str = "value") -> DataFrame:
    """id, verdict: 'yes' if anything stated (one row each; value true, false or null) is true, else 'no' if anything is false, else 'unknown'."""
    yes, no = F.bool_or(F.coalesce(value, F.lit(False))), F.bool_or(F.coalesce(~F.col(value), F.lit(False)))
    return stated.where(F.col(id).isNotNull()).groupBy(id).agg(F.when(yes, "yes").when(no, "no").otherwise("unknown").alias("verdict"))


def merged_similar(*found: tuple[str, DataFrame]) -> DataFrame:
    """query, id, match: results of several searches (query, id) as one list; a pair that several found has the label of the first."""
    rows = None
    for order, (label, part) in enumerate(found):
        part = part.select("query", "id", F.struct(F.lit(order).alias("o"), F.lit(label).alias("l")).alias("m"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.where("query != id").groupBy("query", "id").agg(F.min("m").alias("m")).select("query", "id", F.col("m.l").alias("match"))


def first_records(files: DataFrame, records: DataFrame) -> DataFrame:
    """id, records, raw_id, case_seq, media_seq, media_id, category: the first record of each file by MD5, how many there are, and the first real category.

    ``records`` is as ``sources.media.vic_index`` gives it; a category is real from 1 to 4.
    """
    keyed = records.where("md5 is not null").groupBy(F.lower(F.trim("md5")).alias("k")).agg(
        F.count("*").alias("records"), F.min(F.struct("raw_id", "case_seq", "media_seq", "media_id")).alias("f"),
        F.min_by("category", F.when(F.col("category").between(1, 4), F.struct("raw_id", "case_seq", "media_seq"))).alias("category"),
    )
    return files.select("id", F.lower(F.trim("md5")).alias("k")).join(keyed, "k").select("id", "records", "f.*", "category")


def located(files: DataFrame) -> DataFrame:
    return files.where(valid_place(F.col("gps_lat"), F.col("gps_lon")))


def case_stats(files: DataFrame) -> DataFrame:
    """One row: total, images, videos, others, reviewed, with_error, located, distinct sources, stacks, groups and copies."""
    per = files.where("stack_id is not null").groupBy("stack_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dupes"), F.count("*").alias("stacks"))
    one = files.agg(
        F.count("*").alias("total"), F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "video").alias("videos"),
        F.count_if(~F.col("kind").isin("image", "video")).alias("others"), F.count_if(F.col("reviewed") == 1).alias("reviewed"), F.count("error").alias("with_error"),
        F.count_if(valid_place(F.col("gps_lat"), F.col("gps_lon"))).alias("located"), F.countDistinct("source").alias("sources"), F.countDistinct("vstack_id").alias("vstacks"),
    )
    return one.crossJoin(per)


def by_column(files: DataFrame, column: str) -> DataFrame:
    """column, n, percent of all rows (one decimal, half to even)."""
    per = files.groupBy(F.col(column).cast("string").alias(column)).agg(F.count("*").alias("n"))
    return per.crossJoin(per.agg(F.sum("n").alias("whole"))).select(column, "n", F.bround(100.0 * F.col("n") / F.col("whole"), 1).alias("percent"))


def origins(files: DataFrame) -> DataFrame:
    """source, walk, deleted, carve, other: rows of each source by how they came to be known."""
    o = F.col("origin")
    return files.groupBy("source").agg(*[F.count_if(o == k).alias(k) for k in ("walk", "deleted", "carve")], F.count_if(~o.isin("walk", "deleted", "carve") | o.isNull()).alias("other"))


def largest_groups(files: DataFrame, column: str = "vstack_id", limit: int = 200) -> DataFrame:
    return files.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit)


def duplicate_stacks(files: DataFrame, stacks: DataFrame) -> DataFrame:
    """stack_id, copies, names, sources, bytes, wasted of every stack of two or more: a group's names are kept sorted and distinct."""
    joined = files.select("id", "rel_path", "source", "size").join(stacks, "id")
    per = joined.groupBy("stack_id").agg(
        F.count("*").alias("copies"), F.countDistinct("rel_path").alias("paths"), F.countDistinct("source").alias("sources"), F.max("size").alias("bytes"), F.sum("size").alias("all_bytes")
    )
    return per.where("copies > 1")


def groups_report(files: DataFrame, column: str) -> DataFrame:
    """group_id, files, distinct_md5, sources, bytes of every group of two or more."""
    per = files.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("group_id")).agg(
        F.count("*").alias("files"), F.countDistinct("md5").alias("distinct_md5"), F.countDistinct("source").alias("sources"), F.sum("size").alias("bytes")
    )
    return per.where("files > 1")


def media_files(files: DataFrame) -> DataFrame:
    """The list of media as it is shown: name, size, dimensions and duration as text."""
    dims = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat_ws(" x ", F.col("width").cast("string"), F.col("height").cast("string"))).otherwise("")
    return files.select("id", base_name(F.col("rel_path")).alias("name"), "source", "kind", text_of_size(F.col("size")).alias("size_text"), dims.alias("dimensions"), text_of_duration(F.col("duration")).alias("duration_text"))


def key_frames(files: DataFrame, keyframes: DataFrame) -> DataFrame:
    """file_id, frame_id, offset, rel_path: frames of known files with their place as h:mm:ss."""
    s = F.floor(F.greatest(F.coalesce("ts", F.lit(0.0)), F.lit(0.0))).cast("long")
    offset = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return keyframes.select(F.col("id").alias("frame_id"), "file_id", offset.alias("offset")).join(files.select(F.col("id").alias("file_id"), "rel_path"), "file_id")


def md5_list(files: DataFrame) -> DataFrame:
    return files.where("md5 is not null and trim(md5) != ''").select("md5").distinct()


def area_overview(files: DataFrame, degrees: float = 10.0) -> DataFrame:
    """cell_lat, cell_lon, n: located files by cell of a coarse grid."""
    cell = lambda c: (F.floor(F.col(c) / degrees) * degrees).cast("double")
    return located(files).groupBy(cell("gps_lat").alias("cell_lat"), cell("gps_lon").alias("cell_lon")).agg(F.count("*").alias("n"))


def side_table_breakdown(files: DataFrame, side: DataFrame) -> DataFrame:
    """state, n: media by what a side table (file_id, state) says of them; 'unread' where it has no row."""
    one = side.where("file_id is not null").groupBy("file_id").agg(F.max("state").alias("state"))
    joined = files.where(F.col("kind").isin("image", "video")).select("id").join(one, F.col("id") == F.col("file_id"), "left")
    return joined.groupBy(F.coalesce("state", F.lit("unread")).alias("state")).agg(F.count("*").alias("n"))
