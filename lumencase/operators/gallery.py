"""Filtering, searching, sorting, paging and collapsing the catalog of files."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumencase.functions.scalars import ARCHIVE_EXTS, DOCUMENT_EXTS, ascii_lower, base_name, contains_folded, is_system_path, real_prefix
from lumencase.staging import small_enough

#: Columns that can be filtered and sorted on.
LIST_COLUMNS = (
    "id path rel_path source kind ext size mtime ctime atime md5 sha1 sha256 phash dhash width height duration created_dt "
    "gps_lat gps_lon camera category reviewed error ingested_at stack_id vstack_id origin container_id"
).split()
TEXT_COLUMNS = "path rel_path source kind ext created_dt camera error origin md5 sha1 sha256 phash dhash".split()
#: Columns a search looks into.
SEARCHED = "rel_path camera source created_dt error md5 sha1 sha256 phash".split()
#: How a file came to be known.
ORIGINS = ("walk", "deleted", "carve")
#: A page has so many rows at most.
PAGE_MAX = 5000


#: Columns that are shown but not stored.
VIRTUAL_COLUMNS = ("name", "file_path")


def shown(column: str) -> Column:
    """A list column, or what stands for a virtual one: the name is the last part of the path, the path that in the source, else that on disk."""
    if column == "name":
        return base_name(F.col("rel_path"))
    if column == "file_path":
        return F.replace(F.coalesce(F.when(F.col("rel_path") != "", F.col("rel_path")), F.col("path")), F.lit("\\"), F.lit("/"))
    return F.col(column)


def group_key() -> Column:
    """What a collapsed list shows once: the visual group, else the exact stack, else the file."""
    return F.coalesce("vstack_id", "stack_id", "id")


def column_filter(column: str, op: str, value: object = None) -> Column | None:
    """One column's condition: contains, eq, neq (null counts as unequal), min, max, gt, lt, set, notset.

    An unknown column or operation, an unknown origin, or a bound that is no number, gives None: no condition.
    """
    if column not in LIST_COLUMNS and column not in VIRTUAL_COLUMNS:
        return None
    if column == "origin" and op == "eq" and value not in ORIGINS:
        return None
    c = shown(column)
    text = c.cast("string")
    if op == "contains":
        return contains_folded(text, str(value))
    if op == "eq":
        return c == F.lit(value)
    if op == "neq":
        return c.isNull() | (c != F.lit(value))
    if op in ("set", "notset"):
        there = c.isNotNull() & (text != "")
        return there if op == "set" else ~there
    if op in ("min", "max", "gt", "lt"):
        try:
            n = float(value)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            return None
        # a whole bound is compared as one, so that the comparison with a whole column reaches the scan
        n = int(n) if n.is_integer() else n
        number = F.when(c.isNotNull(), real_prefix(text)) if column in TEXT_COLUMNS or column in VIRTUAL_COLUMNS else c
        return {"min": number >= n, "max": number <= n, "gt": number > n, "lt": number < n}[op]
    return None


_UNITS = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3, "%": 0.01, "": 1}


def parse_filter(column: str, text: str) -> list[tuple[str, str, object]]:
    """The typed grammar of a list column's filter box: ``a-b`` or ``a..b``, ``>= <= > < =``, ``!x``, ``set``, ``none``,
    units (KB, MB, GB, %), m:ss; a bare number is a minimum for size and duration; anything else is text contained."""
    t = text.strip()
    if not t:
        return []
    if t.lower() in ("set", "any", "*"):
        return [(column, "set", None)]
    if t.lower() in ("none", "notset", "-"):
        return [(column, "notset", None)]

    def number(x: str) -> float | None:
        x = x.strip().lower()
        if m := re.fullmatch(r"(\d+):(\d{1,2})(?::(\d{1,2}))?", x):
            a, b, c = int(m[1]), int(m[2]), m[3]
            return float(a * 3600 + b * 60 + int(c)) if c else float(a * 60 + b)
        m = re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s*(b|kb|mb|gb|%)?", x)
        return float(m[1]) * _UNITS[m[2] or ""] if m else None

    if m := re.fullmatch(r"(>=|<=|>|<|=|!=|!)\s*(.+)", t):
        n = number(m[2])
        op = {">=": "min", "<=": "max", ">": "gt", "<": "lt", "=": "eq", "!=": "neq", "!": "neq"}[m[1]]
        if op in ("eq", "neq"):
            return [(column, op, m[2].strip() if n is None else n)]
        return [] if n is None else [(column, op, n)]
    if (m := re.fullmatch(r"(.+?)\s*(?:\.\.|-)\s*(.+)", t)) and number(m[1]) is not None and number(m[2]) is not None:
        return [(column, "min", number(m[1])), (column, "max", number(m[2]))]
    if column in ("size", "duration") and number(t) is not None:
        return [(column, "min", number(t))]
    return [(column, "contains", t)]


def apply_filters(files: DataFrame, filters: Iterable[tuple[str, str, object]]) -> DataFrame:
    for column, op, value in filters:
        condition = column_filter(column, op, value)
        if condition is not None:
            files = files.where(condition)
    return files


def search(files: DataFrame, text: str, flags: DataFrame | None = None, columns: Iterable[str] = SEARCHED) -> DataFrame:
    """Rows in which every word of ``text`` is in some searched column or in the name of a flag (file_id, name).

    A-Z are folded; ``%`` and ``_`` in a word stay wildcards.
    """
    for word in text.split():
        pattern = "%" + "".join(c.lower() if "A" <= c <= "Z" else c for c in word) + "%"
        condition = F.lit(False)
        for c in columns:
            condition = condition | F.coalesce(ascii_lower(c).like(pattern), F.lit(False))
        if flags is not None:
            named = flags.where(ascii_lower("name").like(pattern)).select(F.col("file_id").alias("id")).distinct().withColumn("_flagged", F.lit(True))
            files = files.join(named, "id", "left").where(condition | F.col("_flagged").isNotNull()).drop("_flagged")
        else:
            files = files.where(condition)
    return files


def day_bounds(first: date | None, last: date | None, zone: str = "UTC") -> tuple[float | None, float | None]:
    """(from, before) in epoch seconds: the days from ``first`` to ``last`` as they begin and end on the clock of ``zone``."""
    at = lambda d: datetime(d.year, d.month, d.day, tzinfo=ZoneInfo(zone)).timestamp()
    return None if first is None else at(first), None if last is None else at(last + timedelta(days=1))


def any_date(files: DataFrame, first: date | None, last: date | None, undated: bool = False, readings: str | None = None, zone: str = "UTC") -> DataFrame:
    """Rows with any date in [first, last]: file system times as instants, on days of ``zone``; other dates by the day as written.

    0 and blank are no date. ``undated`` adds (or, without a range, gives only) rows with no date at all.
    ``readings`` names a column with a JSON object of further readings.
    """
    conditions = []
    values = F.map_values(F.from_json(readings, "map<string,string>")) if readings else None
    if first or last:
        low, high = day_bounds(first, last, zone)
        for c in ("ctime", "mtime", "atime"):
            x = (F.col(c) != 0) & ~F.isnan(c)
            conditions.append((x if low is None else x & (F.col(c) >= low)) & (F.lit(True) if high is None else F.col(c) < high))

        def day(v: Column) -> Column:
            d = F.substring(v, 1, 10)
            out = d != ""
            out = out if first is None else out & (d >= first.isoformat())
            return out if last is None else out & (d <= last.isoformat())

        conditions.append(day(F.col("created_dt")))
        if values is not None:
            conditions.append(F.exists(values, day))
    if undated:
        none = F.coalesce(F.col("created_dt"), F.lit("")) == ""
        for c in ("ctime", "mtime", "atime"):
            none = none & (F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) == 0)
        if values is not None:
            none = none & ~F.coalesce(F.exists(values, lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(False))
        conditions.append(none)
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return files.where(out)


def collapse(files: DataFrame) -> DataFrame:
    """The row with the lowest id of each group, among the rows given: filters come first."""
    heads = files.groupBy(group_key().alias("grp")).agg(F.min("id").alias("id"))
    return files.join(heads, "id", "left_semi")


def page(files: DataFrame, sort: str = "rel_path", descending: bool = False, limit: int = 500, offset: int = 0) -> DataFrame:
    """One page, ties broken by id in the same direction; nulls come first ascending."""
    sort = sort if sort in LIST_COLUMNS else "rel_path"
    order = [F.desc_nulls_last(sort), F.desc("id")] if descending else [F.asc_nulls_first(sort), F.asc("id")]
    return files.orderBy(*order).offset(offset).limit(min(limit, PAGE_MAX))


def with_group_sizes(rows: DataFrame, files: DataFrame) -> DataFrame:
    """stack_count (1 without a stack) and vstack_count (0 without a group) of each row, counted over all files."""
    for column, name, default in (("stack_id", "stack_count", 1), ("vstack_id", "vstack_count", 0)):
        sizes = files.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name))
        rows = rows.join(sizes, column, "left").withColumn(name, F.coalesce(name, F.lit(default)))
    return rows


def with_duplicates(files: DataFrame, which: str) -> DataFrame:
    """exact: in a stack of two or more; visual: in a visual group; any: either."""
    stacks = files.where("stack_id is not null").groupBy("stack_id").agg(F.count("*").alias("n")).where("n > 1").select("stack_id", F.lit(True).alias("_dup"))
    if which == "visual":
        return files.where("vstack_id is not null")
    marked = files.join(stacks, "stack_id", "left")
    condition = F.col("_dup").isNotNull() if which == "exact" else F.col("_dup").isNotNull() | F.col("vstack_id").isNotNull()
    return marked.where(condition).drop("_dup").select(files.columns)


def container_kinds(files: DataFrame) -> DataFrame:
    """id, container_kind, media, nested of every row that others came out of.

    A document by its extension, or without one by the names of what came out of it; else an archive.
    """
    parts = files.where("container_id is not null").groupBy(F.col("container_id").alias("id")).agg(
        F.count_if(F.col("kind").isin("image", "video")).alias("media"), F.count_if(~F.col("kind").isin("image", "video")).alias("nested"),
        F.bool_or(F.regexp_like("rel_path", F.lit(r"(^|/)(p\d{4}|unused|attachment)_obj"))).alias("by_name"),
    )
    ext = F.lower(F.coalesce("ext", F.lit("")))
    kind = F.when(ext.isin(DOCUMENT_EXTS) | ((ext == "") & F.col("by_name")), "document").when(ext.isin(ARCHIVE_EXTS), "archive").otherwise("other")
    return files.join(parts, "id").select("id", kind.alias("container_kind"), "media", "nested")


def pulled_from(files: DataFrame, container_kind: str) -> DataFrame:
    """Rows that came out of a container of one kind."""
    of_kind = container_kinds(files).where(F.col("container_kind") == container_kind).select(F.col("id").alias("container_id"))
    return files.join(of_kind, "container_id", "left_semi").select(files.columns)


def flagged(files: DataFrame, file_flags: DataFrame, codes: Iterable[int] | None = None) -> DataFrame:
    """Rows that carry a flag (file_flags: file_id, flag_code), or one of ``codes``."""
    of = file_flags if codes is None else file_flags.where(F.col("flag_code").isin(list(codes)))
    return files.join(of.select(F.col("file_id").alias("id")), "id", "left_semi").select(files.columns)


def scope(
    files: DataFrame, name: str, ids: DataFrame | None = None, uncategorized: int = 5, codes: Iterable[int] = (),
    file_flags: DataFrame | None = None, where: str | None = None, vic_ids: DataFrame | None = None, vic_match: str = "include",
) -> DataFrame:
    """A report's rows: all, selected (ids), categorized, uncategorized, categories (codes), flags, specificflags (codes), where (a condition).

    ``vic_match`` then keeps 'only' the rows that a Project VIC set lists (vic_ids: id), or leaves them out ('exclude').
    """
    if name == "selected":
        files = files.join(ids, "id", "left_semi")
    elif name == "categorized":
        files = files.where((F.col("category") != uncategorized) & F.col("category").isNotNull())
    elif name == "uncategorized":
        files = files.where(F.col("category") == uncategorized)
    elif name == "categories":
        files = files.where(F.col("category").isin(list(codes)))
    elif name in ("flags", "specificflags"):
        files = flagged(files, file_flags, None if name == "flags" else codes)
    elif name == "where" and where:
        files = files.where(where)
    if vic_match in ("only", "exclude"):
        files = files.join(vic_ids.select("id"), "id", "left_semi" if vic_match == "only" else "left_anti")
    return files


def matched_by(files: DataFrame, hits: DataFrame, summary: DataFrame, name: str, sets: DataFrame) -> DataFrame:
    """Rows by what lists them: '*' any set of the case, '*good' known to be good, '*vic', '*stash' and '*both' by source, else the set of that name."""
    if name == "*":
        found = summary.join(sets.select(F.col("name").alias("top")), "top", "left_semi")
    elif name == "*good":
        found = summary.where("top_kind = 'known-good'")
    elif name in ("*vic", "*stash", "*both"):
        bits = {"*vic": 1, "*stash": 2, "*both": 3}[name]
        found = summary.where(F.col("mask").bitwiseAND(bits) == bits)
    else:
        found = hits.where(F.col("name") == name)
    return files.join(found.select("id"), "id", "left_semi")


def retryable(files: DataFrame, placeholder: str) -> DataFrame:
    """Rows with an error that trying again may mend: not those whose content was never there (errors beginning with ``placeholder``)."""
    return files.where(F.col("error").isNotNull() & ~F.col("error").startswith(placeholder))


#: Older names of sort orders: column and whether it descends.
NAMED_SORTS = {"path": ("rel_path", False), "date": ("created_dt", False), "size": ("size", False), "cluster": ("vstack_id", False), "id": ("id", False)}


def named_sort(files: DataFrame, name: str, limit: int = 500) -> DataFrame:
    column, descending = NAMED_SORTS.get(name, ("rel_path", False))
    return page(files, column, descending, limit)


def build_order(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """The rows in the order an index takes them: the system's own artwork last, larger first; the sort is by range, not in one task."""
    return files.orderBy(is_system_path(F.col(path)), F.desc_nulls_last(size), "id")


def expand_to_groups(files: DataFrame, selected: DataFrame) -> DataFrame:
    """id of every file in the group of a selected one (column id)."""
    keys = files.join(selected, "id", "left_semi").select(group_key().alias("grp")).distinct()
    n = keys.count()
    keyed = files.select("id", group_key().alias("grp"))
    return keyed.join(F.broadcast(keys) if small_enough(n, 16) else keys, "grp", "left_semi").select("id")


def newest(rows: DataFrame, partition: str, order: Iterable[str], keep: int) -> DataFrame:
    """The newest ``keep`` rows of each partition: by the order columns, all descending."""
    w = Window.partitionBy(partition).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")
