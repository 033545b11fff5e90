"""Further queries of the catalog: flags, report scopes, named sets, virtual columns, records and artifacts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencase.functions import scalars as S
from lumencase.operators import dedupe, gallery, hashsets, reports, similarity, updates
from lumencase.plans import catalog as C
from lumencase.sources import media
from lumencase.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
query = C.registrar(QUERIES, SQL)

_files, _hits = C._files, C._hits


@query("SELECT id, rel_path, size FROM files WHERE id = 42")
def point_lookup(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root).where("id = 42").select("id", "rel_path", "size")


@query("SELECT id FROM files WHERE contains(lower(split_part(replace(rel_path, chr(92), '/'), '/', -1)), 'img_00')")
def col_filter_name(spark: SparkSession, root: str) -> DataFrame:
    return gallery.apply_filters(_files(spark, root), [("name", "contains", "img_00")]).select("id")


@query("SELECT id FROM files WHERE contains(lower(replace(coalesce(nullif(rel_path, ''), path), chr(92), '/')), 'users/u1')")
def col_filter_file_path(spark: SparkSession, root: str) -> DataFrame:
    return gallery.apply_filters(_files(spark, root), [("file_path", "contains", "users/u1")]).select("id")


@query("SELECT id FROM files")
def unknown_origin_ignored(spark: SparkSession, root: str) -> DataFrame:
    return gallery.apply_filters(_files(spark, root), [("origin", "eq", "nosuch")]).select("id")


for _o in gallery.ORIGINS:
    query(f"SELECT id FROM files WHERE origin = '{_o}'", f"origin_{_o}")(lambda spark, root, o=_o: gallery.apply_filters(_files(spark, root), [("origin", "eq", o)]).select("id"))


# ---- flags and report scopes ------------------------------------------------------------------------------

_FILE_FLAGS_SQL = "(SELECT id AS file_id, 1 AS flag_code FROM files WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL UNION ALL SELECT id, 2 FROM files WHERE size > 5000000 UNION ALL SELECT id, 3 FROM files WHERE error IS NOT NULL)"


def _file_flags(f: DataFrame) -> DataFrame:
    """file_id, flag_code: there is no table of flags in the data, so three are derived."""
    rules = ((1, "gps_lat is not null and gps_lon is not null"), (2, "size > 5000000"), (3, "error is not null"))
    parts = [f.where(rule).select(F.col("id").alias("file_id"), F.lit(code).alias("flag_code")) for code, rule in rules]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT id FROM files WHERE id IN (SELECT file_id FROM {_FILE_FLAGS_SQL} WHERE flag_code = 2)")
def flag_equals(spark: SparkSession, root: str) -> DataFrame:
    f = _files(spark, root)
    return gallery.flagged(f, _file_flags(f), [2]).select("id")


@query(f"SELECT flag_code, count(DISTINCT file_id) AS files FROM {_FILE_FLAGS_SQL} GROUP BY 1")
def flag_counts(spark: SparkSession, root: str) -> DataFrame:
    return _file_flags(_files(spark, root)).groupBy("flag_code").agg(F.countDistinct("file_id").alias("files"))


_VIC_SQL = f"WITH {C._HITS} SELECT id FROM hits WHERE src = 'vic'"
for _name, _sql in (("flags", f"id IN (SELECT file_id FROM {_FILE_FLAGS_SQL})"), ("specificflags", f"id IN (SELECT file_id FROM {_FILE_FLAGS_SQL} WHERE flag_code IN (2, 3))"), ("where", "width > 1000 AND kind = 'image'")):
    for _vic, _more in (("include", "true"), ("only", f"id IN ({_VIC_SQL})"), ("exclude", f"id NOT IN ({_VIC_SQL})")):
        query(f"SELECT id FROM files WHERE ({_sql}) AND {_more}", f"report_scope_{_name}_{_vic}")(
            lambda spark, root, n=_name, v=_vic: gallery.scope(
                _files(spark, root), n, codes=(2, 3), file_flags=_file_flags(_files(spark, root)), where="width > 1000 and kind = 'image'", vic_ids=_hits(spark, root).where("src = 'vic'").select("id"), vic_match=v
            ).select("id")
        )


@query("""SELECT code, name FROM (VALUES (1, 'Located'), (2, 'Big'), (4, 'Follow up')) t(code, name)""")
def flags_upkeep(spark: SparkSession, root: str) -> DataFrame:
    """A table of flags after one was renamed, one added and one removed."""
    rows = lambda x: spark.createDataFrame(x, "code int, name string")
    return updates.put(rows([(1, "Located"), (2, "Large"), (3, "Error")]), rows([(2, "Big"), (4, "Follow up")]), rows([(3, None)]), "code")


# ---- known sets -------------------------------------------------------------------------------------------

for _name, _text, _sql in (
    ("any", "*", "SELECT id FROM summ WHERE top IN (SELECT name FROM hashsets)"), ("good", "*good", "SELECT id FROM summ WHERE top_kind = 'known-good'"),
    ("vic", "*vic", "SELECT id FROM summ WHERE (mask & 1) = 1"), ("stash", "*stash", "SELECT id FROM summ WHERE (mask & 2) = 2"),
    ("named", hashsets.STASH_NAME, f"SELECT id FROM hits WHERE name = '{hashsets.STASH_NAME}'"),
):
    query(f"WITH {C._SUMMARY} {_sql}", f"hashset_name_{_name}")(
        lambda spark, root, t=_text: gallery.matched_by(_files(spark, root), _hits(spark, root), hashsets.summary(_hits(spark, root)), t, table(spark, root, "hashsets")).select("id")
    )


@query(f"""WITH {C._ENTRIES}, a AS (SELECT DISTINCT value FROM n WHERE algo = 'md5'), s AS (SELECT DISTINCT k AS value FROM (SELECT {C._MD5} AS k FROM stash) WHERE k IS NOT NULL)
SELECT coalesce(a.value, s.value) AS value, a.value IS NOT NULL AS in_sets, s.value IS NOT NULL AS in_stash FROM a FULL JOIN s ON a.value = s.value""")
def case_and_global_entries(spark: SparkSession, root: str) -> DataFrame:
    return hashsets.every_value(table(spark, root, "hashset_entries"), table(spark, root, "stash"))


@query(f"""SELECT k AS md5, min(category) AS category, arg_min(source, row(added_at, source)) FILTER (WHERE source IS NOT NULL) AS source, region FROM (SELECT {C._MD5} AS k, * FROM stash) WHERE k IS NOT NULL GROUP BY k, region""")
def stash_export(spark: SparkSession, root: str) -> DataFrame:
    return hashsets.stash_entries(table(spark, root, "stash")).select("md5", "category", "source", "region")


# ---- dates, sorts, errors ---------------------------------------------------------------------------------


@query("""SELECT id FROM files WHERE """ + " OR ".join(f"coalesce({c} <> 0 AND NOT isnan({c}) AND {c} >= 1583125200 AND {c} < 1583989200, false)" for c in ("ctime", "mtime", "atime")) + """
OR coalesce(substr(created_dt, 1, 10) >= '2020-03-02' AND substr(created_dt, 1, 10) <= '2020-03-11', false)""")
def any_date_in_zone(spark: SparkSession, root: str) -> DataFrame:
    """Days of New York around the change to summer time: from 05:00 UTC to 04:00 UTC."""
    return gallery.any_date(_files(spark, root), date(2020, 3, 2), date(2020, 3, 11), zone="America/New_York").select("id")


@query("""SELECT id, CASE WHEN mtime IS NOT NULL AND NOT isnan(mtime) AND mtime <> 0 THEN strftime(timezone('America/New_York', to_timestamp(mtime)), '%Y-%m-%d %H:%M:%S') END AS shown FROM files""")
def times_in_zone(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root).select("id", S.shown_in_zone(F.col("mtime"), "America/New_York").alias("shown"))


@query("""SELECT id, strftime(timezone('UTC', to_timestamp(floor(mtime))), '%Y-%m-%dT%H:%M:%S') || '-05:30' AS taken FROM files WHERE mtime IS NOT NULL AND NOT isnan(mtime)""")
def capture_times(spark: SparkSession, root: str) -> DataFrame:
    """Times written as other tools write them, with an offset in words, and read again."""
    f = _files(spark, root).where("mtime is not null and not isnan(mtime)")
    written = F.concat(F.date_format(F.timestamp_seconds(F.floor("mtime")), "M/d/yyyy h:mm:ss a"), F.lit(" (UTC-5:30)"))
    return f.select("id", S.capture_time(written).alias("taken"))


@query("SELECT id FROM files WHERE error IS NOT NULL AND NOT starts_with(error, 'zero')")
def retryable_errors(spark: SparkSession, root: str) -> DataFrame:
    return gallery.retryable(_files(spark, root), "zero").select("id")


@query("""SELECT id, 'cannot read <path>: ' || error AS shown FROM files WHERE error IS NOT NULL AND NOT contains(path, ' ')""")
def errors_without_paths(spark: SparkSession, root: str) -> DataFrame:
    f = _files(spark, root).where("error is not null and not contains(path, ' ')")
    return f.select("id", S.without_paths(F.concat(F.lit("cannot read "), "path", F.lit(": "), "error")).alias("shown"))


@query("SELECT id, created_dt FROM files ORDER BY created_dt ASC NULLS FIRST, id LIMIT 500")
def sort_by_date(spark: SparkSession, root: str) -> DataFrame:
    return gallery.named_sort(_files(spark, root), "date").select("id", "created_dt")


_SPELLED = "CASE WHEN id % 4 = 0 THEN 'c:/Windows/' || rel_path WHEN id % 4 = 1 THEN 'c:/Program Files (x86)/' || rel_path ELSE path END"


@query(f"SELECT id, size FROM (SELECT id, size, lower({_SPELLED}) AS p FROM files) ORDER BY (p LIKE '%/windows/%' OR p LIKE '%/program files%' OR p LIKE '%/programdata/%' OR p LIKE '%/system/library/%' OR p LIKE '%/applications/%.app/%'), size DESC NULLS LAST, id LIMIT 500")
def index_build_order(spark: SparkSession, root: str) -> DataFrame:
    """The first of a build order; a quarter each is put below two of the system's folders."""
    f = _files(spark, root).select("id", "size", F.expr(_SPELLED).alias("path"))
    return gallery.build_order(f).limit(500).select("id", "size")


@query(f"SELECT id, (p LIKE '%/windows/%' OR p LIKE '%/program files%') AS system FROM (SELECT id, lower({_SPELLED}) AS p FROM files)")
def system_paths(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root).select("id", S.is_system_path(F.expr(_SPELLED)).alias("system"))


# ---- records, verdicts, fingerprints ----------------------------------------------------------------------


@query()
def vic_first_records(spark: SparkSession, root: str) -> DataFrame:
    """For each content that exports name: its first record, how many there are and the first real category."""
    records = media.vic_index(table(spark, root, "vic_raw"))
    contents = records.select(F.lower(F.trim("md5")).alias("md5")).where("md5 is not null").distinct()
    return reports.first_records(contents.select(F.col("md5").alias("id"), "md5"), records)


@query("""SELECT id, CAST(CASE WHEN reviewed IS NULL THEN 0 WHEN reviewed = 1 THEN 257 ELSE 1 END + CASE WHEN error IS NULL THEN 0 ELSE 514 END + CASE WHEN width IS NULL THEN 0 WHEN width > 1000 THEN 1028 ELSE 4 END AS INT) AS packed, width > 1000 AS third FROM files WHERE reviewed IS NOT NULL OR error IS NOT NULL OR width IS NOT NULL""")
def packed_flags(spark: SparkSession, root: str) -> DataFrame:
    """Three-valued flags packed into one number, and the third unpacked again."""
    f = _files(spark, root)
    packed = S.pack_flags(S.tri_state(F.col("reviewed").cast("string")), F.when(F.col("error").isNotNull(), True), F.col("width") > 1000)
    return f.select("id", packed.alias("packed")).where("packed is not null").select("id", "packed", S.unpack_flag(F.col("packed"), 2).alias("third"))


@query("""SELECT file_id, CASE WHEN bool_or(coalesce(v, false)) THEN 'yes' WHEN bool_or(coalesce(NOT v, false)) THEN 'no' ELSE 'unknown' END AS verdict
FROM (SELECT file_id, CASE doc_type WHEN 'report' THEN true WHEN 'mail' THEN false END AS v FROM documents WHERE file_id IS NOT NULL) GROUP BY 1""")
def stated_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """What documents state of files; the kind of document stands in for a credential's statement."""
    d = table(spark, root, "documents").select("file_id", F.when(F.col("doc_type") == "report", True).when(F.col("doc_type") == "mail", False).alias("value"))
    return reports.verdicts(d)


_W = " + ".join(f"CAST(bit_count(xor(CAST('0x' || substr(f.sha256, {1 + 16 * i}, 16) AS UBIGINT), CAST('0x' || substr(q.sha256, {1 + 16 * i}, 16) AS UBIGINT))) AS INT)" for i in range(4))


@query(f"""WITH f AS (SELECT id, sha256 FROM files WHERE regexp_full_match(sha256, '[0-9a-fA-F]{{64}}')), b AS (SELECT q.id AS query, f.id, CAST({_W} AS INT) AS distance FROM f, f q WHERE q.id % 100 = 0 AND f.id <> q.id)
SELECT query, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM b) WHERE rank <= 20""")
def wide_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """The nearest 256-bit patterns of each stated query; content hashes stand in for fingerprints of that width."""
    f = _files(spark, root)
    return similarity.nearest_patterns(f.select("id", S.bits_of_hex(F.col("sha256")).alias("bits")), C._each_hundredth(f), 20)


@query(f"""WITH RECURSIVE exact AS (SELECT q.id AS query, f.id FROM files q JOIN files f ON f.stack_id = q.stack_id WHERE q.id % 100 = 0 AND q.id <> f.id),
hash AS (SELECT query, id FROM ({C.SQL['find_similar']})), face AS (SELECT DISTINCT x.file_id AS query, y.file_id AS id FROM ({C.SQL['face_match']}) m JOIN faces x ON x.id = m.query JOIN faces y ON y.id = m.id WHERE x.file_id IS NOT NULL AND y.file_id IS NOT NULL AND x.file_id <> y.file_id),
every AS (SELECT query, id, 0 AS o FROM hash UNION ALL SELECT query, id, 1 FROM exact UNION ALL SELECT query, id, 2 FROM face)
SELECT query, id, CASE min(o) WHEN 0 THEN 'hash' WHEN 1 THEN 'copy' ELSE 'content' END AS match FROM every GROUP BY 1, 2""")
def similar_merged(spark: SparkSession, root: str) -> DataFrame:
    """What three searches find, each pair once with the label of the first: hashes, exact copies, faces."""
    f, faces = _files(spark, root), table(spark, root, "faces")
    by_hash = C.QUERIES["find_similar"](spark, root).select("query", "id")
    asked = f.where("id % 100 = 0 and stack_id is not null").select(F.col("id").alias("query"), "stack_id")
    exact = asked.join(f.select("id", "stack_id"), "stack_id").select("query", "id")
    of = lambda key: faces.where("file_id is not null").select(F.col("id").alias(key), F.col("file_id").alias(f"file_{key}"))
    met = C.QUERIES["face_match"](spark, root).select("query", "id").join(of("query"), "query").join(of("id"), "id").select(F.col("file_query").alias("query"), F.col("file_id").alias("id"))
    return reports.merged_similar(("hash", by_hash), ("copy", exact), ("content", met))


@query(f"SELECT group_id, count(*) AS files, count(DISTINCT f.md5) AS distinct_md5, count(DISTINCT f.source) AS sources, sum(f.size) AS bytes FROM files f JOIN ({C._groups_sql(12)}) g ON g.id = f.id GROUP BY 1 HAVING count(*) > 1")
def artifact_clusters(spark: SparkSession, root: str) -> DataFrame:
    f = _files(spark, root)
    return reports.groups_report(f.join(dedupe.groups(f, 12), "id"), "group_id")


_HEADS = "CASE ext WHEN 'jpg' THEN 'image' WHEN 'png' THEN 'image' WHEN 'heic' THEN 'image' WHEN 'webp' THEN 'image' WHEN 'mp4' THEN 'video' WHEN 'avi' THEN 'video' WHEN 'zip' THEN 'archive' WHEN 'gz' THEN 'archive' WHEN '7z' THEN 'archive' ELSE 'other' END"


@query(f"SELECT id, {_HEADS} AS sniffed FROM files")
def sniffed_kinds(spark: SparkSession, root: str) -> DataFrame:
    """The first bytes that files of each extension have, and the kind they show."""
    heads = {"jpg": "FFD8FFE000104A46", "png": "89504E470D0A1A0A0000", "heic": "00000018667479706865696300000000", "webp": "524946460000000057454250", "mp4": "000000186674797069736F6D00000000", "avi": "524946460000000041564920", "zip": "504B030414000000", "gz": "1F8B0800", "7z": "377ABCAF271C0004"}
    head = F.unhex(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in heads.items() for x in pair]), F.col("ext")), F.lit("00")))
    return _files(spark, root).select("id", S.sniff_kind(head).alias("sniffed"))
