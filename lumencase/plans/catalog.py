"""The catalog's queries over whole tables, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencase.functions import scalars as S
from lumencase.operators import dedupe, gallery, hashsets, intervals, reports, similarity, updates
from lumencase.sources import media, sinks
from lumencase.streaming import ingest
from lumencase.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registrar(queries: dict, sqls: dict):
    def query(sql: str | None = None, name: str | None = None):
        def add(f):
            queries[name or f.__name__] = f
            if sql is not None:
                sqls[name or f.__name__] = sql
            return f

        return add

    return query


query = registrar(QUERIES, SQL)


def _files(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "files")


def _each_hundredth(rows: DataFrame, id: str = "id") -> DataFrame:
    """The stated queries of a search: every row whose id is divisible by 100."""
    return rows.where(F.col(id) % 100 == 0).select(F.col(id).alias("id"))


# ---- gallery ----------------------------------------------------------------------------------------------


@query("""WITH heads AS (SELECT coalesce(vstack_id, stack_id, id) AS g, min(id) AS id FROM files WHERE kind = 'image' AND size >= 100000 GROUP BY 1)
SELECT f.id, f.rel_path, f.source, f.size FROM files f JOIN heads h ON h.id = f.id ORDER BY f.rel_path ASC NULLS FIRST, f.id LIMIT 500""")
def gallery_collapse_page(spark: SparkSession, root: str) -> DataFrame:
    kept = gallery.apply_filters(_files(spark, root), [("kind", "eq", "image"), ("size", "min", 100000)])
    return gallery.page(gallery.collapse(kept)).select("id", "rel_path", "source", "size")


@query("SELECT id, size, rel_path FROM files WHERE kind <> 'archive' ORDER BY size DESC NULLS LAST, id DESC LIMIT 200 OFFSET 400")
def gallery_plain_page(spark: SparkSession, root: str) -> DataFrame:
    return gallery.page(_files(spark, root).where("kind != 'archive'"), "size", True, 200, 400).select("id", "size", "rel_path")


@query("SELECT count(DISTINCT coalesce(vstack_id, stack_id, id)) AS groups, count(*) AS n FROM files WHERE kind <> 'archive'")
def gallery_total_groups(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root).where("kind != 'archive'").agg(F.countDistinct(gallery.group_key()).alias("groups"), F.count("*").alias("n"))


@query("""SELECT f.id, coalesce(s.n, 1) AS stack_count, coalesce(v.n, 0) AS vstack_count FROM files f
LEFT JOIN (SELECT stack_id, count(*) AS n FROM files WHERE stack_id IS NOT NULL GROUP BY 1) s ON s.stack_id = f.stack_id
LEFT JOIN (SELECT vstack_id, count(*) AS n FROM files WHERE vstack_id IS NOT NULL GROUP BY 1) v ON v.vstack_id = f.vstack_id""")
def page_group_sizes(spark: SparkSession, root: str) -> DataFrame:
    f = _files(spark, root)
    return gallery.with_group_sizes(f.select("id", "stack_id", "vstack_id"), f).select("id", "stack_count", "vstack_count")


_FILTERS = {
    "contains": (("rel_path", "contains", "DSC_00"), "contains(lower(rel_path), 'dsc_00')"),
    "contains_camera": (("camera", "contains", "mini"), "contains(lower(camera), 'mini')"),
    "eq": (("ext", "eq", "jpg"), "ext = 'jpg'"),
    "neq": (("camera", "neq", "Luxel Mini"), "camera IS NULL OR camera <> 'Luxel Mini'"),
    "min": (("size", "min", 1000000), "size >= 1000000"),
    "max": (("duration", "max", "60"), "duration <= 60"),
    "gt": (("width", "gt", 1920), "width > 1920"),
    "lt": (("height", "lt", 1080), "height < 1080"),
    "set": (("gps_lat", "set", None), "gps_lat IS NOT NULL"),
    "notset": (("error", "notset", None), "error IS NULL OR error = ''"),
}
for _name, (_filter, _sql) in _FILTERS.items():
    query(f"SELECT id FROM files WHERE {_sql}", f"col_filter_{_name}")(lambda spark, root, f=_filter: gallery.apply_filters(_files(spark, root), [f]).select("id"))

_GRAMMAR = {
    "range": (("size", "10 KB-2 MB"), "size >= 10240 AND size <= 2097152"),
    "bare": (("duration", "1:30"), "duration >= 90"),
    "compare": (("height", ">= 1080"), "height >= 1080"),
    "not": (("kind", "!image"), "kind IS NULL OR kind <> 'image'"),
}
for _name, ((_column, _text), _sql) in _GRAMMAR.items():
    query(f"SELECT id FROM files WHERE {_sql}", f"filter_grammar_{_name}")(lambda spark, root, c=_column, t=_text: gallery.apply_filters(_files(spark, root), gallery.parse_filter(c, t)).select("id"))

_ANYWHERE = " OR ".join(f"lower({c}) LIKE '%{{0}}%'" for c in gallery.SEARCHED)


@query(f"SELECT id FROM files WHERE ({_ANYWHERE.format('img')}) AND ({_ANYWHERE.format('phone')})")
def search_all_words(spark: SparkSession, root: str) -> DataFrame:
    return gallery.search(_files(spark, root), "IMG phone").select("id")


_FLAGS_SQL = "(SELECT id AS file_id, 'Located Site' AS name FROM files WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL UNION ALL SELECT id, 'Large' FROM files WHERE size > 5000000)"


def _flags(f: DataFrame) -> DataFrame:
    located = f.where("gps_lat is not null and gps_lon is not null").select(F.col("id").alias("file_id"), F.lit("Located Site").alias("name"))
    return located.unionByName(f.where("size > 5000000").select(F.col("id").alias("file_id"), F.lit("Large").alias("name")))


@query(f"SELECT id FROM files f WHERE {_ANYWHERE.format('site')} OR id IN (SELECT file_id FROM {_FLAGS_SQL} WHERE lower(name) LIKE '%site%')")
def search_flag_names(spark: SparkSession, root: str) -> DataFrame:
    f = _files(spark, root)
    return gallery.search(f, "Site", _flags(f)).select("id")


@query(f"SELECT file_id AS id, string_agg(name, ', ' ORDER BY name) AS flags FROM {_FLAGS_SQL} GROUP BY 1")
def flags_per_file(spark: SparkSession, root: str) -> DataFrame:
    return _flags(_files(spark, root)).groupBy(F.col("file_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("flags"))


_RANGE = "({0} <> 0 AND NOT isnan({0}) AND {0} >= 1577836800 AND {0} < 1609459200)"


@query(f"""SELECT id FROM files WHERE {' OR '.join(f'coalesce({_RANGE.format(c)}, false)' for c in ('ctime', 'mtime', 'atime'))}
OR coalesce(substr(created_dt, 1, 10) <> '' AND substr(created_dt, 1, 10) >= '2020-01-01' AND substr(created_dt, 1, 10) <= '2020-12-31', false)""")
def any_date_range(spark: SparkSession, root: str) -> DataFrame:
    return gallery.any_date(_files(spark, root), date(2020, 1, 1), date(2020, 12, 31)).select("id")


@query("""SELECT id FROM files WHERE coalesce(created_dt, '') = '' AND coalesce(ctime, 0) = 0 AND coalesce(mtime, 0) = 0 AND coalesce(atime, 0) = 0""")
def any_date_none(spark: SparkSession, root: str) -> DataFrame:
    return gallery.any_date(_files(spark, root), None, None, True).select("id")


@query("""SELECT event_id AS id FROM (SELECT event_id, ts, json_object('kind', event_type, 'seen', strftime(ts + INTERVAL 12 DAY, '%Y-%m-%dT%H:%M:%S')) AS r FROM events)
WHERE (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-18') OR EXISTS (SELECT 1 FROM (SELECT unnest(json_extract_string(r, '$.*')) AS v) WHERE substr(v, 1, 10) <> '' AND substr(v, 1, 10) >= '2024-01-15' AND substr(v, 1, 10) <= '2024-01-17')""")
def any_date_readings(spark: SparkSession, root: str) -> DataFrame:
    """Events with their own time, and a JSON object of further readings, one of them a date twelve days later."""
    later = F.date_format(F.col("ts") + F.expr("interval 12 days"), "yyyy-MM-dd'T'HH:mm:ss")
    e = table(spark, root, "events").select(F.col("event_id").alias("id"), F.lit(None).cast("double").alias("ctime"), F.unix_timestamp("ts").cast("double").alias("mtime"), F.lit(None).cast("double").alias("atime"), F.lit(None).cast("string").alias("created_dt"), F.to_json(F.struct(F.col("event_type").alias("kind"), later.alias("seen"))).alias("readings"))
    return gallery.any_date(e, date(2024, 1, 15), date(2024, 1, 17), False, "readings").select("id")


_EXACT = "stack_id IN (SELECT stack_id FROM files WHERE stack_id IS NOT NULL GROUP BY stack_id HAVING count(*) > 1)"
for _name, _sql in (("exact", _EXACT), ("visual", "vstack_id IS NOT NULL"), ("any", f"{_EXACT} OR vstack_id IS NOT NULL")):
    query(f"SELECT id FROM files WHERE {_sql}", f"hasdup_{_name}")(lambda spark, root, w=_name: gallery.with_duplicates(_files(spark, root), w).select("id"))

_KINDS_SQL = f"""(SELECT f.id, CASE WHEN lower(coalesce(f.ext, '')) IN ({', '.join(f"'{x}'" for x in S.DOCUMENT_EXTS)}) OR (coalesce(f.ext, '') = '' AND p.by_name) THEN 'document'
 WHEN lower(coalesce(f.ext, '')) IN ({', '.join(f"'{x}'" for x in S.ARCHIVE_EXTS)}) THEN 'archive' ELSE 'other' END AS container_kind, p.media, p.nested
FROM files f JOIN (SELECT container_id AS id, count(*) FILTER (WHERE kind IN ('image', 'video')) AS media, count(*) FILTER (WHERE kind NOT IN ('image', 'video')) AS nested,
 bool_or(regexp_matches(rel_path, '(^|/)(p[0-9]{{4}}|unused|attachment)_obj')) AS by_name FROM files WHERE container_id IS NOT NULL GROUP BY 1) p ON p.id = f.id)"""


@query(f"SELECT * FROM {_KINDS_SQL}")
def container_kinds(spark: SparkSession, root: str) -> DataFrame:
    return gallery.container_kinds(_files(spark, root))


@query(f"SELECT container_kind, count(*) AS containers, sum(media) AS media, sum(nested) AS nested FROM {_KINDS_SQL} GROUP BY 1")
def container_rollup(spark: SparkSession, root: str) -> DataFrame:
    return gallery.container_kinds(_files(spark, root)).groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("media").alias("media"), F.sum("nested").alias("nested"))


for _kind in ("archive", "document"):
    query(f"SELECT id FROM files WHERE container_id IN (SELECT id FROM {_KINDS_SQL} WHERE container_kind = '{_kind}')", f"in_{_kind}")(lambda spark, root, k=_kind: gallery.pulled_from(_files(spark, root), k).select("id"))

_SIDE_SQL = "(SELECT file_id, max(doc_type) AS state FROM documents WHERE file_id IS NOT NULL GROUP BY 1)"


def _side(spark: SparkSession, root: str) -> DataFrame:
    """What documents say of files: a side table with a row for some of them."""
    return table(spark, root, "documents").where("file_id is not null").groupBy("file_id").agg(F.max("doc_type").alias("state"))


@query(f"SELECT id FROM files WHERE id IN (SELECT file_id FROM {_SIDE_SQL} WHERE state IN ('report', 'mail'))")
def side_declared(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root).join(_side(spark, root).where("state in ('report', 'mail')").select(F.col("file_id").alias("id")), "id", "left_semi").select("id")


@query(f"SELECT id FROM files WHERE kind IN ('image', 'video') AND id NOT IN (SELECT file_id FROM {_SIDE_SQL})")
def side_unread(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root).where("kind in ('image', 'video')").join(_side(spark, root).select(F.col("file_id").alias("id")), "id", "left_anti").select("id")


@query(f"SELECT coalesce(s.state, 'unread') AS state, count(*) AS n FROM files f LEFT JOIN {_SIDE_SQL} s ON s.file_id = f.id WHERE f.kind IN ('image', 'video') GROUP BY 1")
def side_breakdown(spark: SparkSession, root: str) -> DataFrame:
    return reports.side_table_breakdown(_files(spark, root), _side(spark, root))


for _name, _sql in (("categorized", "category IS NOT NULL AND category <> 5"), ("uncategorized", "category = 5"), ("categories", "category IN (1, 2, 3)"), ("all", "true")):
    query(f"SELECT id, category FROM files WHERE {_sql}", f"report_scope_{_name}")(lambda spark, root, n=_name: gallery.scope(_files(spark, root), n, codes=(1, 2, 3)).select("id", "category"))


@query("""SELECT id FROM files WHERE coalesce(vstack_id, stack_id, id) IN (SELECT coalesce(vstack_id, stack_id, id) FROM files WHERE error IS NOT NULL)""")
def categorize_group_expand(spark: SparkSession, root: str) -> DataFrame:
    f = _files(spark, root)
    return gallery.expand_to_groups(f, f.where("error is not null").select("id"))


@query("""SELECT id, CASE WHEN coalesce(vstack_id, stack_id, id) IN (SELECT coalesce(vstack_id, stack_id, id) FROM files WHERE error IS NOT NULL) THEN 3 ELSE category END AS category FROM files""")
def categorize_groups(spark: SparkSession, root: str) -> DataFrame:
    f = _files(spark, root)
    return updates.categorize(f, f.where("error is not null").select("id"), 3, True).select("id", "category")


# ---- duplicates -------------------------------------------------------------------------------------------

_STACK_KEY = "coalesce(nullif(lower(trim(sha256)), ''), 'md5:' || nullif(lower(trim(md5)), ''))"
_STACKS_SQL = f"(SELECT id, min(id) OVER (PARTITION BY k) AS stack_id FROM (SELECT id, {_STACK_KEY} AS k FROM files) WHERE k IS NOT NULL)"


@query(f"SELECT id, stack_id FROM {_STACKS_SQL}")
def stack_exact(spark: SparkSession, root: str) -> DataFrame:
    return dedupe.stack_exact(_files(spark, root))


@query(f"SELECT count(*) AS stacks, sum(n - 1) AS redundant FROM (SELECT count(*) AS n FROM files WHERE {_STACK_KEY} IS NOT NULL GROUP BY {_STACK_KEY})")
def redundant_count(spark: SparkSession, root: str) -> DataFrame:
    return dedupe.redundant(_files(spark, root))


_HASHED = """h AS (SELECT * FROM (SELECT id, CASE WHEN regexp_full_match(phash, '[0-9a-fA-F]{16}') THEN CAST('0x' || phash AS UBIGINT) END AS p,
 CASE WHEN regexp_full_match(dhash, '[0-9a-fA-F]{16}') THEN CAST('0x' || dhash AS UBIGINT) END AS d FROM files WHERE stack_id IS NULL OR stack_id = id) WHERE bit_count(p) BETWEEN 12 AND 52)"""


@query(f"""WITH {_HASHED} SELECT b AS band, CAST((p >> (56 - 8 * b)) & 255 AS BIGINT) AS value, count(*) AS n FROM h, range(8) t(b) GROUP BY 1, 2""")
def band_candidates(spark: SparkSession, root: str) -> DataFrame:
    return dedupe.band_buckets(dedupe.comparable(_files(spark, root))).select(F.col("band").cast("long").alias("band"), "value", "n")


def _pairs_sql(t: int) -> str:
    return f"""{_HASHED}, u AS (SELECT p, d, min(id) AS id FROM h GROUP BY p, d),
pairs AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.id < y.id AND bit_count(xor(x.p, y.p)) <= {t} AND coalesce(bit_count(xor(x.d, y.d)) <= {t + 2}, true)
 UNION ALL SELECT u.id, h.id FROM u JOIN h ON h.p = u.p AND h.d IS NOT DISTINCT FROM u.d WHERE u.id < h.id)"""


for _t in (6, 8, 12):
    query(f"WITH {_pairs_sql(_t)} SELECT a, b FROM pairs", f"near_pairs_{_t}")(lambda spark, root, t=_t: dedupe.near_pairs(dedupe.comparable(_files(spark, root)), t))


def _groups_sql(t: int) -> str:
    return f"""WITH RECURSIVE {_pairs_sql(t)}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other),
lab AS (SELECT id, min(other) AS group_id FROM reach GROUP BY id)
SELECT f.id, lab.group_id FROM files f JOIN lab ON lab.id = coalesce(f.stack_id, f.id)"""


for _name, _t in (("stack_visual", 6), ("cluster_near", 12)):
    query(_groups_sql(_t), _name)(lambda spark, root, t=_t: dedupe.groups(_files(spark, root), t))


@query("SELECT vstack_id, count(*) AS n FROM files WHERE vstack_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, vstack_id LIMIT 200")
def clusters_top200(spark: SparkSession, root: str) -> DataFrame:
    return reports.largest_groups(_files(spark, root))


# ---- known hashes -----------------------------------------------------------------------------------------

_FITS = "regexp_full_match({v}, '[0-9a-f]+') AND length({v}) = CASE {a} WHEN 'md5' THEN 32 WHEN 'sha1' THEN 40 WHEN 'sha256' THEN 64 WHEN 'phash' THEN 16 END AND {v} NOT IN ('" + "', '".join(S.EMPTY_HASHES.values()) + "')"
_STORABLE = "CASE WHEN {a} = 'photodna' THEN nullif(regexp_replace({r}, '^\\s+|\\s+$', '', 'g'), '') WHEN " + _FITS.format(v="lower(regexp_replace({r}, '^\\s+|\\s+$', '', 'g'))", a="{a}") + " THEN lower(regexp_replace({r}, '^\\s+|\\s+$', '', 'g')) END"
_ENTRIES = f"""n AS (SELECT hashset_id, algo, value, arg_min({{'category': category, 'media_id': media_id, 'added_at': added_at}}, o) AS f FROM (
 SELECT hashset_id, lower(trim(algo)) AS algo, {_STORABLE.format(a='lower(trim(algo))', r='value')} AS value, category, media_id, added_at,
  row(added_at IS NULL, added_at, coalesce(media_id, -1), coalesce(category, -1)) AS o FROM hashset_entries) WHERE value IS NOT NULL GROUP BY 1, 2, 3)"""
_MD5 = _STORABLE.format(a="'md5'", r="md5")
_STASH = f"""st AS (SELECT k AS md5, min(category) AS category FROM (SELECT {_MD5} AS k, category FROM stash WHERE region = 'US') WHERE k IS NOT NULL GROUP BY 1)"""
_HITS = f"""{_ENTRIES}, {_STASH}, own AS (SELECT * FROM (
 SELECT id, 'sha256' AS algo, {_STORABLE.format(a="'sha256'", r='sha256')} AS value, 0 AS ao FROM files UNION ALL
 SELECT id, 'sha1', {_STORABLE.format(a="'sha1'", r='sha1')}, 1 FROM files UNION ALL SELECT id, 'md5', {_MD5}, 2 FROM files) WHERE value IS NOT NULL),
raw AS (SELECT o.id, s.name, coalesce(s.kind, 'other') AS kind, CAST(n.f.category AS INT) AS category, o.algo AS via,
 CASE WHEN s.vic = 1 THEN 'vic' WHEN s.kind = 'known-good' THEN 'good' ELSE 'other' END AS src, n.f.media_id AS media_id, o.ao, s.id AS hs
 FROM own o JOIN n ON n.algo = o.algo AND n.value = o.value JOIN hashsets s ON s.id = n.hashset_id
 UNION ALL SELECT o.id, '{hashsets.STASH_NAME}', 'known', CAST(st.category AS INT), 'md5-stash', 'stash', NULL, o.ao, 2147483647 FROM own o JOIN st ON o.algo = 'md5' AND st.md5 = o.value),
hits AS (SELECT id, name, kind, category, via, src, media_id, ao, hs FROM (SELECT *, row_number() OVER (PARTITION BY id, name ORDER BY ao, hs, kind, coalesce(category, -1), via, src, coalesce(media_id, -1)) AS rn FROM raw) WHERE rn = 1)"""
_ORDER = "CASE src WHEN 'vic' THEN 0 WHEN 'stash' THEN 1 WHEN 'other' THEN 2 ELSE 3 END"
_SUMMARY = f"""{_HITS}, summ AS (SELECT id, arg_min(name, row({_ORDER}, ao, hs, name)) AS top, arg_min(kind, row({_ORDER}, ao, hs, name)) AS top_kind,
 bit_or(CASE src WHEN 'vic' THEN 1 WHEN 'stash' THEN 2 WHEN 'other' THEN 4 ELSE 8 END) AS mask,
 arg_min(category, CASE WHEN category = 0 THEN 1000000 ELSE category END) FILTER (WHERE kind = 'known' AND category IS NOT NULL AND category <> 5) AS asserted, count(*) AS n_sets FROM hits GROUP BY id)"""


def _hits(spark: SparkSession, root: str) -> DataFrame:
    return hashsets.hits(_files(spark, root), table(spark, root, "hashsets"), table(spark, root, "hashset_entries"), table(spark, root, "stash"))


@query(f"WITH {_ENTRIES} SELECT hashset_id, algo, value, f.category AS category, f.media_id AS media_id FROM n")
def hash_entries_normalised(spark: SparkSession, root: str) -> DataFrame:
    return hashsets.normalised(table(spark, root, "hashset_entries")).select("hashset_id", "algo", "value", "category", "media_id")


@query(f"""SELECT a AS algo, count(*) AS read, count(v) AS kept, count(*) FILTER (WHERE v IS NULL AND NOT coalesce(e, false)) AS skipped, count(*) FILTER (WHERE e) AS empty
FROM (SELECT lower(trim(algo)) AS a, {_STORABLE.format(a='lower(trim(algo))', r='value')} AS v, lower(trim(value)) IN ('{"', '".join(S.EMPTY_HASHES.values())}') AS e FROM hashset_entries) GROUP BY 1""")
def list_counts(spark: SparkSession, root: str) -> DataFrame:
    return hashsets.list_counts(table(spark, root, "hashset_entries"))


@query(f"WITH {_HITS} SELECT id, name, kind, category, via, src, media_id FROM hits")
def match_all_hits(spark: SparkSession, root: str) -> DataFrame:
    return _hits(spark, root).drop("algo_order", "hashset_id")


@query(f"WITH {_SUMMARY} SELECT id, top, top_kind, mask, asserted, n_sets FROM summ")
def match_summary(spark: SparkSession, root: str) -> DataFrame:
    return hashsets.summary(_hits(spark, root))


@query(f"WITH {_SUMMARY} SELECT id FROM summ WHERE (mask & 3) = 3")
def hashset_both_bits(spark: SparkSession, root: str) -> DataFrame:
    return hashsets.summary(_hits(spark, root)).where(F.col("mask").bitwiseAND(3) == 3).select("id")


@query(f"WITH {_SUMMARY} SELECT f.id FROM files f LEFT JOIN summ s ON s.id = f.id WHERE s.top_kind IS NULL OR s.top_kind <> 'known-good'")
def hide_known_good(spark: SparkSession, root: str) -> DataFrame:
    s = hashsets.summary(_hits(spark, root)).where("top_kind = 'known-good'")
    return _files(spark, root).select("id").join(s, "id", "left_anti")


@query(f"""WITH {_SUMMARY} SELECT f.id, CAST(CASE WHEN coalesce(f.category, 5) = 5 AND s.asserted IS NOT NULL THEN s.asserted WHEN coalesce(f.category, 5) = 5 AND s.mask = 8 THEN 0 ELSE coalesce(f.category, 5) END AS INT) AS category,
 s.top AS hashset_hit, s.top_kind AS hashset_kind, coalesce(s.mask, 0) AS hashset_mask FROM files f LEFT JOIN summ s ON s.id = f.id""")
def rematch_apply(spark: SparkSession, root: str) -> DataFrame:
    return hashsets.rematched(_files(spark, root), _hits(spark, root))


@query(f"""WITH {_SUMMARY} SELECT id, string_agg(name || ' (' || via || ')', '; ' ORDER BY {_ORDER}, ao, hs, name) AS sources FROM hits GROUP BY id""")
def sources_text(spark: SparkSession, root: str) -> DataFrame:
    return hashsets.sources_text(_hits(spark, root))


@query(f"""WITH {_HITS} SELECT id, bit_or(CASE src WHEN 'vic' THEN 1 WHEN 'stash' THEN 2 WHEN 'other' THEN 4 ELSE 8 END) AS mask, count(*) AS n_sets FROM hits WHERE name <> '{hashsets.STASH_NAME}' GROUP BY id""")
def drop_source(spark: SparkSession, root: str) -> DataFrame:
    return hashsets.summary(hashsets.without_set(_hits(spark, root), hashsets.STASH_NAME)).select("id", "mask", "n_sets")


@query(f"""WITH {_HITS}, c AS (SELECT hashset_id, count(*) AS stored FROM n GROUP BY 1), m AS (SELECT name, count(DISTINCT id) AS fm FROM hits GROUP BY 1)
SELECT s.id, s.name, s.kind, s.entry_count AS stated, coalesce(c.stored, 0) AS stored, coalesce(m.fm, 0) AS files_matched,
 CASE WHEN coalesce(c.stored, 0) = 0 THEN 'empty' WHEN coalesce(c.stored, 0) < s.entry_count THEN 'incomplete' ELSE 'complete' END AS status
FROM hashsets s LEFT JOIN c ON c.hashset_id = s.id LEFT JOIN m ON m.name = s.name""")
def hashset_listing(spark: SparkSession, root: str) -> DataFrame:
    return hashsets.listing(table(spark, root, "hashsets"), table(spark, root, "hashset_entries"), _hits(spark, root))


@query(f"WITH {_ENTRIES} SELECT hashset_id, " + ", ".join(f"count(*) FILTER (WHERE algo = '{a}') AS {a}" for a in ("md5", "sha1", "sha256", "phash", "photodna")) + " FROM n GROUP BY 1")
def algo_counts(spark: SparkSession, root: str) -> DataFrame:
    return hashsets.algo_counts(table(spark, root, "hashset_entries"))


_MORE_STASH = "(SELECT md5, region, category, added_at, source FROM stash UNION ALL SELECT md5, 'US', 2, 2e9, 'case' FROM files WHERE id % 7 = 0)"


@query(f"""SELECT k AS md5, region, min(category) AS category, arg_min(source, row(added_at, source)) FILTER (WHERE source IS NOT NULL) AS source FROM (SELECT {_MD5} AS k, * FROM {_MORE_STASH}) WHERE k IS NOT NULL GROUP BY 1, 2""")
def stash_upsert(spark: SparkSession, root: str) -> DataFrame:
    """The stash after the hashes of every seventh file were added to it."""
    more = _files(spark, root).where("id % 7 = 0").select("md5", F.lit("US").alias("region"), F.lit(2).alias("category"), F.lit(2e9).alias("added_at"), F.lit("case").alias("source"))
    return hashsets.upsert_stash(table(spark, root, "stash"), more).select("md5", "region", "category", "source")


@query(f"""SELECT region, category, count(DISTINCT k) AS entries, max(added_at) AS newest FROM (SELECT {_MD5} AS k, * FROM stash) WHERE k IS NOT NULL GROUP BY 1, 2""")
def stash_summary(spark: SparkSession, root: str) -> DataFrame:
    return hashsets.stash_summary(table(spark, root, "stash"))


@query("""WITH l AS (SELECT DISTINCT lower(trim(phash)) AS value, CAST('0x' || lower(trim(phash)) AS UBIGINT) AS h FROM files WHERE id % 10 = 0 AND regexp_full_match(lower(trim(phash)), '[0-9a-f]{16}')),
f AS (SELECT id, CAST('0x' || lower(trim(phash)) AS UBIGINT) AS h FROM files WHERE regexp_full_match(lower(trim(phash)), '[0-9a-f]{16}')),
m AS (SELECT f.id, l.value, CAST(bit_count(xor(f.h, l.h)) AS INT) AS distance FROM f, l WHERE bit_count(xor(f.h, l.h)) <= 6)
SELECT id, value, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, value) AS rn FROM m) WHERE rn = 1""")
def phash_nearest_entry(spark: SparkSession, root: str) -> DataFrame:
    """The nearest of a list of perceptual hashes; those of every tenth file stand in for the list."""
    listed = _files(spark, root).where("id % 10 = 0").select(F.lit(1).alias("hashset_id"), F.lit("phash").alias("algo"), F.col("phash").alias("value"), F.lit(None).cast("int").alias("category"), F.col("id").alias("media_id"), F.lit(None).cast("timestamp").alias("added_at"))
    return hashsets.nearest_listed(_files(spark, root), listed)


# ---- similarity -------------------------------------------------------------------------------------------

_BITS = "CASE WHEN regexp_full_match({0}, '[0-9a-fA-F]{{16}}') THEN CAST('0x' || {0} AS UBIGINT) END"


@query(f"""WITH own AS (SELECT id, {_BITS.format('phash')} AS p, {_BITS.format('dhash')} AS d FROM files),
kf AS (SELECT file_id AS id, {_BITS.format('phash')} AS p FROM keyframes), frames AS (SELECT * FROM kf WHERE bit_count(p) BETWEEN 12 AND 52),
probes AS (SELECT DISTINCT id AS query, p AS qp, d AS qd FROM (SELECT id, p, d FROM own WHERE id % 100 = 0 AND bit_count(p) BETWEEN 12 AND 52
 UNION ALL SELECT f.id, f.p, o.d FROM frames f JOIN own o ON o.id = f.id WHERE o.id % 100 = 0)),
met AS (SELECT q.query, o.id, bit_count(xor(o.p, q.qp)) AS dist FROM own o, probes q WHERE o.id <> q.query AND bit_count(o.p) BETWEEN 12 AND 52 AND bit_count(xor(o.p, q.qp)) <= 12 AND coalesce(bit_count(xor(o.d, q.qd)) <= 14, true)
 UNION ALL SELECT q.query, f.id, bit_count(xor(f.p, q.qp)) FROM frames f, probes q WHERE f.id <> q.query AND bit_count(xor(f.p, q.qp)) <= 12),
best AS (SELECT query, id, CAST(min(dist) AS INT) AS distance FROM met GROUP BY 1, 2)
SELECT query, id, distance, rank, round_even(100.0 * (1 - distance / 64.0), 1) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM best) WHERE rank <= 199""")
def find_similar(spark: SparkSession, root: str) -> DataFrame:
    f = _files(spark, root)
    return similarity.similar_files(f, table(spark, root, "keyframes"), _each_hundredth(f))


def _cosine_sql(source: str, id: str, size: int, least: float, limit: int) -> str:
    return f"""WITH v AS (SELECT {id} AS id, CAST(embedding AS DOUBLE[]) AS e FROM {source} WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
m AS (SELECT q.id AS query, v.id, list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))) AS c FROM v, v q WHERE q.id % 100 = 0 AND v.id <> q.id),
k AS (SELECT * FROM m WHERE c >= {least})
SELECT query, id, round_even(100 * c, 1) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank FROM k) WHERE rank <= {limit}"""


@query(_cosine_sql("faces", "id", 128, 0.363, 200))
def face_match(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "faces")
    return similarity.similar_vectors(f, _each_hundredth(f), 0.363, 200, size=128)


@query(_cosine_sql("embeddings", "vec_id", 64, 0.2, 50))
def content_match(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "embeddings")
    return similarity.similar_vectors(v, _each_hundredth(v, "vec_id"), 0.2, 50, id="vec_id", size=64)


@query("""SELECT min(id) AS id FROM files WHERE kind IN ('image', 'video') AND greatest(width, height) >= 128 GROUP BY coalesce(stack_id, id)
EXCEPT SELECT file_id FROM faces""")
def content_todo(spark: SparkSession, root: str) -> DataFrame:
    heads = _files(spark, root).where("kind in ('image', 'video') and greatest(width, height) >= 128").groupBy(F.coalesce("stack_id", "id").alias("g")).agg(F.min("id").alias("id"))
    return heads.select("id").join(table(spark, root, "faces").where("file_id is not null").select(F.col("file_id").alias("id")), "id", "left_anti")


@query(f"""WITH p AS (SELECT id, f FROM (SELECT id, unnest([{_BITS.format('phash')}, {_BITS.format('dhash')}]) AS f FROM files) WHERE f IS NOT NULL),
b AS (SELECT q.id AS query, p.id, CAST(min(bit_count(xor(p.f, q.f))) AS INT) AS distance FROM p, p q WHERE q.id % 100 = 0 AND p.id <> q.id AND bit_count(xor(p.f, q.f)) <= 20 GROUP BY 1, 2)
SELECT query, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM b) WHERE rank <= 150""")
def fingerprint_shortlist(spark: SparkSession, root: str) -> DataFrame:
    f = _files(spark, root)
    return similarity.fingerprint_shortlist(f, _each_hundredth(f))


@query("""WITH w AS (SELECT DISTINCT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM documents WHERE text IS NOT NULL),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents WHERE text IS NOT NULL), r AS (SELECT word, ln((SELECT n FROM n) / count(*)) AS idf FROM w GROUP BY word),
s AS (SELECT id, count(*) AS words FROM w GROUP BY id),
m AS (SELECT q.id AS query, w.id, sum(r.idf) AS total FROM w q JOIN r ON r.word = q.word AND r.idf > 0 JOIN w ON w.word = q.word WHERE w.id <> q.id GROUP BY 1, 2),
k AS (SELECT m.query, m.id, round(m.total / sqrt(s.words), 6) AS score FROM m JOIN s ON s.id = m.id)
SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM k) WHERE rank <= 150""")
def word_shortlist(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    return similarity.word_overlap(d, d.select("doc_id"))


# ---- statistics and reports -------------------------------------------------------------------------------

_PLACED = "gps_lat IS NOT NULL AND gps_lon IS NOT NULL AND NOT isnan(gps_lat) AND NOT isnan(gps_lon) AND abs(gps_lat) <= 90 AND abs(gps_lon) <= 180 AND NOT (gps_lat = 0 AND gps_lon = 0)"


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE kind = 'image') AS images, count(*) FILTER (WHERE kind = 'video') AS videos, count(*) FILTER (WHERE kind NOT IN ('image', 'video')) AS others,
 count(*) FILTER (WHERE reviewed = 1) AS reviewed, count(error) AS with_error, count(*) FILTER (WHERE {_PLACED}) AS located, count(DISTINCT source) AS sources, count(DISTINCT vstack_id) AS vstacks,
 count(stack_id) - count(DISTINCT stack_id) AS dupes, count(DISTINCT stack_id) AS stacks FROM files""")
def case_stats(spark: SparkSession, root: str) -> DataFrame:
    return reports.case_stats(_files(spark, root))


for _c in ("kind", "category", "source"):
    query(f"SELECT CAST({_c} AS VARCHAR) AS {_c}, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM files GROUP BY {_c}", f"report_summary_{_c}")(lambda spark, root, c=_c: reports.by_column(_files(spark, root), c))


@query("SELECT source, count(*) FILTER (WHERE origin = 'walk') AS walk, count(*) FILTER (WHERE origin = 'deleted') AS deleted, count(*) FILTER (WHERE origin = 'carve') AS carve, count(*) FILTER (WHERE origin IS NULL OR origin NOT IN ('walk', 'deleted', 'carve')) AS other FROM files GROUP BY 1")
def origin_counts(spark: SparkSession, root: str) -> DataFrame:
    return reports.origins(_files(spark, root))


@query("SELECT DISTINCT md5 FROM files WHERE md5 IS NOT NULL AND trim(md5) <> ''")
def export_md5(spark: SparkSession, root: str) -> DataFrame:
    return reports.md5_list(_files(spark, root))


_CSV_SQL = ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" if c in ("duration", "gps_lat", "gps_lon") else c for c in reports.CSV_FIELDS)


@query(f"SELECT {_CSV_SQL} FROM files")
def export_csv_rows(spark: SparkSession, root: str) -> DataFrame:
    return reports.exported(_files(spark, root))


_SIZE_TEXT = "CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0) WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0) WHEN size IS NOT NULL THEN printf('%.1f GB', size / 1073741824.0) END"
_SECONDS = "CAST(floor(coalesce(duration, 0)) AS BIGINT)"


@query(f"""SELECT id, split_part(replace(rel_path, chr(92), '/'), '/', -1) AS name, source, kind, {_SIZE_TEXT} AS size_text, CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN width || ' x ' || height ELSE '' END AS dimensions,
 CASE WHEN {_SECONDS} <= 0 THEN '' WHEN {_SECONDS} >= 3600 THEN printf('%d:%02d:%02d', {_SECONDS} // 3600, {_SECONDS} // 60 % 60, {_SECONDS} % 60) ELSE printf('%d:%02d', {_SECONDS} // 60, {_SECONDS} % 60) END AS duration_text FROM files""")
def artifact_media_files(spark: SparkSession, root: str) -> DataFrame:
    return reports.media_files(_files(spark, root))


@query("SELECT id, rel_path, category FROM files WHERE category IS NOT NULL AND category <> 5")
def artifact_categorized(spark: SparkSession, root: str) -> DataFrame:
    return gallery.scope(_files(spark, root), "categorized").select("id", "rel_path", "category")


@query(f"SELECT id, rel_path, gps_lat, gps_lon FROM files WHERE {_PLACED}")
def artifact_locations(spark: SparkSession, root: str) -> DataFrame:
    return reports.located(_files(spark, root)).select("id", "rel_path", "gps_lat", "gps_lon")


@query(f"SELECT floor(gps_lat / 10) * 10.0 AS cell_lat, floor(gps_lon / 10) * 10.0 AS cell_lon, count(*) AS n FROM files WHERE {_PLACED} GROUP BY 1, 2")
def artifact_location_overview(spark: SparkSession, root: str) -> DataFrame:
    return reports.area_overview(_files(spark, root))


_TS = "CAST(floor(greatest(coalesce(k.ts, 0), 0)) AS BIGINT)"


@query(f"""SELECT k.id AS frame_id, k.file_id, printf('%d:%02d:%02d', {_TS} // 3600, {_TS} // 60 % 60, {_TS} % 60) AS "offset", f.rel_path FROM keyframes k JOIN files f ON f.id = k.file_id""")
def artifact_keyframes(spark: SparkSession, root: str) -> DataFrame:
    return reports.key_frames(_files(spark, root), table(spark, root, "keyframes"))


@query(f"""SELECT s.stack_id, count(*) AS copies, count(DISTINCT f.rel_path) AS paths, count(DISTINCT f.source) AS sources, max(f.size) AS bytes, sum(f.size) AS all_bytes FROM files f JOIN {_STACKS_SQL} s ON s.id = f.id GROUP BY 1 HAVING count(*) > 1""")
def artifact_duplicates(spark: SparkSession, root: str) -> DataFrame:
    f = _files(spark, root)
    return reports.duplicate_stacks(f, dedupe.stack_exact(f))


@query("SELECT vstack_id AS group_id, count(*) AS files, count(DISTINCT md5) AS distinct_md5, count(DISTINCT source) AS sources, sum(size) AS bytes FROM files WHERE vstack_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def artifact_similar(spark: SparkSession, root: str) -> DataFrame:
    return reports.groups_report(_files(spark, root), "vstack_id")


@query(f"WITH {_HITS} SELECT f.id, f.rel_path, h.name, h.via, h.category FROM files f JOIN hits h ON h.id = f.id")
def artifact_hashset_hits(spark: SparkSession, root: str) -> DataFrame:
    return _hits(spark, root).select("id", "name", "via", "category").join(_files(spark, root).select("id", "rel_path"), "id")


@query(f"WITH {_HITS} SELECT id, name, media_id FROM hits WHERE src = 'vic' AND media_id IS NOT NULL")
def artifact_vic_matches(spark: SparkSession, root: str) -> DataFrame:
    return _hits(spark, root).where("src = 'vic' and media_id is not null").select("id", "name", "media_id")


@query("SELECT c.code, c.label, coalesce(n.n, 0) AS n FROM (VALUES (0, 'Non-pertinent'), (1, 'One'), (2, 'Two'), (3, 'Three'), (4, 'Four'), (5, 'Uncategorized')) c(code, label) LEFT JOIN (SELECT category, count(*) AS n FROM files GROUP BY 1) n ON n.category = c.code")
def category_definitions(spark: SparkSession, root: str) -> DataFrame:
    codes = spark.createDataFrame([(0, "Non-pertinent"), (1, "One"), (2, "Two"), (3, "Three"), (4, "Four"), (5, "Uncategorized")], "code int, label string")
    n = _files(spark, root).groupBy(F.col("category").alias("code")).agg(F.count("*").alias("n"))
    return codes.join(n, "code", "left").select("code", "label", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_newest(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", "event_type")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20")
def snapshot_retention(spark: SparkSession, root: str) -> DataFrame:
    return gallery.newest(table(spark, root, "events"), "user_id", ["ts", "event_id"], 20).select("event_id")


@query("SELECT file_id, id FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts ASC NULLS FIRST, id) AS r, count(*) OVER (PARTITION BY file_id) AS n FROM keyframes WHERE file_id IS NOT NULL) WHERE r = n // 2 + 1")
def middle_keyframe(spark: SparkSession, root: str) -> DataFrame:
    return dedupe.middle_of(table(spark, root, "keyframes").where("file_id is not null"), "file_id", "ts", "id").select("file_id", "id")


# ---- intervals, merges, paths -----------------------------------------------------------------------------

_SPANS = "(SELECT l_orderkey AS k, CAST(floor(l_extendedprice) AS BIGINT) AS s, CAST(floor(l_extendedprice) AS BIGINT) + CAST(l_quantity * 200 AS BIGINT) AS e FROM lineitem)"


def _spans(spark: SparkSession, root: str) -> DataFrame:
    start = F.floor("l_extendedprice").cast("long")
    return table(spark, root, "lineitem").select(F.col("l_orderkey").alias("k"), start.alias("start"), (start + (F.col("l_quantity") * 200).cast("long")).alias("end"))


@query(f"""WITH w AS (SELECT o_orderkey AS k, 0 AS w0, 100000 AS w1 FROM orders), p AS (SELECT w.k, w0, w1, greatest(s, w0) AS p0, least(e, w1) AS p1 FROM w JOIN {_SPANS} x ON x.k = w.k WHERE greatest(s, w0) < least(e, w1)
 UNION ALL SELECT k, w0, w1, w1, w1 FROM w),
c AS (SELECT k, p0, coalesce(max(p1) OVER (PARTITION BY k ORDER BY p0, p1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w0) AS covered FROM p)
SELECT k, CAST(covered AS BIGINT) AS "start", CAST(p0 AS BIGINT) AS "end" FROM c WHERE p0 > covered""")
def unclaimed_intervals(spark: SparkSession, root: str) -> DataFrame:
    whole = table(spark, root, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).cast("long").alias("start"), F.lit(100000).cast("long").alias("end"))
    return intervals.unclaimed(_spans(spark, root), whole, "k")


@query(f"""WITH m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {_SPANS}),
n AS (SELECT *, CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END AS b FROM m), g AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT k, CAST(run AS BIGINT) AS run, min(s) AS "start", max(e) AS "end", count(*) AS pieces FROM g GROUP BY 1, 2""")
def piece_spans(spark: SparkSession, root: str) -> DataFrame:
    return intervals.joined_runs(_spans(spark, root), "k")


@query("""SELECT rel_path, CASE WHEN ingested_at > 1.68e9 THEN 'missing' WHEN size > 5000000 THEN 'size' END AS problem FROM files WHERE ingested_at > 1.68e9 OR size > 5000000""")
def relink_problems(spark: SparkSession, root: str) -> DataFrame:
    """A listing made without the late files, on which large files have grown by a byte."""
    f = _files(spark, root)
    listed = f.where("not (ingested_at > 1.68e9)").select(F.col("path"), F.when(F.col("size") > 5000000, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "md5")
    paths = f.select(F.col("path").alias("rel_path"), "size", "md5")
    found = updates.relink_problems(paths, listed.withColumnRenamed("path", "rel_path"))
    return found.join(f.select(F.col("path").alias("rel_path"), F.col("rel_path").alias("shown")), "rel_path").select(F.col("shown").alias("rel_path"), "problem")


@query("""WITH e AS (SELECT source, min(path) AS a, max(path) AS b FROM files WHERE path IS NOT NULL GROUP BY 1), s AS (SELECT source, string_split(a, '/') AS x, string_split(b, '/') AS y FROM e),
n AS (SELECT source, x, coalesce(list_min(list_filter(range(1, len(x) + 1), lambda i: x[i] IS DISTINCT FROM y[i])) - 1, len(x)) AS same FROM s)
SELECT source, array_to_string(x[1:least(same, len(x) - 1)], '/') AS root FROM n""")
def folder_root(spark: SparkSession, root: str) -> DataFrame:
    return updates.folder_root(_files(spark, root))


@query("""SELECT CAST(f.id AS BIGINT) AS id, f.path, CASE WHEN f.reviewed = 1 THEN f.size + 1 ELSE f.size END AS size, f.kind FROM files f
UNION ALL SELECT NULL, path || '.new', id, NULL FROM files WHERE id % 50 = 0""")
def upsert_files(spark: SparkSession, root: str) -> DataFrame:
    """Reviewed files get a new size, and new paths are added; the ids of new rows are shown as null once they are known to be fresh."""
    f = _files(spark, root).select("id", "path", "size", "kind")
    changes = _files(spark, root).where("reviewed = 1").select("path", (F.col("size") + 1).alias("size")).unionByName(f.where("id % 50 = 0").select(F.concat("path", F.lit(".new")).alias("path"), F.col("id").alias("size")))
    top = f.agg(F.max("id").alias("top"))
    return updates.upsert(f, changes).crossJoin(top).select(F.when(F.col("id") <= F.col("top"), F.col("id")).alias("id"), "path", "size", "kind")


def _same(lat: Column, lon: Column) -> Column:
    """Whether coordinates that were written and read again are those of the row."""
    return (F.coalesce(F.abs(lat - F.col("gps_lat")) < 2e-6, F.lit(False)) & F.coalesce(F.abs(lon - F.col("gps_lon")) < 2e-6, F.lit(False))).alias("same")


# ---- scalar functions over whole tables -------------------------------------------------------------------


@query(f"""SELECT id, CASE WHEN lower(ext) IN ({', '.join(f"'{x}'" for x in S.IMAGE_EXTS)}) THEN 'image' WHEN lower(ext) IN ({', '.join(f"'{x}'" for x in S.VIDEO_EXTS)}) THEN 'video' WHEN lower(ext) IN ({', '.join(f"'{x}'" for x in S.ARCHIVE_EXTS)}) THEN 'archive' ELSE 'other' END AS by_ext FROM files""")
def kind_by_ext(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root).select("id", S.kind_of_ext("ext").alias("by_ext"))


@query("""SELECT hashset_id, value, CASE WHEN regexp_full_match(trim(value), '[0-9a-fA-F]+') THEN CASE length(trim(value)) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' WHEN 64 THEN 'sha256' END END AS by_length FROM hashset_entries""")
def algo_by_length(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "hashset_entries").select("hashset_id", "value", S.algorithm_of(F.col("value")).alias("by_length"))


@query(f"SELECT id, true AS same FROM files WHERE {_PLACED}")
def coords_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Coordinates written as degrees and decimal minutes with a letter, and read again."""
    f = reports.located(_files(spark, root))

    def written(c: str, plus: str, minus: str):
        a = F.abs(c)
        return F.concat(F.floor(a).cast("string"), F.lit(","), F.format_string("%.6f", (a - F.floor(a)) * 60), F.when(F.col(c) < 0, minus).otherwise(plus))

    return f.select("id", _same(S.xmp_degrees(written("gps_lat", "N", "S")), S.xmp_degrees(written("gps_lon", "E", "W"))))


@query(f"SELECT id, true AS same FROM files WHERE {_PLACED}")
def coords_iso6709(spark: SparkSession, root: str) -> DataFrame:
    f = reports.located(_files(spark, root))
    text = F.concat(F.format_string("%+010.6f", "gps_lat"), F.format_string("%+011.6f", "gps_lon"), F.lit("/"))
    return f.select("id", _same(S.iso6709(text, 1), S.iso6709(text, 2)))


@query(f"""SELECT id, round((gps_lon + 180) / 360 * 65536, 3) AS px, round((0.5 - ln((1 + sin(radians(least(greatest(gps_lat, -85.05112878), 85.05112878)))) / (1 - sin(radians(least(greatest(gps_lat, -85.05112878), 85.05112878))))) / (4 * pi())) * 65536, 3) AS py FROM files WHERE {_PLACED}""")
def mercator_px(spark: SparkSession, root: str) -> DataFrame:
    return reports.located(_files(spark, root)).select("id", F.round(S.world_x(F.col("gps_lon"), 8), 3).alias("px"), F.round(S.world_y(F.col("gps_lat"), 8), 3).alias("py"))


@query()
def tile_ids(spark: SparkSession, root: str) -> DataFrame:
    f = reports.located(_files(spark, root))
    x = F.least(F.floor(S.world_x(F.col("gps_lon"), 8) / 256), F.lit(255))
    y = F.least(F.greatest(F.floor(S.world_y(F.col("gps_lat"), 8) / 256), F.lit(0)), F.lit(255))
    return f.select("id", S.tile_id(8, x, y).alias("tile"))


@query("""SELECT id, md5(rel_path) AS md5, sha1(rel_path) AS sha1, sha256(rel_path) AS sha256 FROM files""")
def crypto_hashes(spark: SparkSession, root: str) -> DataFrame:
    b = F.encode("rel_path", "utf-8")
    return _files(spark, root).select("id", F.md5(b).alias("md5"), F.sha1(b).alias("sha1"), F.sha2(b, 256).alias("sha256"))


@query("""WITH e AS (SELECT 'x/data/media/0/' || rel_path AS p, size AS s, rel_path, id, 1 AS r FROM files WHERE id % 3 = 0 UNION ALL SELECT 'x/sdcard/' || rel_path, CASE WHEN id % 5 = 0 THEN size + 1 ELSE size END, rel_path, id, 2 FROM files WHERE id % 6 = 0
 UNION ALL SELECT 'data/user/10/' || rel_path, size, rel_path, id, 1 FROM files WHERE id % 4 = 0 UNION ALL SELECT 'data_mirror/data_ce/null/10/' || rel_path, size, rel_path, id, 2 FROM files WHERE id % 8 = 0),
g AS (SELECT split_part(p, '/', 1) = 'x' AS m, rel_path, arg_min(p, row(r, p)) AS kept, count(DISTINCT p) AS spellings, count(DISTINCT s) + max(CAST(s IS NULL AS INT)) = 1 AS agree FROM e GROUP BY 1, 2)
SELECT kept, spellings, agree FROM g WHERE spellings > 1""")
def storage_view_plan(spark: SparkSession, root: str) -> DataFrame:
    """Files laid out under spellings of the same storage, some copies with another size, and which spelling is kept."""
    f = _files(spark, root)
    under = lambda prefix, of, size: f.where(F.col("id") % of == 0).select(F.concat(F.lit(prefix), "rel_path").alias("path"), size.alias("size"))
    grown = F.when(F.col("id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size"))
    spelled = under("x/data/media/0/", 3, F.col("size")).unionByName(under("x/sdcard/", 6, grown)).unionByName(under("data/user/10/", 4, F.col("size"))).unionByName(under("data_mirror/data_ce/null/10/", 8, F.col("size")))
    return updates.collapse_views(spelled)


# ---- exports and streams ----------------------------------------------------------------------------------


@query()
def vic_index(spark: SparkSession, root: str) -> DataFrame:
    return media.vic_index(table(spark, root, "vic_raw"))


@query()
def vic_export_join(spark: SparkSession, root: str) -> DataFrame:
    """The chunks' media with the category the catalog gives them by content."""
    decided = _files(spark, root).select(F.lit(None).cast("long").alias("media_id"), "md5", "category", F.col("error").alias("comments"))
    return sinks.vic_export(media.vic_index(table(spark, root, "vic_raw")), decided)


@query()
def export_placemarks(spark: SparkSession, root: str) -> DataFrame:
    return sinks.placemarks(_files(spark, root))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_activity(spark: SparkSession, root: str) -> DataFrame:
    return ingest.activity(table(spark, root, "events"))


# ---- further reports --------------------------------------------------------------------------------------


@query(f"""WITH m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM (SELECT k, s - min(s) OVER (PARTITION BY k) AS s, e - min(s) OVER (PARTITION BY k) AS e FROM {_SPANS})),
n AS (SELECT *, CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END AS b FROM m), g AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM n),
runs AS (SELECT k, run, max(e) AS e, count(*) AS pieces FROM g GROUP BY 1, 2)
SELECT k, arg_min(e, run) AS reach, arg_min(pieces, run) AS pieces, CASE WHEN count(*) > 1 THEN 'gap' ELSE 'complete' END AS state FROM runs GROUP BY 1""")
def piece_reach(spark: SparkSession, root: str) -> DataFrame:
    """How far each item's pieces reach from its first one without a gap."""
    spans = _spans(spark, root)
    first = spans.groupBy("k").agg(F.min("start").alias("s0"))
    moved = spans.join(first, "k").select("k", (F.col("start") - F.col("s0")).alias("start"), (F.col("end") - F.col("s0")).alias("end"))
    return intervals.first_run(moved, "k")


@query("""SELECT id FROM (SELECT id, sum(size) OVER (PARTITION BY source ORDER BY ingested_at DESC NULLS LAST, id DESC ROWS UNBOUNDED PRECEDING) AS used FROM files) WHERE used <= 50000000""")
def cache_kept(spark: SparkSession, root: str) -> DataFrame:
    """The newest files of each source that fit a cache of 50 MB together."""
    return intervals.until_full(_files(spark, root), "source", "ingested_at", "id", "size", 50_000_000).select("id")


@query(f"""WITH {_HITS}, fl AS (SELECT file_id, string_agg(name, ', ' ORDER BY name) AS flags FROM {_FLAGS_SQL} GROUP BY 1),
so AS (SELECT id, string_agg(name || ' (' || via || ')', '; ' ORDER BY {_ORDER}, ao, hs, name) AS sources FROM hits GROUP BY id)
SELECT f.id, split_part(replace(f.rel_path, chr(92), '/'), '/', -1) AS name, f.kind, f.category, coalesce(fl.flags, '') AS flags, coalesce(so.sources, '') AS sources, coalesce(s.state, 'unread') AS side
FROM files f LEFT JOIN fl ON fl.file_id = f.id LEFT JOIN so ON so.id = f.id LEFT JOIN {_SIDE_SQL} s ON s.file_id = f.id""")
def report_rows(spark: SparkSession, root: str) -> DataFrame:
    """Every file with its flags, the sets that list it and what the side table says: one pass of joins."""
    f = _files(spark, root)
    flags = _flags(f).groupBy(F.col("file_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("flags"))
    side = _side(spark, root).select(F.col("file_id").alias("id"), "state")
    joined = f.select("id", S.base_name(F.col("rel_path")).alias("name"), "kind", "category").join(flags, "id", "left").join(hashsets.sources_text(_hits(spark, root)), "id", "left").join(side, "id", "left")
    return joined.select("id", "name", "kind", "category", F.coalesce("flags", F.lit("")).alias("flags"), F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("state", F.lit("unread")).alias("side"))


@query(f"""WITH {_HITS} SELECT h.name, count(DISTINCT h.id) AS files FROM hits h LEFT JOIN hashsets s ON s.name = h.name WHERE s.id IS NULL GROUP BY 1""")
def orphan_sets(spark: SparkSession, root: str) -> DataFrame:
    """Sets that files were matched to but that are not in the list of sets."""
    return _hits(spark, root).join(table(spark, root, "hashsets").select("name"), "name", "left_anti").groupBy("name").agg(F.countDistinct("id").alias("files"))
