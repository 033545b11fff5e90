from datetime import date

import pytest
from pyspark.sql import functions as F

from lumencase.functions import scalars as S
from lumencase.operators import dedupe, gallery, hashsets, intervals, updates

FILES = "id long, rel_path string, path string, source string, kind string, ext string, size long, mtime double, ctime double, atime double, md5 string, sha1 string, sha256 string, phash string, dhash string, width int, height int, duration double, created_dt string, camera string, category int, error string, stack_id long, vstack_id long, container_id long"
NAMES = [f.split()[0] for f in FILES.split(", ")]


def files(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], FILES)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_column_filters_keep_nulls_only_where_said(spark):
    df = files(spark, {"id": 1, "camera": "A%b"}, {"id": 2, "camera": None, "size": 5}, {"id": 3, "camera": "", "size": 9})
    assert ids(gallery.apply_filters(df, [("camera", "neq", "A%b")])) == [2, 3]
    assert ids(gallery.apply_filters(df, [("camera", "contains", "a%")])) == [1]
    assert ids(gallery.apply_filters(df, [("camera", "set", None)])) == [1]
    assert ids(gallery.apply_filters(df, [("camera", "notset", None)])) == [2, 3]
    assert ids(gallery.apply_filters(df, [("size", "min", "x"), ("nosuch", "eq", 1)])) == [1, 2, 3]


@pytest.mark.parametrize(("column", "text", "expected"), [("size", "10 KB-2MB", [("size", "min", 10240.0), ("size", "max", 2097152.0)]), ("duration", "1:30", [("duration", "min", 90.0)]), ("size", ">=5", [("size", "min", 5.0)]), ("camera", "!x", [("camera", "neq", "x")]), ("camera", "none", [("camera", "notset", None)]), ("camera", "Lux", [("camera", "contains", "Lux")]), ("size", "  ", [])])
def test_filter_grammar(column, text, expected):
    assert gallery.parse_filter(column, text) == expected


def test_a_collapsed_group_is_reached_through_any_member(spark):
    df = files(spark, {"id": 1, "stack_id": 1, "size": 1}, {"id": 2, "stack_id": 1, "size": 9}, {"id": 3, "vstack_id": 1, "stack_id": 3, "size": 9}, {"id": 4, "size": 9})
    assert ids(gallery.collapse(df)) == [1, 4]
    assert ids(gallery.collapse(df.where("size = 9"))) == [2, 4]


def test_search_needs_every_word_somewhere(spark):
    df = files(spark, {"id": 1, "rel_path": "DCIM/Ä_1.jpg", "camera": "Luxel"}, {"id": 2, "rel_path": "DCIM/b.jpg"})
    assert ids(gallery.search(df, "dcim LUXEL")) == [1]
    flags = spark.createDataFrame([(2, "Luxel like")], "file_id long, name string")
    assert ids(gallery.search(df, "luxel", flags)) == [1, 2]
    assert ids(gallery.search(df, "ä")) == []  # only A-Z are folded


def test_any_date(spark):
    day = date(2020, 1, 2)
    df = files(spark, {"id": 1, "mtime": 1577923200.0}, {"id": 2, "created_dt": "2020-01-02T10:00:00"}, {"id": 3, "ctime": 0.0, "created_dt": ""}, {"id": 4, "atime": 1578009600.0})
    assert ids(gallery.any_date(df, day, day)) == [1, 2]
    assert ids(gallery.any_date(df, None, day)) == [1, 2]
    assert ids(gallery.any_date(df, None, None, True)) == [3]


def test_near_pairs_need_both_hashes_and_skip_featureless_ones(spark):
    rows = [{"id": 1, "phash": "f0f0f0f0f0f0f0f0", "dhash": "0" * 16}, {"id": 2, "phash": "f0f0f0f0f0f0f0f3", "dhash": "f" * 16}, {"id": 3, "phash": "f0f0f0f0f0f0f0f1"}, {"id": 4, "phash": "0" * 16}, {"id": 5, "phash": "0" * 16}, {"id": 6, "phash": "zz"}, {"id": 7, "phash": "F0F0F0F0F0F0F0F1"}]
    pairs = {tuple(sorted(r)) for r in dedupe.near_pairs(dedupe.comparable(files(spark, *rows)), 6).collect()}
    assert pairs == {(1, 3), (2, 3), (3, 7)}
    assert {(r["id"], r["group_id"]) for r in dedupe.groups(files(spark, *rows), 6).collect()} == {(1, 1), (2, 1), (3, 1), (7, 1)}


def test_known_hash_precedence(spark):
    md5, sha = "a" * 32, "b" * 64
    df = files(spark, {"id": 1, "md5": md5.upper(), "sha256": sha, "category": 5}, {"id": 2, "md5": md5, "category": 3}, {"id": 3, "md5": S.EMPTY_HASHES["md5"], "category": 5})
    sets = spark.createDataFrame([(1, "good", "known-good", 0), (2, "vic", "known", 1)], "id int, name string, kind string, vic int")
    entries = spark.createDataFrame([(1, "sha256", sha, None, None, None), (2, "MD5", f" {md5} ", 2, 7, None), (2, "md5", md5, 1, 8, None), (2, "md5", S.EMPTY_HASHES["md5"], 1, 9, None)], "hashset_id int, algo string, value string, category int, media_id long, added_at timestamp")
    stash = spark.createDataFrame([(md5, "US", 1, 1.0, None), (md5, "UK", 0, 1.0, "x")], "md5 string, region string, category int, added_at double, source string")
    found = hashsets.hits(df, sets, entries, stash)
    got = {r["id"]: (r["top"], r["mask"], r["asserted"], r["n_sets"]) for r in hashsets.summary(found).collect()}
    assert got == {1: ("vic", 11, 1, 3), 2: ("vic", 3, 1, 2)}
    again = {r["id"]: (r["category"], r["hashset_mask"]) for r in hashsets.rematched(df, found).collect()}
    assert again == {1: (1, 11), 2: (3, 3), 3: (5, 0)}


def test_unclaimed_and_runs(spark):
    spans = spark.createDataFrame([("a", 2, 4), ("a", 4, 6), ("a", 5, 8), ("a", 12, 30), ("b", -5, 0)], "k string, start long, end long")
    whole = spark.createDataFrame([("a", 0, 20), ("b", 0, 5), ("c", 0, 3)], "k string, start long, end long")
    assert sorted(tuple(r) for r in intervals.unclaimed(spans, whole, "k").collect()) == [("a", 0, 2), ("a", 8, 12), ("b", 0, 5), ("c", 0, 3)]
    assert sorted((r["k"], r["start"], r["end"], r["pieces"]) for r in intervals.joined_runs(spans, "k").collect()) == [("a", 2, 8, 3), ("a", 12, 30, 1), ("b", -5, 0, 1)]


def test_a_cache_keeps_the_newest_that_fit(spark):
    rows = [(i, "a" if i % 3 else None, float(i // 4) * 50_000, 10 + i % 5) for i in range(60)] + [(99, "a", None, 1), (98, "b", 5.0, None)]
    df = spark.createDataFrame(rows, "id long, k string, at double, size long")
    want = set()
    for key in (None, "a", "b"):
        used = 0
        for r in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] if r[2] is not None else -1, r[0]), reverse=True):
            used += r[3] or 0
            want |= {r[0]} if used <= 150 else set()
    assert set(ids(intervals.until_full(df, "k", "at", "id", "size", 150))) == want


def test_upsert_merges_and_numbers_new_rows(spark):
    old = spark.createDataFrame([(1, "a", 5, "x"), (7, "b", 6, None)], "id long, path string, size long, note string")
    new = spark.createDataFrame([("b", 9), ("c", 1), ("d", None)], "path string, size long")
    got = {r["path"]: (r["id"], r["size"], r["note"]) for r in updates.upsert(old, new).collect()}
    assert got["a"] == (1, 5, "x") and got["b"] == (7, 9, None)
    assert sorted((got["c"][0], got["d"][0])) == [8, 9]


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda *c: tuple(one.select(*c).first())
    assert pick(S.hexbits(F.lit("ffffffffffffffff")), S.hexbits(F.lit("-123456789abcdef"))) == (-1, None)
    assert pick(S.iso6709(F.lit("+4236.69-07455.88+120/"), 1), S.iso6709(F.lit("+42.6116-074.9314/"), 2)) == (pytest.approx(42.6115), pytest.approx(-74.9314))
    assert pick(S.xmp_degrees(F.lit("10,30,36S")), S.xmp_degrees(F.lit("x"))) == (pytest.approx(-10.51), None)
    assert pick(S.exif_time(F.lit("2020:02:30 10:00:00")), S.exif_time(F.lit("2020:02:03 10:00:00"))) == (None, "2020-02-03T10:00:00")
    assert pick(S.similarity_percent(F.lit(12))) == (81.2,)
    assert pick(S.text_of_duration(F.lit(3725.9)), S.text_of_duration(F.lit(None).cast("double"))) == ("1:02:05", "")
    assert pick(S.sniff_kind(F.lit(bytearray(b"\x00\x00\x00\x18ftypheic")).cast("binary")), S.sniff_kind(F.lit(bytearray(b"RIFF0000WEBP")).cast("binary"))) == ("image", "image")
    view = lambda p: pick(S.storage_view(F.lit(p)))[0]
    assert view("nothing") is None and view("x/mydata/media/10/a.jpg") is None
    assert tuple(view("x/data/media/10/a.jpg")) == ("x/", "media", "10", "a.jpg", 5)
    assert tuple(view("mnt/user/0/emulated/0/a"))[:4] == tuple(view("sdcard/a"))[:4] == tuple(view("storage\\emulated\\0\\a"))[:4] == ("", "media", "0", "a")
    assert tuple(view("data_mirror/data_de/9f1c-22/11/b/c"))[:4] == tuple(view("data/user_de/11/b/c"))[:4] == ("", "de", "11", "b/c")
    assert pick(S.capture_time(F.lit("9/9/2024 9:59:59 PM (UTC-5)")), S.capture_time(F.lit("9/9/2024 9:99:99 PM")), S.capture_time(F.lit("12/31/2020 23:00:01"))) == ("2024-09-09T21:59:59-05:00", None, "2020-12-31T23:00:01")
    assert pick(S.without_paths(F.lit("in C:\\a\\b.txt and /x/y: 3/4 left"))) == ("in <path> and <path>: 3/4 left",)
    packed = S.pack_flags(F.lit(True), F.lit(None).cast("boolean"), F.lit(False))
    assert pick(packed, S.unpack_flag(packed, 0), S.unpack_flag(packed, 1), S.unpack_flag(packed, 2), S.pack_flags(F.lit(None).cast("boolean"))) == (261, True, None, False, None)
    assert pick(S.tile_id(1, F.lit(1), F.lit(0)), S.tile_id(0, F.lit(0), F.lit(0)), S.tile_id(2, F.lit(0), F.lit(0)), S.tile_id(1, F.lit(0), F.lit(1))) == (4, 0, 5, 2)
    assert pick(S.real_prefix(F.lit("12.5kg")), S.real_prefix(F.lit("kg"))) == (12.5, 0.0)
