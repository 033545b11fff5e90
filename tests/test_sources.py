import json

import pytest
from pyspark.sql import functions as F

from lumencase.sources import lists, media, sinks
from lumencase.streaming import ingest

MD5, SHA = "a" * 32, "B" * 40


def test_text_lists_in_several_encodings(spark, tmp_path):
    text = f"hash,category\n{MD5},2\r\n\"{SHA}\"\t1\nnothing\n\n"
    for name, data in (("a.csv", text.encode()), ("b.txt", b"\xef\xbb\xbf" + text.encode()), ("c.txt", "﻿".encode("utf-16-le") + text.encode("utf-16-le"))):
        (tmp_path / name).write_bytes(data)
        got = [(r["algo"], r["value"], r["category"]) for r in lists.hash_lines(spark, str(tmp_path / name)).where("algo is not null").collect()]
        assert got == [("md5", MD5, 2), ("sha1", SHA, 1)], name


def test_json_lists(spark, tmp_path):
    record = {"MD5Hash": MD5, "VicsCategory": 0, "MediaID": 7, "PhotoDNA": "x"}
    for i, doc in enumerate(([record], {"value": [record]}, record)):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc))
        got = sorted((r["algo"], r["value"], r["category"], r["media_id"]) for r in lists.hash_json(spark, str(tmp_path / f"{i}.json")).collect())
        assert got == [("md5", MD5, 0, 7), ("photodna", "x", 0, 7)]


def test_refusals_and_tables(spark):
    t = spark.createDataFrame([(MD5, SHA, 5), (MD5, SHA, 0), (MD5, SHA, 5)], "MD5 string, SHA1 string, file_size long")
    entries = lists.hash_table(t)
    assert entries.count() == 2
    assert lists.checked(entries, "known").count() == 2
    with pytest.raises(lists.Refused):
        lists.checked(entries, "known-good", is_vic=True)
    with pytest.raises(lists.Refused):
        lists.checked(entries.withColumn("value", F.lit("x")), "known")
    with pytest.raises(lists.Refused):
        lists.hash_table(spark.range(1))
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = lists.apply_delta(base, base.where("k = 1"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(tuple(r) for r in got.collect()) == [(2, "c"), (3, "d")]


def test_folder_by_name_and_by_first_bytes(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.JPG").write_bytes(b"x")
    (tmp_path / "s/b").write_bytes(b"\x89PNG\r\n\x1a\n0000")
    (tmp_path / "s/._a.jpg").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"plain text here")
    got = {(r["rel_path"], r["ext"], r["kind"], r["size"]) for r in media.folder(spark, str(tmp_path), "s1").collect()}
    assert got == {("s/a.JPG", "jpg", "image", 1), ("s/b", "", "image", 12)}
    assert media.folder(spark, str(tmp_path), "s1", include_other=True).count() == 3


def test_jobs():
    assert media.job("/x/y") == [{"name": "y", "path": "/x/y"}]
    assert media.job({"Sources": [{"Path": "a", "Name": "n"}, "/b"]}, "/r") == [{"path": "/r/a", "name": "n"}, {"path": "/b", "name": "b"}]
    assert [s["path"] for s in media.job('{"folders": ["a"], "folder": "b"}', "/r")] == ["/r/a", "/r/b"]


def test_vic_index_and_export(spark):
    chunk = {"value": [{"Media": [{"MediaID": 1, "MD5": MD5.upper(), "MimeType": "image/jpeg", "RelativeFilePath": "Files\\a.jpg", "Category": "2"}, {"MediaID": 2, "MD5": "c" * 32}]}]}
    index = media.vic_index(spark.createDataFrame([(1, json.dumps(chunk))], "raw_id long, payload string"))
    assert sorted((r["media_id"], r["md5"], r["kind"], r["rel_path"], r["category"]) for r in index.collect()) == [(1, MD5, "image", "Files/a.jpg", 2), (2, "c" * 32, "other", None, None)]
    decided = spark.createDataFrame([(1, None, 9, "own"), (None, "C" * 32, 3, "by hash")], "media_id long, md5 string, category int, comments string")
    got = {r["media_id"]: (r["category"], r["comments"]) for r in sinks.vic_export(index, decided).collect()}
    assert got == {1: (None, "own"), 2: (3, "by hash")}


def test_c4all(spark, tmp_path):
    (tmp_path / "i.xml").write_text(f"<ReportIndex><Image><MD5>{MD5}</MD5><Path>a\\b.jpg</Path><Size>3</Size><Category>0</Category></Image><Movie><MD5>{MD5}</MD5><Category>2</Category></Movie></ReportIndex>")
    got = sorted((r["kind"], r["rel_path"], r["category"]) for r in media.c4all_index(spark, str(tmp_path / "i.xml")).collect())
    assert got == [("image", "a/b.jpg", 5), ("video", None, 2)]


def test_writers_and_case(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a&b.jpg", MD5, 1.5, 2.5, "p"), (2, "c", None, None, None, "q"), (3, "d", MD5, 0.0, 0.0, "r")], "id long, rel_path string, md5 string, gps_lat double, gps_lon double, path string")
    sinks.write_md5(rows, str(tmp_path / "m"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()] == [MD5]
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).columns == ["id", "rel_path", "md5", "gps_lat", "gps_lon"]
    sinks.write_json(rows, str(tmp_path / "j"))
    assert "path" not in spark.read.json(str(tmp_path / "j")).columns
    assert [r["value"] for r in sinks.placemarks(rows).collect()] == ["<Placemark><name>a&amp;b.jpg</name><Point><coordinates>2.5000000,1.5000000</coordinates></Point></Placemark>"]
    case = sinks.Case(spark, str(tmp_path / "case"))
    with pytest.raises(FileNotFoundError):
        case.read("files")
    first = case.write("files", rows)
    case.write("files", case.read("files").where("id = 1"))
    assert case.read("files").count() == 1 and case.read("files", first).count() == 3
    for _ in range(3):
        case.write("files", rows, keep=2)
    assert len(case.versions("files")) == 2 and case.read("files").count() == 3


def test_enrichers_and_resumable_passes(spark):
    media.ENRICHERS["length_of"] = (lambda s: s.map(len), "long")
    rows = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b""))], "id long, content binary")
    assert {r["id"]: r["length_of"] for r in media.enrich(rows, "length_of").collect()} == {1: 3, 2: 0}
    assert [r["id"] for r in media.unread(rows, rows.where("id = 1")).collect()] == [2]


def test_stream_takes_up_each_file_once(spark, tmp_path):
    source, target, progress = (str(tmp_path / x) for x in ("in", "out", "p"))
    for part in ([(1, "a"), (1, "a")], [(2, "b")]):
        spark.createDataFrame(part, "id long, v string").write.mode("append").parquet(source)
        ingest.take_up(spark, source, "id long, v string", target, progress, "id")
    assert sorted(tuple(r) for r in spark.read.parquet(target).select("id", "v").collect()) == [(1, "a"), (2, "b")]
