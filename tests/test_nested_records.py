import json

from lumencase.operators.nested_records import media, shred, vic_children


def chunks(spark, payloads):
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p), "k") for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "raw_id long, payload string, key string")


def children(spark, *payloads):
    return sorted(tuple(r) for r in vic_children(chunks(spark, payloads)).collect())


def medium(**fields):
    return {"value": [{"Media": [fields]}]}


def test_shapes_of_children(spark):
    got = children(spark, medium(Exifs={"PropertyName": " ISO ", "PropertyValue": 0}, Tags=" a ,;b", Series={"Name": "s"}, victimIDENTIFIED=" TRUE ", IsSuspected=1, SelfGenerated="no"))
    assert got == [(0, 0, 0, "exif", 0, "ISO"), (0, 0, 0, "flag", 0, "is_suspected"), (0, 0, 0, "flag", 0, "victim_identified"), (0, 0, 0, "series", 0, "s"), (0, 0, 0, "tag", 0, "a"), (0, 0, 0, "tag", 2, "b")]


def test_places_count_null_and_blank_children(spark):
    got = children(spark, {"Cases": [None, {"Media": [7, {"Tags": [None, {"Tag": "x"}, " ", "y,z"], "Exifs": [7, {"PropertyName": "A", "PropertyValue": " "}, {"PropertyName": "B", "PropertyValue": "v"}]}]}]})
    assert got == [(0, 1, 1, "exif", 2, "B"), (0, 1, 1, "tag", 1, "x"), (0, 1, 1, "tag", 3, "y,z")]


def test_wrapped_marked_damaged_and_repeated_payloads(spark):
    plain = json.dumps(medium(Tags="t"))
    got = children(spark, "﻿" + plain, json.dumps(plain), plain[:-3], None, "", plain, "[]", "7")
    assert got == [(i, 0, 0, "tag", 0, "t") for i in (0, 1, 5)]


def test_value_comes_before_cases_but_null_is_none(spark):
    assert children(spark, {"value": None, "Cases": {"Media": {"Series": "s"}}}) == [(0, 0, 0, "series", 0, "s")]
    assert children(spark, {"value": [], "Cases": {"Media": {"Series": "s"}}}) == []


def test_records_nested_very_deeply_are_whole(spark):
    deep = json.dumps(medium(Tags="t", More="@")).replace('"@"', "[" * 900 + "]" * 900)
    assert children(spark, deep) == [(0, 0, 0, "tag", 0, "t")]


def test_equal_subtrees_are_stored_once(spark):
    tables = shred(chunks(spark, [medium(Tags=["a", "a"], MD5="x")] * 5), "raw_id", "payload")
    assert tables["roots"].count() == 5
    assert tables["roots"].select("node").distinct().count() == 1
    # root, case, medium and the one tag
    assert tables["nodes"].count() == 4
    assert tables["bridge"].where("field = 'Tags'").count() == 2
    assert media(tables).count() == 5


def test_types_are_told_apart(spark):
    tables = shred(chunks(spark, [{"a": 1}, {"a": "1"}, {"a": True}, {"a": 1.0}, {"a": None}, {"a": {}}, {"a": []}]), "raw_id", "payload")
    assert tables["roots"].select("node").distinct().count() == 7


def test_very_deep_and_very_long_payloads_do_not_crash(spark):
    deep = "[" * 100_000 + "]" * 100_000
    long = json.dumps(medium(Tags=["x" * 2_000_000]))
    assert [r[3] for r in children(spark, deep, long)] == ["tag"]


def test_empty_table(spark):
    assert vic_children(spark.createDataFrame([], "raw_id long, payload string")).count() == 0
