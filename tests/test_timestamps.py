import json
from datetime import UTC, datetime

import pytest

from lumencase.operators.timestamps import CERTAIN, em_mixture, instants, read_value


def us(*parts):
    return int(datetime(*parts, tzinfo=UTC).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("text", "zone", "expected"),
    [
        ("2020-01-02T03:04:05.1234567Z", None, us(2020, 1, 2, 3, 4, 5) + 123456),
        ("2020-01-02 03:04:05 UTC+05:30", None, us(2020, 1, 1, 21, 34, 5)),
        ("Thu, 30 Aug 2012 18:09:15 +0100", None, us(2012, 8, 30, 17, 9, 15)),
        ("20210222T075817Z", None, us(2021, 2, 22, 7, 58, 17)),
        ("/Date(1385344862679+0200)/", None, 1385344862679000),
        (1498645830, None, 1498645830000000),
        ("1457860602491", None, 1457860602491000),
        (131972747710000003, None, (131972747710000003 // 10) - 11644473600000000),
        ("2020-07-01 12:00 CET", "Europe/Berlin", us(2020, 7, 1, 11)),
        ("2020-07-01 12:00:00", "Europe/Berlin", us(2020, 7, 1, 10)),
        ("Mar 13, 2016 02:10:09 PM", "America/Denver", us(2016, 3, 13, 20, 10, 9)),
        ("2020:07:01  00:00:00", "Asia/Kathmandu", us(2020, 6, 30, 18, 15)),
    ],
)
def test_one_interpretation(text, zone, expected):
    found = read_value(text, zone)
    assert [v for v, _ in found.values()] == [expected]


@pytest.mark.parametrize(
    ("text", "zone", "why"),
    [
        ("2021-10-31 02:30:00", "Europe/Berlin", "shown twice"), ("2021-03-28 02:30:00", "Europe/Berlin", "never shown"), ("2021-03-28 02:30:00", None, "no zone"),
        ("2021-03-28 02:30:00 CET", None, "unknown zone"), ("2021-03-28 02:30:00 PST", "Europe/Berlin", "unknown zone"),
    ],
)
def test_valid_times_that_are_no_instant(text, zone, why):
    assert [w for _, w in read_value(text, zone).values()] == [why]


@pytest.mark.parametrize("text", ["", "  ", "2020-01-01", "unknown", "2021-02-30 10:00:00", "13:00 PM", "2020-01-01 13:00:00 PM", "0", "12345", True, None, 1.5, "20" * 400, "/Date(99999999999999999999)/", "9999-12-31T99:99:99Z"])
def test_no_timestamp(text):
    assert read_value(text, "Europe/Berlin") == {}


def test_em_learns_the_order_and_marks_what_it_cannot_tell():
    _, chosen = em_mixture({"DMY|MDY": 50, "DMY": 40}, None)
    assert chosen["DMY|MDY"][0] == "DMY" and chosen["DMY|MDY"][1] > CERTAIN
    _, chosen = em_mixture({"DMY|MDY": 50}, None)
    assert chosen["DMY|MDY"][1] == pytest.approx(0.5)
    _, chosen = em_mixture({"DMY|MDY": 5, "DMY": 40}, "MDY")
    assert chosen["DMY|MDY"] == ("MDY", 1.0) and chosen["DMY"][0] is None


def _chunk(spark, files, export_id=1):
    return spark.createDataFrame([(1, export_id, json.dumps({"value": {"Media": {"MediaFiles": files}}}))], "raw_id long, export_id int, payload string")


def test_sources_fields_and_states(spark):
    exports = spark.createDataFrame([(1, "Europe/Berlin", "DMY"), (2, None, None)], "export_id int, zone_name string, date_order string")
    files = [{"Created": "03/04/2020 10:00:00", "Written": " ", "Modified": "2020-01-01T00:00:00Z"}, None, {"Accessed": "1601-01-01T00:00:00Z"}]
    got = {(r["file_seq"], r["field"]): (r["utc_us"], r["status"]) for r in instants(_chunk(spark, files), exports).collect()}
    assert got == {(0, "fs_created"): (us(2020, 4, 3, 8), "settled"), (0, "fs_modified"): (us(2020, 1, 1), "settled"), (2, "fs_accessed"): (None, "before 1980")}
    got = {r["status"] for r in instants(_chunk(spark, {"Created": "03/04/2020 10:00:00 UTC"}, 2), exports).collect()}
    assert got == {"ambiguous format"}
    got = {r["status"] for r in instants(_chunk(spark, {"Created": "04/04/2020 10:00:00 UTC"}, 9), exports).collect()}
    assert got == {"settled"}


def test_empty_tables(spark):
    exports = spark.createDataFrame([], "export_id int, zone_name string, date_order string")
    chunks = spark.createDataFrame([(1, None, None), (2, 1, "{")], "raw_id long, export_id int, payload string")
    assert instants(chunks, exports).count() == 0
