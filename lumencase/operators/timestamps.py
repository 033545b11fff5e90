"""Mixed timestamp formats and time zones to one unambiguous instant, by expectation-maximisation.

``interpretations`` reads each value under every format it can be valid in: a value with its own zone, a
count since an epoch, a date that begins with the year or names its month has one interpretation; an
all-numeric date that does not begin with the year may have two. The sufficient statistics are
counts per (source, set of valid interpretations), a small table however many values there are.

``format_mixtures`` runs EM on those counts for each source: a format's weight is the share of values it
explains, a value's posterior the weight of each of its interpretations. A declared date order
fixes the weight of the other order at zero; without one the posterior decides, and a value whose best
posterior stays under ``certain`` is marked ambiguous instead of guessed.

``instants`` joins the choice back and gives utc_us or, explicitly, why there is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from typing import Any
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumencase.functions.arrow import sliced
from lumencase.functions.payloads import cases_of, listed, whole_json
from lumencase.staging import cut, small_enough

#: The years in which a bare count must fall, the first year of a settled instant, month names.
COUNT_YEARS, FIRST_YEAR = (1990, 2035), 1980
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: A posterior under this is an ambiguity, not a choice.
CERTAIN = 0.95

_EPOCH = datetime(1970, 1, 1)
_US = timedelta(microseconds=1)


def _us(year: int, *rest: int) -> int:
    return (datetime(year, *(rest or (1, 1))) - _EPOCH) // _US


_FIRST_US = _us(FIRST_YEAR)
_LOW_US, _HIGH_US = _us(COUNT_YEARS[0]), _us(COUNT_YEARS[1])
_TICKS_1601 = 11_644_473_600  # seconds from 1601 to 1970

_DOTNET = re.compile(r"/date\((-?\d+)(?:[+-]\d{4})?\)/", re.I)
_COUNT = re.compile(r"\d+")
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?\s*(?P<half>[ap]\.?m\.?)?"
_ZONE = r"\s*(?P<zone>z|(?:utc|gmt)?\s*[+-]\d{2}:?(?:\d{2})?|[a-z]{2,5})?"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_FORMS = [
    ("year_first", re.compile(rf"(?P<y>\d{{4}})(?P<sep>[-/:.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:t|\s+|\s*t\s*){_CLOCK}{_ZONE}", re.I)),
    ("compact", re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})t?\s*(?P<h>\d{{2}}):?(?P<mi>\d{{2}})(?::?(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?(?P<half>)?{_ZONE}", re.I)),
    ("named_month", re.compile(rf"{_DAY}(?P<d>\d{{1,2}})[\s-]+(?P<mon>[a-z]{{3,9}})\.?,?[\s-]+(?P<y>\d{{4}}),?\s+{_CLOCK}{_ZONE}", re.I)),
    ("named_month", re.compile(rf"{_DAY}(?P<mon>[a-z]{{3,9}})\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}),?\s+{_CLOCK}{_ZONE}", re.I)),
    ("numeric", re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}),?\s+{_CLOCK}{_ZONE}", re.I)),
]


@lru_cache(maxsize=1024)
def zone_of(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name.strip()) if name and name.strip() else None
    except Exception:
        return None


@lru_cache(maxsize=1024)
def abbreviations(name: str | None) -> dict[str, frozenset[timedelta]]:
    """The abbreviations the zone's clock has shown since FIRST_YEAR, each with its offsets from UTC."""
    zone, found = zone_of(name), {}
    if zone:
        at, end = datetime(FIRST_YEAR, 1, 1, 12, tzinfo=UTC), datetime(2038, 1, 1, tzinfo=UTC)
        while at < end:
            local = at.astimezone(zone)
            short = (local.tzname() or "").lower()
            if short.isalpha():
                found.setdefault(short, set()).add(local.utcoffset())
            at += timedelta(days=7)
    return {k: frozenset(v) for k, v in found.items()}


def _to_utc(local: datetime, zone_text: str | None, zone_name: str | None) -> tuple[int | None, str]:
    """(utc_us, '') or (None, why not)."""
    z = (zone_text or "").lower().replace(" ", "")
    if z in ("z", "utc", "gmt"):
        return (local - _EPOCH) // _US, ""
    digits = re.fullmatch(r"(?:utc|gmt)?([+-])(\d{2}):?(\d{2})?", z)
    if digits:
        hours, minutes = int(digits[2]), int(digits[3] or 0)
        if hours > 18 or minutes > 59:
            return None, "impossible zone"
        offset = timedelta(hours=hours, minutes=minutes) * (1 if digits[1] == "+" else -1)
        return (local - _EPOCH - offset) // _US, ""
    zone = zone_of(zone_name)
    if z:
        offsets = abbreviations(zone_name).get(z)
        if not offsets:
            return None, "unknown zone"
        if len(offsets) > 1:
            shown = {x.utcoffset() for fold in (0, 1) if ((x := local.replace(tzinfo=zone, fold=fold)).tzname() or "").lower() == z}
            offsets = shown & offsets
        if len(offsets) != 1:
            return None, "ambiguous zone"
        return (local - _EPOCH - next(iter(offsets))) // _US, ""
    if zone is None:
        return None, "no zone"
    early, late = (local.replace(tzinfo=zone, fold=fold).utcoffset() for fold in (0, 1))
    if early != late:  # the clock showed this time twice (early > late) or never
        return None, "shown twice" if early > late else "never shown"
    return (local - _EPOCH - early) // _US, ""


def _local(found: re.Match, month: int, day: int) -> datetime | None:
    hour, half = int(found["h"]), (found["half"] or "").lower()
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half[0] == "p" else 0)
    try:
        return datetime(int(found["y"]), month, day, hour, int(found["mi"]), int(found["s"] or 0), int(((found["f"] or "") + "000000")[:6]))
    except ValueError:
        return None


def read_value(value: Any, zone_name: str | None) -> dict[str, tuple[int | None, str]]:
    """Every valid interpretation of one reading: format -> (utc_us, why there is none)."""
    if value is None or isinstance(value, bool | dict | list):
        return {}
    if isinstance(value, float):
        if not value.is_integer() or abs(value) > 1e19:
            return {}
        value = int(value)
    text = str(value).strip().strip("﻿").strip()
    if found := _DOTNET.fullmatch(text):
        return {"dotnet": (int(found[1]) * 1000, "")} if len(found[1]) < 16 else {}
    if _COUNT.fullmatch(text) and len(text) < 20:
        n = int(text)
        for unit, us in (("count_s", n * 1_000_000), ("count_ms", n * 1000), ("count_us", n), ("count_ticks", n // 10 - _TICKS_1601 * 1_000_000)):
            if _LOW_US <= us <= _HIGH_US:
                return {unit: (us, "")}
        return {}
    for form, pattern in _FORMS:
        found = pattern.fullmatch(text)
        if not found:
            continue
        groups = found.groupdict()
        if form == "numeric":
            orders = {"MDY": (int(groups["a"]), int(groups["b"])), "DMY": (int(groups["b"]), int(groups["a"]))}
        elif groups.get("mon"):
            name = groups["mon"].lower()[:3]
            if name not in MONTHS:
                return {}
            orders = {form: (MONTHS.index(name) + 1, int(groups["d"]))}
        else:
            orders = {form: (int(groups["m"]), int(groups["d"]))}
        out = {}
        for order, (month, day) in orders.items():
            local = _local(found, month, day)
            if local is not None:
                out[order] = _to_utc(local, groups["zone"], zone_name)
        return out
    return {}


#: Result field -> the names it has in a media file, the first that is there and not blank counts.
FIELDS = {"fs_created": ("Created",), "fs_modified": ("Written", "Modified"), "fs_accessed": ("Accessed",)}
_READING = "raw_id long, case_seq int, media_seq int, file_seq int, field string, export_id int, text string, formats string, us_any long, us_mdy long, us_dmy long, why string"


def _present(record: dict, names: tuple[str, ...]) -> Any:
    for name in names:
        value = record.get(name)
        if value is not None and not (isinstance(value, str) and not value.strip()):
            return value
    return None


def interpretations(chunks: DataFrame, exports: DataFrame) -> DataFrame:
    """One row per reading with the set of formats it is valid in and the instant under each.

    formats is the sorted set joined by '|', '' if the value is no timestamp; us_mdy and us_dmy are the
    instants of a numeric date, us_any of any other; why tells what keeps a valid time from being an
    instant. Each source's zone comes with its chunks by a join on export_id.
    """
    zones = exports.select(F.col("export_id").cast("int").alias("export_id"), F.col("zone_name").cast("string").alias("zone_name")).where("export_id is not null").groupBy("export_id").agg(F.max("zone_name").alias("zone_name"))
    rows = chunks.select(F.col("raw_id").cast("long").alias("raw_id"), F.col("export_id").cast("int").alias("export_id"), F.col("payload").cast("string").alias("payload")).where("payload is not null")
    n = zones.count()
    rows = rows.join(F.broadcast(zones) if small_enough(n, 64) else zones, "export_id", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[tuple] = []
            for raw_id, export_id, payload, zone in zip(*(batch.column(c).to_pylist() for c in ("raw_id", "export_id", "payload", "zone_name")), strict=True):
                for ci, case in enumerate(cases_of(whole_json(payload))):
                    for mi, medium in enumerate(listed(case.get("Media")) if isinstance(case, dict) else []):
                        for fi, file in enumerate(listed(medium.get("MediaFiles")) if isinstance(medium, dict) else []):
                            if not isinstance(file, dict):
                                continue
                            for field, names in FIELDS.items():
                                value = _present(file, names)
                                if value is None:
                                    continue
                                found = read_value(value, zone)
                                plain = [v for k, v in found.items() if k not in ("MDY", "DMY")]
                                any_us = plain[0][0] if plain else None
                                whys = {w for _, w in found.values() if w}
                                out.append((raw_id, ci, mi, fi, field, export_id, str(value).encode("utf-8", "replace").decode(), "|".join(sorted(found)), any_us, found.get("MDY", (None,))[0], found.get("DMY", (None,))[0], ", ".join(sorted(whys)) or None))
            names = [x.split()[0] for x in _READING.split(", ")]
            types = [pa.int64(), *[pa.int32()] * 3, pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 3, pa.string()]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return rows.select("raw_id", "export_id", "payload", "zone_name").mapInArrow(read, _READING)


def em_mixture(counts: dict[str, int], declared: str | None, rounds: int = 50) -> tuple[dict[str, float], dict[str, tuple[str | None, float]]]:
    """(weight of each format, choice and posterior of each set of formats) of one source."""
    sets = {s: [f for f in s.split("|") if f] for s in counts}
    formats = sorted({f for fs in sets.values() for f in fs})
    # half a value of each format beforehand, so that a format is never ruled out by chance; a declared order rules the other out
    prior = {f: 0.0 if declared and f in ("MDY", "DMY") and f != declared else 0.5 for f in formats}
    weight = {f: 1.0 if prior[f] else 0.0 for f in formats}
    for _ in range(rounds):
        expected = dict(prior)
        for s, fs in sets.items():
            total = sum(weight[f] for f in fs)
            for f in fs:
                if total:
                    expected[f] += counts[s] * weight[f] / total
        norm = sum(expected.values()) or 1.0
        new = {f: e / norm for f, e in expected.items()}
        if max((abs(new[f] - weight[f]) for f in formats), default=0.0) < 1e-12:
            break
        weight = new
    chosen: dict[str, tuple[str | None, float]] = {}
    for s, fs in sets.items():
        total = sum(weight[f] for f in fs)
        best = max(fs, key=lambda f: (weight[f], f), default=None)
        chosen[s] = (best, weight[best] / total) if best and total else (None, 0.0)
    return weight, chosen


def format_mixtures(readings: DataFrame, exports: DataFrame) -> DataFrame:
    """export_id, formats, n, chosen, posterior: for each source and set of valid formats the EM choice."""
    counts = readings.groupBy("export_id", "formats").agg(F.count("*").alias("n"))
    order = exports.select(F.col("export_id").cast("int").alias("export_id"), F.upper(F.trim("date_order")).alias("date_order")).where("export_id is not null").groupBy("export_id").agg(F.max("date_order").alias("date_order"))
    rows = counts.join(order, "export_id", "left").select(F.coalesce("export_id", F.lit(-1)).alias("export_id"), "formats", "n", "date_order")

    def source(table: pd.DataFrame) -> pd.DataFrame:
        declared = table["date_order"].iloc[0]
        declared = declared if isinstance(declared, str) and declared in ("MDY", "DMY", "YMD") else None
        _, chosen = em_mixture(dict(zip(table["formats"], table["n"], strict=True)), declared)
        return pd.DataFrame({"export_id": table["export_id"], "formats": table["formats"], "n": table["n"], "chosen": [chosen[s][0] for s in table["formats"]], "posterior": [chosen[s][1] for s in table["formats"]]})

    return rows.groupBy("export_id").applyInPandas(source, "export_id int, formats string, n long, chosen string, posterior double")


def undeclared_agreement(readings: DataFrame, exports: DataFrame) -> DataFrame:
    """declared, readings, agree, contradict, ambiguous: how EM reads the all-numeric dates valid in both orders if no order is declared.

    One row per declared order; a choice counts only with a posterior of CERTAIN or more.
    """
    free = format_mixtures(readings, exports.withColumn("date_order", F.lit(None).cast("string"))).where("formats = 'DMY|MDY'")
    told = exports.select(F.col("export_id").cast("int").alias("export_id"), F.upper(F.trim("date_order")).alias("declared")).where("declared in ('DMY', 'MDY')").groupBy("export_id").agg(F.max("declared").alias("declared"))
    sure = F.col("posterior") >= CERTAIN
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return free.join(told, "export_id").groupBy("declared").agg(
        F.sum("n").alias("readings"), count(sure & (F.col("chosen") == F.col("declared"))).alias("agree"), count(sure & (F.col("chosen") != F.col("declared"))).alias("contradict"), count(~sure).alias("ambiguous")
    )


def instants(chunks: DataFrame, exports: DataFrame) -> DataFrame:
    """raw_id, case_seq, media_seq, file_seq, field, text, utc_us, status of every reading that is there.

    status is 'settled' with utc_us, or why there is none: 'no timestamp' (unreadable, no time of day,
    impossible), 'ambiguous format', 'contradicts the declared order', 'no zone', 'unknown zone',
    'shown twice', 'never shown', 'before 1980'. Null and blank readings are not there; chunks that are not
    whole JSON give none; a source missing from ``exports`` has no zone and no declared order.
    """
    readings = cut(interpretations(chunks, exports))
    choice = format_mixtures(readings, exports)
    joined = readings.withColumn("export_id", F.coalesce("export_id", F.lit(-1))).join(choice.drop("n"), ["export_id", "formats"], "left")
    us = F.when(F.col("chosen") == "MDY", F.col("us_mdy")).when(F.col("chosen") == "DMY", F.col("us_dmy")).otherwise(F.col("us_any"))
    status = (
        F.when(F.col("formats") == "", "no timestamp")
        .when(F.col("chosen").isNull(), "contradicts the declared order")
        .when((F.col("posterior") < CERTAIN) & ~F.col("us_mdy").eqNullSafe(F.col("us_dmy")), "ambiguous format")
        .when(us.isNull(), F.coalesce("why", F.lit("no timestamp")))
        .when(us < _FIRST_US, "before 1980")
        .otherwise("settled")
    )
    return joined.select("raw_id", "case_seq", "media_seq", "file_seq", "field", "text", us.alias("us"), status.alias("status")).select(
        "raw_id", "case_seq", "media_seq", "file_seq", "field", "text", F.when(F.col("status") == "settled", F.col("us")).alias("utc_us"), "status"
    )
