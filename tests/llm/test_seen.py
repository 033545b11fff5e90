import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumencase.llm.seen import EMPTY_MD5, build, error_report, found_ids, golomb_decode, golomb_encode, md5_key, probe

SCHEMA = "id long, ingested_at double, md5 string, key string, value string, at string"


@pytest.mark.parametrize("k", [0, 1, 5, 10, 20])
def test_golomb_round_trip(k):
    rng = np.random.default_rng(k)
    for n in (1, 2, 100, 5000):
        values = np.sort(rng.integers(0, 1 << 22, n))
        values[n // 2 :] = np.maximum(values[n // 2 :], values[n // 2 - 1 if n > 1 else 0])
        assert (golomb_decode(golomb_encode(np.sort(values), k), n, k) == np.sort(values)).all()


def rows(spark, data):
    return spark.createDataFrame([(i, t, m, "k", "v", "a") for i, t, m in data], SCHEMA)


def known(spark, values):
    return spark.createDataFrame([(v,) for v in values], "m string").select(md5_key("m").alias("key"))


def brute(data, listed):
    clean = lambda m: None if m is None else m.replace("﻿", "").strip().lower()
    usable = lambda m: m is not None and len(m) == 32 and all(c in "0123456789abcdef" for c in m) and m != EMPTY_MD5
    seen, out = {clean(v) for v in listed}, set()
    for i, _, m in sorted(data, key=lambda r: (float("inf") if r[1] is None else r[1], r[0])):
        if usable(k := clean(m)):
            if k in seen:
                out.add(i)
            seen.add(k)
    return out


def test_against_brute_force_with_hot_and_dirty_keys(spark):
    rng = random.Random(4)
    keys = [f"{rng.getrandbits(128):032x}" for _ in range(400)]
    pool = [*keys, *[keys[0]] * 300, None, "", "pending", keys[1][:-1], "﻿" + keys[2], f" {keys[3].upper()}\t", EMPTY_MD5, EMPTY_MD5]
    data = [(i, rng.choice([None, float(rng.randrange(50))]), rng.choice(pool)) for i in range(1, 1500)]
    listed = [keys[5], keys[6].upper() + " ", "junk", None, EMPTY_MD5, f"{rng.getrandbits(128):032x}"]
    got = found_ids(rows(spark, data), [known(spark, listed)], md5_key("md5"))
    assert sorted(r["id"] for r in got.collect()) == sorted(brute(data, listed))


def test_no_lists_and_empty_tables(spark):
    k = "a" * 32
    assert [r["id"] for r in found_ids(rows(spark, [(2, 1.0, k), (1, 1.0, k)]), [], md5_key("md5")).collect()] == [2]
    assert found_ids(rows(spark, []), [known(spark, [k])], md5_key("md5")).count() == 0
    assert found_ids(rows(spark, [(1, 1.0, None)]), [], md5_key("md5")).count() == 0


def test_false_positives_are_counted_and_no_key_is_missed(spark):
    rng = random.Random(6)
    data = [(i, float(i), f"{rng.getrandbits(128):032x}") for i in range(4000)]
    r = error_report(rows(spark, data), [], md5_key("md5"), fp_bits=4).first()
    assert r["truly_seen"] == 0 and r["said_seen"] == r["wrong_answers"]
    assert r["audited_rate"] == pytest.approx(r["theoretical_rate"], rel=0.35)
    assert r["bytes_coded"] < 4000 * 2


def test_probe_decodes_only_what_is_there(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(1).alias("arrivals"))
    found = build(keys)
    values = keys.select(found.reduced(F.col("key")).alias("value")).distinct()
    assert probe(found, values).count() == values.count()
    assert found.blocks.count() >= 1
