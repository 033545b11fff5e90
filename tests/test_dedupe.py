import random

import pytest

from lumencase.operators import dedupe


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def brute(rows, threshold):
    out = set()
    for n, (a, p, d) in enumerate(rows):
        for b, q, e in rows[n + 1 :]:
            x = p ^ q
            if x.bit_count() <= threshold and (d is None or e is None or (d ^ e).bit_count() <= threshold + 2):
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("threshold", [2, 6, 8, 12, 16])
def test_all_pairs_are_found_in_a_bucket_of_any_size(spark, threshold):
    rng = random.Random(5)
    rows = [(i, 0xF0 << 56 | rng.getrandbits(56), rng.choice([None, 0, rng.getrandbits(64)])) for i in range(1, 1601)]
    for _, p, d in rows[:300]:
        # all share the first eight bits; the differences stand anywhere, also one in every other byte
        x = sum(1 << k for k in rng.sample(range(56), rng.randrange(1, 18)))
        if rng.random() < 0.3:
            x = sum(1 << 8 * k + rng.randrange(8) for k in range(7))
        rows.append((len(rows) + 1, p ^ x, d))
    table = spark.createDataFrame([(i, signed(p), d if d is None else signed(d)) for i, p, d in rows], "id long, p long, d long")
    got = [tuple(r) for r in dedupe.near_pairs(table, threshold).collect()]
    want = brute(rows, threshold)
    assert len(want) >= 5 and len(got) == len(set(got)) and set(got) == want
