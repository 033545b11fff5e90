import heapq
import random

import pytest

from lumencase.llm.mixing import mixture, sainte_lague


def by_quotients(weights, seats, caps):
    got = [0] * len(weights)
    q = [(-w, i) for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    heapq.heapify(q)
    for _ in range(seats):
        if not q:
            break
        _, i = heapq.heappop(q)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(q, (-weights[i] / (2 * got[i] + 1), i))
    return got


def test_bisection_gives_the_same_seats_as_quotients():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 12)
        weights = [rng.choice([0.0, rng.random(), 0.25]) for _ in range(n)]
        caps = [rng.randrange(0, 60) for _ in range(n)]
        seats = rng.randrange(0, 200)
        assert sainte_lague(weights, seats, caps) == by_quotients(weights, seats, caps)


def test_no_seats_or_sources():
    assert sainte_lague([], 5, []) == []
    assert sainte_lague([0.0], 5, [3]) == [0]
    assert sainte_lague([1.0], 10**12, [10**9]) == [10**9]


def _tables(spark, sizes, shares, repeats=3):
    rng = random.Random(3)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, rng.choice([source, source.upper(), f" {source} "]), "word " * rng.randrange(1, 60), "t"))
            i += 1
    rows += [(i, None, "x y z", "t"), (i + 1, "elsewhere", "x", "t"), (i + 2, next(iter(sizes), "a"), None, "t"), (i + 3, "", "x", "t")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, tokens string"), spark.createDataFrame([(s, w, repeats) for s, w in shares.items()], "source string, target_share double, max_repeats int")


def test_shares_caps_and_repeatability(spark):
    documents, targets = _tables(spark, {"a": 400, "b": 60, "c": 300}, {"a": 0.5, "b": 0.2, "c": 0.3})
    got = mixture(documents, targets)
    report = {r["source"]: r for r in got["shares"].collect()}
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1)
    for source, share in (("a", 0.5), ("b", 0.2), ("c", 0.3)):
        assert report[source]["actual_share"] == pytest.approx(share, abs=0.02)
        assert report[source]["repeats_used"] <= 3
    rows = sorted(tuple(r) for r in got["rows"].collect())
    assert rows == sorted(tuple(r) for r in mixture(documents, targets)["rows"].collect())
    assert all(1 <= r[3] <= 3 for r in rows) and len({r[0] for r in rows}) == len(rows)


def test_a_source_without_documents_and_a_fixed_size(spark):
    documents, targets = _tables(spark, {"a": 100, "b": 100}, {"a": 0.4, "b": 0.4, "none": 0.2})
    report = {r["source"]: r for r in mixture(documents, targets, total_tokens=2048)["shares"].collect()}
    assert report["none"]["mixed_tokens"] == 0
    assert report["a"]["actual_share"] == pytest.approx(0.5, abs=0.08)
    assert sum(r["mixed_tokens"] for r in report.values()) == pytest.approx(2048, rel=0.1)


def test_empty_tables(spark):
    documents, targets = _tables(spark, {}, {"a": 1.0})
    assert mixture(documents.limit(0), targets)["rows"].count() == 0
    assert mixture(documents, targets.limit(0))["rows"].count() == 0
