import random

from lumencase.llm import groups
from lumencase.llm.groups import group_labels, match_groups
from tests.test_components import brute


def labels(spark, edges):
    return {r["node"]: r["label"] for r in group_labels(spark.createDataFrame(edges, "a long, b long")).collect()}


def test_hub_chains_and_small_groups(spark):
    rng = random.Random(2)
    edges = [(500, i) for i in range(501, 700)] + [(699, 3), (3, 4)] + [(i, i + 1) for i in range(1000, 1100)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    edges += [(b, a) for a, b in edges[:30]] + edges[:10] + [(9, 9), (None, 1), (1, None)]
    assert labels(spark, edges) == brute([(a, b) for a, b in edges if a != b and a is not None and b is not None])


def test_a_giant_with_a_long_tail_is_contracted(spark, monkeypatch):
    monkeypatch.setattr(groups, "DWINDLED", 0.5)
    edges = [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(559, 620)] + [(620, 2)]
    assert labels(spark, edges) == brute(edges)


def test_no_edges(spark):
    assert labels(spark, []) == {}
    assert labels(spark, [(1, 1), (None, None)]) == {}


def test_verified_links(spark):
    rows = [(1, "f" * 16, None), (2, "F" * 15 + "0", None), (3, "0" * 16, None), (4, None, 1), (5, "zz", 99), (6, "f" * 16, 6), (7, "f" * 17, 3), (8, " " + "f" * 16, None)]
    files = spark.createDataFrame([(*r, "x", "y") for r in rows], "id long, phash string, vstack_id long, a string, b string")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 77), (5, 1), (None, 1), (6, 6), (7, 1), (8, 2)], "id_a long, id_b long")
    got = {r["id"]: r["group_id"] for r in match_groups(files, pairs).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 8: 1, 3: 3, 7: 3}
