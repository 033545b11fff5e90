import random

from lumencase.operators.components import min_labels


def brute(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_random_graphs_with_long_paths_repeats_and_nulls(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    rows = edges + edges[:20] + [(b, a) for a, b in edges[:20]] + [(None, 1), (2, None)]
    got = {r["node"]: r["label"] for r in min_labels(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == brute([(a, b) for a, b in edges if a != b])


def test_no_edges(spark):
    assert min_labels(spark.createDataFrame([], "a long, b long")).count() == 0
