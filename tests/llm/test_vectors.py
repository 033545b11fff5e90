import numpy as np
import pytest

from lumencase.llm import vectors
from lumencase.llm.vectors import SmallWorld, nearest, recall_report, similar_pairs

SCHEMA = "id long, embedding array<float>, v string, cell string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if y is None else float(y) for y in x], "a", "b") for i, x in rows], SCHEMA)


def people(n, size, seed, spread=0.35):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(max(1, n // 12), size))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    x = centre[rng.integers(0, len(centre), n)] + spread * rng.normal(size=(n, size)) / np.sqrt(size)
    return (x * rng.uniform(0.5, 20, n)[:, None]).astype(np.float32)


def brute(ids, x, k, least):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i and s[i, j] >= least), key=lambda j: (-round(s[i, j], 6), ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order}
    return out


def test_graph_finds_the_neighbours():
    x = people(4000, 32, 1)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = SmallWorld(x)
    got, _ = graph.search(x[:500], 11)
    s = x[:500] @ x.T
    want = np.argsort(-s, axis=1)[:, :11]
    assert np.mean([len(set(a) & set(b)) / 11 for a, b in zip(got, want)]) > 0.95


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40, 65, 200])
def test_small_graphs(n):
    x = np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32)
    ids, _ = SmallWorld(x).search(x, 3)
    assert ids.shape == (n, 3) or n == 0
    assert all((row >= 0).sum() == min(3, n) for row in ids)


def test_pairs_against_brute_force_over_split_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 300)
    monkeypatch.setattr(vectors, "SHARD_ROWS", 250)
    x = people(1200, 128, 2)
    ids = list(range(10, 1210))
    got = {tuple(r) for r in similar_pairs(table(spark, zip(ids, x.tolist(), strict=True)), 10, 0.7).collect()}
    want = brute(ids, x, 10, 0.7)
    assert len(got & want) >= 0.95 * len(want)
    assert len(got - want) <= 0.05 * len(want)


def test_centroids_in_two_steps_a_hot_cell_cut_again_and_queries_in_parts(spark, monkeypatch):
    for name, value in (("CELL_ROWS", 100), ("SHARD_ROWS", 120), ("FIT_CELLS", 4), ("FIT_ROWS", 32), ("ASKING_ROWS", 150)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(8)
    # a third of the rows is one dense cloud that no centroid can part well
    x = np.vstack([people(900, 128, 6), np.eye(128)[0] + 0.02 * rng.normal(size=(450, 128))]).astype(np.float32)
    ids = list(range(1350))
    got = {tuple(r) for r in similar_pairs(table(spark, zip(ids, x.tolist(), strict=True)), 10, 0.7).collect()}
    want = brute(ids, x, 10, 0.7)
    assert len(got & want) >= 0.85 * len(want)  # cells of a hundred vectors, far smaller than in use


def test_copies_rank_by_id_and_none_is_lost(spark):
    a, b = np.eye(128)[0], np.eye(128)[0] * 0.9 + np.eye(128)[1] * 0.1
    rows = [(i, (a * (1 + i)).tolist()) for i in range(1, 31)] + [(100, b.tolist())]
    got = {(r["id"], r["rank"]): r["other"] for r in nearest(table(spark, rows), 10, 0.7).collect()}
    assert [got[30, r] for r in range(1, 11)] == list(range(1, 11))
    assert [got[1, r] for r in range(1, 11)] == list(range(2, 12))
    assert [got[100, r] for r in range(1, 11)] == list(range(1, 11))


def test_unusable_vectors_repeated_rows_and_empty_tables(spark):
    good = [1.0] + [0.0] * 127
    rows = [(1, good), (1, good), (2, good), (3, None), (4, [1.0] * 127), (5, [0.0] * 128), (6, [float("nan")] * 128), (7, [None] * 128), (8, [float("inf")] + [1.0] * 127), (None, good)]
    assert {tuple(r) for r in similar_pairs(table(spark, rows)).collect()} == {(1, 2)}
    assert similar_pairs(table(spark, [])).count() == 0
    assert similar_pairs(table(spark, rows[:1])).count() == 0


def test_recall_report(spark):
    x = people(600, 128, 3)
    r = recall_report(table(spark, zip(range(600), x.tolist(), strict=True)), every=10).first()
    assert r["queries"] > 0 and r["recall"] >= 0.9
    assert r["missed"] == r["true_neighbours"] - round(r["recall"] * r["true_neighbours"])


def test_a_vector_on_a_third_of_rows_meets_its_neighbours_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 40)
    rng = np.random.default_rng(4)
    hot = rng.normal(size=128)
    hot /= np.linalg.norm(hot)
    around = hot + 0.6 * rng.normal(size=(100, 128)) / np.sqrt(128)
    x = np.vstack([np.repeat(hot[None, :], 750, axis=0), around, people(1200, 128, 5)])
    order = rng.permutation(len(x))
    got = nearest(table(spark, [(int(i), x[i].tolist()) for i in order]), 10, 0.7).where("other < 750").select("id").distinct().collect()
    assert len({r["id"] for r in got} & set(range(750, 850))) >= 95


def test_pairs_that_meet_in_no_cell_are_found_through_others(spark, monkeypatch):
    # cells that no face has shaped, as if each held thousands of people; faces of one person are at about 0.77
    c = np.random.default_rng(12).normal(size=(200, 128)).astype(np.float32)
    monkeypatch.setattr(vectors, "centroids", lambda *_: c / np.linalg.norm(c, axis=1)[:, None])
    x = people(600, 128, 9, 0.55)
    got = {tuple(r) for r in similar_pairs(table(spark, enumerate(x.tolist())), 10, 0.7).collect()}
    want = brute(range(600), x, 10, 0.7)
    assert len(got & want) >= 0.97 * len(want)
    assert len(got - want) <= 0.01 * len(want)


def test_groups_too_large_to_be_compared_whole_are_searched_by_graphs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP_ROWS", 30)
    rng = np.random.default_rng(10)
    x = np.vstack([people(300, 128, 11), np.eye(128)[0] + 0.03 * rng.normal(size=(200, 128))]).astype(np.float32)
    got = {tuple(r) for r in similar_pairs(table(spark, enumerate(x.tolist())), 10, 0.7).collect()}
    want = brute(range(500), x, 10, 0.7)
    assert len(got & want) >= 0.98 * len(want)
    assert len(got - want) <= 0.02 * len(want)
