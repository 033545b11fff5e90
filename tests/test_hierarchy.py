import random

from lumencase.operators.hierarchy import descendants, hierarchy, holdings

SCHEMA = "id long, container_id long, node string, up string"


def rows_of(spark, parents):
    return spark.createDataFrame([(i, p, "x", "y") for i, p in parents.items()], SCHEMA)


def expected(parents):
    out = {}
    for i, p in parents.items():
        if p is None:
            continue
        way, seen = [i], {i}
        while (up := parents.get(way[-1])) is not None and up in parents:
            if up in seen:
                way = None
                break
            seen.add(up)
            way.append(up)
        out[i] = (-1, -1, "") if way is None else (way[-1], len(way) - 1, "/".join(map(str, reversed(way))))
    return out


def found(df):
    return {r["id"]: (r["root_id"], r["depth"], r["id_path"]) for r in df.collect()}


def test_random_forest_with_circles_deep_chains_and_broken_links(spark):
    rng = random.Random(5)
    parents = {i: (rng.choice([None, rng.randrange(1, 400), i, 10_000 + i]) if i < 400 else i - 1) for i in range(1, 460)}
    assert found(hierarchy(rows_of(spark, parents))) == expected(parents)


def test_a_chain_longer_than_any_round(spark):
    parents = {1: None} | {i: i - 1 for i in range(2, 60)}
    got = found(hierarchy(rows_of(spark, parents)))
    assert got == expected(parents)
    assert got[59][1] == 58


def test_circle_and_what_hangs_below_it(spark):
    parents = {1: 2, 2: 3, 3: 1, 4: 3, 5: 4, 6: 6}
    assert set(found(hierarchy(rows_of(spark, parents))).values()) == {(-1, -1, "")}


def test_one_container_holds_most_rows(spark):
    parents = {1: None} | {i: 1 for i in range(2, 3000)}
    df = rows_of(spark, parents)
    assert found(hierarchy(df))[2999] == (1, 1, "1/2999")
    assert {r["id"]: r["n_held"] for r in holdings(df).collect()} == {1: 2998}


def test_empty_table_null_ids_and_clashing_columns(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, 1, "a", "b"), (1, None, "a", "b"), (2, 1, "a", "b")], SCHEMA)
    assert found(hierarchy(df)) == {2: (1, 1, "1/2")}


def test_descendants_name_every_container_above(spark):
    parents = {1: None, 2: 1, 3: 2, 4: 3}
    assert {tuple(r) for r in descendants(rows_of(spark, parents)).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 3), (2, 4, 2), (3, 4, 1)}
