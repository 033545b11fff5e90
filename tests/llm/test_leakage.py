import random

from lumencase.llm.leakage import item_report, leak_report, leaks, window_hits

WORDS = "alpha beta gamma delta cellar lamp drawer report window margin seal label order copy frame archive".split()


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, item_id string, kind string")


def items(spark, *texts):
    return spark.createDataFrame([(100 + i, t, "s") for i, t in enumerate(texts)], "item_id long, text string, suite string")


ITEM = "Before the generator failed, seventeen grainy stills from Morava were restored by a visiting engineer because the labels had faded in Gudich after 12 days."


def found(spark, doc, item=ITEM):
    return leaks(docs(spark, doc), items(spark, item)).count() == 1


def test_appearance_makes_no_difference(spark):
    part = "seventeen grainy stills from Morava were restored by a visiting engineer because"
    for text in (part, part.upper(), part.replace(" ", "_"), part.replace(" ", " - "), part.replace("grainy", "gra­i​ny"), part.replace("f", "ｆ"), "x " + part.replace(" ", "\n") + " y", part.replace("st", "ﬆ"), "**" + part + "**"):
        assert found(spark, text), text


def test_eleven_words_or_a_changed_word_are_no_leak(spark):
    assert not found(spark, "grainy stills from Morava were restored by a visiting engineer because")
    assert not found(spark, "seventeen grainy stills from Morava were mended by a visiting engineer because the labels")


def test_re_parameterised_items_are_told_from_verbatim_ones(spark):
    item = "Long before that the clerk near Morava had put 12 frames of Gudich under a lamp for Selat because it rained"
    changed = item.replace("Morava", "Zoruwen").replace("12", "99").replace("Gudich", "Tarotha").replace("Selat", "Belin")
    got = {(r["doc_id"], r["kind"]) for r in leak_report(docs(spark, changed, item), items(spark, item)).collect()}
    assert got == {(0, "re-parameterised"), (1, "verbatim")}
    assert leaks(docs(spark, changed), items(spark, item)).count() == 0


def test_slots_must_be_replaced_consistently(spark):
    item = "the keeper saw Morava and then Morava again and after that also Gudich near it"
    fine = "the keeper saw Zoru and then Zoru again and after that also Tarot near it"
    mixed = "the keeper saw Zoru and then Tarot again and after that also Belin near it"
    kinds = {r["doc_id"]: r["kind"] for r in window_hits(docs(spark, fine, mixed), items(spark, item)).where("item_at = 0").collect()}
    assert kinds == {0: "re-parameterised", 1: "resemblance"}


def test_random_texts_against_brute_force(spark):
    rng = random.Random(8)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    item_words = [text(rng.randrange(8, 40)) for _ in range(8)]
    doc_words = []
    for _ in range(60):
        w = text(rng.randrange(0, 40))
        source = rng.choice(item_words)
        n = rng.randrange(8, 16)
        doc_words.append(w + source[:n] + text(5) if rng.random() < 0.7 else w)
    want = {(d, 100 + i) for d, w in enumerate(doc_words) for i, it in enumerate(item_words) if any(it[a : a + 12] == w[b : b + 12] for a in range(len(it) - 11) for b in range(len(w) - 11))}
    got = {tuple(r) for r in leaks(docs(spark, *map(" ".join, doc_words)), items(spark, *map(" ".join, item_words))).collect()}
    assert got == want and want


def test_nulls_empty_and_very_long_texts(spark):
    long = "filler word " * 200_000 + ITEM
    assert {r["doc_id"] for r in leaks(docs(spark, None, "", long), items(spark, ITEM, None, "")).collect()} == {2}
    assert leaks(docs(spark), items(spark, ITEM)).count() == 0
    assert leaks(docs(spark, ITEM), items(spark)).count() == 0
    assert sorted(tuple(r) for r in item_report(docs(spark, ITEM, ITEM), items(spark, ITEM, "other")).collect()) == [(100, 2, 0), (101, 0, 0)]
