import random

from lumencase.llm.subjects import composition, document_subjects, sentence_type, sentences

KNOWN = {"sport": ["The referee stopped the bout after {n} rounds.", "A goalkeeper in the box wears the away kit of the club."], "finance": ["The bank froze the card once the merchant code changed {n} times.", "A transfer of {n} left the account and came back two days later."]}
#: Sentences no example shows; their subject has to come from the documents they stand in.
NEW = {"sport": ["Compare the penalty shot with the league table in item {n}.", "The half time score came {n} days before the relay baton."], "finance": ["Compare the exchange rate with the ledger page in item {n}.", "The pension fund came {n} days before the wire transfer."]}
PLAIN = ["Left open is row {n} as the preview did not load.", "This note replaces the one of day {n} in the binder.", "Please tick the box once it is back on the shelf."]


def corpus(spark, n=160):
    rng = random.Random(9)
    rows, truth = [], {}
    for i in range(n):
        subjects = rng.choice([[], *[["sport"], ["finance"]] * 3, ["sport", "finance"]])
        said = []
        for s in subjects:
            said += [rng.choice(KNOWN[s]) for _ in range(2)] + [rng.choice(NEW[s]) for _ in range(2)]
        other = [s for s in KNOWN if s not in subjects]
        if other and subjects and rng.random() < 0.3:
            said.append(rng.choice(KNOWN[other[0]]))  # a remark in passing
        said += [rng.choice(PLAIN) for _ in range(3)]
        rng.shuffle(said)
        rows.append((i, rng.choice([" ", "\n"]).join(s.format(n=rng.randrange(900)) for s in said), "s", 1))
        truth[i] = set(subjects)
    examples = [(k, s, " ".join(x.format(n=k) for x in KNOWN[s])) for k, s in enumerate(KNOWN)] + [(9, "unknown", "The bout."), (10, None, "x"), (11, "sport", None)]
    return (
        spark.createDataFrame(rows + [(1000, None, "s", 1), (1001, "", "s", 1), (None, "x", "s", 1)], "doc_id long, text string, subject string, n int"),
        spark.createDataFrame(examples, "example_id long, subject string, text string"),
        spark.createDataFrame([("sport", "d"), ("finance", "d"), (None, "d")], "subject string, description string"),
        truth,
    )


def test_known_and_new_sentences_several_subjects_and_remarks(spark):
    documents, examples, areas, truth = corpus(spark)
    got = {}
    for r in document_subjects(documents, examples, areas).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    wrong = sum(got.get(i, set()) != want for i, want in truth.items())
    assert wrong <= 0.05 * len(truth)
    assert not {1000, 1001} & set(got)


def test_empty_tables(spark):
    documents, examples, areas, _ = corpus(spark, 4)
    assert document_subjects(documents.limit(0), examples, areas).count() == 0
    assert document_subjects(documents, examples.limit(0), areas).count() == 0
    assert document_subjects(documents, examples, areas.limit(0)).count() == 0
    assert composition(documents, examples, areas).count() <= 2


def test_sentences_and_types():
    assert sentences("- One is here. Two\nis wrapped. \n\nThree!") == ["One is here.", "Two is wrapped.", "Three!"]
    assert sentences("") == []
    key, terms = sentence_type("The bank froze 12 cards of Varesh in IMG_1.png.")
    assert key == "bank froze # cards of @ in #"
    assert "bank froze" in terms and "froze #" not in terms


def test_very_long_text(spark):
    _, examples, areas, _ = corpus(spark, 4)
    text = "The referee stopped the bout after 3 rounds. " * 50_000
    got = document_subjects(spark.createDataFrame([(1, text)], "doc_id long, text string"), examples, areas).collect()
    assert [(r["doc_id"], r["subject"], r["sentences"]) for r in got] == [(1, "sport", 50_000)]
