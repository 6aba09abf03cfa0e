import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusweave.llm.queries import QUERIES
from corpusweave.llm.toxicity import (
    _TOKEN,
    BACKWARD,
    EVENTS,
    FORWARD,
    PRIORS,
    Lexicon,
    ToxicityModel,
    _matcher,
    _surroundings,
    _term_counts,
    clause_events,
    drop_toxic,
    event_features,
    fit_toxicity,
    toxicity_score,
)

WORDS = Lexicon(words=("blargh",), stems=("zorp",))


def events(text, lexicon=WORDS):
    return [e for _, _, e in clause_events(text, lexicon)]


def test_clauses_are_matched_not_words():
    assert events("what a blargh") == ["insult"]
    assert events("you are a blargh.") == ["insult+target"]
    assert events("blargh, all of you") == ["insult", "insult+target"]
    assert events("that is not a blargh") == ["insult+negated"]
    assert events("she said what a blargh") == ["insult+reported"]
    assert events('he said "blargh" and a blargh') == ["insult+reported", "insult"]
    assert events("Zorpified zorpings") == ["insult", "insult"]
    assert events("blarghs unblargh") == []


def test_scopes_end():
    assert events("not today. a blargh") == ["insult"]
    assert events("not one two three a blargh") == ["insult"]
    assert events("you one two three four five blargh") == ["insult"]


def test_threats_need_a_target():
    assert events("I will kill you") == ["threat"]
    assert events("kill the process") == []
    assert events("never hurt them") == ["threat+negated"]
    assert events("he wrote kill them") == ["threat+reported"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Take out the trash and the filth.", []),
        ("The garbage collection runs on Monday.", []),
        ("We use garbage collection here", []),
        ("This clown fish is stupid cheap.", []),
        ("They take out the trash", []),
        ("We beat the team and burn the candle", []),
        ("The engine will die soon, he said", []),
        ("You are a clown", ["insult+target"]),
        ("you clown", ["insult+target"]),
        ("You’re trash", ["insult+target"]),
        ("I will kill you.", ["threat"]),
        ("I hate you and hope you die", ["threat", "threat"]),
        ('"You are an idiot," he said.', ["insult+reported"]),
        ('"You are an idiot!" she wrote', ["insult+reported"]),
        ("“Kill them all”, he claimed", ["threat+reported"]),
        ("Don't you dare, idiot!", ["insult+target"]),
        ("you are not a clown", ["insult+negated"]),
        ("It is not so. You idiot", ["insult+target"]),
    ],
)
def test_senses_reports_and_wishes(text, want):
    assert events(text) == want


def test_plain_senses_stay_below_the_threshold(spark):
    docs = spark.createDataFrame(
        [
            (0, "Take out the trash and the filth."), (1, "The garbage collection runs on Monday."),
            (2, "This clown fish is stupid cheap."), (3, "We beat the team."), (4, "He said 'you' is a word"),
            (5, "I will kill you."), (6, "I hate you and hope you die"), (7, "You are a clown"), (8, "you moron"),
            (9, '"You are an idiot," he said.'), (10, "You are not an idiot"),
        ],
        "doc_id long, text string",
    )
    model = fit_toxicity(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")))
    assert {r.doc_id for r in drop_toxic(docs, model).collect()} == {0, 1, 2, 3, 4, 9, 10}


def plain_events(text, lexicon):
    """The machines of each direction one after another over the symbols of a clause."""
    symbols = _matcher(lexicon).symbols(_TOKEN.findall(text.lower()))

    def run(machine, tape):
        out, state = [], machine.start
        for symbol in tape:
            state, said = machine(state, symbol)
            out.append(said)
        return out

    tape = symbols[::-1]
    for machine in BACKWARD:
        tape = run(machine(), tape)
    tape = tape[::-1]
    for machine in FORWARD:
        tape = run(machine(), tape)
    return [e for e in tape if e]


VOCABULARY = (
    "you are is the a not never said hope die kill hate blargh zorpy trash clown fish cheap word , \" “ idiot he them"
).split()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(VOCABULARY), max_size=14))
def test_composed_machines_say_what_single_ones_say(words):
    text = " ".join(words)
    want = plain_events(text, WORDS)
    # A clause is only read if it holds a word that can start an event.
    assert events(text) == want or (not want and not events(text))


def test_given_documents_against_single_machines(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for text in texts:
        clauses = {(a, b) for a, b, _ in clause_events(text, WORDS)}
        for a, b in clauses:
            want = plain_events(text[a:b], WORDS)
            assert [e for x, y, e in clause_events(text, WORDS) if (x, y) == (a, b)] == want


def test_positions_are_those_of_the_clause():
    text = "Fine. What a blargh! Good."
    (start, end, _), = clause_events(text, WORDS)
    assert text[start:end] == " What a blargh!"


def test_events_are_known():
    text = "you blargh. not you blargh, said you kill you, not kill you. kill you"
    assert set(events(text)) <= set(EVENTS)
    assert len(event_features(text, WORDS)) == len(EVENTS)


def labelled(spark):
    # Words in a third of the rows, all of them toxic, in several forms.
    rows, labels = [], []
    forms = ("krunka", "krunkeb", "krunkic", "krunkod")
    for i in range(240):
        toxic = i % 3 == 0
        around = "".join(chr(97 + int(d)) for d in str(i))
        rows.append((i, f"plain text {around} " + (forms[i % 4] if toxic else "calm") + " ends"))
        labels.append((i, int(toxic), 1))
    docs = spark.createDataFrame(
        [(i, t, "x", 0.5, 1) for i, t in rows], "doc_id long, text string, score string, label double, _key int"
    )
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_stems_are_learned(spark):
    docs, labels = labelled(spark)
    model = fit_toxicity(docs, labels)
    assert "krun" in model.lexicon.stems and not model.lexicon.words
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(240) if i % 3]


def test_copies_of_a_passage_are_one_witness(spark):
    rows = [(i, "the same harmless passage " if i % 3 == 0 else f"clean {chr(97 + i % 26)} row") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert fit_toxicity(docs, labels).lexicon == Lexicon()


def test_batches_of_one_label_or_without_terms(spark):
    for label in (0, 1):
        sample = spark.createDataFrame([("zorped again", label), ("", label)], "text string, label int").coalesce(1)
        counts = {(r.term, r.toxic, r.clean) for r in _term_counts(sample).collect()}
        assert ("zorped", label, 1 - label) in counts and ("agai*", label, 1 - label) in counts
    none = spark.createDataFrame([("", 1), ("a", 0)], "text string, label int").coalesce(1)
    assert not _term_counts(none).collect()
    assert _surroundings(none, {"zorped"}) == {}


def test_odd_rows(spark, long_text):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (None, "you blargh"), (3, long_text + "you blargh"), (3, long_text), (3, long_text)],
        "doc_id long, text string",
    )
    model = ToxicityModel(WORDS, tuple(PRIORS.values()), -3.0)
    scores = [r[0] for r in docs.select(toxicity_score(model)("text")).collect()]
    assert scores[0] == scores[1] == scores[4] == scores[5] < 0.7 < scores[2] == scores[3]
    assert all(0 <= s <= 1 for s in scores)
    assert drop_toxic(docs, model).count() == 4


def test_without_labels_the_priors_hold(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(None, 1), (1, None)]):
        model = fit_toxicity(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert model.weights == tuple(PRIORS.values()) and model.lexicon == Lexicon()
    empty = docs.limit(0)
    assert drop_toxic(empty, fit_toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_held_out_accuracy(spark):
    rows = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert not any(p and not y for p, y in held)
    assert len(rows) == 1000 and all(r.predicted == (r.score >= 0.7) for r in rows)
