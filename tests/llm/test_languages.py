"""Short units inside a text of another language."""

import random

import numpy as np

from lektra.llm import languages

EN = "the old scribe of the mill explains the names of the ships "
LA = "servum amat dominus et puellae in silva portant aquam "
MODEL = languages.fit([("en", EN * 5), ("la", LA * 5), ("en", EN), ("la", LA)])


def langs(text):
    return [x[2] for x in languages.detect(MODEL, [text])[0]]


def test_neighbouring_short_sentences_make_a_stretch():
    around = EN.strip() + ". "
    assert langs(around * 2 + "Puellae portant aquam. Servum amat dominus. " + around * 2) == ["en", "la", "en"]
    # a phrase of three words in all is no stretch, in one sentence or in two
    assert langs(around * 2 + "Puellae portant aquam. " + around * 2) == ["en"]
    assert langs(around * 2 + "Puellae portant. Aquam. " + around * 2) == ["en"]
    # two phrases apart from each other are no stretch either
    assert langs(around + "Puellae portant aquam. " + around + "Servum amat dominus. " + around) == ["en"]


def test_weights_of_short_units():
    a, b = [5.0, 0.0], [0.0, 5.0]
    cases = [
        ([a, b, b, a], [9, 3, 3, 9], [1, 1, 1, 1]),
        ([a, b, b, a], [9, 2, 1, 9], [1, 0.25, 0.25, 1]),
        ([a, b, a, b, a], [9, 3, 2, 3, 9], [1, 0.25, 0.25, 0.25, 1]),
        ([a, b, b, b, a], [9, 3, 9, 3, 9], [1, 0.25, 1, 0.25, 1]),
        ([a, b, [0.0, 0.0], b], [9, 2, 0, 2], [1, 1, 0.25, 1]),
        ([a, b], [3, 3], [1, 1]),
    ]
    for scores, sizes, want in cases:
        assert languages._weights(np.array(scores), np.array(sizes)).tolist() == want
    assert languages._weights(np.zeros((0, 2)), np.zeros(0, dtype=np.int64)).tolist() == []


def _toy_model(k=2, seed=1):
    rnd = random.Random(seed)
    vocab = {f"l{j}": ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(40)] for j in range(k)}
    text = lambda j, n: " ".join(rnd.choices(vocab[f"l{j}"], k=n))
    return vocab, text, languages.fit([(f"l{j}", text(j, 60) + ".") for j in range(k) for _ in range(6)])


def test_two_languages_without_a_mark_between_them():
    _, text, model = _toy_model()
    for a, b in ((40, 30), (13, 37), (60, 11)):
        left, right = text(0, a), text(1, b)
        got = languages.detect(model, [f"{left} {right}"])[0]
        assert [(x[0], x[1], x[2]) for x in got] == [(0, len(left), "l0"), (len(left) + 1, len(left) + 1 + len(right), "l1")]
    assert [x[2] for x in languages.detect(model, [text(0, 100)])[0]] == ["l0"]


def test_more_labels_than_a_hundred(spark):
    _, text, model = _toy_model(120)
    assert len(model.langs) == 120
    assert all(languages.detect(model, [text(j, 12)])[0][0][2] == f"l{j}" for j in range(0, 120, 7))
    rows = [(i, f"l{i % 120}", "word " * 12) for i in range(600)]
    got = languages.sample(spark.createDataFrame(rows, "k long, lang string, t string"), "k", "t", "lang")
    assert len({lang for lang, _ in got}) == 120
