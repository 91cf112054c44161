"""Properties over generated texts."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lektra.llm import confusables, contamination, languages, sentences

ANY = st.text(alphabet=st.characters(max_codepoint=0xFFFF, exclude_categories=("Cs",)), max_size=60)
LIKELY = st.text(alphabet="αβγδοvpɣıtoа еcάέὶῳᾧςσ́̓​ .;·»«\"'?!κτλM1\n", max_size=60)
TEXT = st.one_of(ANY, LIKELY)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_a_form_is_its_own_form(s):
    form = confusables.mapped_form(s)
    assert confusables.mapped_form(form) == form


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 9))
def test_sentences_cover_the_text_whatever_the_chunks(s, width):
    got = sentences.spans([s])[0]
    assert sentences.spans([s], width=width)[0] == got
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    assert "".join("".join(s[a:b] for a, b in got).split()) == "".join(s.split())


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_languages_give_ordered_stretches(texts):
    model = languages.fit([("a", "αβγδ σσ ος"), ("b", "vpt to ec cat")])
    for t, found in zip(texts, languages.detect(model, texts)):
        assert found and all(0 <= a <= b <= len(t) for a, b, _, _ in found)
        assert all(x[1] <= y[0] and x[2] != y[2] for x, y in zip(found, found[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=40), min_size=1, max_size=4),
       st.lists(st.sampled_from("abcd"), max_size=60))
def test_noted_matches_are_common_runs(items, doc):
    a = contamination.Automaton(list(enumerate(items)))
    ids = a.numbers(doc)
    import numpy as np

    notes = a.notes(ids, np.array(ids, dtype=np.int64))
    for n, found in notes.items():
        for (diag, end), length in found.items():
            assert doc[end - length + 1:end + 1] == items[n][end - diag - length + 1:end - diag + 1]
    for n, item in enumerate(items):
        runs = [
            (d, i) for d in range(len(doc)) for i in range(len(item))
            if doc[d:d + contamination.SEED] == item[i:i + contamination.SEED] and len(item) - i >= contamination.SEED
            and len(doc) - d >= contamination.SEED]
        for d, i in runs:
            assert any(diag == d - i and end - length + 1 <= d and end >= d + contamination.SEED - 1
                       for (diag, end), length in notes.get(n, {}).items())
