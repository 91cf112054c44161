"""Alignment without cuts: tiles, runs, long translations, common words."""

import random

import pytest

from lektra.llm import alignment
from tests.llm.test_llm import hard_books


def run(spark, lines, segs, look, lex):
    frames = (
        spark.createDataFrame(lines, "id long, book_id string, line_number int, line_text string"),
        spark.createDataFrame(segs, "id long, book_id string, start_line int, end_line int, translation_text string"),
        spark.createDataFrame(look, "book_id string, line_number int, segment_id long"),
        spark.createDataFrame(lex, "headword string, entry_plain string"))
    return {(r.line_id, r.line_start, r.segment_id, r.segment_start): round(r.score, 4) for r in alignment.align(*frames).collect()}


def words(n, seed):
    rnd = random.Random(seed)
    made = sorted({"".join(rnd.choices("αβγδεζηθικλμνπρτφχ", k=7)) for _ in range(n)})
    return rnd, made, {w: f"en{i}" for i, w in enumerate(made)}


def en(lex, ws):
    return "The " + " and the ".join(lex[w] for w in ws) + "."


def test_tiles_find_what_the_whole_book_gives(spark, monkeypatch):
    lines, segs, look, truth, lex = hard_books(seed=3, books=2)
    # the same sentence lies nearer than its true partner: a partner within a tile is no reason not to look further
    lines.append((900, lines[0][1], 61, lines[4][3]))
    whole = run(spark, lines, segs, look, sorted(lex.items())[:150])
    assert len(whole.keys() & truth) > 0.9 * len(truth)
    monkeypatch.setattr(alignment, "LIMIT", 20)
    assert run(spark, lines, segs, look, sorted(lex.items())[:150]) == whole


@pytest.mark.parametrize("parts", [5, 9])
def test_sentences_rendered_by_many(spark, parts):
    rnd, made, lex = words(24 * parts, 5)
    lines, segs, look, truth = [], [], [], set()
    for n in range(1, 25):
        ws = rnd.sample(made, 4 * parts)
        pieces = [ws[k:k + 4] for k in range(0, len(ws), 4)]
        if n % 2:  # one line, many sentences of the translation
            lines.append((n, "tlg1.w.001", n, " ".join(ws).capitalize() + "."))
            text = [en(lex, p) for p in pieces]
            segs.append((n, "tlg1.w.001", n, n, " ".join(text)))
            truth |= {(n, 0, n, sum(len(t) + 1 for t in text[:k])) for k in range(parts)}
        else:  # many sentences of a line, one of the translation
            text = [" ".join(p).capitalize() + "." for p in pieces]
            lines.append((n, "tlg1.w.001", n, " ".join(text)))
            segs.append((n, "tlg1.w.001", n, n, en(lex, ws)))
            truth |= {(n, sum(len(t) + 1 for t in text[:k]), n, 0) for k in range(parts)}
        look.append(("tlg1.w.001", n, n))
    got = run(spark, lines, segs, look, sorted(lex.items())).keys()
    assert len(got & truth) > 0.95 * len(truth) and len(got & truth) > 0.95 * len(got), (len(got & truth), len(truth), len(got))


def test_translations_over_many_lines_are_matched_whole(spark):
    rnd, made, lex = words(2000, 8)
    lines, segs, truth = [], [], set()
    for b in range(30):
        book, text = f"tlg{b}.w.001", ""
        for n in range(1, 101):
            ws = rnd.sample(made, 5)
            lines.append((b * 1000 + n, book, n, " ".join(ws).capitalize() + "."))
            truth.add((b * 1000 + n, 0, b, len(text)))
            text += en(lex, ws) + " "
        segs.append((b, book, -2**31 + 1 if b == 1 else 1, 2**31 - 1 if b == 0 else 100, text))
    got = run(spark, lines, segs, [("x", 1, 1)], [("x", "y")]).keys()
    assert len(got & truth) > 0.9 * len(truth) and len(got & truth) > 0.9 * len(got), (len(got & truth), len(truth), len(got))


def test_sentences_of_common_words(spark):
    rnd, made, lex = words(300, 9)
    lines, segs, look = [], [], []
    for n in range(1, 201):
        # four words stand in a quarter of the lines each, and once by themselves
        ws = made[:4] if n == 100 else [made[n % 4], *rnd.sample(made[4:], 4)]
        lines.append((n, "tlg1.w.001", n, " ".join(ws).capitalize() + "."))
        segs.append((n, "tlg1.w.001", n, n, en(lex, ws)))
        look.append(("tlg1.w.001", n, n))
    got = run(spark, lines, segs, look, sorted(lex.items())).keys()
    assert (100, 0, 100, 0) in got and len(got) > 190
