"""Leaked passages: what must be noted, and what must count."""

import random

import numpy as np
import pyarrow.parquet as pq

from lektra.llm import contamination


def numbered(n, prefix="w"):
    return [f"{prefix}{k}" for k in range(n)]


def automaton(*items):
    return contamination.Automaton(list(enumerate(items)))


def found(items, doc):
    return {n for n, _, _ in contamination.find([automaton(*items)], " ".join(doc))}


def test_an_item_inside_a_longer_match_with_another_is_noted():
    whole = numbered(60)
    inner = numbered(20, "p") + whole[15:45] + numbered(20, "q")
    other = numbered(10, "r") + whole[20:42]
    doc = numbered(30, "x") + whole + numbered(30, "y")
    assert found([whole, inner, other], doc) == {0, 1, 2}
    assert found([other, inner, whole], doc) == {0, 1, 2}
    # windows that slide along one passage
    windows = [whole[k:k + 25] for k in range(0, 36, 5)]
    assert found(windows, doc) == set(range(len(windows)))


def test_notes_are_the_maximal_common_runs():
    rnd = random.Random(3)
    for _ in range(60):
        items = [[rnd.choice("abc") for _ in range(rnd.randint(8, 40))] for _ in range(4)]
        doc = [rnd.choice("abc") for _ in range(60)]
        a = automaton(*items)
        ids = a.numbers(doc)
        got = {(n, diag, end, l) for n, f in a.notes(ids, np.array(ids)).items() for (diag, end), l in f.items()}
        want = set()
        for n, item in enumerate(items):
            for d in range(len(doc)):
                for i in range(len(item)):
                    if doc[d] != item[i] or (d and i and doc[d - 1] == item[i - 1]):
                        continue
                    l = 0
                    while d + l < len(doc) and i + l < len(item) and doc[d + l] == item[i + l]:
                        l += 1
                    if l >= contamination.SEED:
                        want.add((n, d - i, d + l - 1, l))
        assert got == want


ITEM = numbered(60)
OTHER = numbered(40, "z") + ITEM[30:36]


def test_two_stretches_with_other_words_between_them():
    put = numbered(10, "x")
    assert found([ITEM], ITEM[5:20] + put + ITEM[30:45]) == {0}
    assert found([ITEM], ITEM[5:15] + numbered(40, "x") + ITEM[55:60] + put) == set()  # 15 words
    assert found([ITEM], ITEM[:12] + numbered(30, "x") + ITEM[42:52]) == {0}
    assert found([ITEM], ITEM[:12] + numbered(50, "x") + ITEM[42:52]) == set()  # too far
    assert found([ITEM], ITEM[42:52] + put + ITEM[:12]) == set()  # not in order


def test_a_short_part_beside_a_long_one_counts_unless_it_is_stock_wording():
    put = numbered(10, "x")
    assert found([ITEM], ITEM[:19] + put + ITEM[19:26]) == {0}
    assert found([ITEM], ITEM[:7] + put + ITEM[7:26]) == {0}
    assert found([ITEM], ITEM[:16] + put + ITEM[30:35]) == {0}
    assert found([ITEM, OTHER], ITEM[:16] + put + ITEM[30:35]) == set()
    # an item that shares the passage does not make it stock wording
    assert found([ITEM, numbered(9, "z") + ITEM[5:45]], ITEM[:16] + put + ITEM[30:35]) >= {0}


def test_a_dense_run_counts_whatever_is_chained_to_it():
    run = ITEM[20:42]
    assert found([ITEM], run) == {0}
    doc = ITEM[6:9] + numbered(4, "x") + ITEM[13:16] + numbered(4, "y") + run
    assert found([ITEM], doc) == {0}
    a = automaton(ITEM)
    # 25 of 29 words; with the first match it would be 28 of 36, under DENSE
    assert contamination.leak(contamination.chain(a.exact_runs(a.numbers(doc), 0, 0, len(doc)))) == (25, [(7, 36)])


def test_runs_of_three_and_four_words_make_a_leak():
    item = numbered(60)

    def doc(*sizes):
        out, at = numbered(8, "x"), 10
        for k, n in enumerate(sizes):
            out += item[at:at + n] + [f"y{k}"]
            at += n + 1
        return out + numbered(8, "z")

    assert found([item], doc(8, 4, 4, 4)) == {0}  # 20 of 23
    assert found([item], doc(4, 4, 4, 4, 4)) == {0}  # 20 of 24
    assert found([item], doc(4, 4, 3, 3, 3, 3)) == {0}  # 20 of 25
    assert found([item], doc(3, 3, 3, 3, 3, 3, 3)) == set()  # 21 of 27, under DENSE
    assert found([item], doc(5, 5, 5)) == set()


def test_nothing_that_the_check_of_all_pairs_finds_is_lost():
    rnd = random.Random(5)
    vocab = numbered(200)
    items = [[rnd.choice(vocab) for _ in range(40)] for _ in range(8)]
    for k in range(1, 8):  # shared pieces
        items[k][5:5 + k] = items[0][5:5 + k]
    docs = []
    for _ in range(150):
        at, item = rnd.randint(0, 12), rnd.choice(items)
        part = [w for w in item[at:at + rnd.randint(18, 34)] if rnd.random() > 0.05]
        part = [rnd.choice(vocab) if rnd.random() < 0.15 else w for w in part]
        cut = rnd.randint(0, len(part))
        docs.append(numbered(9, "x") + part[:cut] + numbered(rnd.choice([0, 0, 3, 12]), "y") + part[cut:])
    a, both = automaton(*items), 0
    for doc in docs:
        ids = a.numbers(doc)
        want = {
            n for n in range(len(items))
            if contamination.leak(contamination.chain(a.exact_runs(ids, n, 0, len(ids))), lambda s, l: a.stock(n, s, l))}
        assert found(items, doc) == want
        both += len(want)
    assert both > 30


def test_nothing_is_lost_on_a_test_table():
    rows = {t: pq.read_table(f"/root/testdata/sf0.001/{t}.parquet").to_pylist() for t in ("eval_passages", "documents")}
    a = contamination.build((r["item_id"], r["text"]) for r in rows["eval_passages"])[0]
    for r in rows["documents"]:
        ids = a.numbers(contamination.WORD.findall(r["text"] or ""))
        want = {
            a.items[n] for n in range(len(a.items))
            if contamination.leak(contamination.chain(a.exact_runs(ids, n, 0, len(ids))), lambda s, l: a.stock(n, s, l))}
        assert {n for n, _, _ in contamination.find([a], r["text"] or "")} == want


def test_an_item_that_ends_before_an_unknown_word_is_noted():
    item = numbered(25)
    other = item[:20] + numbered(5, "o")
    for doc in (item + ["?"] + item[:6], item[3:] + ["?"] + other[12:] + ["?"], other + ["?"] + item):
        want = {n for n, it in enumerate((item, other)) if any(it[k:k + 20] == doc[d:d + 20] for k in range(6) for d in range(len(doc) - 19))}
        assert found([item, other], doc) == want
        a = automaton(item, other)
        ids = a.numbers(doc)
        notes = a.notes(ids, np.array(ids))
        for n in range(2):
            runs = {(e - l + 1, e - l + 1 - g, l) for (g, e), l in notes.get(n, {}).items()}
            assert runs == set(a.exact_runs(ids, n, 0, len(ids)))


def spans_of(items, doc, short=False):
    return {n: (w, s) for n, w, s in contamination.find([automaton(*items)], " ".join(doc), short)}


def test_every_stretch_of_an_item_is_found():
    fill = numbered(80, "x")
    assert spans_of([ITEM], ITEM + fill + ITEM[10:50])[0] == (60, [(0, 60), (140, 180)])
    parts = ITEM[:22] + fill + ITEM[22:40] + numbered(50, "y") + ITEM[40:60]
    assert spans_of([ITEM], parts)[0] == (22, [(0, 22), (102, 120), (170, 190)])
    # what is left of a leaked item beside the leak goes with it
    assert spans_of([ITEM], ITEM[:30] + numbered(6, "x") + ITEM[45:55])[0] == (30, [(0, 30), (36, 46)])
    assert spans_of([ITEM], ITEM[45:55]) == {}


def test_long_runs_and_steady_edits_are_found_whole():
    item = numbered(1400)
    doc = item[:600] + ["q"] + item[601:]
    assert spans_of([item], doc)[0] == (1399, [(0, 1400)])
    item = numbered(60)
    assert spans_of([item], ["q" if k % 5 == 4 else w for k, w in enumerate(item)])[0] == (48, [(0, 59)])


def test_short_items_leak_by_coverage():
    item = numbered(12)
    doc = numbered(5, "x") + item + numbered(5, "y")
    assert spans_of([item], doc) == {}
    assert spans_of([item], doc, short=True) == {0: (12, [(5, 17)])}
    assert spans_of([item], doc[:14], short=True) == {}  # 9 of 12
    assert spans_of([item[:7]], doc, short=True) == {}


def test_clean_text_holds_nothing_of_a_twice_leaked_item(spark):
    text = " ".join(numbered(30, "x") + ITEM + numbered(90, "y") + ITEM[5:45] + numbered(9, "z"))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "a b"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(ITEM)), (6, None)], "item_id long, text string")
    found = contamination.leaks(spark, docs.distinct(), items, short=True)
    clean = {r.doc_id: r.clean_text for r in contamination.removed(docs, found).collect()}
    assert clean[2] == "a b" and clean[3] is None
    assert not set(clean[1].split()) & set(ITEM)
