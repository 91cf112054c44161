"""Core operators: small fixtures, brute force, plans."""

import datetime as dt
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lektra.functions import text
from lektra.operators import line_alignment, morphology, orphans, skew, tables
from lektra.plans import bookmarks, problems, queries
from lektra.plans.corpus import Corpus

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- text

def brute_n1(s: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower().replace("ς", "σ")
    return "".join(c for c in s if c.isalpha() and ("Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿"))


def test_normalize_greek_against_unicodedata(spark):
    random.seed(1)
    block = [chr(c) for c in [*range(0x370, 0x400), *range(0x1F00, 0x2000)] if unicodedata.category(chr(c))[0] in "LMPS"]
    samples = ["".join(random.choices(block + list("abc ,.;·'"), k=12)) for _ in range(300)]
    samples += ["μῆνιν", "ΛΌΓΟΣ", "", "oris,", "λόγος", None]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    for r in df.select("s", text.normalize_greek(F.col("s")).alias("n")).collect():
        assert r.n == (None if r.s is None else brute_n1(r.s)), r.s
    again = df.select(text.normalize_greek(F.col("s")).alias("n")).select("n", text.normalize_greek(F.col("n")).alias("m"))
    assert again.where("n <> m").count() == 0


def test_tokens_match_str_split(spark):
    samples = ["a b  c", " x y z\n", "", " ", "one　two"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r[0] for r in df.select(text.tokens(F.col("s"))).collect()] == [s.split() for s in samples]


# --- skewed keys

def skewed(spark, n=4000):
    random.seed(2)
    rows = [("hot" if random.random() < 0.5 else f"k{random.randrange(300)}", random.randrange(20), None if i % 50 == 0 else i % 7) for i in range(n)]
    rows += [(None, 1, 1)] * 30 + [("", 2, 2)] * 10
    return spark.createDataFrame(rows, "key string, a int, b int"), rows


def test_balanced_counts_and_loads(spark):
    df, rows = skewed(spark)
    p = skew.plan_load(df, "key", tasks=8)
    assert p.total == len(rows) and "hot" in p.heavy and len(p.heavy) <= 16
    assert max(p.load) <= 1.5 * len(rows) / 8
    got = {r.key: (r.row_count, r.na, r.nb) for r in skew.balanced_agg(df, "key", {"na": "a", "nb": "b"}, p).collect()}
    want = {}
    for k, a, b in rows:
        x = want.setdefault(k, [0, set(), set()])
        x[0] += 1
        x[1].add(a)
        if b is not None:
            x[2].add(b)
    assert got == {k: (n, len(a), len(b)) for k, (n, a, b) in want.items()}
    sizes = p.fragment(df, "key").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in sizes) <= 1.5 * len(rows) / 8


def test_balanced_join_is_the_join(spark):
    df, rows = skewed(spark, 1500)
    right = spark.createDataFrame([("hot", 1, 9), ("hot", 2, 9), ("k1", 3, 9), (None, 4, 9), ("zz", 5, 9)], "key string, v int, a int")
    got = skew.balanced_join(df, right, "key")
    want = df.join(right.withColumnRenamed("a", "a_right"), "key")
    assert sorted(map(tuple, got.select("key", "a", "b", "v", "a_right").collect()), key=str) == sorted(
        map(tuple, want.select("key", "a", "b", "v", "a_right").collect()), key=str)
    assert "Cartesian" not in plan(got)


def test_skew_of_empty_tables(spark):
    df = spark.createDataFrame([], "key string, a int, b int")
    assert skew.balanced_agg(df, "key", {"n": "a"}).count() == 0
    assert skew.heavy_keys(df, "key").count() == 0
    assert skew.balanced_join(df, df, "key").count() == 0


def test_heavy_keys_threshold(spark):
    df = spark.createDataFrame([("a",)] * 98 + [("b",)] * 2 + [("",)] * 3 + [(None,)] * 3, "key string")
    assert {r.key for r in skew.heavy_keys(df, "key", 0.02).collect()} == {"a"}
    assert {r.key for r in skew.heavy_keys(df, "key", 2 / 106).collect()} == {"a", "b"}


def test_pack_is_balanced():
    placed, load = skew.pack([(n, n) for n in range(1, 50)], 5)
    assert len(placed) == 49 and sum(load) == sum(range(1, 50)) and max(load) - min(load) <= 5


# --- orphan references

def T(s):
    return dt.datetime.fromisoformat(s)


def brute_orphans(refs, parents):
    out = set()
    for k, t in refs:
        if k is None:
            continue
        ps = [p for p in parents if p[0] == k]
        m = t.strftime("%Y-%m")
        if not ps:
            out.add((k, m, "missing"))
        elif all(p[2] is not None for p in ps):
            out.add((k, m, "deleted"))
        elif min(p[1] for p in ps) > t:
            out.add((k, m, "late"))
    return out


@pytest.mark.parametrize("cuts", [[], ["2023-01-01", "2024-01-01"], None])
def test_orphans_against_brute_force(spark, cuts):
    random.seed(3)
    day = lambda: T("2022-06-01") + dt.timedelta(hours=random.randrange(24 * 900))
    keys = [f"p{i}" for i in range(40)]
    parents = [(k, day(), day() if random.random() < 0.4 else None) for k in keys for _ in range(random.choice([0, 1, 1, 2]))]
    refs = [(random.choice([*keys, "gone", None, "p1", "p1"]), day()) for _ in range(300)]
    refs += refs[:20]
    child = spark.createDataFrame([(k, t, "x") for k, t in refs], "ref string, ingested_at timestamp, id string")
    parent = spark.createDataFrame(parents, "id string, ingested_at timestamp, removed_at timestamp")
    state, _ = orphans.track([orphans.Reference("t", child, "ref", parent, "id")], cuts=cuts)
    got = {(r.ref_key, r.load_month, r.kind) for r in state.broken().collect()}
    assert got == brute_orphans(refs, parents)
    assert state.refs.agg(F.sum("refs")).first()[0] == sum(k is not None for k, _ in refs)


def test_orphans_reopen_and_resolve(spark):
    child = spark.createDataFrame([("a", T("2022-03-01"))], "ref string, ingested_at timestamp")
    parent = spark.createDataFrame([("a", T("2023-02-01"), T("2024-05-01"))], "id string, ingested_at timestamp, removed_at timestamp")
    _, snaps = orphans.track([orphans.Reference("t", child, "ref", parent, "id")], with_snapshots=True)
    assert [s.count() for s in snaps] == [1, 0, 1]  # open, resolved, open again


def test_orphans_of_empty_tables(spark):
    child = spark.createDataFrame([], "ref string, ingested_at timestamp")
    parent = spark.createDataFrame([], "id string, ingested_at timestamp, removed_at timestamp")
    state, _ = orphans.track([orphans.Reference("t", child, "ref", parent, "id")])
    assert state.broken().count() == 0
    one = spark.createDataFrame([("a", None), (None, None)], "ref string, ingested_at timestamp")
    state, _ = orphans.track([orphans.Reference("t", one, "ref", parent, "id")])
    assert [(r.ref_key, r.load_month, r.kind) for r in state.broken().collect()] == [("a", None, "missing")]


# --- tables

def test_nearest_and_band_against_brute_force(spark):
    random.seed(4)
    pts = [(random.choice("ab"), random.randrange(600)) for _ in range(200)]
    ivs = [(random.choice("ab"), i, a := random.randrange(600), a + random.randrange(-3, 40)) for i in range(40)]
    p = spark.createDataFrame(sorted(set(pts)), "k string, x int")
    v = spark.createDataFrame(ivs, "k string, id int, lo int, hi int")
    got = {(r.k, r.x, r.id) for r in tables.band_join(p, v, ["k"], "x", "lo", "hi", 50).collect()}
    assert got == {(k, x, i) for k, x in set(pts) for kk, i, lo, hi in ivs if k == kk and lo <= x <= hi}
    near = {(r.k, r.x): r.id for r in tables.nearest(p, v, ["k"], "x", "lo", "hi", 30, ["lo", "id"]).collect()}
    want = {}
    for k, x in set(pts):
        c = [(min(abs(x - lo), abs(x - hi)), lo, i) for kk, i, lo, hi in ivs if kk == k and min(abs(x - lo), abs(x - hi)) < 30]
        if c:
            want[k, x] = min(c)[2]
    assert near == want
    for df in (tables.band_join(p, v, ["k"], "x", "lo", "hi", 50), tables.nearest(p, v, ["k"], "x", "lo", "hi", 30, ["id"])):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_scans_in_blocks_equal_scans_in_one(spark, block):
    random.seed(10)
    rows = [(random.choice("ab"), i, random.choice([None, None, "x", "y"])) for i in random.sample(range(300), 150)]
    df = spark.createDataFrame(rows, "k string, pos int, v string")
    flag = F.coalesce(F.col("v") == "x", F.lit(False))
    for f in (
        lambda b: tables.carried(df, ["k"], ["pos"], "v", "o", block=b),
        lambda b: tables.islands(df, ["k"], ["pos"], flag, "o", block=b),
        lambda b: tables.changed(df, ["k"], ["pos"], "v", "o", block=b),
    ):
        one, many = ({(r.k, r.pos): (r.v, r.o) for r in f(b).collect()} for b in (None, block))
        assert one == many and len(one) == 150


def test_writers(spark):
    a = spark.createDataFrame([("x", 1, "a1"), ("y", 2, "a2"), ("x", 0, "a0")], "k string, pos int, v string")
    b = spark.createDataFrame([("x", 1, "b1"), ("z", 1, "b2")], "k string, pos int, v string")
    got = lambda df: {r.k: r.v for r in df.collect()}
    assert got(tables.first_writer([a, b], ["k"], ["pos"])) == {"x": "a0", "y": "a2", "z": "b2"}
    assert got(tables.last_writer([a, b], ["k"], ["pos"])) == {"x": "b1", "y": "a2", "z": "b2"}
    assert got(tables.insert_ignore(a, b, ["k"], ["pos"])) == {"z": "b2"}
    assert got(tables.toggle(a.where("pos > 0"), b, ["k"])) == {"y": "a2", "z": "b2"}


def test_pages(spark):
    df = spark.createDataFrame([(250,), (100,), (0,), (None,)], "total int")
    rows = [(r.total, r.range_start, r.range_end) for r in tables.page_ranges(df, "total").collect()]
    assert rows == [(250, 1, 100), (250, 101, 200), (250, 201, 250), (100, 1, 100)]


# --- morphology

def brute_lemmas(word, heads):
    m = morphology
    found = set()
    add = lambda c: found.add(c) if c in heads else None
    for s in [word] + [word[: -len(e)] for e in m.STRIPPED if word.endswith(e) and len(word) > len(e) + 2]:
        for c in [s] + [s + e for e in m.HEADWORD_ENDINGS]:
            add(c)
    if word.startswith("ε") and len(word) > 3:
        add(word[1:])
        if word.startswith("εθ"):
            add("τιθημι")
    if word.endswith("θεισ") and len(word) > 4:
        s = word[:-4]
        if s.endswith("ω"):
            add(s[:-1] + "οω")
        for e in ("ω", "εω", "αω", "οω", "υω"):
            add(s + e)
    if word.endswith("ηοσ"):
        add(word[:-3] + "ευσ")
        if word[:-3] and word[-4] in "λμνρ":
            add(word[:-3] + word[-4] + "ευσ")
    for e, n in m.PATRONYMICS:
        if word.endswith(e) and len(word) > len(e) + 2:
            b = word[: -len(e)]
            add(b + n)
            if b.endswith("η"):
                add(b[:-1] + (n if n == "ευσ" else "ε" + n))
            elif b.endswith("ε") and n == "ευσ":
                add(b + "υσ")
    return found


def test_lemmatize_against_a_loop(spark):
    heads = "λογοσ τιθημι λυω χολοω πηλευσ ατρευσ αχιλλευσ νομοσ ψυχη δωρον αγω θεοσ".split()
    words = "λογου λογοισ εθηκε ελυσα χολωθεισ πηληιαδησ ατρειδησ αχιληοσ νομ δωρα ψυχησ αγομεν θεων ω".split()
    w = spark.createDataFrame([(x,) for x in [*words, words[0], None]], "word_normalized string")
    h = spark.createDataFrame([(x,) for x in heads], "headword_normalized string")
    df = morphology.lemmatize(w, h)
    got = {}
    for r in df.collect():
        got.setdefault(r.word_normalized, set()).add(r.lemma)
    assert got == {x: b for x in words if (b := brute_lemmas(x, set(heads)))}
    conf = {(r.word_normalized, r.lemma): r.confidence for r in df.collect()}
    assert conf["λογου", "λογοσ"] == 0.5 and conf["νομ", "νομοσ"] == 0.7 and conf["ατρειδησ", "ατρευσ"] == 0.75
    assert "Cartesian" not in plan(df) and "Python" not in plan(df)


def test_generated_forms(spark):
    e = spark.createDataFrame([("λόγος", "λογοσ"), ("λύω", "λυω"), ("φημί", "φημι")], "headword string, headword_normalized string")
    got = {}
    for r in morphology.generated_mappings(e).collect():
        got.setdefault(r.lemma, set()).add(r.word_form)
    assert "λογοσου" in got["λογοσ"] and "λογου" not in got["λογοσ"]
    assert {"λυομεν", "λυουσι", "ελυον", "ελυσα"} <= got["λυω"]
    assert {"φησι", "φαμεν"} <= got["φημι"]
    fixed = {r.word_form for r in morphology.generated_mappings(e, fix_sigma=True).where("lemma = 'λογοσ'").collect()}
    assert {"λογου", "λογοισ"} <= fixed


# --- alignment

def test_lookup_is_direct_proportional_nearest(spark):
    lines = spark.createDataFrame([("b", n) for n in range(1, 101)] + [("c", n) for n in range(1, 11)], "book_id string, line_number int")
    seg = spark.createDataFrame(
        [("b", 1, 1, 2), ("b", 2, 3, 4), ("c", 3, 2, None), ("c", 4, 9, 10)], "book_id string, id long, start_line int, end_line int")
    got = {}
    for r in line_alignment.lookup(lines, seg).collect():
        got.setdefault((r.book_id, r.line_number), []).append((r.segment_id, r.how))
    assert got["b", 10] == [(1, "proportional")] and got["b", 90] == [(2, "proportional")]
    assert got["c", 2] == [(3, "direct")] and got["c", 1] == [(3, "nearest")] and got["c", 6] == [(4, "nearest")]
    assert all(len(v) >= 1 for v in got.values()) and len(got) == 110


# --- bookmarks

def test_bookmarks(spark):
    row = lambda i, n, note, t: (i, "w", "b", n, "A", "W", None, "t", note, t, t)
    old = spark.createDataFrame([row(1, 1, "x", 1), row(2, 2, "", 2)], bookmarks.SCHEMA)
    new = spark.createDataFrame([row(3, 2, "y", 3), row(4, 3, None, 4)], bookmarks.SCHEMA)
    up = bookmarks.upsert(old, new)
    assert sorted(r.id for r in up.collect()) == [1, 3, 4]
    snap, added = bookmarks.insert_ignore(old, new)
    assert [r.id for r in added.collect()] == [4] and snap.count() == 3
    assert [r.id for r in bookmarks.recent(up, 2).collect()] == [4, 3]
    assert [r.id for r in bookmarks.of_work(up, "w", with_note=True).collect()] == [1, 3]
    assert sorted(r.id for r in bookmarks.toggle(old, new).collect()) == [1, 4]
    assert bookmarks.touch(up, 1, 99).where("last_accessed = 99").count() == 1
    assert bookmarks.update_note(up, 4, "n").where("note = 'n'").count() == 1
    assert bookmarks.delete(up, old).count() == 1
    assert {(r.line_number, r.bookmarked) for r in bookmarks.is_bookmarked(old, new).collect()} == {(2, True), (3, False)}


# --- whole queries

def test_every_core_query_runs_and_has_sql(spark):
    for m in (queries, problems):
        assert set(m.SQL) == set(m.QUERIES)
    for name in ("q04_concordance", "q28_lookup", "q33_lemmatize", "q36_dictionary_all"):
        df = queries.QUERIES[name](spark, SF)
        assert df.count() >= 0
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df), name


def test_filters_and_columns_reach_the_scan(spark):
    df = queries.QUERIES["q08_text_range"](spark, SF)
    p = plan(df)
    assert "PushedFilters: [IsNotNull(line_number)" in p and "line_xml" not in p
    c = Corpus(spark, SF)
    assert "PushedFilters" in plan(c.words.where("word_normalized = 'x'").select("book_id"))
