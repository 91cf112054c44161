import bz2
import json

from pyspark.sql import functions as F

from lektra import schema
from lektra.functions import text
from lektra.sources import files, tei

VERSE = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>
<div type="textpart" subtype="book" n="1"><l n="1">μῆνιν ἄειδε<note>x</note> θεὰ</l><l n="2"> </l><l n="3">pointer pattern</l><l n="4">τέλος &ldquo;ὧδε&rdquo;</l></div>
<div type="textpart" subtype="book" n="2"><l n="1">ἄλλοι μέν</l></div></body></text></TEI>"""
DRAMA = """<TEI><body><sp><speaker>Nurse</speaker><l n="2">second line</l><l n="1">first line</l></sp>
<sp><speaker>Chorus</speaker><l n="3">third</l><l n="x">no number</l></sp></body></TEI>"""
PROSE = """<TEI><body><div type="textpart" subtype="section" n="1"><p>A long first sentence here. em. Nauck says no. Another good sentence.</p></div>
<div type="textpart" subtype="section" n="2">Only the direct text of a section without paragraphs.</div></body></TEI>"""
PAGED = """<TEI><body><p><milestone unit="section" n="327a"/>First paragraph.</p><p>None here.</p>
<p><milestone unit="section" n="328b"/>Second <milestone unit="section" n="330"/>one.</p></body></TEI>"""


def _files(spark, **docs):
    return spark.createDataFrame([(k, v) for k, v in docs.items()], "path string, value string")


def test_verse_numbers_have_gaps_and_notes_go(spark):
    ev = tei.read_events(_files(spark, a=VERSE, bad="<TEI><l>"))
    lines = tei.text_lines(ev, F.lit(True))
    got = [tuple(r) for r in lines.select("path", "book", "line_number", "line_text").orderBy("book", "line_number").collect()]
    assert got == [("a", "1", 1, "μῆνιν ἄειδε θεὰ"), ("a", "1", 4, "τέλος “ὧδε”"), ("a", "2", 1, "ἄλλοι μέν")]
    assert ev.where("kind = 'error'").select("path").collect()[0][0] == "bad"
    books = {(r.book, r.id_part, r.end_line) for r in tei.books(lines).collect()}
    assert books == {("1", "001", 2), ("2", "002", 1)}
    words = tei.words(lines, ["path", "book"], F.lit("greek"))
    assert [tuple(r) for r in words.where("book = '1' and line_number = 1").select("word_position", "word_normalized").orderBy("word_position").collect()] == [
        (1, "μηνιν"), (2, "αειδε"), (3, "θεα")]


def test_drama_carries_the_speaker_and_sorts(spark):
    ev = tei.read_events(_files(spark, d=DRAMA))
    lines = tei.text_lines(ev, F.lit(False), drama=F.col("path") == "d")
    got = [tuple(r) for r in lines.select("line_number", "speaker", "line_text").orderBy("line_number").collect()]
    assert got == [(1, "Nurse", "first line"), (2, "Nurse", "second line"), (3, "Chorus", "third")]
    seg = [tuple(r) for r in tei.translation_segments(ev).where("speaker IS NOT NULL").select("start_line", "end_line", "segment_text", "speaker").orderBy("pos").collect()]
    assert seg == [(2, 1, "second line first line", "Nurse"), (3, 3, "third", "Chorus")]


def test_prose_layout_and_noise(spark):
    ev = tei.read_events(_files(spark, p=PROSE))
    assert tei.layouts(ev).first()["layout"] == "prose"
    got = [r.line_text for r in tei.text_lines(ev, F.lit(False)).orderBy("line_number").collect()]
    assert got == ["A long first sentence here", "Another good sentence.", "Only the direct text of a section without paragraphs."]
    seg = tei.section_segments(ev).orderBy("start_line").collect()
    assert [s.start_line for s in seg] == [1, 2]


def test_milestones_plain_and_paged(spark):
    ev = tei.read_events(_files(spark, m=PAGED))
    plain = [tuple(r) for r in tei.milestone_segments(ev, F.lit(False)).select("start_line", "end_line").orderBy("pos").collect()]
    assert plain == [(327, 327), (328, 330)]
    paged = [tuple(r) for r in tei.milestone_segments(ev, F.lit(True)).select("start_line", "end_line").orderBy("pos").collect()]
    assert paged == [(1, 1), (2, 2)]


def test_compat_matches_by_ending():
    xml = "<TEI><sp><l n='1'>a <del>b</del> c</l></sp></TEI>"
    kinds = [e[2] for e in tei.events("x", xml)]
    assert kinds == ["line"]
    assert [e[2] for e in tei.events("x", xml, compat=True)] == ["para", "line", "line"]


def test_metadata_titles_translators(spark):
    cts = """<ti:work xmlns:ti="u" urn="urn:cts:x"><ti:groupname>Author</ti:groupname><ti:title xml:lang="lat">Carmina</ti:title>
    <ti:edition><ti:label>l</ti:label></ti:edition></ti:work>"""
    f = _files(spark, **{"/c/tlg0001/__cts__.xml": cts})
    meta = tei.resolve_titles(tei.cts_metadata(f), F.lit("w1")).first()
    assert (meta.title, meta.title_english, meta.urn) == ("Carmina", "Odes", "urn:cts:x")
    assert tuple(tei.discover_authors(f).first()) == ("tlg0001", "Author", "greek")
    t = _files(spark, **{
        "/a/tlg0016.tlg001.x-eng2.xml": "<TEI/>", "/a/z-jowett-eng1.xml": "<TEI/>", "/a/q.xml": "<TEI/>",
        "/a/e.xml": "<TEI><editor role='translator'> J. Doe </editor></TEI>"})
    got = {r.path: r.translator for r in tei.translator(t).collect()}
    assert list(got.values()) == ["A. D. Godley", "Benjamin Jowett", "Unknown", "J. Doe"]


def test_dictionary_entries(spark):
    xml = """<d><entryFree type="main" key="logos"><orth>λόγος</orth>
    <sense n="A"><usg>prose</usg><trans><tr>word</tr><tr>speech</tr></trans></sense><sense n="B"><trans><tr>account</tr></trans></sense></entryFree>
    <entryFree type="main" key="x"><orth>κενός</orth><sense n="A"/></entryFree><entryFree type="other"/></d>"""
    rows = files.dictionary_entries(files.dictionary(_files(spark, d=xml))).collect()
    assert [(r.headword, r.headword_normalized, r.entry_plain) for r in rows] == [
        ("λόγος", "λογοσ", "A. (prose) word; speech\nB. account")]
    one = """<d><entry type="main" key="nomo/s"><sense n="A"><trans><tr>law</tr></trans></sense></entry></d>"""
    row = files.dictionary_entries(files.dictionary(_files(spark, d=one))).first()
    assert (row.headword, row.entry_plain) == ("nomo\u0301s", "law")


def test_wiki_dump(spark, tmp_path):
    pages = [
        ("λόγου", "==Ancient Greek==\n===Noun===\n{{genitive of|grc|λόγος}}\n# a form\n==Greek==\n{{plural of|grc|x}}"),
        ("λόγος", "==Ancient Greek==\n===Noun===\n{{grc-decl|λόγοι|λόγων}}\n# that which is [[said|spoken]] ''word''\n# (rare) account"),
        ("User:x", "==Ancient Greek=="), ("word", "==English=="),
    ]
    xml = "<mediawiki>" + "".join(f"<page><title>{t}</title><revision><text>{x}</text></revision></page>" for t, x in pages) + "</mediawiki>"
    path = tmp_path / "dump.xml.bz2"
    path.write_bytes(bz2.compress(xml.encode()))
    p = files.main_pages(files.wiki_pages(spark, str(path)))
    assert p.count() == 3
    g = files.greek_pages(p)
    assert g.count() == 2 and g.where("has_ancient").count() == 2
    m = files.form_mappings(g).collect()
    assert [(r.word_form, r.lemma, r.morph_info) for r in m] == [("λόγου", "λογοσ", "genitive")]
    w = {r.word_form: (r.lemma, r.confidence, r.morph_info) for r in files.page_words(g).collect()}
    assert w == {"λόγου": ("λογοσ", 0.9, "inflection:noun"), "λόγος": ("λογοσ", 0.95, "lemma:noun")}
    d = {r.word_normalized: r.entry_plain for r in files.definitions(g).collect()}
    assert d["λογοσ"] == "that which is spoken word; account"
    assert {(r.form, r.lemma, r.pos) for r in files.table_forms(g).collect()} == {("λόγοι", "λογοσ", "noun"), ("λόγων", "λογοσ", "noun")}


def test_json_csv_lists(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"metadata": {"a": "b"}, "mappings": [
        {"word_form": "λόγου", "lemma": "λογοσ", "morph_type": "gen"}, {"word_form": "x", "lemma": "y", "confidence": 0.5, "morph_info": "m", "morph_type": "t"}]}))
    rows = [tuple(r) for r in files.json_mappings(spark, str(tmp_path / "m.json")).collect()]
    assert rows == [("λόγου", "λογου", "λογοσ", 1.0, "wiktionary", "gen"), ("x", "", "y", 0.5, "wiktionary", "m")]
    (tmp_path / "o.json").write_text(json.dumps({"k": {"html": "<b>", "plain": "p"}}))
    assert [tuple(r) for r in files.json_objects(spark, str(tmp_path / "o.json"), "html:string,plain:string").collect()] == [("k", "<b>", "p")]
    (tmp_path / "l.txt").write_text(" Homer \n\nVirgil\n")
    names = files.name_list(spark, str(tmp_path / "l.txt"))
    assert sorted(r.name for r in names.collect()) == ["homer", "virgil"]
    a = spark.createDataFrame([("1", "Homer", "greek"), ("2", "Homeric Hymns", "greek"), ("3", "P. Virgilius", "latin")], "id string, name string, language string")
    assert sorted(r.id for r in files.listed_authors(a, names).collect()) == ["1", "3"]
    assert [r.id for r in files.first_authors(a, ["3"], 2).collect()] == ["3", "1"]
    bm = spark.createDataFrame([(1, "w", "b", 3, "A", "T", None, 'say "hi", x', None, 5, 6)], files.BOOKMARKS)
    files.write_bookmarks_csv(bm, str(tmp_path / "csv"))
    assert [tuple(r) for r in files.read_bookmarks_csv(spark, str(tmp_path / "csv")).collect()] == [tuple(r) for r in bm.collect()]
    m = files.json_mappings(spark, str(tmp_path / "m.json"))
    files.write_json_mappings(m.repartition(2), str(tmp_path / "out"), {"n": "3"}, per_file=1)
    assert sorted(tuple(r) for r in files.json_mappings(spark, str(tmp_path / "out")).collect()) == sorted(rows)
    heads = spark.read.json(str(tmp_path / "out"), multiLine=True).select("metadata.n").collect()
    assert [r.n for r in heads] == ["3", "3"]
    files.write_json_mappings(m.limit(0), str(tmp_path / "none"), {})


def test_schema_check():
    good = {t: schema.struct(t) for t in schema.TABLES}
    assert schema.validate(good, nullability=True) == []
    bad = dict(good)
    del bad["works"]
    bad["books"] = schema.struct("authors")
    issues = schema.validate(bad)
    assert "missing table: works" in issues and "missing column: books.work_id" in issues
    assert schema.keys("translation_lookup") == ["book_id", "line_number", "segment_id"]


def test_beta_key(spark):
    df = spark.createDataFrame([("lo/gos|",)], "k string")
    assert df.select(text.beta_key(F.col("k"))).first()[0] == "lo\u0301gosι"


def test_wiki_ladders(spark):
    rows = [
        ("λόγου", "==Ancient Greek==\n===Noun===\n# the [[word|speech]]\n{{inflection of|grc|λόγος||gen|s}} {{inflection of|el|[[λόγος]]||x}}"),
        ("θεοῖς", "==Greek==\n{{dative plural of|grc|θεός#A}}"), ("x", "==English=="),
        ("μῆνιν", "=={{-grc-}}==\n{{μορφή ουσιαστικού|grc}} {{κλ|grc|π=α|μῆνις}}"),
        ("νόμου", "=={{-grc-}}==\n{{μορφή ουσιαστικού|grc}} γενική της λέξης [[νόμος]]"),
        ("λύω", "==Αρχαία ελληνικά==\n===Ρήμα==="),
    ]
    p = spark.createDataFrame(rows, "title string, wikitext string")
    assert [(r.word_form, r.lemma, r.tags) for r in files.inflection_of(p).collect()] == [("λογου", "λογοσ", "|gen|s")]
    info = {r.word_form: (r.lemma, r.morphology, r.pos, r.definition) for r in files.inflection_info(p).collect()}
    assert info == {"λόγου": ("λόγος", ["gen", "s"], "noun", "the speech"), "θεοῖς": ("θεός", ["dative"], None, None)}
    assert {(r.word_form, r.lemma, r.source) for r in files.greek_noun_forms(p).collect()} == {
        ("μηνιν", "μηνισ", "elwiktionary:κλ"), ("νομου", "νομοσ", "elwiktionary:λέξης")}
    assert [r.title for r in files.greek_verb_pages(p).collect()] == ["λύω"]


def test_supplements_and_tables(spark, tmp_path):
    e = spark.createDataFrame([("ατρευσ",)], "headword_normalized string")
    m = spark.createDataFrame([("πρῶτα", "πρωτα")], "word_form string, lemma string")
    new, own = files.supplements(spark, e, m)
    assert {r.headword_normalized for r in new.collect()} == {"σφωε", "πρωτα", "νουσοσ", "ελωριον"}
    assert {r.lemma for r in own.collect()} == {"σφωε", "νουσοσ", "ελωριον"}
    files.write_tables({"lemma_map": m.withColumn("word_normalized", F.col("lemma")), "x": e}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "lemma_map.parquet")).count() == 1


def test_quality_text(spark):
    from lektra.plans import reports
    from lektra.plans.corpus import Corpus

    lines = [r.line for r in reports.quality_text(Corpus(spark, "/root/testdata/sf0.001")).collect()]
    assert lines[0].startswith("Author ") and lines[1].startswith("  Work ") and any("segments" in x for x in lines)


def test_display_title(spark):
    df = spark.createDataFrame([("Ἰλιάς", "Iliad"), ("a", " "), ("b", "tlg001"), ("c", None)], "t string, e string")
    assert [r[0] for r in df.select(text.display_title(F.col("t"), F.col("e"))).collect()] == ["Iliad", "a", "b", "c"]


def test_api_facade(spark):
    from lektra.plans.api import Api
    from lektra.plans.corpus import Corpus

    api = Api(Corpus(spark, "/root/testdata/sf0.001"))
    a = api.authors("greek").first()
    w = api.works(a.id).first()
    b = api.books(w.id).first()
    assert api.text(b.id, 1, 10).where("line_number > 10").count() == 0 and api.text(b.id, 1, 10).count() > 0
    assert api.translations(b.id, 1, 100).count() >= 0 and api.translators(b.id).count() >= 0
    assert api.dictionary("Λόγος").count() >= 0
    # words of the server keep their final sigma, the stored keys do not
    assert api.occurrences("Λόγος").count() == 0 and api.occurrences("λόγοσ").count() > 0


def test_unknown_way_of_inserting(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, "a")], "id int, v string")
    df.write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        files.insert(spark, str(tmp_path / "t"), df, ["id"], ["v"], "other")
    files.insert(spark, str(tmp_path / "t"), df, ["id"], ["v"], "replace")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
