"""Queries of the readers and writers: files are built from whole tables, read by the sources, and
compared with what the tables say in plain SQL.

Files hold the rows of one book by ranges of 200 lines (or 200 ids), so that no file grows with a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lektra.functions import text
from lektra.operators import orphans
from lektra.plans import bookmarks, corpus, problems
from lektra.plans.corpus import Corpus
from lektra.plans.queries import _GREEK, _MARKS, _SPACE, _n1
from lektra.runtime import shared_dir
from lektra.sources import files, tei
from lektra.streaming import changes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def wrap(f):
        QUERIES[f.__name__] = lambda spark, d: f(Corpus(spark, d))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return wrap


# --- building files

def esc(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def documents(rows: DataFrame, path: Column, order: list[str], body: Column, head: str, tail: str) -> DataFrame:
    """(path, value): ``body`` of the rows of a path in order, between head and tail."""
    parts = rows.select(path.alias("path"), F.struct(*order, body.alias("body")).alias("x")).groupBy("path").agg(
        F.array_sort(F.collect_list("x")).alias("xs"))
    return parts.select("path", F.concat(
        F.lit(head), F.array_join(F.transform("xs", lambda x: x["body"]), "\n"), F.lit(tail)).alias("value"))


def _block(c: str, size: int = 200) -> Column:
    return F.concat(F.col("book_id"), F.lit("/"), F.floor(F.col(c) / size).cast("string"))


def _lines(c: Corpus) -> DataFrame:
    return c.lines.where("book_id IS NOT NULL AND line_number IS NOT NULL AND line_text IS NOT NULL")


def _line(n: Column) -> Column:
    return F.concat(F.lit('<l n="'), n.cast("string"), F.lit('">'), esc(F.col("line_text")), F.lit("<note>"),
                    esc(F.coalesce("speaker", F.lit("?"))), F.lit("</note></l>"))


_STRIP = lambda x: f"regexp_replace({x}, '^{_SPACE}|{_SPACE}$', '', 'g')"
_VERSE = f"""v AS (SELECT book_id || '/' || (line_number // 200) AS path, line_number AS n, id, {_STRIP('line_text')} AS s
 FROM text_lines WHERE book_id IS NOT NULL AND line_number IS NOT NULL AND line_text IS NOT NULL),
l AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY n, id) AS INTEGER) AS k FROM v)"""


def _verse_files(c: Corpus) -> DataFrame:
    return documents(
        _lines(c), _block("line_number"), ["line_number", "id"], _line(F.col("line_number")),
        '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div type="textpart" subtype="book" n="7">',
        "</div></body></text></TEI>")


@query(f"WITH {_VERSE} SELECT path, '7' AS book, k AS line_number, s AS line_text FROM l WHERE s <> ''")
def q60_verse_files(c: Corpus) -> DataFrame:
    """Verse: every line element counts, blank ones go, editorial elements are left out."""
    return tei.text_lines(tei.read_events(_verse_files(c)), F.lit(True)).select("path", "book", "line_number", "line_text")


@query(f"""WITH {_VERSE} SELECT path, 7 AS book_number, '007' AS id_part, 'Book 7' AS label, CAST(count(*) AS INTEGER) AS line_count
FROM l WHERE s <> '' GROUP BY path""")
def q60_verse_books(c: Corpus) -> DataFrame:
    lines = tei.text_lines(tei.read_events(_verse_files(c)), F.lit(True))
    return tei.books(lines).select("path", "book_number", "id_part", "label", "line_count")


@query(f"""WITH {_VERSE}, f AS (SELECT path, count(*) AS n FROM l GROUP BY path)
SELECT path, 0 AS p, n AS l, 'verse_books' AS layout FROM f
UNION ALL SELECT path || '#p', 3 * n, n, 'prose_books' FROM f
UNION ALL SELECT path || '#d', 0, n, 'drama' FROM f""")
def q60_layouts(c: Corpus) -> DataFrame:
    """Verse, prose and drama files of the same lines: three paragraphs a line make prose."""
    v = _verse_files(c)
    p = v.select(F.concat("path", F.lit("#p")).alias("path"), F.replace(
        F.col("value"), F.lit("</l>"), F.lit("</l><p>a</p><p>b</p><p>c</p>")).alias("value"))
    d = v.select(F.concat("path", F.lit("#d")).alias("path"), "value")
    ev = tei.read_events(v.unionByName(p).unionByName(d))
    return tei.layouts(ev, drama=F.col("path").endswith("#d")).select("path", "p", "l", "layout")


_DRAMA = f"""{_VERSE}, d AS (SELECT *, last_value(CASE WHEN n % 5 = 1 THEN 'S' || n END IGNORE NULLS)
 OVER (PARTITION BY path ORDER BY n, id ROWS UNBOUNDED PRECEDING) AS speaker,
 sum(CASE WHEN n % 5 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n, id ROWS UNBOUNDED PRECEDING) AS island FROM l)"""


def _drama_files(c: Corpus) -> DataFrame:
    n = F.col("line_number")
    speaker = F.when(n % 5 == 1, F.concat(F.lit("<speaker>S"), n.cast("string"), F.lit("</speaker>"))).otherwise(F.lit(""))
    return documents(
        _lines(c), _block("line_number"), ["line_number", "id"], F.concat(speaker, _line(n)), "<TEI><body><sp>", "</sp></body></TEI>")


@query(f"WITH {_DRAMA} SELECT path, CAST(n AS INTEGER) AS line_number, s AS line_text, speaker FROM d WHERE s <> ''")
def q61_drama_files(c: Corpus) -> DataFrame:
    ev = tei.read_events(_drama_files(c))
    return tei.text_lines(ev, F.lit(True), drama=F.lit(True)).select("path", "line_number", "line_text", "speaker")


@query(f"""WITH {_DRAMA} SELECT path, CAST(min_by(n, k) AS INTEGER) AS start_line, CAST(max_by(n, k) AS INTEGER) AS end_line,
string_agg(s, ' ' ORDER BY k) AS segment_text, any_value(speaker) AS speaker
FROM d WHERE s <> '' AND island > 0 GROUP BY path, island""")
def q61_speaker_segments(c: Corpus) -> DataFrame:
    return tei.speaker_segments(tei.read_events(_drama_files(c))).select("path", "start_line", "end_line", "segment_text", "speaker")


_SEGMENTS = f"""s AS (SELECT book_id || '/' || (id // 200) AS path, id, start_line, coalesce(end_line, start_line) AS end_line,
 {_STRIP('translation_text')} AS t FROM translation_segments WHERE book_id IS NOT NULL AND start_line IS NOT NULL
 AND translation_text IS NOT NULL)"""


def _segments(c: Corpus) -> DataFrame:
    return c.segments.where("book_id IS NOT NULL AND start_line IS NOT NULL AND translation_text IS NOT NULL")


_PROSE = f"""WITH {_SEGMENTS}, x AS (SELECT path, id, regexp_split_to_array(t, '[.!?]\\s+') AS a FROM s),
y AS (SELECT path, id, generate_subscripts(a, 1) AS n, {_STRIP('unnest(a)')} AS u FROM x)
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY id, n) AS INTEGER) AS line_number, u AS line_text FROM y
WHERE length(u) > 10 AND NOT regexp_matches(u, '^[A-Z]:') AND NOT starts_with(u, 'em.') AND NOT starts_with(u, 'add.')
  AND NOT starts_with(u, 'id.') AND NOT contains(u, 'Nauck') AND NOT contains(u, 'Mullach')"""


@query(_PROSE)
def q62_prose_files(c: Corpus) -> DataFrame:
    """Sections with a paragraph each, cut into sentences that are numbered through the file."""
    body = F.concat(F.lit('<div type="textpart" subtype="section"><p>'), esc(F.col("translation_text")), F.lit("</p></div>"))
    f = documents(_segments(c), _block("id"), ["id"], body, "<TEI><body>", "</body></TEI>")
    return tei.text_lines(tei.read_events(f), F.lit(False)).select("path", "line_number", "line_text")


@query(_PROSE.replace("length(u) > 10", "length(u) > 20").replace("AND NOT starts_with(u, 'id.')", ""))
def q62_bare_sections(c: Corpus) -> DataFrame:
    """Sections without paragraphs give their own text."""
    body = F.concat(F.lit('<div type="textpart" subtype="chapter">'), esc(F.col("translation_text")), F.lit("</div>"))
    f = documents(_segments(c), _block("id"), ["id"], body, "<TEI><body>", "</body></TEI>")
    return tei.text_lines(tei.read_events(f), F.lit(False), prose=F.lit(True)).select("path", "line_number", "line_text")


@query(f"""WITH {_SEGMENTS}, m AS (SELECT *, first_value(start_line * 7) OVER (PARTITION BY path ORDER BY id) AS first_num,
 row_number() OVER (PARTITION BY path ORDER BY id) AS k FROM s WHERE t <> '')
SELECT path, CAST(CASE WHEN first_num > 1000 THEN k ELSE start_line * 7 END AS INTEGER) AS start_line,
 CAST(CASE WHEN first_num > 1000 THEN k ELSE end_line END AS INTEGER) AS end_line, t AS segment_text FROM m""")
def q63_milestone_segments(c: Corpus) -> DataFrame:
    """Paragraphs between milestones; where the first number is a page, paragraphs are numbered instead."""
    body = F.concat(
        F.lit('<p><milestone unit="section" n="'), (F.col("start_line") * 7).cast("string"), F.lit('a"/>'),
        esc(F.col("translation_text")), F.lit('<milestone unit="card" n="'),
        F.coalesce("end_line", "start_line").cast("string"), F.lit('"/></p>'))
    rows = _segments(c).where(text.py_strip(F.col("translation_text")) != "")
    f = documents(rows, _block("id"), ["id"], body, "<TEI><body>", "</body></TEI>")
    return tei.milestone_segments(tei.read_events(f), F.lit(False)).select("path", "start_line", "end_line", "segment_text")


@query(f"""WITH {_SEGMENTS} SELECT path, start_line, start_line AS end_line, t AS segment_text FROM s WHERE t <> ''
UNION ALL SELECT path || '#p', k, k, t FROM (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY id) AS INTEGER) AS k
  FROM s WHERE length(t) > 20)""")
def q63_section_segments(c: Corpus) -> DataFrame:
    """Numbered sections, and files without sections by their longer paragraphs."""
    t = esc(F.col("translation_text"))
    a = documents(_segments(c), _block("id"), ["id"], F.concat(
        F.lit('<div subtype="section" n="'), F.col("start_line").cast("string"), F.lit('">'), t, F.lit("</div>")),
        "<TEI><body>", "</body></TEI>")
    b = documents(_segments(c), F.concat(_block("id"), F.lit("#p")), ["id"], F.concat(F.lit("<p>"), t, F.lit("</p>")),
                  "<TEI><body>", "</body></TEI>")
    return tei.section_segments(tei.read_events(a.unionByName(b))).select("path", "start_line", "end_line", "segment_text")


@query(f"""WITH s AS (SELECT book_id || '/' || (start_line // 200) AS path, start_line, {_STRIP('translation_text')} AS t
 FROM translation_segments WHERE book_id IS NOT NULL AND start_line IS NOT NULL AND translation_text IS NOT NULL), {_VERSE},
many AS (SELECT path FROM s WHERE t <> '' GROUP BY path HAVING count(*) >= 50)
SELECT path, CAST(start_line AS INTEGER) AS start_line, t AS segment_text FROM s WHERE t <> ''
UNION ALL SELECT path, CAST(n AS INTEGER), s FROM l WHERE s <> '' AND path NOT IN (SELECT path FROM many)""")
def q64_topped_up_segments(c: Corpus) -> DataFrame:
    """Sections; files with fewer than 50 of them get their lines as well."""
    one = F.concat(F.lit('<div subtype="section" n="'), F.col("start_line").cast("string"), F.lit('">'),
                   esc(F.col("translation_text")), F.lit("</div>"))
    rows = _segments(c).select(
        _block("start_line").alias("path"), F.lit(0).alias("kind"), F.col("start_line").alias("n"), "id", one.alias("body"))
    rows = rows.unionByName(_lines(c).select(
        _block("line_number").alias("path"), F.lit(1).alias("kind"), F.col("line_number").alias("n"), "id",
        _line(F.col("line_number")).alias("body")))
    f = documents(rows, F.col("path"), ["kind", "n", "id"], F.col("body"), "<TEI><body>", "</body></TEI>")
    return tei.translation_segments(tei.read_events(f)).select("path", "start_line", "segment_text")


# --- metadata

_IDS = "SELECT DISTINCT work_id, split_part(work_id, '.', 1) AS author FROM books WHERE work_id IS NOT NULL"


def _works(c: Corpus) -> DataFrame:
    w = c.get("books").where("work_id IS NOT NULL").select("work_id").distinct()
    return w.withColumn("author", F.split_part("work_id", F.lit("."), F.lit(1)))


@query(f"""WITH w AS ({_IDS}) SELECT author AS id, CASE WHEN min(work_id) LIKE '%.001' THEN author ELSE 'Name of ' || author END AS name,
CASE WHEN author LIKE 'tlg%' THEN 'greek' WHEN author LIKE 'phi%' THEN 'latin' END AS language FROM w GROUP BY author""")
def q65_discovered_authors(c: Corpus) -> DataFrame:
    """Authors by the folders of their catalogue files; without a group name the id stands."""
    a = _works(c).groupBy("author").agg(F.min("work_id").alias("w"))
    name = F.when(F.col("w").endswith(".001"), F.lit("")).otherwise(F.concat(F.lit("Name of "), F.col("author")))
    return tei.discover_authors(a.select(
        F.concat(F.lit("/c/"), F.col("author"), F.lit("/__cts__.xml")).alias("path"),
        F.concat(F.lit('<ti:textgroup xmlns:ti="u"><ti:groupname>'), name, F.lit("</ti:groupname></ti:textgroup>")).alias("value")))


@query(f"""SELECT work_id AS path, CASE WHEN author LIKE 'tlg%' THEN 'Γ ' || work_id ELSE 'Carmina' END AS title,
CASE WHEN author LIKE 'tlg%' THEN 'English ' || work_id ELSE 'Odes' END AS title_english, 'urn:x:' || work_id AS urn FROM ({_IDS})""")
def q65_titles(c: Corpus) -> DataFrame:
    """Titles of the catalogue: the label of a translation stands for the English one, a Latin title is put into English."""
    greek = F.concat(
        F.lit('<ti:title xml:lang="eng">other</ti:title><ti:title xml:lang="grc">Γ '), F.col("work_id"),
        F.lit("</ti:title><ti:translation><ti:label>English "), F.col("work_id"), F.lit("</ti:label></ti:translation>"))
    body = F.when(F.col("author").startswith("tlg"), greek).otherwise(F.lit('<ti:title xml:lang="lat">Carmina</ti:title>'))
    f = _works(c).select(F.col("work_id").alias("path"), F.concat(
        F.lit('<ti:work xmlns:ti="u" urn="urn:x:'), F.col("work_id"), F.lit('">'), body, F.lit("</ti:work>")).alias("value"))
    return tei.resolve_titles(tei.cts_metadata(f), F.col("path")).select("path", "title", "title_english", "urn")


@query(f"""SELECT work_id, CASE WHEN author LIKE 'tlg%' THEN 'English title' ELSE work_id END AS shown FROM ({_IDS})""")
def q65_display_titles(c: Corpus) -> DataFrame:
    english = F.when(F.col("author").startswith("tlg"), F.lit("English title")).otherwise(F.lit("phi0"))
    return _works(c).select("work_id", text.display_title(F.col("work_id"), english).alias("shown"))


@query(f"""WITH t AS (SELECT DISTINCT coalesce({_STRIP('translator')}, '') AS t FROM translation_segments)
SELECT t || '-' || k AS path, CASE WHEN t = '' THEN CASE k WHEN 3 THEN 'Benjamin Jowett' ELSE 'Unknown' END ELSE t END AS translator
FROM t, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE t = '' OR k < 3""")
def q65_translators(c: Corpus) -> DataFrame:
    """Translators named as editor, in a statement of responsibility, as author with that role, or by the file's name."""
    t = c.segments.select(F.coalesce(text.py_strip(F.col("translator")), F.lit("")).alias("t")).distinct()
    k = t.select("t", F.explode(F.when(F.col("t") == "", F.array(*map(F.lit, range(4)))).otherwise(F.array(*map(F.lit, range(3))))).alias("k"))
    form = F.when(F.col("k") == 0, F.concat(F.lit('<editor role="translator">'), esc(F.col("t")), F.lit("</editor>"))).when(
        F.col("k") == 1, F.concat(F.lit("<respStmt><resp>Translated by</resp><name>"), esc(F.col("t")), F.lit("</name></respStmt>"))).when(
        F.col("k") == 2, F.concat(F.lit('<author role="translator">'), esc(F.col("t")), F.lit("</author>"))).otherwise(F.lit(""))
    name = F.concat(F.col("t"), F.lit("-"), F.col("k").cast("string"))
    f = k.select(F.when(F.col("k") == 3, F.concat(name, F.lit("/x-eng-jowett.xml"))).otherwise(name).alias("path"),
                 F.concat(F.lit("<TEI>"), form, F.lit("</TEI>")).alias("value"))
    return tei.translator(f).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("path"), "translator")


@query(f"SELECT work_id AS work, '/c/' || author || '/' || work_id || '/' || work_id || '.proj-grc1.xml' AS path FROM ({_IDS})")
def q65_editions(c: Corpus) -> DataFrame:
    """Of the files of a work the first of the project in its own language."""
    names = ["__cts__.xml", ".other-grc0.xml", ".proj-eng0.xml", ".proj-grc2.xml", ".proj-grc1.xml"]
    f = _works(c).select("author", "work_id", F.explode(F.array(*map(F.lit, names))).alias("n"))
    name = F.when(F.col("n").startswith("_"), F.col("n")).otherwise(F.concat("work_id", "n"))
    f = f.select(F.concat_ws("/", F.lit("/c"), "author", "work_id", name).alias("path"))
    return tei.pick_editions(f, "proj").select("work", "path")


_AUTHORS = f"a AS (SELECT DISTINCT author AS id, upper(author) || ' the Poet' AS name FROM ({_IDS}))"


def _author_rows(c: Corpus) -> DataFrame:
    return _works(c).select("author").distinct().select(
        F.col("author").alias("id"), F.concat(F.upper("author"), F.lit(" the Poet")).alias("name"),
        text.language_of(F.col("author")).alias("language"))


@query(f"""WITH {_AUTHORS} SELECT id FROM a WHERE CASE WHEN id LIKE 'tlg%' THEN right(id, 1) IN ('1', '3') ELSE right(id, 1) IN ('1', '5') END""")
def q66_listed_authors(c: Corpus) -> DataFrame:
    """Greek authors by their whole name, Latin ones by a part of it, from a list in a file."""
    a = _author_rows(c)
    path = shared_dir(c.spark)
    low = F.lower("name")
    lines = a.select(F.when(F.col("id").rlike("^tlg.*[13]$"), F.concat(F.lit("  "), F.col("name"))).when(
        F.col("id").rlike("^tlg"), F.split_part(low, F.lit(" "), F.lit(1))).when(
        F.col("id").rlike("[15]$"), F.split_part(F.upper("name"), F.lit(" "), F.lit(1))).otherwise(F.lit(" ")).alias("value"))
    lines.write.text(path)
    return files.listed_authors(a, files.name_list(c.spark, path)).select("id")


@query(f"""WITH {_AUTHORS} SELECT id FROM a ORDER BY CASE id WHEN 'tlg3003' THEN 0 WHEN 'phi3001' THEN 1 ELSE 2 END, id LIMIT 5""")
def q66_first_authors(c: Corpus) -> DataFrame:
    return files.first_authors(_author_rows(c), ["tlg3003", "phi3001"], 5).select("id")


# --- dictionaries

_ENTRY = f"""e AS (SELECT id, {_STRIP('headword')} AS h, list_filter(list_transform(string_split(entry_plain, ','), lambda x: {_STRIP('x')}),
 lambda x: x <> '') AS g FROM dictionary_entries WHERE headword IS NOT NULL AND entry_plain IS NOT NULL)"""


@query(f"""WITH {_ENTRY} SELECT id, h AS headword, {_n1('h')} AS headword_normalized,
'A. (rare) ' || array_to_string(g, '; ') || ' | λόγος' || chr(10) || 'B. ' || g[1] AS entry_plain,
'<b>' || h || '</b><br/><b>A.</b> <i>rare</i> ' || array_to_string(g, '; ') || ' | λόγος<br/><b>B.</b> ' || g[1] AS entry_html
FROM e WHERE h <> '' AND len(g) > 0""")
def q67_dictionary_files(c: Corpus) -> DataFrame:
    """Dictionary files: senses, usage and Greek words of main entries, rendered; senses without translation do not count."""
    d = c.dictionary.where("headword IS NOT NULL AND entry_plain IS NOT NULL")
    g = F.filter(F.transform(F.split("entry_plain", ","), text.py_strip), lambda x: x != "")
    tr = lambda a: F.concat(F.lit("<trans>"), F.array_join(F.transform(a, lambda x: F.concat(
        F.lit("<tr>"), esc(x), F.lit("</tr>"))), ""), F.lit("</trans>"))
    body = F.concat(
        F.lit('<entryFree type="main" key="'), F.col("id").cast("string"), F.lit('"><orth>'), esc(F.col("headword")),
        F.lit('</orth><sense n="A"><usg>rare</usg>'), tr(g), F.lit('<foreign lang="greek">λόγος</foreign></sense><sense n="B">'),
        tr(F.slice(g, 1, 1)), F.lit('</sense><sense n="C"/></entryFree><entryFree type="gloss"/>'))
    f = documents(d, F.floor(F.col("id") / 200).cast("string"), ["id"], body, "<d>", "</d>")
    parsed = files.dictionary(f)
    rows = files.dictionary_entries(parsed.withColumn("language", F.lit("x")))
    key = F.regexp_extract("entry_xml", 'key="([0-9]+)"', 1).cast("bigint")
    return rows.select(key.alias("id"), "headword", "headword_normalized", "entry_plain", "entry_html")


@query("""SELECT id, replace(replace(replace(replace(k, '/', chr(769)), '\\', chr(768)), '=', chr(834)), '|', 'ι') AS beta
FROM (SELECT id, headword_normalized || '/x=y|' AS k FROM dictionary_entries WHERE headword_normalized IS NOT NULL)""")
def q67_beta_keys(c: Corpus) -> DataFrame:
    k = F.concat(F.col("headword_normalized"), F.lit("/x=y|"))
    return c.dictionary.where("headword_normalized IS NOT NULL").select("id", text.beta_key(k).alias("beta"))


# --- wiki dumps

_FORMS = f"""f AS (SELECT word_form, min(lemma) AS lemma FROM lemma_map WHERE word_form IS NOT NULL AND lemma IS NOT NULL AND lemma <> ''
 AND word_form = {_STRIP('word_form')} GROUP BY word_form)"""


def _forms(c: Corpus) -> DataFrame:
    """One lemma of every form."""
    ok = "word_form IS NOT NULL AND lemma IS NOT NULL AND lemma <> ''"
    return c.lemmas.where(ok).where(F.col("word_form") == text.py_strip(F.col("word_form"))).groupBy("word_form").agg(
        F.min("lemma").alias("lemma"))


def _pages(c: Corpus, *parts) -> DataFrame:
    return _forms(c).select(F.col("word_form").alias("title"), F.concat(
        *[F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts]).alias("wikitext"))


@query(f"""WITH {_FORMS} SELECT word_form AS title, '==Ancient Greek==' || chr(10) || '{{{{genitive of|grc|' || lemma || '}}}}' AS wikitext,
true AS has_ancient, false AS has_modern, true AS has_form_of, false AS has_table
FROM f WHERE NOT contains(word_form, ':') AND regexp_matches(word_form, '[\\x{{0370}}-\\x{{03FF}}\\x{{1F00}}-\\x{{1FFF}}]')""")
def q70_wiki_dump(c: Corpus) -> DataFrame:
    """Pages of a dump that is written and read back: those of no namespace with Greek titles, and what they hold."""
    p = _pages(c, "==Ancient Greek==\n{{genitive of|grc|", "$lemma", "}}")
    page = lambda t: F.concat(F.lit("<page><title>"), t, F.lit("</title><revision><text>"), esc(F.col("wikitext")),
                              F.lit("</text></revision></page>"))
    path = shared_dir(c.spark)
    parts = F.pmod(F.xxhash64("title"), F.lit(c.lemmas.count() // 500 + 1)).cast("string")
    both = F.concat(page(esc(F.col("title"))), page(F.concat(F.lit("User:"), esc(F.col("title")))))
    documents(p, parts, ["title"], both, "<mediawiki>", "</mediawiki>").select("value").write.option(
        "maxRecordsPerFile", 1).text(path)
    return files.greek_pages(files.main_pages(files.wiki_pages(c.spark, path)))


_MAPPED = f"{_n1('lemma')} <> '' AND {_n1('lemma')} <> {_n1('word_form')}"


@query(f"""WITH {_FORMS} SELECT word_form, {_n1('word_form')} AS word_normalized, {_n1('lemma')} AS lemma, 0.95::DOUBLE AS confidence,
'wiktionary' AS source, 'genitive' AS morph_info FROM f WHERE {_MAPPED}""")
def q71_form_mappings(c: Corpus) -> DataFrame:
    p = _pages(c, "==Ancient Greek==\n===Noun===\n{{genitive of|grc|", "$lemma", "}}{{dative of|grc|", "$lemma", "}}\n==Greek==\n{{plural of|grc|x}}")
    return files.form_mappings(p)


@query(f"""WITH {_FORMS}, x AS (SELECT DISTINCT {_n1('word_form')} AS word_form, {_n1('lemma')} AS lemma FROM f)
SELECT word_form, lemma, 1.0::DOUBLE AS confidence, 'wiktionary:inflection_of' AS source, '|gen|s' AS tags
FROM x WHERE word_form <> '' AND lemma <> '' AND lemma <> word_form""")
def q71_inflection_of(c: Corpus) -> DataFrame:
    return files.inflection_of(_pages(c, "{{inflection of|grc|[[", "$lemma", "]]||gen|s}} {{inflection of|el|", "$lemma", "||gen|s}}"))


@query(f"""WITH {_FORMS} SELECT word_form, {_n1('word_form')} AS word_normalized, lemma, {_n1('lemma')} AS lemma_normalized,
'noun' AS pos, 'gen,s' AS morphology, 'form of ' || lemma AS definition FROM f WHERE lemma = {_STRIP('lemma')}""")
def q71_inflection_info(c: Corpus) -> DataFrame:
    """The first template of the ladder that fits; what follows # in a lemma goes."""
    p = _pages(c, "==Ancient Greek==\n===Noun===\n# form of [[x|", "$lemma", "]]\n{{infl of|grc|other|x}} {{inflection of|grc|", "$lemma", "#A||gen|s}}")
    return files.inflection_info(p).where(F.col("lemma") == text.py_strip(F.col("lemma"))).withColumn(
        "morphology", F.array_join("morphology", ","))


_WORDS = f"""w AS (SELECT word_form, {_n1('word_form')} AS word_normalized, {_n1('lemma')} AS lemma, 0.9::DOUBLE AS confidence,
 'inflection:noun,verb' AS morph_info FROM f WHERE word_form <> lemma
 UNION ALL SELECT word_form, {_n1('word_form')}, {_n1('word_form')}, 0.95, 'lemma:adverb' FROM f WHERE word_form = lemma)"""


def _page_words(c: Corpus) -> DataFrame:
    own = F.col("word_form") == F.col("lemma")
    return files.page_words(_forms(c).select(F.col("word_form").alias("title"), F.when(
        own, F.lit("==Ancient Greek==\n===Adverb===\n# x")).otherwise(F.concat(
            F.lit("==Ancient Greek==\n===Verb===\n===noun===\n{{genitive of|grc|"), F.col("lemma"), F.lit("}}"))).alias("wikitext")))


@query(f"WITH {_FORMS}, {_WORDS} SELECT * FROM w")
def q71_page_words(c: Corpus) -> DataFrame:
    return _page_words(c)


@query(f"""WITH {_FORMS}, {_WORDS} SELECT split_part(morph_info, ':', 1) AS type, unnest(string_split(split_part(morph_info, ':', 2), ',')) AS pos,
count(*) AS n FROM w GROUP BY 1, 2""")
def q71_parts_of_speech(c: Corpus) -> DataFrame:
    """Counts by part of speech."""
    return files.part_of_speech_counts(_page_words(c))


@query(f"""WITH {_FORMS}, x AS (SELECT {_n1('word_form')} AS word_normalized, min(word_form) AS headword, min_by(lemma, word_form) AS lemma FROM f
 WHERE {_n1('word_form')} IN (SELECT word_normalized FROM word_forms) GROUP BY 1)
SELECT word_normalized, headword, left('form of ' || lemma || '; second; third', 30) AS entry_plain,
'<ol><li>form of ' || lemma || '</li><li>second</li><li>third</li></ol>' AS entry_html FROM x""")
def q72_definitions(c: Corpus) -> DataFrame:
    """The first three senses of each page whose word occurs in the texts."""
    p = _pages(c, "==Ancient Greek==\n# form of [[x|", "$lemma", "]]\n# ''second''\n#* quoted\n# third\n# fourth\n==Greek==\n# other")
    return files.definitions(p, c.words, chars=30)


@query(f"""WITH x AS (SELECT lemma, {_n1('word_form')} AS word_normalized, min(word_form) AS form FROM lemma_map
 WHERE lemma IS NOT NULL AND word_form IS NOT NULL AND regexp_full_match(word_form, '[\\x{{0370}}-\\x{{03FF}}\\x{{1F00}}-\\x{{1FFF}}]+') GROUP BY 1, 2)
SELECT {_n1('lemma')} AS lemma, word_normalized, max(form) AS form, 'noun' AS pos FROM x
WHERE length(form) > 2 AND form <> lemma AND word_normalized <> '' AND word_normalized <> {_n1('lemma')} AND {_n1('lemma')} = lemma
GROUP BY 1, 2""")
def q72_table_forms(c: Corpus) -> DataFrame:
    """Greek runs of the inflection templates."""
    rows = c.lemmas.where("lemma IS NOT NULL AND word_form IS NOT NULL").where(F.col("word_form").rlike("^[Ͱ-Ͽἀ-῿]+$"))
    rows = rows.where(text.normalize_greek(F.col("lemma")) == F.col("lemma")).groupBy(
        "lemma", text.normalize_greek(F.col("word_form")).alias("w")).agg(F.min("word_form").alias("form"))
    p = rows.select(F.col("lemma").alias("title"), F.concat(
        F.lit("==Ancient Greek==\n{{grc-decl|"), F.col("form"), F.lit("|αβ}}\n==Greek==\n{{grc-decl|ωωω}}")).alias("wikitext"))
    return files.table_forms(p)


@query(f"""WITH {_FORMS} SELECT {_n1('word_form')} AS word_form, {_n1('lemma')} AS lemma, 1.0::DOUBLE AS confidence,
CASE WHEN length(lemma) % 2 = 0 THEN 'elwiktionary:κλ' ELSE 'elwiktionary:λέξης' END AS source FROM f WHERE {_MAPPED}""")
def q72_greek_noun_forms(c: Corpus) -> DataFrame:
    form = F.when(F.length("lemma") % 2 == 0, F.concat(F.lit("{{κλ|grc|π=α|"), F.col("lemma"), F.lit("}}"))).otherwise(
        F.concat(F.lit("γενική της λέξης [["), F.col("lemma"), F.lit("]]")))
    return files.greek_noun_forms(_forms(c).select(F.col("word_form").alias("title"), F.concat(
        F.lit("=={{-grc-}}==\n{{μορφή ουσιαστικού|grc}} "), form).alias("wikitext")))


@query(f"""WITH {_FORMS} SELECT word_form AS title, {_n1('word_form')} AS lemma FROM f WHERE length(lemma) % 3 < 2""")
def q72_greek_verb_pages(c: Corpus) -> DataFrame:
    head = F.when(F.length("lemma") % 3 == 0, "===Ρήμα===").when(F.length("lemma") % 3 == 1, "{{κλ:λύω}}").otherwise("===Όνομα===")
    return files.greek_verb_pages(_forms(c).select(F.col("word_form").alias("title"), F.concat(
        F.lit("==Αρχαία ελληνικά==\n"), head).alias("wikitext")))


@query(f"""WITH s AS (SELECT unnest(['σφωέ', 'Ἀτρεύς', 'πρῶτα', 'νοῦσος', 'ἑλώριον']) AS headword)
SELECT headword, {_n1('headword')} AS headword_normalized FROM s
WHERE {_n1('headword')} NOT IN (SELECT headword_normalized FROM dictionary_entries WHERE headword_normalized IS NOT NULL)""")
def q72_supplements(c: Corpus) -> DataFrame:
    """Entries that the dictionary lacks, with their own lemma."""
    new, own = files.supplements(c.spark, c.dictionary, c.lemmas)
    return new.join(own.select(F.col("word_form").alias("headword")), "headword", "left").select("headword", "headword_normalized")


# --- JSON, CSV, tables

@query("""SELECT word_form, word_normalized, lemma, coalesce(confidence, 1.0) AS confidence, coalesce(source, 'wiktionary') AS source, morph_info
FROM lemma_map WHERE word_normalized IS NOT NULL""")
def q73_json_mappings(c: Corpus) -> DataFrame:
    """The lemma map written as files with a header and read back."""
    path = shared_dir(c.spark)
    files.write_json_mappings(c.lemmas.where("word_normalized IS NOT NULL").drop("ingested_at"), path, {"source": "x"})
    return files.json_mappings(c.spark, path)


@query("SELECT CAST(id AS VARCHAR) AS key, entry_plain AS plain, entry_html AS html FROM dictionary_entries")
def q73_json_objects(c: Corpus) -> DataFrame:
    """Files {key: object}, one for every 200 entries."""
    path = shared_dir(c.spark)
    rows = c.dictionary.select(F.floor(F.col("id") / 200).alias("part"), F.col("id").cast("string").alias("k"), F.struct(
        F.col("entry_plain").alias("plain"), F.col("entry_html").alias("html")).alias("v"))
    rows.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")).select(
        F.to_json("m")).write.option("maxRecordsPerFile", 1).text(path)
    return files.json_objects(c.spark, path, "plain:string,html:string")


@query(f"""WITH {_MARKS} SELECT id, book_id, line_number, line_text, nullif(note, '') AS note, created_at, last_accessed FROM bm""")
def q74_bookmarks_csv(c: Corpus) -> DataFrame:
    """Bookmarks written as quoted CSV and read back."""
    path = shared_dir(c.spark)
    files.write_bookmarks_csv(bookmarks.upsert(None, bookmarks.from_lines(c.lines)), path)
    return files.read_bookmarks_csv(c.spark, path).select("id", "book_id", "line_number", "line_text", "note", "created_at", "last_accessed")


_HALVES = """a AS (SELECT * FROM dictionary_entries WHERE source IS NULL), b AS (SELECT * FROM dictionary_entries WHERE source IS NOT NULL)"""
_ONE = "QUALIFY row_number() OVER (PARTITION BY headword_normalized ORDER BY id {}) = 1"


@query(f"""WITH {_HALVES} SELECT 'plain' AS how, id, headword_normalized FROM dictionary_entries
UNION ALL SELECT 'ignore', id, headword_normalized FROM a
UNION ALL SELECT 'ignore', id, headword_normalized FROM (SELECT * FROM b
  WHERE headword_normalized NOT IN (SELECT headword_normalized FROM a) {_ONE.format('')})
UNION ALL SELECT 'replace', id, headword_normalized FROM a WHERE headword_normalized NOT IN (SELECT headword_normalized FROM b)
UNION ALL SELECT 'replace', id, headword_normalized FROM (SELECT * FROM b {_ONE.format('DESC')})""")
def q75_insert_modes(c: Corpus) -> DataFrame:
    """Entries with a source added to a table of those without one, in the three ways of inserting."""
    out = None
    for how in ("plain", "ignore", "replace"):
        path = shared_dir(c.spark)
        d = c.dictionary
        files.write_tables({"dictionary_entries": d.where("source IS NULL")}, path)
        files.insert(c.spark, f"{path}/dictionary_entries.parquet", d.where("source IS NOT NULL"), ["headword_normalized"], ["id"], how)
        part = c.spark.read.parquet(f"{path}/dictionary_entries.parquet").select(F.lit(how).alias("how"), "id", "headword_normalized")
        out = part if out is None else out.unionByName(part)
    return out


# --- pages

_PAGES = """t AS (SELECT book_id, max(line_number) AS total FROM text_lines GROUP BY 1),
p AS (SELECT book_id, total, unnest(range(1, total + 1, 100)) AS a FROM t),
q AS (SELECT book_id, total, a, least(a + 99, total) AS z FROM p)"""


@query(f"""WITH {_PAGES},
r AS (SELECT book_id, translator, bool_or(start_line <= 0 AND (end_line IS NULL OR end_line >= 1)) AS ahead,
       bool_or(start_line <= total AND (end_line IS NULL OR end_line >= total + 1)) AS beyond
      FROM translation_segments JOIN t USING (book_id) WHERE translator IS NOT NULL AND start_line IS NOT NULL GROUP BY 1, 2),
x AS (SELECT *, NULL AS translator, false AS ahead, false AS beyond FROM q UNION ALL SELECT q.*, translator, ahead, beyond FROM q JOIN r USING (book_id))
SELECT book_id, CAST(a AS INTEGER) AS range_start, CAST(z AS INTEGER) AS range_end, translator,
CAST(CASE WHEN a > 1 OR ahead THEN greatest(1, a - 100) END AS INTEGER) AS previous_start,
CAST(CASE WHEN a > 1 OR ahead THEN a - 1 END AS INTEGER) AS previous_end,
CAST(CASE WHEN z < total OR beyond THEN z + 1 END AS INTEGER) AS next_start,
CAST(CASE WHEN z < total OR beyond THEN least(total, z + 100) END AS INTEGER) AS next_end FROM x""")
def q76_page_neighbours(c: Corpus) -> DataFrame:
    """The ranges before and after each page, of the text and of every translator."""
    return corpus.page_neighbours(c)


@query("""WITH p AS (SELECT book_id, (line_number - 1) // 30 + 1 AS page, count(*) AS line_rows FROM text_lines WHERE line_number >= 1 GROUP BY 1, 2),
m AS (SELECT book_id, unnest(range(1, max(page) + 2)) AS page FROM p GROUP BY 1),
f AS (SELECT book_id, page, coalesce(line_rows, 0) AS line_rows FROM m LEFT JOIN p USING (book_id, page)),
l AS (SELECT book_id, min(page) AS last FROM f WHERE line_rows < 30 GROUP BY 1)
SELECT book_id, CAST(page AS INTEGER) AS page, CAST(page * 30 - 29 AS INTEGER) AS first_line, CAST(page * 30 AS INTEGER) AS last_line,
line_rows, page = last AS is_last FROM f JOIN l USING (book_id) WHERE page <= last""")
def q76_web_pages(c: Corpus) -> DataFrame:
    return corpus.web_pages(c)


# --- streams

@query("""WITH c AS (SELECT id AS seq, book_id, line_number, line_text, id % 5 = 0 AS gone FROM text_lines
 QUALIFY row_number() OVER (PARTITION BY book_id, line_number ORDER BY id DESC) = 1)
SELECT book_id, line_number, line_text FROM c WHERE NOT gone""")
def q77_bookmark_stream(c: Corpus) -> DataFrame:
    """Every line as a change of its place (one id in five deletes), run through the stream."""
    base = shared_dir(c.spark)
    at, work = F.lit(0).cast("bigint"), F.col("book_id")
    log = c.lines.select(
        F.col("id").alias("seq"), F.when(F.col("id") % 5 == 0, "delete").otherwise("put").alias("op"), "id", work.alias("work_id"),
        "book_id", "line_number", work.alias("author_name"), work.alias("work_title"), work.alias("book_label"), "line_text",
        F.col("speaker").alias("note"), at.alias("created_at"), at.alias("last_accessed"))
    log.write.parquet(f"{base}/log")
    stream = c.spark.readStream.schema(log.schema).parquet(f"{base}/log")
    changes.bookmark_stream(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return c.spark.read.parquet(f"{base}/out/v=0").select("book_id", "line_number", "line_text")


@query(problems.SQL["p3_found"] + " AND table_name = 'translation_lookup'")
def q77_orphan_stream(c: Corpus) -> DataFrame:
    """References of the lookup run through the stream in two batches, the segments after the lookup."""
    base = shared_dir(c.spark)
    row = lambda key, side, at: (
        F.lit("translation_lookup").alias("table_name"), F.lit(side).alias("side"), F.col(key).cast("string").alias("ref_key"), F.col(at).alias("at"))
    parts = [
        c.get("translation_lookup").select(*row("segment_id", "ref", "ingested_at")),
        c.segments.select(*row("id", "parent", "ingested_at")).unionByName(
            c.segments.where("removed_at IS NOT NULL").select(*row("id", "removed", "removed_at")))]
    for n, part in enumerate(parts):
        part.write.mode("append").parquet(f"{base}/events")
        stream = c.spark.readStream.schema(part.schema).parquet(f"{base}/events")
        changes.orphan_stream(stream, f"{base}/state", f"{base}/checkpoint").awaitTermination()
    state: orphans.OrphanState = changes.orphan_state(c.spark, f"{base}/state", 1)
    return state.broken().select("table_name", "ref_key", "load_month", "kind")
