"""Marked-up texts: files -> events -> lines and segments.

The only Python step turns each file into *events*: one row per element that
matters, in document order, with its place (book, section, poem, paragraph) and
its text. Every layout (verse, drama, prose) and every kind of segment is then
DataFrame algebra over the events, so a corpus is parsed once and in parallel by
file.

``compat`` matches tags by their endings and strips text at every level, as
older builds of such corpora did; otherwise local names must be equal and text
is stripped once. Files that are not well formed give no events and one row of
kind ``error``.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lektra.functions import text
from lektra.operators import tables

EVENTS = """path string, pos int, kind string, n string, book string, section string, section_pos int,
poem_pos int, para_pos int, content string, xml string"""
EXCLUDED = {"note", "foreign", "ref", "bibl"}
UNITS = {"line", "card", "section", "chapter"}
# What lines that are not text contain. A corpus may add names its editors sign with.
BOILERPLATE = ("pointer pattern", "This pointer")
# Authors whose works are prose or drama whatever their markup says.
PROSE_AUTHORS = "tlg0007 tlg0016 tlg0003 tlg0032 tlg0059 tlg0086".split()
DRAMA_AUTHORS = "tlg0085 tlg0011 tlg0006 tlg0019".split()
_XML_NAMES = {"amp", "lt", "gt", "quot", "apos"}


def named_entities(xml: str) -> str:
    """Named entities that XML does not know become characters."""
    def sub(m: re.Match) -> str:
        name = m.group(1)
        return m.group() if name in _XML_NAMES or name not in name2codepoint else chr(name2codepoint[name])

    return re.sub(r"&([A-Za-z][A-Za-z0-9]*);", sub, xml)


def local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def content(elem: ET.Element, compat: bool = False) -> str:
    """Text of an element without editorial elements; what follows them stays."""
    if local(elem.tag) in EXCLUDED:
        return ""
    parts = [elem.text or ""]
    for child in elem:
        if local(child.tag) not in EXCLUDED:
            parts.append(content(child, compat))
        parts.append(child.tail or "")
    out = "".join(parts)
    return out.strip() if compat else out


def events(path: str, xml: str, compat: bool = False) -> Iterator[tuple]:
    try:
        root = ET.fromstring(named_entities(xml).encode("utf-8"))
    except ET.ParseError:
        yield (path, 0, "error", None, None, None, None, None, None, None, None)
        return
    fits = (lambda tag, name: tag.endswith(name)) if compat else (lambda tag, name: tag == name)
    pos = 0

    def walk(elem: ET.Element, book, section, section_pos, poem_pos, para_pos) -> Iterator[tuple]:
        nonlocal pos
        tag, n = local(elem.tag), elem.get("n")
        if not tag:
            return
        kinds = []
        if fits(tag, "div") or re.fullmatch(r"div\d", tag):
            sub = elem.get("subtype") or elem.get("type")
            if sub == "book":
                book = n
                kinds.append("book")
            elif sub in ("section", "chapter"):
                section, section_pos = n, pos
                kinds.append("section")
            elif sub == "poem":
                poem_pos = pos
                kinds.append("poem")
        if fits(tag, "speaker"):
            kinds.append("speaker")
        if fits(tag, "l") or fits(tag, "line"):
            kinds.append("line")
        if fits(tag, "p"):
            kinds.append("para")
        if fits(tag, "milestone") and elem.get("unit") in UNITS:
            kinds.append("milestone")
        here = pos
        for kind in kinds:
            body = "" if kind in ("milestone", "book", "poem") else content(elem, compat).strip()
            raw = ET.tostring(elem, encoding="unicode") if kind == "line" else None
            own_para = here if kind == "para" else para_pos
            yield (path, pos, kind, n, book, section, section_pos, poem_pos, own_para, body, raw)
            pos += 1
        if "para" in kinds:
            para_pos = here
        for child in elem:
            yield from walk(child, book, section, section_pos, poem_pos, para_pos)

    yield from walk(root, None, None, None, None, None)


def read_events(files: DataFrame, compat: bool = False) -> DataFrame:
    """``files`` (path, value) -> events."""
    names = [c.split(" ")[0] for c in re.sub(r"\s+", " ", EVENTS).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, value in zip(b["path"], b["value"]):
                rows = pd.DataFrame(list(events(path, value, compat)), columns=names)
                for c in ("pos", "section_pos", "poem_pos", "para_pos"):
                    rows[c] = rows[c].astype("Int32")
                yield rows

    return files.select("path", "value").mapInPandas(run, EVENTS)


def read_files(spark: SparkSession, root: str, glob: str = "*.xml") -> DataFrame:
    """Files below a folder as (path, value)."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        .select("path", F.decode("content", "UTF-8").alias("value"))
    )


# --- layouts

def layouts(ev: DataFrame, prose: Column | None = None, drama: Column | None = None) -> DataFrame:
    """Layout of each file: prose before drama before verse. ``prose`` and ``drama``
    say by the path which files are so anyway (default: the lists of authors)."""
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))
    counts = ev.groupBy("path").agg(
        n("para").alias("p"), n("line").alias("l"), n("section").alias("s"), n("book").alias("b"))
    by_count = (F.col("p") > 2 * F.col("l")) | ((F.col("s") > 0) & (F.col("p") > 0) & (F.col("p") >= F.col("s")))
    author = F.regexp_extract("path", "((?:tlg|phi)[0-9]+)", 1)
    is_prose = by_count | (author.isin(*PROSE_AUTHORS) if prose is None else prose)
    return counts.withColumn(
        "layout",
        F.when(is_prose & (F.col("b") > 0), "prose_books").when(is_prose, "prose")
        .when(author.isin(*DRAMA_AUTHORS) if drama is None else drama, "drama")
        .when(F.col("b") > 0, "verse_books").otherwise("verse"))


def _text_ok(c: Column, boilerplate: tuple[str, ...] = BOILERPLATE) -> Column:
    ok = c != ""
    for b in boilerplate:
        ok = ok & ~c.contains(b)
    return ok


def verse_lines(ev: DataFrame) -> DataFrame:
    """Every line element counts, also those dropped as blank or boilerplate, so numbers may have gaps."""
    rows = ev.where(F.col("kind") == "line").withColumn("book", F.coalesce("book", F.lit("1")))
    rows = tables.numbered(rows, ["path", "book"], ["pos"], "line_number")
    return rows.where(_text_ok(F.col("content"))).select(
        "path", "book", "line_number", F.col("content").alias("line_text"), F.col("xml").alias("line_xml"),
        F.lit(None).cast("string").alias("speaker"))


def drama_lines(ev: DataFrame) -> DataFrame:
    """Numbered lines with the speaker seen last, in order of their numbers."""
    rows = ev.where(F.col("kind").isin("line", "speaker"))
    rows = tables.carried(
        rows.withColumn("sp", F.when(F.col("kind") == "speaker", F.col("content"))), ["path"], ["pos"], "sp", "speaker")
    return rows.where((F.col("kind") == "line") & F.col("n").rlike("^[0-9]+$") & _text_ok(F.col("content"))).select(
        "path", F.lit("1").alias("book"), F.col("n").cast("int").alias("line_number"),
        F.col("content").alias("line_text"), F.col("xml").alias("line_xml"), "speaker")


def prose_lines(ev: DataFrame, greek: Column) -> DataFrame:
    """Paragraphs cut into sentences, apparatus dropped, numbered within the book. A section
    without paragraphs gives its own text."""
    paras = ev.where(F.col("kind") == "para")
    with_p = paras.select("path", "section_pos").distinct()
    bare = ev.where(F.col("kind") == "section").withColumn("at", F.col("pos")).join(
        with_p.withColumnRenamed("section_pos", "at"), ["path", "at"], "left_anti").drop("at")
    rows = paras.unionByName(bare.select(*paras.columns)).withColumn("book", F.coalesce("book", F.lit("1")))
    s = rows.select("path", "book", "pos", "kind", F.posexplode(text.sentences(F.col("content"), greek)).alias("k", "s"))
    s = s.withColumn("s", text.py_strip(F.col("s"))).where(
        F.when(F.col("kind") == "para", ~text.is_editorial_noise(F.col("s")))
        .otherwise(~text.is_editorial_noise(F.col("s"), 20, False)))
    return tables.numbered(s, ["path", "book"], ["pos", "k"], "line_number").select(
        "path", "book", "line_number", F.col("s").alias("line_text"),
        F.lit(None).cast("string").alias("line_xml"), F.lit(None).cast("string").alias("speaker"))


def text_lines(ev: DataFrame, greek: Column, prose: Column | None = None, drama: Column | None = None) -> DataFrame:
    """Lines of all files, each by its layout."""
    kinds = layouts(ev, prose, drama).select("path", "layout")
    part = lambda *names: ev.join(kinds.where(F.col("layout").isin(*names)), "path", "left_semi")
    return (
        verse_lines(part("verse", "verse_books")).unionByName(drama_lines(part("drama")))
        .unionByName(prose_lines(part("prose", "prose_books"), greek))
    )


def books(lines: DataFrame) -> DataFrame:
    """One book per (path, book): its number, padded id part, and line count as its last line."""
    num = F.coalesce(F.expr("try_cast(book as int)"), F.lit(1))
    return lines.groupBy("path", "book").agg(F.count(F.lit(1)).cast("int").alias("line_count")).select(
        "path", "book", num.alias("book_number"), F.lpad(num.cast("string"), 3, "0").alias("id_part"),
        F.concat(F.lit("Book "), F.col("book")).alias("label"), F.lit(1).alias("start_line"),
        F.col("line_count").alias("end_line"), "line_count")


def words(lines: DataFrame, key: list[str], language: Column) -> DataFrame:
    """Words with their positions; dropped tokens leave gaps."""
    w = lines.select(*key, "line_number", language.alias("language"), F.posexplode(text.tokens(F.col("line_text"))).alias("p", "word"))
    return w.select(
        *key, "line_number", (F.col("p") + 1).alias("word_position"), "word",
        text.normalize_word(F.col("word"), F.col("language")).alias("word_normalized"),
    ).where(F.col("word_normalized") != "")


# --- translations

def speaker_segments(ev: DataFrame) -> DataFrame:
    """Per run of one speaker: from its first to its last numbered line, text joined."""
    rows = tables.islands(
        ev.where(F.col("kind").isin("line", "speaker")), ["path", "book"], ["pos"], F.col("kind") == "speaker")
    named = tables.carried(
        rows.withColumn("sp", F.when(F.col("kind") == "speaker", F.col("content"))), ["path", "book"], ["pos"], "sp", "speaker")
    ok = (F.col("kind") == "line") & (F.col("island") > 0) & F.col("n").rlike("^[0-9]+$") & (F.col("content") != "")
    n = F.col("n").cast("int")
    return named.where(ok).groupBy("path", "book", "island").agg(
        F.min_by(n, "pos").alias("start_line"), F.max_by(n, "pos").alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), " ").alias("segment_text"),
        F.first("speaker").alias("speaker"), F.min("pos").alias("pos")).drop("island")


def milestone_segments(ev: DataFrame, stephanus: Column) -> DataFrame:
    """Paragraphs with milestones: from the first to the last number in them; a number that
    is none becomes its CRC modulo 10,000. Where the first number of the book is a page
    of an edition (above 1,000, or three figures where ``stephanus``) paragraphs are
    numbered in order instead."""
    m = ev.where((F.col("kind") == "milestone") & (F.coalesce("n", F.lit("")) != ""))
    digits = F.regexp_extract("n", "^(\\d+)", 1)
    m = m.withColumn("num", F.when(digits != "", digits.cast("int")).otherwise((F.crc32("n") % 10000).cast("int")))
    first = m.where(digits != "").groupBy("path", "book").agg(F.min_by("num", "pos").alias("first_num"))
    paged = (F.col("first_num") > 1000) | (stephanus & F.col("first_num").between(100, 999))
    inside = m.where(F.col("para_pos").isNotNull()).groupBy("path", F.col("para_pos").alias("pos")).agg(
        F.min_by("num", "pos").alias("a"), F.max_by("num", "pos").alias("z"))
    p = ev.where((F.col("kind") == "para") & (F.col("content") != "")).join(inside, ["path", "pos"])
    p = p.join(first, [p["path"] == first["path"], p["book"].eqNullSafe(first["book"])], "left").select(p["*"], "first_num")
    p = tables.numbered(p, ["path", "book"], ["pos"], "k").withColumn("paged", F.coalesce(paged, F.lit(False)))
    return p.select(
        "path", "book", F.when(F.col("paged"), F.col("k")).otherwise(F.col("a")).alias("start_line"),
        F.when(F.col("paged"), F.col("k")).otherwise(F.col("z")).alias("end_line"),
        F.col("content").alias("segment_text"), F.lit(None).cast("string").alias("speaker"), "pos")


def section_segments(ev: DataFrame) -> DataFrame:
    """Numbered sections; books without any section give their paragraphs of more than 20 characters."""
    s = ev.where(F.col("kind") == "section")
    none = F.lit(None).cast("string").alias("speaker")
    n = F.col("n").cast("int")
    by_section = s.where(F.col("n").rlike("^[0-9]+$") & (F.col("content") != "")).select(
        "path", "book", n.alias("start_line"), n.alias("end_line"), F.col("content").alias("segment_text"), none, "pos")
    p = ev.where((F.col("kind") == "para") & (F.length("content") > 20)).withColumn("b", F.coalesce("book", F.lit("")))
    p = p.join(s.select("path", F.coalesce("book", F.lit("")).alias("b")).distinct(), ["path", "b"], "left_anti").drop("b")
    p = tables.numbered(p, ["path", "book"], ["pos"], "k")
    return by_section.unionByName(p.select(
        "path", "book", F.col("k").alias("start_line"), F.col("k").alias("end_line"),
        F.col("content").alias("segment_text"), none, "pos"))


def line_segments(ev: DataFrame) -> DataFrame:
    """Lines as segments: numbered in order through the poems of a book that has any, else by their own number."""
    l = ev.where((F.col("kind") == "line") & (F.col("content") != ""))
    poems = ev.where(F.col("kind") == "poem").select("path", F.coalesce("book", F.lit("")).alias("b")).distinct()
    l = l.withColumn("b", F.coalesce("book", F.lit(""))).join(poems.withColumn("has_poems", F.lit(True)), ["path", "b"], "left").drop("b")
    in_poem = F.coalesce("has_poems", F.lit(False))
    a = tables.numbered(l.where(in_poem & F.col("poem_pos").isNotNull()), ["path", "book"], ["pos"], "k")
    b = l.where(~in_poem & F.col("n").rlike("^[0-9]+$")).withColumn("k", F.col("n").cast("int"))
    return a.unionByName(b).select(
        "path", "book", F.col("k").alias("start_line"), F.col("k").alias("end_line"),
        F.col("content").alias("segment_text"), F.lit(None).cast("string").alias("speaker"), "pos")


def translation_segments(ev: DataFrame, stephanus: Column | None = None, few: int = 50) -> DataFrame:
    """Segments of every book: by speakers, else by milestones, else by sections or
    paragraphs; books with fewer than ``few`` get their lines as well."""
    key = lambda df: df.withColumn("b", F.coalesce("book", F.lit("")))
    sp = key(speaker_segments(ev))
    has_sp = sp.select("path", "b").distinct()
    marked = key(ev.where(F.col("kind") == "milestone")).select("path", "b").distinct()
    ms = key(milestone_segments(ev, F.lit(False) if stephanus is None else stephanus)).join(has_sp, ["path", "b"], "left_anti")
    se = key(section_segments(ev)).join(has_sp, ["path", "b"], "left_anti").join(marked, ["path", "b"], "left_anti")
    main = sp.unionByName(ms).unionByName(se)
    many = main.groupBy("path", "b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= few).select("path", "b")
    extra = key(line_segments(ev)).join(many, ["path", "b"], "left_anti")
    return main.unionByName(extra).drop("b")


# --- metadata

def cts_metadata(files: DataFrame) -> DataFrame:
    """Titles and URN of catalogue files (path, value); of several titles the last counts,
    and the label of a translation stands for the English title."""
    x = lambda p: F.array_compact(F.xpath("value", F.lit(p)))
    title = lambda lang: f"//*[contains(local-name(),'title') and @*[local-name()='lang']='{lang}']/text()"
    last = lambda a: F.element_at(a, -1)
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return files.select(
        "path",
        F.coalesce(
            some(F.try_element_at(x("//*[local-name()='translation']/*[local-name()='label']/text()"), F.lit(-1))),
            some(F.try_element_at(x(title("eng")), F.lit(-1)))).alias("title_english"),
        some(F.try_element_at(x(title("lat")), F.lit(-1))).alias("title_latin"),
        some(F.try_element_at(x(title("grc")), F.lit(-1))).alias("title_greek"),
        F.coalesce(some(F.xpath_string("value", F.lit("string(/*/@urn)"))),
                   some(F.xpath_string("value", F.lit("string((//*[contains(local-name(),'work')]/@urn)[1])")))).alias("urn"),
        some(F.xpath_string("value", F.lit("string(//*[local-name()='groupname'])"))).alias("groupname"))


# Latin titles with usual English ones.
ENGLISH_TITLES = {
    "Carmina": "Odes", "Epistulae": "Epistles", "Sermones": "Satires", "Epodi": "Epodes",
    "De Bello Gallico": "The Gallic War", "De Bello Civili": "The Civil War", "Metamorphoses": "Metamorphoses",
    "Fasti": "Fasti", "Tristia": "Tristia", "Ex Ponto": "Letters from Pontus", "Heroides": "Heroides",
    "Amores": "The Loves", "Remedia Amoris": "The Cure for Love", "Medicamina Faciei Femineae": "Cosmetics for Ladies",
}
# Work, edition and translator where a file does not say.
TRANSLATORS = """
tlg0012.tlg001 eng3 Samuel Butler
tlg0012.tlg001 eng4 A. T. Murray
tlg0012.tlg002 eng3 Samuel Butler
tlg0012.tlg002 eng4 A. T. Murray
tlg0016.tlg001 eng2 A. D. Godley
tlg0032.tlg001 eng2 H. G. Dakyns
tlg0032.tlg002 eng2 H. G. Dakyns
tlg0032.tlg006 eng2 H. G. Dakyns
tlg0032.tlg007 eng2 H. G. Dakyns
tlg0086.tlg003 eng2 Frederic G. Kenyon
tlg0086.tlg025 eng2 Hugh Tredennick
tlg0086.tlg010 eng2 Harris Rackham
tlg0086.tlg038 eng2 John Henry Freese
tlg0086.tlg034 eng2 William Hamilton Fyfe
tlg0086.tlg035 eng2 Harris Rackham
tlg0086.tlg009 eng2 Harris Rackham
tlg0086.tlg029 eng2 George Cyril Armstrong
tlg0086.tlg045 eng2 H. Rackham
tlg0007.tlg051 eng1 Bernadotte Perrin
tlg0007.tlg052 eng1 Bernadotte Perrin
phi0893.phi004 eng2 Christopher Smart
"""
# Translators named within a file's name.
NAMED_FILES = {"butler": "Samuel Butler", "murray": "A. T. Murray", "jowett": "Benjamin Jowett"}


def resolve_titles(meta: DataFrame, work_number: Column, english: dict[str, str] | None = None) -> DataFrame:
    """``title`` and ``title_english`` from what the catalogue has; a Latin title that stands
    for the English one is put into English where the table knows it."""
    names = F.create_map(*[F.lit(x) for kv in (english or ENGLISH_TITLES).items() for x in kv])
    stand_in = F.coalesce("title_latin", work_number)
    eng = F.coalesce("title_english", F.try_element_at(names, stand_in), stand_in)
    return meta.withColumn("title", F.coalesce("title_greek", "title_latin", eng)).withColumn("title_english", eng)


def translator(files: DataFrame, not_translators: tuple[str, ...] = ()) -> DataFrame:
    """Translator of each file (path, value): editor, a responsibility that speaks of
    translation (but for names that are known not to be), author with that role, the
    table by work and edition, a name within the file's name, "Unknown"."""
    one = lambda p: F.nullif(F.trim(F.xpath_string("value", F.lit(f"string({p})"))), F.lit(""))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    resp = one("//*[local-name()='respStmt'][contains(., 'ranslat')]//*[contains(local-name(), 'name') or contains(local-name(), 'Name')]")
    for n in not_translators:
        resp = F.when(~F.lower(resp).contains(n.lower()), resp)
    table = F.lit(None).cast("string")
    for line in TRANSLATORS.strip().splitlines():
        work, edition, who = line.split(" ", 2)
        table = F.when(name.startswith(work + ".") & name.endswith(f"-{edition}.xml"), who).otherwise(table)
    within = F.lit(None).cast("string")
    for k, v in reversed(NAMED_FILES.items()):
        within = F.when(name.contains("eng") & name.contains(k), v).otherwise(within)
    return files.select("path", F.coalesce(
        one("//*[contains(local-name(), 'editor')][@role='translator']"), resp,
        one("//*[local-name()='author'][contains(@role,'trans')]"), table, within, F.lit("Unknown")).alias("translator"))


def pick_editions(files: DataFrame, project: str = "", marks: tuple[str, ...] = ("grc", "lat")) -> DataFrame:
    """One file per work folder: the first by path whose name has the project's mark and a language."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    ok = name.contains(project)
    lang = F.lit(False)
    for m in marks:
        lang = lang | name.contains(m)
    rows = files.withColumn("work", F.element_at(parts, -2)).where(ok & lang & ~name.startswith("__"))
    w = Window.partitionBy("work").orderBy("path")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def discover_authors(files: DataFrame) -> DataFrame:
    """Author ids and names from catalogue files of folders named by author."""
    meta = cts_metadata(files)
    key = F.regexp_extract("path", "/((?:tlg|phi)[^/]*)/[^/]*$", 1)
    return meta.withColumn("id", key).where(F.col("id") != "").select(
        "id", F.coalesce("groupname", "id").alias("name"), text.language_of(F.col("id")).alias("language"))
