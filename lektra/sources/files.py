"""Dictionary files, wiki dumps, JSON mappings, CSV and list files; and the writers."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lektra.functions import text
from lektra.operators.tables import first_writer, insert_ignore, last_writer
from lektra.plans.bookmarks import SCHEMA as BOOKMARKS
from lektra.sources.tei import local, named_entities

ENTRIES = """path string, pos int, entry_key string, headword string,
senses array<struct<n:string,translations:array<string>,usage:array<string>,greek:array<string>>>, entry_xml string"""


def _entries(path: str, xml: str) -> Iterator[tuple]:
    words = lambda e: [t for t in ("".join(x.itertext()).strip() for x in e) if t]
    pos = 0
    for _, e in ET.iterparse(BytesIO(named_entities(xml).encode("utf-8"))):
        if not local(e.tag).startswith("entry") or e.get("type") != "main":
            continue
        orth = next((x for x in e.iter() if local(x.tag) == "orth"), None)
        senses = []
        for s in (x for x in e.iter() if local(x.tag) == "sense"):
            senses.append({
                "n": s.get("n"),
                "translations": words(t for r in s.iter() if local(r.tag) == "trans" for t in r.iter() if local(t.tag) == "tr"),
                "usage": words(u for u in s.iter() if local(u.tag) == "usg"),
                "greek": words(f for f in s.iter() if local(f.tag) == "foreign" and (f.get("lang") or "").startswith("gr")),
            })
        head = "".join(orth.itertext()).strip() if orth is not None else None
        yield (path, pos, e.get("key"), head, senses, ET.tostring(e, encoding="unicode"))
        pos += 1
        e.clear()


def dictionary(files: DataFrame) -> DataFrame:
    """Main entries of dictionary files (path, value), parsed as a stream per file."""
    names = ["path", "pos", "entry_key", "headword", "senses", "entry_xml"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, value in zip(b["path"], b["value"]):
                yield pd.DataFrame(list(_entries(path, value)), columns=names)

    return files.select("path", "value").mapInPandas(run, ENTRIES)


def dictionary_entries(parsed: DataFrame, language: str = "greek") -> DataFrame:
    """Entries with a headword and a translation, rendered: sense numbers only where there are several."""
    head = F.coalesce(F.nullif("headword", F.lit("")), text.beta_key(F.col("entry_key")))
    full = F.filter("senses", lambda s: F.size(s["translations"]) > 0)

    def render(s: Column, html: bool) -> Column:
        num = F.when((F.size(full) > 1) & s["n"].isNotNull(), F.concat(
            F.lit("<b>" if html else ""), s["n"], F.lit(".</b> " if html else ". "))).otherwise(F.lit(""))
        usage = F.when(F.size(s["usage"]) > 0, F.concat(
            F.lit("<i>" if html else "("), F.array_join(s["usage"], ", "), F.lit("</i> " if html else ") "))).otherwise(F.lit(""))
        greek = F.when(F.size(s["greek"]) > 0, F.concat(F.lit(" | "), F.array_join(s["greek"], " | "))).otherwise(F.lit(""))
        return F.concat(num, usage, F.array_join(s["translations"], "; "), greek)

    return parsed.withColumn("headword", head).where((F.coalesce("headword", F.lit("")) != "") & (F.size(full) > 0)).select(
        "headword", text.normalize_word(F.col("headword"), F.lit(language)).alias("headword_normalized"),
        F.lit(language).alias("language"), "entry_xml",
        F.concat(F.lit("<b>"), F.col("headword"), F.lit("</b><br/>"),
                 F.array_join(F.transform(full, lambda s: render(s, True)), "<br/>")).alias("entry_html"),
        F.array_join(F.transform(full, lambda s: render(s, False)), "\n").alias("entry_plain"))


# --- wiki dumps

def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages (title, wikitext) of a dump, also of a .bz2."""
    pages = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", "true").schema(
        "title string, revision struct<text:string>").load(path)
    return pages.select("title", F.col("revision.text").alias("wikitext"))


def main_pages(pages: DataFrame, reconstructions: bool = False) -> DataFrame:
    """Pages of no namespace (and reconstructions, if asked for)."""
    ok = ~F.col("title").contains(":")
    return pages.where(ok | F.col("title").startswith("Reconstruction:") if reconstructions else ok)


def greek_pages(pages: DataFrame) -> DataFrame:
    """Pages titled in Greek letters, with what they hold."""
    t = F.col("wikitext")
    return pages.where(F.col("title").rlike("[Ͱ-Ͽἀ-῿]")).select(
        "title", "wikitext", t.contains("==Ancient Greek==").alias("has_ancient"), t.contains("==Greek==").alias("has_modern"),
        t.rlike("\\{\\{[^{}|]* of\\|").alias("has_form_of"), t.rlike("\\{\\{(grc-decl|grc-conj|grc-adecl)").alias("has_table"))


def form_mappings(pages: DataFrame, confidence: float = 0.95, source: str = "wiktionary") -> DataFrame:
    """Lemma map rows of the form templates in each page's Ancient Greek section."""
    s = pages.withColumn("s", text.wiki_section(F.col("wikitext"), "Ancient Greek")).where(F.col("s") != "")
    rows = s.select("title", text.template_morphology(F.col("s")).alias("morph_info"),
                    F.explode(F.array_distinct(text.template_lemmas(F.col("s")))).alias("raw"))
    norm = rows.select(
        F.col("title").alias("word_form"), text.normalize_greek(F.col("title")).alias("word_normalized"),
        text.normalize_greek(F.col("raw")).alias("lemma"), F.lit(confidence).alias("confidence"),
        F.lit(source).alias("source"), "morph_info")
    ok = (F.col("lemma") != "") & (F.col("lemma") != F.col("word_normalized"))
    return first_writer([norm.where(ok)], ["word_form", "lemma"], ["morph_info"])


# Part-of-speech headings, and those a single inflected page is looked up for.
PARTS_OF_SPEECH = "Noun Verb Adjective Adverb Particle Conjunction Preposition Pronoun Numeral Interjection Article Determiner".split()
PAGE_PARTS = "Noun Verb Adjective Pronoun Particle Adverb Preposition Conjunction Numeral Interjection Proper noun".split(" ", 10)


def inflection_of(pages: DataFrame) -> DataFrame:
    """Every "inflection of" template of a page with its tags; one row per form and lemma, the first."""
    found = F.regexp_extract_all("wikitext", F.lit("\\{\\{inflection of\\|(?:grc|el)\\|[^|{}]+\\|[^{}]*\\}\\}"), F.lit(0))
    rows = pages.select("title", F.posexplode(found).alias("pos", "t"))
    raw = F.regexp_replace(F.regexp_extract("t", "of\\|(?:grc|el)\\|([^|]+)\\|", 1), "\\[\\[|\\]\\]", "")
    rows = rows.select(
        text.normalize_greek(F.col("title")).alias("word_form"), text.normalize_greek(raw).alias("lemma"), "title", "pos",
        F.lit(1.0).alias("confidence"), F.lit("wiktionary:inflection_of").alias("source"),
        F.regexp_extract("t", "of\\|(?:grc|el)\\|[^|]+\\|([^}]*)\\}\\}", 1).alias("tags"))
    ok = (F.col("word_form") != "") & (F.col("lemma") != "") & (F.col("lemma") != F.col("word_form"))
    return first_writer([rows.where(ok)], ["word_form", "lemma"], ["title", "pos"]).drop("title", "pos")


def inflection_info(pages: DataFrame) -> DataFrame:
    """One row per inflected page: lemma and tags of the first template in this order, and
    the page's part of speech and first definition. The Ancient Greek section counts, else the Greek one."""
    ancient, modern = (text.wiki_section(F.col("wikitext"), h) for h in ("Ancient Greek", "Greek"))
    s = pages.withColumn("s", F.coalesce(F.nullif(ancient, F.lit("")), F.nullif(modern, F.lit("")))).where(F.col("s").isNotNull())
    get = lambda p, g: F.nullif(F.regexp_extract("s", p, g), F.lit(""))
    # Fixed values, in order: pattern, group of the lemma, group of the tags.
    ladder = [
        ("(?i)\\{\\{inflection of\\|grc\\|([^|]+)\\|([^}]+)\\}\\}", 1, 2),
        ("(?i)\\{\\{inflection of\\|el\\|([^|]+)\\|([^}]+)\\}\\}", 1, 2),
        ("(?i)\\{\\{infl of\\|grc\\|([^|]+)\\|([^}]+)\\}\\}", 1, 2),
        ("(?i)\\{\\{form of\\|([^|]+)\\|([^|]+)\\|lang=grc[^}]*\\}\\}", 2, 0),
        ("(?i)\\{\\{inflected form of\\|grc\\|([^|}]+)[^}]*\\}\\}", 1, 0),
        ("(?i)\\{\\{(nominative|genitive|dative|accusative|vocative) (?:singular|plural) of\\|grc\\|([^}]+)\\}\\}", 2, 1),
    ]
    hits = [F.struct(get(p, g).alias("lemma"), (F.filter(F.transform(F.split(get(p, t), "\\|"), F.trim), lambda x: x != "")
                     if t else F.array().cast("array<string>")).alias("tags")) for p, g, t in ladder]
    # the first that fits; exploded, so that the ladder is climbed once
    first = F.slice(F.filter(F.array(*hits), lambda x: x["lemma"].isNotNull()), 1, 1)
    s = s.select("title", "s", F.inline(first))
    pos = F.lower(get("===(" + "|".join(PAGE_PARTS) + ")===", 1))
    lines = F.filter(F.split("s", "\n"), lambda x: x.startswith("# "))
    lemma = F.trim(F.regexp_replace("lemma", "[#|].*", ""))
    return s.select(
        F.col("title").alias("word_form"), text.normalize_greek(F.col("title")).alias("word_normalized"), lemma.alias("lemma"),
        text.normalize_greek(lemma).alias("lemma_normalized"), pos.alias("pos"), F.col("tags").alias("morphology"),
        F.when(pos.isNotNull(), text.wiki_plain(F.substr(F.get(lines, 0), F.lit(3)))).alias("definition"))


def greek_noun_forms(pages: DataFrame) -> DataFrame:
    """Noun forms of the Greek-language wiki: the last parameter of the inflection template,
    else the word named in the text."""
    t = F.col("wikitext")
    template = F.nullif(F.trim(F.regexp_extract(t, "\\{\\{\\s*κλ\\s*\\|\\s*grc\\s*\\|[^}]*\\|([^}|]+)\\s*\\}\\}", 1)), F.lit(""))
    named = F.nullif(F.trim(F.regexp_extract(t, "της λέξης \\[\\[([^\\]]+)\\]\\]", 1)), F.lit(""))
    return pages.where(t.contains("=={{-grc-}}==") & t.contains("{{μορφή ουσιαστικού|grc}}")).select(
        text.normalize_greek(F.col("title")).alias("word_form"), text.normalize_greek(F.coalesce(template, named)).alias("lemma"),
        F.lit(1.0).alias("confidence"), F.when(template.isNotNull(), "elwiktionary:κλ").otherwise("elwiktionary:λέξης").alias("source"),
    ).where((F.col("lemma") != "") & (F.col("lemma") != F.col("word_form")))


def greek_verb_pages(pages: DataFrame) -> DataFrame:
    """Pages of the Greek-language wiki about ancient verbs."""
    t = F.col("wikitext")
    return pages.where(t.contains("==Αρχαία ελληνικά==") & (t.contains("===Ρήμα===") | t.contains("{{κλ:"))).select(
        "title", text.normalize_greek(F.col("title")).alias("lemma"))


def page_words(pages: DataFrame) -> DataFrame:
    """Inflected pages by their lemmas (0.9), pages with a part of speech and no lemma as
    their own lemma (0.95); morphology "type:pos,pos"."""
    s = pages.withColumn("s", text.wiki_section(F.col("wikitext"), "Ancient Greek")).where(F.col("s") != "")
    pos = F.array_compact(F.array(*[
        F.when(F.col("s").rlike(f"(?i)==={p}==="), F.lit(p.lower())) for p in PARTS_OF_SPEECH]))
    s = s.withColumn("pos", pos).withColumn("lemmas", F.array_distinct(text.template_lemmas(F.col("s"))))
    inflected = F.size("lemmas") > 0
    rows = s.where(inflected | (F.size("pos") > 0)).select(
        "title", "pos", inflected.alias("inflected"),
        F.explode(F.when(inflected, F.col("lemmas")).otherwise(F.array("title"))).alias("raw"))
    return rows.select(
        F.col("title").alias("word_form"), text.normalize_greek(F.col("title")).alias("word_normalized"),
        text.normalize_greek(F.col("raw")).alias("lemma"),
        F.when(F.col("inflected"), 0.9).otherwise(0.95).alias("confidence"),
        F.concat(F.when(F.col("inflected"), "inflection").otherwise("lemma"), F.lit(":"), F.array_join("pos", ",")).alias("morph_info"))


def part_of_speech_counts(words: DataFrame) -> DataFrame:
    """``page_words`` counted: one row per type of page and part of speech (pages without one: "unknown")."""
    kind = F.split("morph_info", ":")
    pos = F.when(F.get(kind, 1) == "", F.array(F.lit("unknown"))).otherwise(F.split(F.get(kind, 1), ","))
    return words.select(F.get(kind, 0).alias("type"), F.explode(pos).alias("pos")).groupBy("type", "pos").agg(
        F.count(F.lit(1)).alias("n"))


def definitions(pages: DataFrame, wanted: DataFrame | None = None, n: int = 3, chars: int = 500) -> DataFrame:
    """Up to n senses of each page, restricted to wanted words (word_normalized); of several
    pages of one word the first by title counts."""
    s = pages.withColumn("s", text.wiki_section(F.col("wikitext"), "Ancient Greek"))
    lines = F.filter(F.split("s", "\n"), lambda x: x.startswith("# "))
    senses = F.filter(F.transform(lines, lambda x: text.wiki_plain(F.substr(x, F.lit(3)))), lambda x: x != "")
    rows = s.select("title", text.normalize_greek(F.col("title")).alias("word_normalized"), F.slice(senses, 1, n).alias("d")).where(F.size("d") > 0)
    if wanted is not None:
        rows = rows.join(wanted.select("word_normalized").distinct(), "word_normalized", "left_semi")
    return rows.groupBy("word_normalized").agg(F.min_by("d", "title").alias("d"), F.min("title").alias("headword")).select(
        "word_normalized", "headword", F.left(F.array_join("d", "; "), F.lit(chars)).alias("entry_plain"),
        F.concat(F.lit("<ol><li>"), F.array_join("d", "</li><li>"), F.lit("</li></ol>")).alias("entry_html"))


def table_forms(pages: DataFrame) -> DataFrame:
    """Every Greek run of more than two letters in the inflection templates and sections of
    the Ancient Greek section; of a form named twice the last counts."""
    s = text.wiki_section(F.col("wikitext"), "Ancient Greek")
    # Templates and sections with inflected forms.
    verb = "\\{\\{(?:grc-conj|grc-verb|el-conj)[^}]*\\}\\}|====Conjugation====.*?(?=\\n====|\\n===|\\z)|===Verb===.*?(?=\\n===|\\z)"
    noun = "\\{\\{(?:grc-decl|grc-adecl|grc-noun|el-nN|el-nF|el-nM)[^}]*\\}\\}|====Declension====.*?(?=\\n====|\\n===|\\z)"
    runs = lambda p: F.flatten(F.transform(
        F.regexp_extract_all(s, F.lit("(?s)" + p), F.lit(0)),
        lambda b: F.regexp_extract_all(b, F.lit("[\u0370-\u03FF\u1F00-\u1FFF]+"), F.lit(0))))
    both = F.concat(
        F.transform(runs(verb), lambda f: F.struct(f.alias("form"), F.lit("verb").alias("pos"))),
        F.transform(runs(noun), lambda f: F.struct(f.alias("form"), F.lit("noun").alias("pos"))))
    rows = pages.select("title", F.posexplode(both).alias("i", "f")).select("title", "i", "f.form", "f.pos").where(
        (F.length("form") > 2) & (F.col("form") != F.col("title")))
    rows = rows.withColumn("word_normalized", text.normalize_greek(F.col("form"))).withColumn("lemma", text.normalize_greek(F.col("title")))
    return rows.where((F.col("word_normalized") != "") & (F.col("word_normalized") != F.col("lemma"))).groupBy(
        "lemma", "word_normalized").agg(F.max_by(F.struct("form", "pos"), "i").alias("x")).select(
        "lemma", "word_normalized", F.col("x.form").alias("form"), F.col("x.pos").alias("pos"))


# Entries that the dictionary lacks: headword, its text.
SUPPLEMENTS = """
σφωέ|pronoun. Epic enclitic third person dual personal pronoun: they two, both of them, these two.
Ἀτρεύς|-έως, ὁ, proper name. Atreus, king of Mycenae, father of Agamemnon and Menelaus.
πρῶτα|neuter plural of πρῶτος used adverbially: first, at first, firstly.
νοῦσος|ἡ, (Ionic for νόσος) disease, sickness, plague.
ἑλώριον|τό, prey, spoil, booty; especially of bodies given as prey.
"""


def supplements(spark: SparkSession, entries: DataFrame, lemma_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to add: entries of absent headwords, and their lemma of their own where it is absent."""
    rows = spark.createDataFrame([tuple(x.split("|", 1)) for x in SUPPLEMENTS.strip().splitlines()], "headword string, t string")
    head = F.col("headword")
    new = rows.select(
        "headword", text.normalize_greek(head).alias("headword_normalized"), F.lit("greek").alias("language"),
        F.concat(F.lit("<b>"), head, F.lit("</b>, "), F.col("t")).alias("entry_html"),
        F.concat(head, F.lit(", "), F.col("t")).alias("entry_plain"), F.lit("wiktionary").alias("source"),
    ).join(entries.select("headword_normalized").distinct(), "headword_normalized", "left_anti")
    own = new.select(
        head.alias("word_form"), F.col("headword_normalized").alias("word_normalized"),
        F.col("headword_normalized").alias("lemma"), F.lit(1.0).alias("confidence"), F.lit("wiktionary").alias("source"))
    return new, own.join(lemma_map.select("word_form", "lemma").distinct(), ["word_form", "lemma"], "left_anti")


def write_tables(frames: dict[str, DataFrame], path: str) -> None:
    """Tables as Parquet (zstd), sorted within files by what lookups ask for, so that row groups can be skipped."""
    # Sort keys of the tables.
    order = {
        "text_lines": ["book_id", "line_number"], "words": ["word_normalized"], "word_forms": ["word_normalized"],
        "translation_segments": ["book_id", "start_line"], "translation_lookup": ["book_id", "line_number"],
        "dictionary_entries": ["headword_normalized"], "lemma_map": ["word_normalized"]}
    for name, df in frames.items():
        if name in order:
            df = df.sortWithinPartitions(*order[name])
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}.parquet")


# --- JSON, CSV, lists

MAPPINGS = """metadata map<string,string>, mappings array<struct<word_form:string,word_normalized:string,lemma:string,
confidence:double,source:string,morph_info:string,morph_type:string>>"""


def json_mappings(spark: SparkSession, path: str, source: str = "wiktionary") -> DataFrame:
    """A file {metadata, mappings: [...]}; optional keys get their defaults."""
    m = spark.read.json(path, schema=MAPPINGS, multiLine=True).select(F.explode("mappings").alias("m")).select("m.*")
    return m.select(
        "word_form", F.coalesce("word_normalized", text.normalize_greek(F.col("word_form"))).alias("word_normalized"), "lemma",
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("source", F.lit(source)).alias("source"),
        F.coalesce("morph_info", "morph_type").alias("morph_info"))


def json_objects(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A file {key: object, ...} as rows (key, fields of ``value``)."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias("key", "v")).select("key", "v.*")


def write_json_mappings(mappings: DataFrame, path: str, metadata: dict[str, str], per_file: int = 50_000) -> None:
    """Files {metadata, mappings: [...]} of at most ``per_file`` mappings each, as ``json_mappings`` reads them."""
    # ids count up within a partition, so a file takes rows of one task only
    part = F.floor(F.monotonically_increasing_id() / per_file)
    head = F.create_map(*[F.lit(x) for kv in sorted(metadata.items()) for x in kv]) if metadata else F.create_map()
    files = mappings.select(F.struct(*mappings.columns).alias("m"), part.alias("part")).groupBy("part").agg(
        F.collect_list("m").alias("mappings"))
    files.select(F.to_json(F.struct(head.alias("metadata"), "mappings"))).write.mode("overwrite").option(
        "maxRecordsPerFile", 1).text(path)


def insert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[str], how: str = "plain") -> None:
    """Add rows to the table at ``path``: ``plain`` keeps all, ``ignore`` keeps what is there on a conflict of the
    keys, ``replace`` the new row; of new rows in conflict the first, or the last, by ``order`` counts. The new
    version is written beside the old one before it takes its place."""
    old = spark.read.parquet(path)
    if how == "plain":
        out = old.unionByName(new)
    elif how == "ignore":
        out = old.unionByName(insert_ignore(old, new, keys, order))
    elif how == "replace":
        fresh = last_writer([new], keys, order)
        out = old.join(fresh.select(*keys), keys, "left_anti").select(*old.columns).unionByName(fresh)
    else:
        raise ValueError(f"no such way to insert: {how}")
    path = path.rstrip("/")
    out.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}__new")
    at = lambda x: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.rename(at(path), at(f"{path}__old"))
    fs.rename(at(f"{path}__new"), at(path))
    fs.delete(at(f"{path}__old"), True)


def read_bookmarks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with a header; rows that do not fit are dropped, empty labels and notes are null."""
    raw = spark.read.csv(path, header=True, escape='"', mode="DROPMALFORMED", schema=BOOKMARKS, nullValue="\x00")
    return raw.where(F.col("line_number").isNotNull() & F.col("id").isNotNull()).withColumns(
        {c: F.nullif(c, F.lit("")) for c in ("book_label", "note")})


def write_bookmarks_csv(df: DataFrame, path: str) -> None:
    df.fillna("").write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """One name a line, lower case, blanks dropped."""
    return spark.read.text(path).select(F.lower(text.py_strip(F.col("value"))).alias("name")).where(F.col("name") != "")


def listed_authors(authors: DataFrame, names: DataFrame) -> DataFrame:
    """Greek authors by equal names, Latin ones by a listed name within theirs: a part of a name that is
    listed is one of its substrings, so both are joins on equal text, however long the list is."""
    low = F.lower("name")
    listed = names.select(F.col("name").alias("__lk")).distinct()
    exact = authors.where("language = 'greek'").withColumn("__lk", low).join(listed, "__lk", "left_semi")
    size = F.length("name")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(
        F.sequence(F.lit(1), size - i + 1), lambda n: F.substr(low, i, n))))
    latin = authors.where("language = 'latin'").where(size > 0)
    within = latin.select("id", F.explode(F.array_distinct(parts)).alias("__lk")).join(listed, "__lk", "left_semi").select("id")
    return exact.select(*authors.columns).unionByName(latin.join(within.distinct(), "id", "left_semi").select(*authors.columns))


def first_authors(authors: DataFrame, priority: list[str], n: int) -> DataFrame:
    """Those of a priority list first, in its order, then by id, up to n."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("id")) if priority else F.lit(0)
    return authors.withColumn("r", F.nullif(rank, F.lit(0))).orderBy(F.asc_nulls_last("r"), "id").limit(n).drop("r")
