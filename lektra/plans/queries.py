"""Registered queries over the corpus operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lektra.functions import text
from lektra.operators import line_alignment, morphology, tables
from lektra.plans import bookmarks, corpus, reports
from lektra.plans.corpus import Corpus
from lektra.runtime import table

WORD = "λογοσ"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of a Corpus under its name."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, d: f(Corpus(spark, d))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return wrap


# --- SQL pieces

_GREEK = r"[^\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]"
_SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}]+"


def _fold(x: str) -> str:
    return f"replace(lower(strip_accents({x})), 'ς', 'σ')"


def _n1(x: str) -> str:
    return rf"regexp_replace(regexp_replace({_fold(x)}, '{_GREEK}', '', 'g'), '\P{{L}}', '', 'g')"


_BOOKS = """b AS (SELECT * FROM books QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1),
wk AS (SELECT work_id AS id, split_part(work_id, '.', 1) AS author_id, count(*) AS book_count FROM b GROUP BY 1, 2),
au AS (SELECT author_id AS id, CASE WHEN author_id LIKE 'tlg%' THEN 'greek' WHEN author_id LIKE 'phi%' THEN 'latin' END AS language,
       count(*) AS work_count FROM wk GROUP BY 1, 2)"""
_LOOKUP = "lk AS (SELECT DISTINCT book_id, line_number, segment_id FROM translation_lookup)"


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- text

@query(rf"""
SELECT doc_id, CAST(n AS INTEGER) AS line_number, line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
WHERE trim(line) <> '' AND NOT contains(line, 'pointer pattern')""")
def q01_lines(c: Corpus) -> DataFrame:
    """Lines numbered before blank and boilerplate ones are dropped, so numbers have gaps."""
    lines = c.get("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where((F.trim("line") != "") & ~F.col("line").contains("pointer pattern")).select(
        "doc_id", (F.col("n") + 1).alias("line_number"), "line")


@query(rf"""
WITH t AS (SELECT id, book_id, list_filter(regexp_split_to_array(line_text, '{_SPACE}'), lambda x: x <> '') AS ws FROM text_lines),
w AS (SELECT id, book_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM t),
n AS (SELECT id, CAST(p AS INTEGER) AS word_position, word,
      CASE WHEN book_id LIKE 'tlg%' THEN {_n1('word')} ELSE lower(regexp_replace(word, '(\p{{L}})Σ(\P{{L}}|$)', '\1ς\2', 'g')) END AS word_normalized FROM w)
SELECT * FROM n WHERE word_normalized <> ''""")
def q02_words(c: Corpus) -> DataFrame:
    """Words of every line; positions count dropped tokens too."""
    w = c.lines.select("id", "book_id", F.posexplode(text.tokens(F.col("line_text"))).alias("p", "word"))
    return w.select(
        "id", (F.col("p") + 1).alias("word_position"), "word",
        text.normalize_word(F.col("word"), text.language_of(F.col("book_id"))).alias("word_normalized"),
    ).where(F.col("word_normalized") != "")


@query(rf"""
SELECT id, {_fold('line_text')} AS folded, lower(regexp_replace(strip_accents(line_text), '(\p{{L}})Σ(\P{{L}}|$)', '\1ς\2', 'g')) AS web,
  trim(regexp_replace({_fold('line_text')}, '\P{{L}}+', ' ', 'g')) AS search_line,
  lower(regexp_replace(regexp_replace(line_text, '[.,;:!?·]', '', 'g'), '([\p{{L}}\p{{M}}])Σ(\P{{L}}|$)', '\1ς\2', 'g')) AS latin_key
FROM text_lines""")
def q02_normal_forms(c: Corpus) -> DataFrame:
    """The other normal forms of each line."""
    t = F.col("line_text")
    return c.lines.select(
        "id", text.fold(t).alias("folded"), text.normalize_web(t).alias("web"),
        text.normalize_search_line(t).alias("search_line"), text.latin_lookup(t).alias("latin_key"))


@query(r"""
SELECT id, len(regexp_extract_all(line_text, '\p{L}+(?:''\p{L}+)*')) AS click_words,
  len(list_filter(list_transform(regexp_extract_all(line_text, '[^\s\x{2018}\x{2019}\x{201C}\x{201D}.,;:!?\-\[\]()]+'),
      lambda x: regexp_replace(x, '[\x{02BC}'']+$', '')), lambda x: x <> '')) AS web_words,
  len(regexp_extract_all(line_text, '(?s)[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]+|[a-zA-Z]{2,}|.')) AS dictionary_tokens
FROM text_lines""")
def q02_tokenizers(c: Corpus) -> DataFrame:
    t = F.col("line_text")
    return c.lines.select(
        "id", F.size(text.click_words(t)).cast("bigint").alias("click_words"),
        F.size(text.web_words(t)).cast("bigint").alias("web_words"),
        F.size(text.dictionary_tokens(t)).cast("bigint").alias("dictionary_tokens"))


@query(r"""
WITH s AS (SELECT doc_id, lang IN ('grc', 'el') AS g, text FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, CASE WHEN g THEN regexp_split_to_array(text, '[.!?·;]\s+') ELSE regexp_split_to_array(text, '[.!?]\s+') END AS a FROM s),
y AS (SELECT doc_id, generate_subscripts(a, 1) AS n, unnest(a) AS sentence FROM x)
SELECT doc_id, CAST(n AS INTEGER) AS n, sentence FROM y
WHERE length(sentence) > 10 AND NOT regexp_matches(sentence, '^[A-Z]:') AND NOT starts_with(sentence, 'em.')
  AND NOT starts_with(sentence, 'add.') AND NOT starts_with(sentence, 'id.') AND NOT contains(sentence, 'Nauck')
  AND NOT contains(sentence, 'Mullach')""")
def q39_sentence_split(c: Corpus) -> DataFrame:
    """Prose cut into sentences; apparatus is dropped."""
    greek = F.coalesce(F.col("lang").isin("grc", "el"), F.lit(False))
    return c.get("documents").select(
        "doc_id", F.posexplode(text.sentences(F.col("text"), greek)).alias("n", "sentence")
    ).where(~text.is_editorial_noise(F.col("sentence"))).select("doc_id", (F.col("n") + 1).alias("n"), "sentence")


_HTML = "entry_html"
for _a, _b in (("<br>", "chr(10)"), ("<br/>", "chr(10)"), ("<BR>", "chr(10)"), ("<BR/>", "chr(10)"),
               ("</p>", "chr(10) || chr(10)"), ("</P>", "chr(10) || chr(10)")):
    _HTML = f"replace({_HTML}, '{_a}', {_b})"
_HTML = f"regexp_replace({_HTML}, '<[^>]*>', '', 'g')"
for _a, _b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
    _HTML = f"replace({_HTML}, '{_a}', '{_b}')"


@query(f"SELECT id, {_HTML} AS plain FROM dictionary_entries WHERE entry_html IS NOT NULL")
def q37_html_strip(c: Corpus) -> DataFrame:
    return c.dictionary.where(F.col("entry_html").isNotNull()).select("id", text.html_to_text(F.col("entry_html")).alias("plain"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def q38_json_props(c: Corpus) -> DataFrame:
    """A JSON object per row, its keys and values as rows."""
    m = F.from_json("props", "map<string,bigint>")
    return c.get("events").select("event_id", F.explode(m).alias("key", "k")).where("key = 'k'").select("event_id", "k")


@query("""
SELECT word_form, lemma, lemma AS found, 'genitive' AS morphology, '# form of ' || lemma AS definition
FROM (SELECT DISTINCT word_form, lemma FROM lemma_map WHERE lemma IS NOT NULL AND lemma <> '')""")
def q40_template_extract(c: Corpus) -> DataFrame:
    """Wiki pages made of the lemma map, read back: section, template lemma, class, definition line."""
    m = c.lemmas.where(F.col("lemma").isNotNull() & (F.col("lemma") != "")).select("word_form", "lemma").distinct()
    page = F.concat(F.lit("==Ancient Greek==\n===Noun===\n{{genitive of|grc|"), F.col("lemma"), F.lit("}}\n# form of [[x|"),
                    F.col("lemma"), F.lit("]]\n==Greek==\n{{plural of|grc|other}}"))
    s = m.withColumn("s", text.wiki_section(page, "Ancient Greek"))
    lines = F.filter(F.split("s", "\n"), lambda x: x.startswith("# "))
    return s.select(
        "word_form", "lemma", F.get(text.template_lemmas(F.col("s")), 0).alias("found"),
        text.template_morphology(F.col("s")).alias("morphology"), text.wiki_plain(F.get(lines, 0)).alias("definition"))


def _tags_sql() -> str:
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in text.MORPH_TAGS.items())
    return f"""
SELECT DISTINCT morph_info, array_to_string(list_transform(
  list_filter(regexp_split_to_array(replace(morph_info, ':', ' '), '[_ ;]'), lambda x: trim(x) <> ''),
  lambda x: coalesce(MAP {{{pairs}}}[trim(x)], x)), ' ') AS readable
FROM lemma_map WHERE morph_info IS NOT NULL"""


@query(_tags_sql())
def q41_morph_tags(c: Corpus) -> DataFrame:
    m = c.lemmas.where(F.col("morph_info").isNotNull()).select("morph_info").distinct()
    return m.select("morph_info", text.expand_morphology(F.replace("morph_info", F.lit(":"), F.lit(" "))).alias("readable"))


@query(r"""
WITH p AS (SELECT book_id, line_number, list(DISTINCT word_position) AS ps FROM word_forms
           WHERE word_normalized = 'και' AND book_id IS NOT NULL GROUP BY 1, 2),
l AS (SELECT id, line_text, ps, regexp_split_to_array(line_text, '[ \t\n\x0B\f\r]+') AS ws FROM text_lines JOIN p USING (book_id, line_number))
SELECT id, array_to_string(list_transform(ws, lambda x, i: CASE WHEN list_contains(ps, i) THEN '<b>' || x || '</b>' ELSE x END), ' ') AS marked
FROM l""")
def q43_highlight(c: Corpus) -> DataFrame:
    """Lines with the places of one word marked."""
    p = c.words.where((F.col("word_normalized") == "και") & F.col("book_id").isNotNull()).groupBy("book_id", "line_number").agg(
        F.collect_set("word_position").alias("ps"))
    return c.lines.join(p, ["book_id", "line_number"]).select("id", text.highlight(F.col("line_text"), F.col("ps")).alias("marked"))


# --- navigation and reading

@query(f"WITH {_BOOKS} SELECT id, id AS name, language, work_count FROM au")
def q07_authors(c: Corpus) -> DataFrame:
    return corpus.authors(c)


@query("SELECT DISTINCT CASE WHEN id LIKE 'tlg%' THEN 'greek' WHEN id LIKE 'phi%' THEN 'latin' END AS language FROM books")
def q07_languages(c: Corpus) -> DataFrame:
    return c.authors.select("language").distinct()


@query(f"""WITH {_BOOKS},
h AS (SELECT DISTINCT work_id FROM translation_segments s JOIN b ON s.book_id = b.id
      WHERE translation_text IS NOT NULL AND length(trim(translation_text)) > 10)
SELECT wk.id, author_id, wk.id AS title, book_count, h.work_id IS NOT NULL AS has_translation FROM wk LEFT JOIN h ON wk.id = h.work_id""")
def q07_works(c: Corpus) -> DataFrame:
    return corpus.works(c)


@query(f"""WITH {_BOOKS} SELECT id, work_id, book_number, coalesce(label, 'Book ' || book_number) AS label,
coalesce(line_count, 0) AS line_count FROM b""")
def q07_books(c: Corpus) -> DataFrame:
    return corpus.books(c)


@query("SELECT id, book_id, line_number, line_text, speaker FROM text_lines WHERE line_number BETWEEN 1 AND 100")
def q08_text_range(c: Corpus) -> DataFrame:
    """First page of every book."""
    return corpus.text_range(c, 1, 100).select("id", "book_id", "line_number", "line_text", "speaker")


@query(f"""WITH {_LOOKUP}
SELECT s.id, s.book_id, s.start_line, s.end_line, s.translation_text FROM translation_segments s
WHERE EXISTS (SELECT 1 FROM lk WHERE lk.segment_id = s.id AND lk.book_id = s.book_id AND lk.line_number BETWEEN 31 AND 60)
   OR (s.start_line <= 60 AND (s.end_line IS NULL OR s.end_line >= 31))""")
def q09_overlap(c: Corpus) -> DataFrame:
    """Translations for lines 31 to 60 of every book."""
    return corpus.translations(c, 31, 60).select("id", "book_id", "start_line", "end_line", "translation_text")


@query(f"""WITH {_LOOKUP}
SELECT s.id, s.book_id FROM translation_segments s WHERE translator = 'B. Marrowby' AND (
  EXISTS (SELECT 1 FROM lk WHERE lk.segment_id = s.id AND lk.book_id = s.book_id AND lk.line_number BETWEEN 31 AND 60)
   OR (s.start_line <= 60 AND (s.end_line IS NULL OR s.end_line >= 31)))""")
def q09_by_translator(c: Corpus) -> DataFrame:
    return corpus.translations(c, 31, 60, translator="B. Marrowby").select("id", "book_id")


@query(f"""WITH {_LOOKUP},
s AS (SELECT s.id, s.book_id, greatest(start_line, 31) AS lo, least(coalesce(end_line, 60), 60) AS hi FROM translation_segments s
  WHERE EXISTS (SELECT 1 FROM lk WHERE lk.segment_id = s.id AND lk.book_id = s.book_id AND lk.line_number BETWEEN 31 AND 60)
   OR (s.start_line <= 60 AND (s.end_line IS NULL OR s.end_line >= 31))),
p AS (SELECT DISTINCT book_id, line_number FROM text_lines WHERE line_number BETWEEN 31 AND 60)
SELECT s.id AS segment_id, s.book_id, count(*) AS visible_lines, min(line_number) AS first_visible
FROM s JOIN p ON s.book_id = p.book_id AND line_number BETWEEN lo AND hi GROUP BY 1, 2""")
def q09_visible(c: Corpus) -> DataFrame:
    return corpus.visible_segments(c, 31, 60)


_PAGES = """pg AS (SELECT book_id, CAST(range_start AS INTEGER) AS range_start, CAST(least(range_start + 99, total) AS INTEGER) AS range_end
  FROM (SELECT book_id, total, unnest(range(1, total + 1, 100)) AS range_start
    FROM (SELECT book_id, max(line_number) AS total FROM text_lines GROUP BY 1)))"""
_PAGE_SEGMENTS = f"""{_LOOKUP}, {_PAGES},
ps AS (SELECT DISTINCT s.id, s.book_id, start_line, end_line, range_start, range_end FROM translation_segments s JOIN pg ON s.book_id = pg.book_id
  WHERE EXISTS (SELECT 1 FROM lk WHERE lk.segment_id = s.id AND lk.book_id = s.book_id AND lk.line_number BETWEEN range_start AND range_end)
   OR (start_line <= range_end AND (end_line IS NULL OR end_line >= range_start)))"""


@query(f"""WITH {_PAGES} SELECT id, t.book_id, range_start, line_number, line_text, speaker
FROM text_lines t JOIN pg ON t.book_id = pg.book_id AND line_number BETWEEN range_start AND range_end""")
def q08_text_pages(c: Corpus) -> DataFrame:
    """All pages of every book."""
    return corpus.page_lines(c).select("id", "book_id", "range_start", "line_number", "line_text", "speaker")


@query(f"WITH {_PAGE_SEGMENTS} SELECT id, book_id, range_start, range_end FROM ps")
def q09_overlap_pages(c: Corpus) -> DataFrame:
    """Translations for every page of every book."""
    return corpus.page_translations(c).select("id", "book_id", "range_start", "range_end")


@query(f"""WITH {_PAGE_SEGMENTS}, p AS (SELECT DISTINCT book_id, line_number FROM text_lines)
SELECT ps.id AS segment_id, ps.book_id, range_start, count(*) AS visible_lines, min(line_number) AS first_visible
FROM ps JOIN p ON ps.book_id = p.book_id
  AND line_number BETWEEN greatest(start_line, range_start) AND least(coalesce(end_line, range_end), range_end) GROUP BY 1, 2, 3""")
def q09_visible_pages(c: Corpus) -> DataFrame:
    return corpus.page_visible_segments(c)


@query(f"""WITH {_PAGE_SEGMENTS} SELECT translator, ps.id, ps.book_id, range_start
FROM ps JOIN translation_segments t ON t.id = ps.id WHERE translator IS NOT NULL""")
def q09_translator_pages(c: Corpus) -> DataFrame:
    """Translations of every translator for every page of every book."""
    who = c.segments.where("translator IS NOT NULL").select("id", "translator")
    return corpus.page_translations(c).join(who, "id").select("translator", "id", "book_id", "range_start")


@query("SELECT DISTINCT book_id, translator FROM translation_segments WHERE translator IS NOT NULL")
def q10_translators(c: Corpus) -> DataFrame:
    return corpus.translators(c)


@query("""WITH t AS (SELECT book_id, max(line_number) AS total FROM text_lines GROUP BY 1),
r AS (SELECT book_id, total, unnest(range(1, total + 1, 100)) AS range_start FROM t)
SELECT book_id, CAST(total AS INTEGER) AS total, CAST(range_start AS INTEGER) AS range_start,
CAST(least(range_start + 99, total) AS INTEGER) AS range_end FROM r""")
def q19_page_ranges(c: Corpus) -> DataFrame:
    return tables.page_ranges(c.lines.groupBy("book_id").agg(F.max("line_number").alias("total")), "total")


@query("""SELECT id, CAST(((line_number - 1) // 100) * 100 + 1 AS INTEGER) AS page_start,
CAST(((line_number - 1) // 100) * 100 + 100 AS INTEGER) AS page_end,
CAST(greatest(((line_number - 1) // 100) * 100 + 1 - 100, 1) AS INTEGER) AS previous_start,
((line_number - 1) // 100) * 100 + 101 <= max(line_number) OVER (PARTITION BY book_id) AS has_next,
CAST((line_number - 1) // 30 + 1 AS INTEGER) AS web_page FROM text_lines""")
def q19_page_of_line(c: Corpus) -> DataFrame:
    """The page of each line, the one before it and whether there is a next."""
    first, last = tables.page_of(F.col("line_number"))
    top = c.lines.groupBy("book_id").agg(F.max("line_number").alias("total"))
    return c.lines.join(top, "book_id").select(
        "id", first.alias("page_start"), last.alias("page_end"),
        F.greatest(first - 100, F.lit(1)).alias("previous_start"), (last + 1 <= F.col("total")).alias("has_next"),
        (F.floor((F.col("line_number") - 1) / 30) + 1).cast("int").alias("web_page"))


# --- concordance and dictionary

_PAIRS = "pr AS (SELECT DISTINCT word_normalized, lemma FROM lemma_map WHERE lemma IS NOT NULL)"


@query(f"""WITH {_BOOKS}, {_PAIRS},
h AS (SELECT lemma, book_id, line_number, list(DISTINCT {{'p': word_position, 'w': word}}) AS m
      FROM word_forms JOIN pr USING (word_normalized) WHERE book_id IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY book_id, line_number) AS rank FROM h)
SELECT lemma, book_id, line_number, array_to_string(list_transform(list_sort(m), lambda x: x.w || ':' || x.p), ',') AS matches,
  coalesce(split_part(work_id, '.', 1), 'Unknown Author') AS author, coalesce(work_id, 'Unknown Work') AS work,
  coalesce(label, 'Book ' || book_number, 'Unknown Book') AS book
FROM t LEFT JOIN b ON t.book_id = b.id WHERE rank <= 500""")
def q04_concordance(c: Corpus) -> DataFrame:
    """Concordance of every lemma, at most 500 lines each."""
    return corpus.occurrences(c, c.lemmas.select("lemma"))


@query(f"""WITH {_PAIRS}
SELECT lemma, count(DISTINCT (book_id, line_number)) AS lines
FROM word_forms JOIN pr USING (word_normalized) WHERE book_id IS NOT NULL GROUP BY 1""")
def q05_count_lines(c: Corpus) -> DataFrame:
    return corpus.count_occurrences(c, c.lemmas.select("lemma"))


_WEB = f"""WITH {_BOOKS},
f AS (SELECT word_normalized FROM lemma_map WHERE lemma = '{WORD}' OR word_normalized = '{WORD}' UNION SELECT '{WORD}'),
o AS (SELECT DISTINCT w.book_id, w.line_number, w.word, w.word_position, t.line_text, b.label AS book_label,
  b.work_id AS work_title, split_part(b.work_id, '.', 1) AS author_name
  FROM word_forms w JOIN f USING (word_normalized)
  JOIN text_lines t ON w.book_id = t.book_id AND w.line_number = t.line_number JOIN b ON w.book_id = b.id
  ORDER BY w.book_id, w.line_number, word_position, word, line_text LIMIT 50)
"""


@query(_WEB + "SELECT * FROM o")
def q06_web_occurrences(c: Corpus) -> DataFrame:
    return corpus.web_occurrences(c, WORD)


@query(_WEB + """SELECT concat_ws(' - ', author_name, work_title, book_label) AS place, count(*) AS hits,
min(line_number) AS first_line FROM o GROUP BY 1""")
def q06_grouped(c: Corpus) -> DataFrame:
    g = corpus.grouped_occurrences(corpus.web_occurrences(c, WORD))
    return g.select("place", F.size("occurrences").cast("bigint").alias("hits"),
                    F.get("occurrences", 0)["line_number"].alias("first_line"))


_WORDS = "w AS (SELECT DISTINCT word_normalized FROM word_forms WHERE word_normalized IS NOT NULL)"
_FIRST_ENTRY = """d AS (SELECT headword_normalized AS lemma, id AS entry_id, coalesce(entry_html, entry_plain, '') AS definition
  FROM dictionary_entries WHERE language = 'greek' QUALIFY row_number() OVER (PARTITION BY headword_normalized ORDER BY id) = 1)"""
_BEST = """bl AS (SELECT word_normalized, lemma, confidence, morph_info FROM lemma_map WHERE word_normalized IN (SELECT word_normalized FROM w)
  QUALIFY row_number() OVER (PARTITION BY word_normalized ORDER BY confidence DESC NULLS LAST, lemma NULLS FIRST, morph_info NULLS LAST) = 1)"""


@query(f"WITH {_WORDS}, {_BEST} SELECT * FROM bl")
def q35_best_lemma(c: Corpus) -> DataFrame:
    return corpus.best_lemma(c, c.words)


@query("SELECT lemma, max(confidence) AS confidence FROM lemma_map GROUP BY 1")
def q35_lemmas_by_confidence(c: Corpus) -> DataFrame:
    """Distinct lemmas in order of a key that is not shown."""
    return c.lemmas.groupBy("lemma").agg(F.max("confidence").alias("confidence")).orderBy(F.desc("confidence"), "lemma")


@query(f"""WITH {_WORDS}, {_FIRST_ENTRY}, {_BEST}
SELECT word_normalized, lemma, entry_id, definition, CAST(NULL AS VARCHAR) AS morph_info, true AS is_direct FROM w JOIN d ON word_normalized = lemma
UNION ALL
SELECT word_normalized, lemma, entry_id, definition, morph_info, false FROM bl JOIN d USING (lemma)
WHERE word_normalized NOT IN (SELECT lemma FROM d)""")
def q36_dictionary_entry(c: Corpus) -> DataFrame:
    return corpus.dictionary_entry(c, c.words)


@query(f"""WITH {_WORDS}, {_FIRST_ENTRY},
pl AS (SELECT word_normalized, lemma, max(confidence) AS confidence FROM lemma_map GROUP BY 1, 2),
m AS (SELECT * FROM w JOIN pl USING (word_normalized)),
x AS (SELECT word_normalized, lemma, entry_id, 1.0::DOUBLE AS confidence, 0 AS kind FROM w JOIN d ON word_normalized = lemma
  UNION ALL SELECT word_normalized, lemma, entry_id, confidence, 1 FROM m JOIN d USING (lemma) WHERE lemma <> word_normalized
  UNION ALL
  SELECT r.word_normalized, pl.lemma, entry_id, coalesce(pl.confidence, 0) * 0.8, 2
  FROM (SELECT word_normalized, left(word_normalized, length(word_normalized) - 2) || 'οι' AS related FROM m
        WHERE lemma = word_normalized AND lemma NOT IN (SELECT lemma FROM d)
          AND word_normalized LIKE '%ων' AND length(word_normalized) >= 4) r
  JOIN pl ON pl.word_normalized = r.related JOIN d ON d.lemma = pl.lemma
  WHERE pl.lemma <> r.related AND NOT EXISTS (SELECT 1 FROM m WHERE m.word_normalized = r.word_normalized AND m.lemma = pl.lemma))
SELECT *, CAST(row_number() OVER (PARTITION BY word_normalized ORDER BY kind <> 0, coalesce(confidence, 0) DESC, lemma, kind) AS INTEGER) AS rank,
  round(CASE WHEN kind <> 0 THEN coalesce(confidence, 0.5) END
        / sum(CASE WHEN kind <> 0 THEN coalesce(confidence, 0.5) END) OVER (PARTITION BY word_normalized) * 100, 1) AS share_pct
FROM x""")
def q36_dictionary_all(c: Corpus) -> DataFrame:
    return corpus.all_entries(c, c.words)


@query(f"""WITH {_WORDS},
d AS (SELECT id, headword, headword_normalized FROM dictionary_entries WHERE language = 'greek'),
a AS (SELECT word_normalized, id, headword FROM w JOIN d ON word_normalized = headword_normalized
      QUALIFY row_number() OVER (PARTITION BY word_normalized ORDER BY id) <= 5),
v AS (SELECT word_normalized, id, headword FROM w JOIN (SELECT DISTINCT word_normalized, lemma FROM lemma_map) USING (word_normalized)
      JOIN d ON headword_normalized = lemma QUALIFY row_number() OVER (PARTITION BY word_normalized ORDER BY id) <= 5)
SELECT word_normalized, id, headword, 0 AS src FROM a UNION ALL
SELECT word_normalized, id, headword, 1 FROM v WHERE (word_normalized, id) NOT IN (SELECT word_normalized, id FROM a)""")
def q36_web_dictionary(c: Corpus) -> DataFrame:
    return corpus.web_dictionary(c, c.words.where(F.col("word_normalized").isNotNull()))


@query("""SELECT id, headword_normalized FROM dictionary_entries WHERE language = 'greek' AND headword_normalized ILIKE 'λ%σ'
ORDER BY headword_normalized, id LIMIT 10""")
def q45_like_search(c: Corpus) -> DataFrame:
    return corpus.search_entries(c, "λ%σ").select("id", "headword_normalized")


# --- words and reports

@query("""SELECT word_normalized, count(*) AS freq FROM word_forms WHERE book_id LIKE 'tlg%' GROUP BY 1 HAVING count(*) >= 2""")
def q03_word_freq(c: Corpus) -> DataFrame:
    return reports.word_frequency(c)


@query("""WITH f AS (SELECT word_normalized, count(*) AS freq FROM word_forms WHERE book_id LIKE 'tlg%' GROUP BY 1)
SELECT count(*) FILTER (freq = 1) AS once, count(*) FILTER (freq >= 10) AS ten_and_more, count(*) FILTER (freq >= 100) AS hundred_and_more FROM f""")
def q20_freq_histogram(c: Corpus) -> DataFrame:
    return reports.frequency_classes(reports.word_frequency(c, least=1))


@query("""WITH p AS (SELECT split_part(book_id, '.', 1) AS author_id, word_normalized, count(*) AS n FROM word_forms
  WHERE book_id IS NOT NULL AND word_normalized <> '' GROUP BY 1, 2),
j AS (SELECT p.*, word_normalized IN (SELECT word_normalized FROM lemma_map) AS mapped,
  word_normalized IN (SELECT headword_normalized FROM dictionary_entries) AS own FROM p)
SELECT author_id, count(*) AS unique_words, count(*) FILTER (mapped) AS mapped_words, count(*) FILTER (own) AS own_entries,
  CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (mapped), 0) AS BIGINT) AS mapped_tokens,
  round(count(*) FILTER (mapped) * 100.0 / count(*), 2) AS word_pct,
  round(coalesce(sum(n) FILTER (mapped), 0) * 100.0 / sum(n), 2) AS token_pct FROM j GROUP BY 1""")
def q11_semi_coverage(c: Corpus) -> DataFrame:
    return reports.forms_coverage(c)


@query("""SELECT word_normalized, count(*) AS freq FROM word_forms w WHERE book_id LIKE 'tlg%'
AND NOT EXISTS (SELECT 1 FROM lemma_map l WHERE l.word_normalized = w.word_normalized)
AND NOT EXISTS (SELECT 1 FROM dictionary_entries d WHERE d.headword_normalized = w.word_normalized)
GROUP BY 1 HAVING count(*) >= 2""")
def q12_anti_missing(c: Corpus) -> DataFrame:
    return reports.missing_words(c)


@query("""SELECT lemma, count(*) AS forms FROM lemma_map WHERE lemma NOT IN (SELECT headword_normalized FROM dictionary_entries) GROUP BY 1""")
def q13_not_in(c: Corpus) -> DataFrame:
    return reports.missing_lemmas(c)


@query("""WITH p AS (SELECT split_part(book_id, '.', 1) AS author_id, word_normalized, count(*) AS freq FROM word_forms
  WHERE book_id IS NOT NULL AND word_normalized NOT IN (SELECT word_normalized FROM lemma_map WHERE word_normalized IS NOT NULL) GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY author_id ORDER BY freq DESC, word_normalized) AS INTEGER) AS rank FROM p
QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY freq DESC, word_normalized) <= 10""")
def q14_top_missing_per_group(c: Corpus) -> DataFrame:
    return reports.top_missing(c)


@query(f"""WITH {_BOOKS}
SELECT 'authors' AS table_name, count(*) AS rows FROM au UNION ALL SELECT 'works', count(*) FROM wk
UNION ALL SELECT 'books', count(*) FROM b UNION ALL SELECT 'text_lines', count(*) FROM text_lines
UNION ALL SELECT 'words', count(*) FROM word_forms UNION ALL SELECT 'translation_segments', count(*) FROM translation_segments
UNION ALL SELECT 'dictionary_entries', count(*) FROM dictionary_entries UNION ALL SELECT 'lemma_map', count(*) FROM lemma_map""")
def q15_stats_view(c: Corpus) -> DataFrame:
    return reports.counters(c)


@query(f"""WITH {_BOOKS}
SELECT author_id, CASE WHEN author_id LIKE 'tlg%' THEN 'greek' WHEN author_id LIKE 'phi%' THEN 'latin' END AS language,
count(DISTINCT work_id) AS works, count(DISTINCT b.id) AS books, CAST(coalesce(sum(line_count), 0) AS BIGINT) AS total_lines
FROM wk JOIN b ON b.work_id = wk.id GROUP BY 1, 2""")
def q16_manifest(c: Corpus) -> DataFrame:
    return reports.author_summary(c)


@query(f"""WITH {_BOOKS}
SELECT split_part(work_id, '.', 1) AS author_id, count(DISTINCT work_id) AS works, count(*) AS books FROM b GROUP BY 1""")
def q16_nested_manifest(c: Corpus) -> DataFrame:
    m = reports.manifest(c)
    return m.select(
        "author_id", F.size("works").cast("bigint").alias("works"),
        F.aggregate("works", F.lit(0).cast("bigint"), lambda n, w: n + F.size(w["books"])).alias("books"))


@query(f"""WITH {_BOOKS},
j AS (SELECT b.work_id, b.id, coalesce(line_count, 0) AS line_count, s.id AS sid FROM b LEFT JOIN translation_segments s ON s.book_id = b.id),
p AS (SELECT work_id, id, line_count, count(sid) AS segments, count(*) AS fan FROM j GROUP BY 1, 2, 3)
SELECT work_id, count(*) AS books, CAST(sum(segments) AS BIGINT) AS segments, CAST(sum(line_count * fan) AS BIGINT) AS joined_lines,
CAST(sum(line_count) AS BIGINT) AS total_lines, CAST(max(CAST(segments > 0 AS INTEGER)) AS INTEGER) AS has_translation FROM p GROUP BY 1""")
def q17_fanout_sum(c: Corpus) -> DataFrame:
    return reports.work_manifest(c)


@query(f"""WITH {_BOOKS},
l AS (SELECT book_id, count(*) AS lines, min(line_number) AS first_line, max(line_number) AS last_line FROM text_lines GROUP BY 1),
s AS (SELECT book_id, count(*) AS segments, min(start_line) AS first_segment, max(coalesce(end_line, start_line)) AS last_segment
      FROM translation_segments GROUP BY 1),
r AS (SELECT b.id AS book_id, work_id, book_number, line_count, split_part(work_id, '.', 1) AS author_id,
  coalesce(lines, 0) AS lines, first_line, last_line, coalesce(segments, 0) AS segments, first_segment, last_segment
  FROM b LEFT JOIN l ON l.book_id = b.id LEFT JOIN s ON s.book_id = b.id)
SELECT *, work_id IS DISTINCT FROM lag(work_id) OVER (PARTITION BY author_id ORDER BY work_id, book_number, book_id) AS new_work FROM r""")
def q18_quality_report(c: Corpus) -> DataFrame:
    return reports.quality(c)


@query(f"""WITH {_BOOKS}
SELECT count(DISTINCT split_part(work_id, '.', 1)) AS authors, count(DISTINCT work_id) AS works, count(DISTINCT s.id) AS segments
FROM translation_segments s JOIN b ON s.book_id = b.id""")
def q32_translation_totals(c: Corpus) -> DataFrame:
    return reports.translation_totals(c)


@query(f"""WITH {_BOOKS}
SELECT count(DISTINCT work_id) AS works, count(DISTINCT CASE WHEN s.id IS NOT NULL THEN work_id END) AS with_translation,
round(count(DISTINCT CASE WHEN s.id IS NOT NULL THEN work_id END) * 100.0 / count(DISTINCT work_id), 1) AS coverage_pct
FROM b LEFT JOIN translation_segments s ON s.book_id = b.id""")
def q32_translation_coverage(c: Corpus) -> DataFrame:
    return reports.translation_coverage(c)


@query("""SELECT count(*) AS mappings, count(*) FILTER (lemma IS NULL OR lemma NOT IN (SELECT headword_normalized FROM dictionary_entries)) AS without_entry,
count(morph_info) AS with_morphology, round(count(morph_info) * 100.0 / count(*), 1) AS morphology_pct FROM lemma_map""")
def q53_lemma_map_stats(c: Corpus) -> DataFrame:
    return reports.lemma_map_stats(c)


@query("""SELECT word_form, lemma, confidence FROM lemma_map WHERE word_normalized IN (SELECT word_normalized FROM word_forms)""")
def q17_restricted_vocabulary(c: Corpus) -> DataFrame:
    return reports.restrict_vocabulary(c).select("word_form", "lemma", "confidence")


# Words whose lemmas are looked for.
PROBE = "μηνιν αειδε πολλασ ψυχασ εθηκε ουλομενην μαλιστα πρωτον μεντοι ορθωσ ουχ ημιν".split()


@query(f"""SELECT p AS word_normalized, count(l.lemma) AS mappings FROM (SELECT unnest({_list(PROBE)}) AS p)
LEFT JOIN lemma_map l ON l.word_normalized = p GROUP BY 1""")
def q23_probe_coverage(c: Corpus) -> DataFrame:
    return reports.probe_coverage(c, PROBE)


@query(f"""WITH {_BOOKS}
SELECT id, language, CAST(EXISTS (SELECT 1 FROM translation_segments s WHERE split_part(s.book_id, '.', 1) = au.id
AND translation_text IS NOT NULL AND length(trim(translation_text)) > 10) AS INTEGER) AS has_translations FROM au""")
def q25_flag_update(c: Corpus) -> DataFrame:
    return reports.with_translation_flag(c)


@query("""SELECT book_id, count(*) AS lines, count(DISTINCT line_number) AS numbers,
(SELECT count(*) FROM translation_segments s WHERE s.book_id = t.book_id) AS segments,
(SELECT max(coalesce(end_line, start_line)) FROM translation_segments s WHERE s.book_id = t.book_id) AS last_segment
FROM text_lines t GROUP BY 1""")
def q54_scalar_subqueries(c: Corpus) -> DataFrame:
    """Counts per book beside those of another table: two aggregates and one join."""
    s = c.segments.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("segments"), F.max(F.coalesce("end_line", "start_line")).alias("last_segment"))
    return c.lines.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("line_number").alias("numbers")
    ).join(s, "book_id", "left").withColumn("segments", F.coalesce("segments", F.lit(0)))


@query("""SELECT book_id, min(line_number) AS first_line, max(line_number) AS last_line, count(*) FILTER (speaker IS NOT NULL) AS spoken
FROM text_lines GROUP BY 1""")
def q55_line_bounds(c: Corpus) -> DataFrame:
    return c.lines.groupBy("book_id").agg(
        F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"), F.count("speaker").alias("spoken"))


# --- conflict rules

_PRIORITY = "['generated', 'lexicon', 'wiktionary', 'algorithmic']"


@query(f"""SELECT word_form, lemma, source, confidence FROM lemma_map WHERE source IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY word_form, lemma ORDER BY list_position({_PRIORITY}, source), ingested_at, confidence NULLS FIRST) = 1""")
def q21_priority_union(c: Corpus) -> DataFrame:
    """Lemma map built from its sources in order; the first writer of a pair keeps it."""
    parts = [c.lemmas.where(F.col("source") == s) for s in ("generated", "lexicon", "wiktionary", "algorithmic")]
    return tables.first_writer(parts, ["word_form", "lemma"], ["ingested_at", "confidence"]).select(
        "word_form", "lemma", "source", "confidence")


@query("""SELECT headword_normalized, source FROM dictionary_entries WHERE source = 'lexicon' UNION ALL
SELECT headword_normalized, source FROM dictionary_entries d WHERE source = 'wiktionary'
AND NOT EXISTS (SELECT 1 FROM dictionary_entries x WHERE x.source = 'lexicon' AND x.headword_normalized = d.headword_normalized)""")
def q22_fallback_union(c: Corpus) -> DataFrame:
    d = c.dictionary.select("headword_normalized", "source")
    return tables.fallback(d.where("source = 'lexicon'"), d.where("source = 'wiktionary'"), ["headword_normalized"])


@query("SELECT id, label, line_count, ingested_at FROM books QUALIFY row_number() OVER (PARTITION BY id ORDER BY removed_at IS NULL DESC, ingested_at DESC) = 1")
def q23_replace_on_conflict(c: Corpus) -> DataFrame:
    """Withdrawn rows first, then live ones over them."""
    b = c.get("books")
    return tables.last_writer(
        [b.where("removed_at IS NOT NULL"), b.where("removed_at IS NULL")], ["id"], ["ingested_at"]
    ).select("id", "label", "line_count", "ingested_at")


@query("""WITH e AS (SELECT DISTINCT word_form, lemma FROM lemma_map WHERE source = 'lexicon'),
n AS (SELECT DISTINCT word_form, lemma FROM lemma_map WHERE source = 'wiktionary')
SELECT count(*) AS inserted FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.word_form = n.word_form AND e.lemma IS NOT DISTINCT FROM n.lemma)""")
def q24_insert_ignore_count(c: Corpus) -> DataFrame:
    m = c.lemmas
    return tables.insert_ignore(
        m.where("source = 'lexicon'"), m.where("source = 'wiktionary'"), ["word_form", "lemma"], ["ingested_at"]
    ).agg(F.count(F.lit(1)).alias("inserted"))


@query("""WITH e AS (SELECT word_form, max_by(lemma, ingested_at) AS lemma, max(coalesce(confidence, 0)) AS confidence FROM lemma_map
  WHERE source = 'lexicon' GROUP BY 1),
n AS (SELECT word_form, max(lemma) AS lemma FROM lemma_map WHERE source = 'wiktionary' GROUP BY 1)
SELECT word_form, CASE WHEN n.lemma IS NOT NULL AND e.confidence < 0.9 THEN n.lemma ELSE coalesce(e.lemma, n.lemma) END AS lemma,
CASE WHEN e.word_form IS NULL OR (n.lemma IS NOT NULL AND e.confidence < 0.9) THEN CAST(0.95 AS DOUBLE) ELSE e.confidence END AS confidence
FROM e FULL JOIN n USING (word_form)""")
def q49_raise_confidence(c: Corpus) -> DataFrame:
    """Update weak rows, insert absent ones."""
    e = c.lemmas.where("source = 'lexicon'").groupBy("word_form").agg(
        F.max_by("lemma", "ingested_at").alias("lemma"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    n = c.lemmas.where("source = 'wiktionary'").groupBy("word_form").agg(F.max("lemma").alias("lemma"))
    return tables.raise_confidence(e, n, "word_form")


@query("""WITH a AS (SELECT DISTINCT book_id, line_number FROM text_lines WHERE speaker IS NOT NULL),
w AS (SELECT DISTINCT book_id, line_number FROM text_lines WHERE line_number % 2 = 0)
(SELECT * FROM a EXCEPT SELECT * FROM w) UNION ALL (SELECT * FROM w EXCEPT SELECT * FROM a)""")
def q50_toggle(c: Corpus) -> DataFrame:
    k = ["book_id", "line_number"]
    return tables.toggle(
        c.lines.where("speaker IS NOT NULL").select(*k).distinct(), c.lines.where("line_number % 2 = 0").select(*k).distinct(), k)


@query("""WITH a AS (SELECT DISTINCT book_id, line_number FROM text_lines WHERE speaker IS NOT NULL),
w AS (SELECT DISTINCT book_id, line_number FROM translation_lookup)
(SELECT * FROM a EXCEPT SELECT * FROM w) UNION ALL (SELECT * FROM w EXCEPT SELECT * FROM a)""")
def q50_toggle_linked(c: Corpus) -> DataFrame:
    """Spoken lines beside the lines that the lookup links."""
    k = ["book_id", "line_number"]
    return tables.toggle(
        c.lines.where("speaker IS NOT NULL").select(*k).distinct(), c.lookup.select(*k).distinct(), k)


@query("SELECT DISTINCT split_part(book_id, '.', 1) AS id FROM text_lines WHERE split_part(book_id, '.', 1) IN (SELECT split_part(id, '.', 1) FROM books)")
def q51_delete_childless(c: Corpus) -> DataFrame:
    """Authors named by lines, without those that have no work."""
    named = c.lines.select(F.split_part(F.col("book_id"), F.lit("."), F.lit(1)).alias("id")).where("id IS NOT NULL").distinct()
    return tables.delete_where_no_child(named, "id", c.works, "author_id")


@query("""(SELECT word_normalized FROM word_forms WHERE word_normalized IS NOT NULL EXCEPT SELECT word_normalized FROM lemma_map)""")
def q52_words_not_found(c: Corpus) -> DataFrame:
    return c.words.where("word_normalized IS NOT NULL").select("word_normalized").subtract(c.lemmas.select("word_normalized"))


@query("""SELECT word_normalized, min_by(lemma, (ingested_at, lemma)) AS first_lemma, max_by(lemma, (ingested_at, lemma)) AS last_lemma
FROM lemma_map WHERE lemma IS NOT NULL GROUP BY 1""")
def q52_first_and_last_writer(c: Corpus) -> DataFrame:
    pos = F.struct("ingested_at", "lemma")
    return c.lemmas.where("lemma IS NOT NULL").groupBy("word_normalized").agg(
        F.min_by("lemma", pos).alias("first_lemma"), F.max_by("lemma", pos).alias("last_lemma"))


# --- order

@query("""WITH o AS (SELECT id, book_id, line_number, speaker, line_text,
  speaker IS NOT NULL AND speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY book_id ORDER BY line_number, id) AS s FROM text_lines),
i AS (SELECT *, sum(CAST(s AS INTEGER)) OVER (PARTITION BY book_id ORDER BY line_number, id ROWS UNBOUNDED PRECEDING) AS island,
  last_value(speaker IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY line_number, id ROWS UNBOUNDED PRECEDING) AS carried FROM o)
SELECT book_id, CAST(island AS BIGINT) AS island, min(carried) AS speaker, arg_min(line_number, (line_number, id)) AS start_line,
arg_max(line_number, (line_number, id)) AS end_line, count(*) AS lines,
string_agg(line_text, ' ' ORDER BY line_number, id) AS segment_text FROM i WHERE island > 0 GROUP BY 1, 2""")
def q26_sessionize(c: Corpus) -> DataFrame:
    """Runs of lines under one speaker, lines before the first dropped."""
    order = ["line_number", "id"]
    rows = tables.changed(c.lines, ["book_id"], order, "speaker", "new", block=10_000)
    rows = tables.islands(rows, ["book_id"], order, F.col("new") & F.col("speaker").isNotNull(), block=10_000)
    rows = tables.carried(rows, ["book_id"], order, "speaker", "carried", block=10_000)
    pos = F.struct("line_number", "id")
    return rows.where("island > 0").groupBy("book_id", "island").agg(
        F.min("carried").alias("speaker"), F.min_by("line_number", pos).alias("start_line"),
        F.max_by("line_number", pos).alias("end_line"), F.count(F.lit(1)).alias("lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "id", "line_text"))),
                                 lambda x: x["line_text"]), " ").alias("segment_text"))


# --- alignment

_STATS = "ls AS (SELECT book_id, count(DISTINCT line_number) AS line_count, min(line_number) AS lo, max(line_number) AS hi FROM text_lines GROUP BY 1)"


def _section_books(c: Corpus) -> DataFrame:
    m = c.lines.groupBy("book_id").agg(F.max("line_number").alias("max_line"))
    s = c.segments.groupBy("book_id").agg(
        F.greatest(F.floor(F.max("start_line") / 4), F.lit(1)).cast("int").alias("max_section"),
        F.count(F.lit(1)).alias("segment_count"))
    return m.join(s, "book_id")


@query(f"""WITH {_STATS}, s AS (SELECT book_id, greatest(max(start_line) // 4, 1) AS m, count(*) AS n FROM translation_segments GROUP BY 1),
j AS (SELECT book_id, hi, m, unnest(range(1, m + 1)) AS k FROM ls JOIN s USING (book_id)
      WHERE hi > 0 AND ((n = m AND m < hi / 2) OR (m < hi / 3 AND m < 200)))
SELECT book_id, CAST(k AS INTEGER) AS section, CAST(floor((k - 1) * (hi / m)) + 1 AS INTEGER) AS start_line,
CAST(least(floor(k * (hi / m)), hi) AS INTEGER) AS end_line FROM j""")
def q27_section_map(c: Corpus) -> DataFrame:
    """Sections (a quarter as many as the numbers of the segments) laid over the lines."""
    return line_alignment.section_map(_section_books(c))


_SEG = """sg AS (SELECT book_id, id AS segment_id, start_line AS s, coalesce(end_line, start_line) AS e FROM translation_segments)"""
_MAPPED = f"""{_STATS}, {_SEG}, mt AS (SELECT book_id, max(e) AS t FROM sg GROUP BY 1),
mp AS (SELECT sg.*, (t < hi / 2 OR t > hi * 2) AND t > 0 AND t < 500 AS scaled,
  CASE WHEN (t < hi / 2 OR t > hi * 2) AND t > 0 AND t < 500 THEN floor(lo + (s - 1) / t * (hi - lo)) ELSE s END AS ms,
  CASE WHEN (t < hi / 2 OR t > hi * 2) AND t > 0 AND t < 500 THEN floor(lo + e / t * (hi - lo)) ELSE e END AS me
  FROM sg JOIN ls USING (book_id) JOIN mt USING (book_id)),
vl AS (SELECT DISTINCT book_id, line_number FROM text_lines),
ins AS (SELECT DISTINCT vl.book_id, line_number, segment_id, CASE WHEN scaled THEN 'proportional' ELSE 'direct' END AS how
  FROM vl JOIN mp ON vl.book_id = mp.book_id AND line_number BETWEEN ms AND me),
nr AS (SELECT vl.book_id, vl.line_number, segment_id, 'nearest' AS how FROM vl JOIN sg ON vl.book_id = sg.book_id
  WHERE least(abs(line_number - s), abs(line_number - e)) < 100 AND (vl.book_id, line_number) NOT IN (SELECT book_id, line_number FROM ins)
  QUALIFY row_number() OVER (PARTITION BY vl.book_id, line_number ORDER BY least(abs(line_number - s), abs(line_number - e)), s, segment_id) = 1),
lkp AS (SELECT * FROM ins UNION ALL SELECT * FROM nr)"""


@query(f"WITH {_MAPPED} SELECT * FROM lkp")
def q28_lookup(c: Corpus) -> DataFrame:
    return line_alignment.lookup(c.lines, c.segments)


def _quarters(c: Corpus) -> DataFrame:
    """The translations as if numbered by sections of ten lines."""
    q = lambda x: F.floor((F.col(x) + 9) / 10).cast("int")
    return c.segments.withColumn("start_line", q("start_line")).withColumn("end_line", q("end_line"))


_SECTIONED = _MAPPED.replace(
    _SEG, "sg AS (SELECT book_id, id AS segment_id, (start_line + 9) // 10 AS s, coalesce((end_line + 9) // 10, (start_line + 9) // 10) AS e FROM translation_segments)")


@query(f"WITH {_SECTIONED} SELECT * FROM lkp")
def q29_lookup_proportional(c: Corpus) -> DataFrame:
    return line_alignment.lookup(c.lines, _quarters(c))


@query(f"""WITH {_STATS}, {_SEG}, vl AS (SELECT DISTINCT book_id, line_number FROM text_lines),
x AS (SELECT vl.book_id, line_number, segment_id, least(abs(line_number - s), abs(line_number - e)) AS distance, s FROM vl JOIN sg ON vl.book_id = sg.book_id)
SELECT book_id, line_number, segment_id, CAST(distance AS INTEGER) AS distance FROM x WHERE distance < 100
QUALIFY row_number() OVER (PARTITION BY book_id, line_number ORDER BY distance, s, segment_id) = 1""")
def q30_nearest(c: Corpus) -> DataFrame:
    seg = c.segments.select(
        "book_id", F.col("id").alias("segment_id"), "start_line", F.coalesce("end_line", "start_line").alias("end_line"))
    near = tables.nearest(
        c.lines.select("book_id", "line_number").distinct(), seg, ["book_id"], "line_number", "start_line", "end_line", 100,
        ["start_line", "segment_id"])
    return near.select("book_id", "line_number", "segment_id", "distance")


@query(f"""WITH {_STATS}, s AS (SELECT book_id, count(*) AS segment_count, count(DISTINCT start_line) AS sl, min(start_line) AS first_line,
  max(coalesce(end_line, start_line)) AS last_line FROM translation_segments GROUP BY 1)
SELECT book_id, line_count, segment_count, first_line, last_line, round(sl * 100.0 / line_count, 1) AS coverage_pct,
CASE WHEN last_line < line_count * 0.5 THEN 'SEVERELY_MISALIGNED' WHEN last_line < line_count * 0.8 THEN 'MISALIGNED' ELSE 'ALIGNED' END AS status
FROM ls JOIN s USING (book_id)""")
def q31_alignment_status(c: Corpus) -> DataFrame:
    s = line_alignment.status(c.lines, c.segments)
    return s.orderBy(F.when(F.col("book_id").startswith("tlg"), 0).otherwise(1), "coverage_pct", "book_id")


@query(f"""WITH {_STATS}, m AS (SELECT book_id, count(DISTINCT line_number) AS n FROM translation_lookup GROUP BY 1)
SELECT book_id, line_count, coalesce(n, 0) AS mapped_lines, round(coalesce(n, 0) * 100.0 / line_count, 1) AS coverage_pct
FROM ls LEFT JOIN m USING (book_id)""")
def q32_coverage_pct(c: Corpus) -> DataFrame:
    return line_alignment.coverage(c.lines, c.lookup)


# --- morphology

_M = morphology


def _lemmatize_sql() -> str:
    dic = _list(_M.HEADWORD_ENDINGS)
    pats = "[" + ", ".join(f"{{'e': '{e}', 'n': '{n}'}}" for e, n in _M.PATRONYMICS) + "]"
    return f"""
WITH w AS (SELECT DISTINCT word_normalized AS w FROM word_forms WHERE word_normalized IS NOT NULL),
d AS (SELECT unnest({dic}) AS x), e AS (SELECT DISTINCT unnest({_list(_M.STRIPPED)}) AS e),
st AS (SELECT w, w AS s FROM w UNION ALL SELECT w, left(w, length(w) - length(e)) FROM w JOIN e ON ends_with(w, e) AND length(w) > length(e) + 2),
p AS (SELECT w, left(w, length(w) - length(p.e)) AS base, p.n AS n,
  CASE WHEN ends_with(w, 'ου') OR ends_with(w, 'εω') THEN left(w, length(w) - 1) || 'σ' ELSE w END AS itself
  FROM w JOIN (SELECT unnest({pats}) AS p) ON ends_with(w, p.e) AND length(w) > length(p.e) + 2),
c AS (
  SELECT w, s AS l FROM st UNION SELECT w, s || x FROM st, d
  UNION SELECT w, substr(w, 2) FROM w WHERE w LIKE 'ε%' AND length(w) > 3
  UNION SELECT w, 'τιθημι' FROM w WHERE w LIKE 'εθ%' AND length(w) > 3
  UNION SELECT w, left(w, length(w) - 4) || v FROM w, (SELECT unnest(['ω', 'εω', 'αω', 'οω', 'υω']) AS v) WHERE w LIKE '%θεισ' AND length(w) > 4
  UNION SELECT w, left(w, length(w) - 5) || 'οω' FROM w WHERE w LIKE '%ωθεισ'
  UNION SELECT w, CASE WHEN base LIKE '%η' THEN left(base, length(base) - 1) || CASE WHEN n = 'ευσ' THEN n ELSE 'ε' || n END ELSE base || 'υσ' END
    FROM p WHERE base LIKE '%η' OR (base LIKE '%ε' AND n = 'ευσ')
  UNION SELECT w, base || n FROM p
  UNION SELECT w, CASE WHEN itself LIKE '%ησ' THEN left(itself, length(itself) - 1) || 'σ' ELSE itself END FROM p
  UNION SELECT w, left(w, length(w) - 3) || 'ευσ' FROM w WHERE w LIKE '%ηοσ'
  UNION SELECT w, left(w, length(w) - 3) || substr(w, length(w) - 3, 1) || 'ευσ' FROM w WHERE regexp_matches(w, '[λμνρ]ηοσ$'))
SELECT w AS word_form, w AS word_normalized, l AS lemma,
  CAST(CASE WHEN l = w THEN 0.9 WHEN l IN (w || 'οσ', w || 'η', w || 'ον') THEN 0.7
       WHEN l LIKE '%ευσ' AND regexp_matches(w, '({"|".join(dict.fromkeys(e for e, _ in _M.PATRONYMICS))})$') THEN 0.75
       WHEN length(l) < length(w) THEN 0.6 ELSE 0.5 END AS DOUBLE) AS confidence, 'algorithmic' AS source
FROM c WHERE l IN (SELECT headword_normalized FROM dictionary_entries WHERE language = 'greek')"""


@query(_lemmatize_sql())
def q33_lemmatize(c: Corpus) -> DataFrame:
    return morphology.lemmatize(c.words, c.dictionary.where("language = 'greek'"))


def _forms_sql() -> str:
    v = {k: x.split() for k, x in _M.VERB_ENDINGS.items()}
    contract = " UNION ".join(
        f"SELECT h, left(s, length(s) - 1) || unnest({_list(v[name])}) AS f FROM v WHERE om AND s LIKE '%{vowel}'"
        for vowel, name in (("α", "contract alpha"), ("ε", "contract epsilon"), ("ο", "contract omicron")))
    return f"""
WITH h AS (SELECT DISTINCT headword_normalized AS h, {_fold('headword')} AS l FROM dictionary_entries WHERE language = 'greek'),
n AS (SELECT h, l AS s FROM h UNION ALL SELECT h, CASE WHEN l LIKE '%ος' OR l LIKE '%ον' THEN left(l, length(l) - 2)
  WHEN l LIKE '%η' OR l LIKE '%α' THEN left(l, length(l) - 1) END FROM h),
v AS (SELECT h, s, om, CASE WHEN left(s, 1) IN ('α', 'ε', 'η', 'ι', 'ο', 'υ', 'ω') THEN s ELSE 'ε' || s END AS a FROM (
  SELECT h, l, l LIKE '%ω' OR l LIKE '%ειν' AS om, CASE WHEN l LIKE '%ω' THEN left(l, length(l) - 1) WHEN l LIKE '%μι' THEN left(l, length(l) - 2)
    WHEN l LIKE '%ειν' THEN left(l, length(l) - 3) END AS s FROM h WHERE l <> 'φημι') WHERE length(s) >= 2),
f AS (SELECT h, l AS f FROM h
  UNION SELECT h, s || unnest({_list(_M.noun_endings())}) FROM n WHERE length(s) >= 2
  UNION SELECT h, s || unnest({_list(v['present active'] + v['present middle'])}) FROM v WHERE om
  UNION SELECT h, s || unnest({_list(v['present mi'])}) FROM v WHERE NOT om
  UNION {contract}
  UNION SELECT h, a || unnest({_list(v['imperfect active'] + v['imperfect middle'] + v['strong aorist'])}) FROM v
  UNION SELECT h, a || 'σ' || unnest({_list(v['weak aorist'])}) FROM v
  UNION SELECT h, unnest({_list(_M.IRREGULAR['φημι'].split())}) FROM h WHERE l = 'φημι')
SELECT f AS word_form, f AS word_normalized, h AS lemma, CAST(0.8 AS DOUBLE) AS confidence, 'generated' AS source FROM f
WHERE length(f) >= 2 AND regexp_matches(f, '{_M.VALID_FORM}') AND f <> h"""


@query(_forms_sql())
def q34_generated_forms(c: Corpus) -> DataFrame:
    return morphology.generated_mappings(c.dictionary.where("language = 'greek'"))


def _declined_sql() -> str:
    rows = ", ".join(
        f"('{name}', {i}, '{case}', '{e}')"
        for name, es in _M.declension_endings().items() for i, (case, e) in enumerate(es))
    nom = ", ".join(f"('{name}', '{es[0][1]}')" for name, es in _M.declension_endings().items())
    return f"""
WITH t(p, i, c, e) AS (VALUES {rows}), o(p, n) AS (VALUES {nom}),
h AS (SELECT DISTINCT headword AS t, CASE WHEN headword LIKE '%ος' THEN 'δρόμος' WHEN headword LIKE '%ον' THEN 'πρόσωπον'
  WHEN headword LIKE '%η' OR headword LIKE '%ή' THEN 'γνώμη' ELSE 'πόλις' END AS p FROM dictionary_entries WHERE language = 'greek'),
f AS (SELECT t, h.p, i, c, CASE WHEN ends_with(t, n) THEN left(t, length(t) - length(n)) ELSE t END || e AS f FROM h JOIN o USING (p) JOIN t ON t.p = h.p)
SELECT f AS word_form, t AS lemma, arg_min(c, i) AS "case", min(p) AS pattern FROM f WHERE f <> t GROUP BY 1, 2"""


@query(_declined_sql())
def q34_declined_forms(c: Corpus) -> DataFrame:
    """Forms of every Greek headword by the declension template of its ending."""
    t = F.col("headword")
    name = F.when(t.endswith("ος"), "δρόμος").when(t.endswith("ον"), "πρόσωπον").when(
        t.endswith("η") | t.endswith("ή"), "γνώμη").otherwise("πόλις")
    pages = c.dictionary.where("language = 'greek'").select(t.alias("title"), F.concat(F.lit("{{decl|"), name, F.lit("}}")).alias("template"))
    return morphology.declined_forms(pages.distinct())


# --- bookmarks

_MARKS = """bm AS (SELECT id, book_id, line_number, speaker AS note, line_text, epoch_us(ingested_at) // 1000 AS created_at,
  epoch_us(ingested_at) // 1000 + id % 7 * 1000 AS last_accessed FROM text_lines WHERE speaker IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY book_id, line_number ORDER BY id DESC) = 1)"""


@query(f"WITH {_MARKS} SELECT id, book_id, line_number, note, created_at, last_accessed FROM bm")
def q48_bookmarks(c: Corpus) -> DataFrame:
    """Spoken lines as bookmarks: the last insert of a place replaces the others."""
    return bookmarks.upsert(None, bookmarks.from_lines(c.lines)).select(
        "id", "book_id", "line_number", "note", "created_at", "last_accessed")


@query(f"WITH {_MARKS} SELECT id, last_accessed FROM bm ORDER BY last_accessed DESC, id LIMIT 20")
def q48_recent_bookmarks(c: Corpus) -> DataFrame:
    return bookmarks.recent(bookmarks.upsert(None, bookmarks.from_lines(c.lines)), 20).select("id", "last_accessed")


@query(f"""WITH {_MARKS} SELECT split_part(book_id, '.', 1) || '.' || split_part(book_id, '.', 2) AS work_id, count(*) AS marks,
count(*) FILTER (note IS NOT NULL AND note <> '') AS noted FROM bm GROUP BY 1""")
def q48_bookmarks_by_work(c: Corpus) -> DataFrame:
    return bookmarks.counts_by_work(bookmarks.upsert(None, bookmarks.from_lines(c.lines)))


# --- other tables of the directory

@query("""SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders,
round(coalesce(sum(o_totalprice), 0), 2) AS total FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def q16_outer_chain(c: Corpus) -> DataFrame:
    """A chain of outer joins over four levels, aggregated from below so that each join is small."""
    o = c.get("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    cu = c.get("customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.sum("t").alias("t"))
    return (
        c.get("region").join(c.get("nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .join(cu, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .groupBy("r_name").agg(
            F.count("n_nationkey").alias("nations"), F.coalesce(F.sum("c"), F.lit(0)).alias("customers"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.round(F.coalesce(F.sum("t"), F.lit(0.0)), 2).alias("total"))
    )
