"""Queries of the text-collection problems and, where it can be said in SQL, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lektra.llm import alignment, confusables, contamination, languages, mixing, sentences, term_counts
from lektra.runtime import cut, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return (
        sentences.split_sentences(table(spark, d, "text_lines"), "id", "line_text")
        .select(F.col("id").alias("line_id"), "sent_start", "sent_end").distinct()
    )


def p2_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the translations with their text."""
    return sentences.split_sentences(
        table(spark, d, "translation_segments"), "id", "translation_text", with_text=True)


def _p4(spark: SparkSession, d: str, canonical) -> DataFrame:
    def part(name: str, field: str, key) -> DataFrame:
        rows = table(spark, d, name).select(field, key.alias("record_key"))
        return canonical(rows, field).select(
            F.lit(name).alias("table_name"), "record_key", F.col(field).alias("stored"), "canonical")

    return (
        part("text_lines", "line_text", F.col("id").cast("string"))
        .unionByName(part("dictionary_entries", "headword", F.col("id").cast("string")))
        .unionByName(part("lemma_map", "word_form", F.concat(
            F.coalesce("word_form", F.lit("")), F.lit("|"), F.coalesce("lemma", F.lit("")))))
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d, confusables.odd_rows).where(F.col("stored") != F.col("canonical")).select("table_name", "record_key").distinct()


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its field in the consistent form."""
    return _p4(spark, d, confusables.with_canonical).distinct()


def _located(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "word_forms").where(F.col("book_id").isNotNull())


def p5_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_counts(_located(spark, d), "word_normalized", ["book_id", "line_number"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _located(spark, d)
    total = rows.select("book_id", "line_number").distinct().count()
    # three marks are read from the counts: they are made once
    return term_counts.marks(cut(p5_term_counts(spark, d)), total, table(spark, d, "missing_words_analysis"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return alignment.align(
        table(spark, d, "text_lines"), table(spark, d, "translation_segments"),
        table(spark, d, "translation_lookup"), table(spark, d, "dictionary_entries"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs(spark, d).drop("score")


def _p7(spark: SparkSession, d: str, short: bool = False) -> DataFrame:
    return contamination.leaks(spark, table(spark, d, "documents"), table(spark, d, "eval_passages"), short)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the passages stand: one row per stretch, in characters of the text."""
    return _p7(spark, d).select("doc_id", "item_id", "words", F.explode("spans").alias("s")).select(
        "doc_id", "item_id", "words", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the leaked spans removed, those of short items too."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return contamination.removed(docs, cut(_p7(spark, d, short=True)))


def _p8(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    docs = table(spark, d, "documents").join(
        F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    counted = cut(mixing.count_tokens(docs.select("doc_id", "source", "text")))
    rate = cut(mixing.rates(counted, targets))
    return mixing.draw(counted, rate), rate


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen records, one row per copy."""
    return _p8(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_p8(spark, d))


def _p9(spark: SparkSession, d: str) -> DataFrame:
    return languages.stretches(spark, table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    stored = F.coalesce(F.trim("stored_lang"), F.lit(""))
    return _p9(spark, d).where(
        (F.col("segments") > 1) | stored.isin("", "und") | (F.col("stored_lang") != F.col("lang"))
    ).select("doc_id", "seg_no", "lang")


def p9_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every document's stretches with offsets and confidence."""
    return _p9(spark, d).select("doc_id", "seg_no", "seg_start", "seg_end", "lang", "confidence")


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_sentences, p4_found, p4_canonical, p5_term_counts, p5_found,
        p6_found, p6_pairs, p8_mix, p8_shares, p7_found, p7_spans, p7_clean, p9_found, p9_stretches,
    )
}

_COUNTS = """
WITH d AS (SELECT DISTINCT * FROM word_forms WHERE book_id IS NOT NULL),
c AS (SELECT word_normalized AS term, count(*) AS occurrences, count(DISTINCT (book_id, line_number)) AS records
      FROM d WHERE word_normalized IS NOT NULL GROUP BY 1)
"""

_LATIN = r"a-zA-Z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}"
_GREEK = r"\x{0370}-\x{0373}\x{0376}\x{0377}\x{037B}-\x{037D}\x{037F}\x{0386}\x{0388}-\x{03FF}\x{1F00}-\x{1FFC}"
_CYRILLIC = r"\x{0400}-\x{052F}"


def _odd(c: str) -> str:
    """Not composed; invisible; another space; a compatibility form; a letter of another script in a word, or a
    whole word of Cyrillic letters that look Latin or Greek beside one that is."""
    return rf"""(nfc_normalize({c}) <> {c}
 OR regexp_matches({c}, '[\p{{Cf}}\x{{034F}}\x{{115F}}\x{{1160}}\x{{FE00}}-\x{{FE0F}}]')
 OR regexp_matches({c}, '[\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\t\x0B\f\x{{0085}}]')
 OR regexp_matches({c}, '[\x{{FF01}}-\x{{FFEF}}\x{{FB00}}-\x{{FB06}}\x{{00B5}}\x{{03D0}}-\x{{03D6}}\x{{03F0}}-\x{{03F2}}\x{{03F4}}\x{{03F5}}\x{{03F9}}\x{{2100}}-\x{{214F}}\x{{2460}}-\x{{24FF}}\x{{017F}}]')
 OR regexp_matches({c}, '[ɣıɑɩ]')
 OR regexp_matches({c}, '[{_LATIN}][{_GREEK}{_CYRILLIC}]|[{_GREEK}][{_LATIN}{_CYRILLIC}]|[{_CYRILLIC}][{_LATIN}{_GREEK}]')
 OR (regexp_matches({c}, '[{_LATIN}{_GREEK}]') AND regexp_matches({c}, '[{_CYRILLIC}]')
     AND NOT regexp_matches({c}, '[б-джзйлфчш-яБ-ДЖЗИЙЛФЧШ-Я]')))"""


SQL = {
    "p4_found": f"""
SELECT 'text_lines' AS table_name, CAST(id AS VARCHAR) AS record_key FROM text_lines WHERE {_odd('line_text')}
UNION SELECT 'dictionary_entries', CAST(id AS VARCHAR) FROM dictionary_entries WHERE {_odd('headword')}
UNION SELECT 'lemma_map', coalesce(word_form, '') || '|' || coalesce(lemma, '') FROM lemma_map WHERE {_odd('word_form')}""",
    # translations are English: every mark ends a sentence but those of decimals and of two abbreviations
    "p2_sentences": r"""
WITH t AS (SELECT id, regexp_extract_all(translation_text,
  '(?:i\.e\.|e\.g\.|[.][0-9]|[^.!?])+(?:[.!?]+\s*|$)') AS a FROM translation_segments WHERE translation_text IS NOT NULL),
u AS (SELECT id, generate_subscripts(a, 1) AS n, unnest(a) AS s FROM t),
v AS (SELECT id, n, regexp_replace(s, '\s+$', '') AS sentence, length(s) AS l,
  sum(length(s)) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS z FROM u)
SELECT id, CAST(n AS INTEGER) AS sent_no, CAST(z - l AS INTEGER) AS sent_start,
  CAST(z - l + length(sentence) AS INTEGER) AS sent_end, sentence FROM v""",
    "p5_term_counts": _COUNTS + "SELECT * FROM c",
    "p5_found": _COUNTS + """
SELECT term, 'rare' AS mark FROM c WHERE records < 3
UNION ALL
SELECT term, 'common' FROM c WHERE records > 0.1 * (SELECT count(DISTINCT (book_id, line_number)) FROM d)
UNION ALL
SELECT DISTINCT word, 'misreported' FROM missing_words_analysis LEFT JOIN c ON word = term
WHERE frequency IS NOT NULL AND word IS NOT NULL AND frequency <> coalesce(occurrences, 0)""",
}
