"""Queries of the general data problems (skewed keys, orphan references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lektra.operators import orphans, skew
from lektra.runtime import table


#: what tells the rows of a frequent word or lemma apart
SPREAD = {"word_forms": ["book_id", "line_number", "word_position"], "lemma_map": ["word_form", "source"]}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, key in (("word_forms", "word_normalized"), ("lemma_map", "lemma")):
        part = skew.heavy_keys(table(spark, d, name), key, spread=SPREAD[name]).select(
            F.lit(name).alias("table_name"), F.col(key).alias("key_value"))
        out = part if out is None else out.unionByName(part)
    return out


def p1_word_stats(spark: SparkSession, d: str) -> DataFrame:
    return skew.balanced_agg(
        table(spark, d, "word_forms"), "word_normalized", {"books": "book_id", "forms": "word"},
        spread=SPREAD["word_forms"])


def p1_lemma_stats(spark: SparkSession, d: str) -> DataFrame:
    return skew.balanced_agg(
        table(spark, d, "lemma_map"), "lemma", {"forms": "word_form", "normal_forms": "word_normalized"},
        spread=SPREAD["lemma_map"])


def p1_lemma_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences in the texts per lemma: both the words and the lemmas are skewed."""
    words = table(spark, d, "word_forms").select("word_normalized", "book_id", "line_number", "word_position")
    lemmas = table(spark, d, "lemma_map").select("word_normalized", "lemma").distinct()
    return (
        skew.balanced_join(words, lemmas, "word_normalized", spread=SPREAD["word_forms"])
        .groupBy("lemma", "word_normalized", "book_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("lemma").agg(
            F.sum("n").alias("occurrences"),
            F.count_distinct("word_normalized").alias("words"),
            F.count_distinct("book_id").alias("books"))
    )


def references(spark: SparkSession, d: str) -> list[orphans.Reference]:
    return [
        orphans.Reference("word_forms", table(spark, d, "word_forms"), "book_id", table(spark, d, "books"), "id"),
        orphans.Reference(
            "translation_lookup", table(spark, d, "translation_lookup"), "segment_id",
            table(spark, d, "translation_segments"), "id"),
        orphans.Reference(
            "lemma_map", table(spark, d, "lemma_map"), "lemma",
            table(spark, d, "dictionary_entries"), "headword_normalized"),
    ]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    state, _ = orphans.track(references(spark, d))
    return state.broken().select("table_name", "ref_key", "load_month", "kind")


def p3_monthly(spark: SparkSession, d: str) -> DataFrame:
    state, _ = orphans.track(references(spark, d))
    return state.broken().groupBy("table_name", "load_month", "kind").agg(
        F.sum("refs").alias("refs"), F.count(F.lit(1)).alias("ref_keys"))


def p3_snapshots(spark: SparkSession, d: str) -> DataFrame:
    _, snaps = orphans.track(references(spark, d), with_snapshots=True)
    out = snaps[0]
    for s in snaps[1:]:
        out = out.unionByName(s)
    return out.select("as_of", "table_name", "load_month", "open_refs", "open_keys")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_word_stats, p1_lemma_stats, p1_lemma_occurrences, p3_found, p3_monthly, p3_snapshots)
}

_REFS = """
refs AS (
  SELECT 'word_forms' AS table_name, book_id AS ref_key, ingested_at FROM word_forms WHERE book_id IS NOT NULL
  UNION ALL SELECT 'translation_lookup', CAST(segment_id AS VARCHAR), ingested_at FROM translation_lookup WHERE segment_id IS NOT NULL
  UNION ALL SELECT 'lemma_map', lemma, ingested_at FROM lemma_map WHERE lemma IS NOT NULL),
par AS (
  SELECT 'word_forms' AS table_name, id AS ref_key, ingested_at, removed_at FROM books
  UNION ALL SELECT 'translation_lookup', CAST(id AS VARCHAR), ingested_at, removed_at FROM translation_segments
  UNION ALL SELECT 'lemma_map', headword_normalized, ingested_at, removed_at FROM dictionary_entries),
"""
_STANDING = f"""
WITH {_REFS}
p AS (SELECT table_name, ref_key, count(*) AS n, count(*) FILTER (removed_at IS NULL) AS live, min(ingested_at) AS first_seen
      FROM par WHERE ref_key IS NOT NULL GROUP BY 1, 2),
r AS (SELECT table_name, ref_key, strftime(ingested_at, '%Y-%m') AS load_month, count(*) AS refs, min(ingested_at) AS first_ref
      FROM refs GROUP BY 1, 2, 3),
b AS (SELECT r.*, CASE WHEN p.n IS NULL THEN 'missing' WHEN live = 0 THEN 'deleted'
                       WHEN first_seen > first_ref THEN 'late' ELSE 'ok' END AS kind
      FROM r LEFT JOIN p USING (table_name, ref_key))
"""

SQL = {
    "p1_found": """
SELECT 'word_forms' AS table_name, word_normalized AS key_value FROM word_forms WHERE word_normalized <> ''
GROUP BY word_normalized HAVING count(*) >= 0.02 * (SELECT count(*) FROM word_forms)
UNION ALL
SELECT 'lemma_map', lemma FROM lemma_map WHERE lemma <> ''
GROUP BY lemma HAVING count(*) >= 0.02 * (SELECT count(*) FROM lemma_map)""",
    "p1_word_stats": """
SELECT word_normalized, count(*) AS row_count, count(DISTINCT book_id) AS books, count(DISTINCT word) AS forms
FROM word_forms GROUP BY word_normalized""",
    "p1_lemma_stats": """
SELECT lemma, count(*) AS row_count, count(DISTINCT word_form) AS forms, count(DISTINCT word_normalized) AS normal_forms
FROM lemma_map GROUP BY lemma""",
    "p1_lemma_occurrences": """
SELECT lemma, count(*) AS occurrences, count(DISTINCT word_normalized) AS words, count(DISTINCT book_id) AS books
FROM word_forms JOIN (SELECT DISTINCT word_normalized, lemma FROM lemma_map) USING (word_normalized)
GROUP BY lemma""",
    "p3_found": _STANDING + "SELECT table_name, ref_key, load_month, kind FROM b WHERE kind <> 'ok'",
    "p3_monthly": _STANDING + """
SELECT table_name, load_month, kind, CAST(sum(refs) AS BIGINT) AS refs, count(*) AS ref_keys
FROM b WHERE kind <> 'ok' GROUP BY 1, 2, 3""",
    "p3_snapshots": f"""
WITH {_REFS}
ys AS (SELECT min(y) AS lo, max(y) AS hi FROM (
  SELECT year(ingested_at) AS y FROM word_forms UNION SELECT year(ingested_at) FROM translation_lookup
  UNION SELECT year(ingested_at) FROM lemma_map
  UNION SELECT year(ingested_at) FROM par UNION SELECT year(removed_at) FROM par)),
cuts AS (SELECT CAST(y AS VARCHAR) || '-01-01' AS as_of, make_timestamp(y, 1, 1, 0, 0, 0) AS t
         FROM (SELECT unnest(range(lo + 1, hi + 1)) AS y FROM ys)
         UNION ALL SELECT 'end', TIMESTAMP '9999-01-01'),
p AS (SELECT as_of, table_name, ref_key, count(*) AS n, count(*) FILTER (removed_at IS NULL OR removed_at >= t) AS live
      FROM par, cuts WHERE ref_key IS NOT NULL AND ingested_at < t GROUP BY 1, 2, 3),
r AS (SELECT as_of, table_name, ref_key, strftime(ingested_at, '%Y-%m') AS load_month, count(*) AS refs
      FROM refs, cuts WHERE ingested_at < t GROUP BY 1, 2, 3, 4)
SELECT as_of, table_name, load_month, CAST(sum(refs) AS BIGINT) AS open_refs, count(*) AS open_keys
FROM r LEFT JOIN p USING (as_of, table_name, ref_key)
WHERE coalesce(live, 0) <= 0 GROUP BY 1, 2, 3""",
}
