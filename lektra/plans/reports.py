"""Corpus reports: counters, manifest, quality, coverage, missing words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektra.functions import text
from lektra.operators import tables
from lektra.plans.corpus import Corpus, is_translation


def counters(c: Corpus) -> DataFrame:
    """Rows of every table, one row each."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in (
            ("authors", c.authors), ("works", c.works), ("books", c.books), ("text_lines", c.lines), ("words", c.words),
            ("translation_segments", c.segments), ("dictionary_entries", c.dictionary), ("lemma_map", c.lemmas))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def author_summary(c: Corpus) -> DataFrame:
    """Works, books and lines per author; authors without works stay."""
    w = c.works.select(F.col("id").alias("work_id"), "author_id")
    b = c.books.select("work_id", F.col("id").alias("book_id"), "line_count")
    return (
        c.authors.select(F.col("id").alias("author_id"), "language").join(w, "author_id", "left").join(b, "work_id", "left")
        .groupBy("author_id", "language").agg(
            F.count_distinct("work_id").alias("works"), F.count_distinct("book_id").alias("books"),
            F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"))
    )


def work_manifest(c: Corpus) -> DataFrame:
    """Per work: books, segments, and lines twice: summed over the join with the
    segments (a book counts once per segment) and counted once per book."""
    s = c.segments.select("book_id", F.col("id").alias("segment_id"))
    j = c.books.select("work_id", F.col("id").alias("book_id"), F.coalesce("line_count", F.lit(0)).alias("line_count")).join(
        s, "book_id", "left")
    per_book = j.groupBy("work_id", "book_id", "line_count").agg(
        F.count("segment_id").alias("segments"), F.count(F.lit(1)).alias("fan"))
    return per_book.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("books"), F.sum("segments").alias("segments"),
        F.sum(F.col("line_count") * F.col("fan")).alias("joined_lines"), F.sum("line_count").alias("total_lines"),
        F.max((F.col("segments") > 0).cast("int")).alias("has_translation"))


def manifest(c: Corpus) -> DataFrame:
    """The manifest as nested rows: author -> works -> books."""
    b = c.books.select("work_id", F.struct("book_number", "id", "label", "line_count").alias("b"))
    w = b.groupBy("work_id").agg(F.sort_array(F.collect_list("b")).alias("books"))
    return (
        w.withColumn("author_id", F.split_part(F.col("work_id"), F.lit("."), F.lit(1)))
        .groupBy("author_id").agg(F.sort_array(F.collect_list(F.struct("work_id", "books"))).alias("works"))
        .withColumn("language", text.language_of(F.col("author_id")))
    )


def translation_coverage(c: Corpus) -> DataFrame:
    """Works in all, works with a translation, and their share."""
    return work_manifest(c).agg(
        F.count(F.lit(1)).alias("works"),
        F.count_distinct(F.when(F.col("has_translation") == 1, F.col("work_id"))).alias("with_translation"),
    ).withColumn("coverage_pct", F.round(F.col("with_translation") * 100.0 / F.col("works"), 1))


def translation_totals(c: Corpus) -> DataFrame:
    b = c.books.select(F.col("id").alias("book_id"), "work_id")
    j = c.segments.join(b, "book_id")
    return j.agg(
        F.count_distinct(F.split_part(F.col("work_id"), F.lit("."), F.lit(1))).alias("authors"),
        F.count_distinct("work_id").alias("works"), F.count_distinct("id").alias("segments"))


def quality(c: Corpus) -> DataFrame:
    """Books in order of author and work, with headers where those change, and what their
    lines and segments say against the book's own figures."""
    lines = c.lines.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("lines"), F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"))
    seg = c.segments.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("segments"), F.min("start_line").alias("first_segment"),
        F.max(F.coalesce("end_line", "start_line")).alias("last_segment"))
    rows = (
        c.books.select(F.col("id").alias("book_id"), "work_id", "book_number", "line_count",
                       F.split_part(F.col("work_id"), F.lit("."), F.lit(1)).alias("author_id"))
        .join(lines, "book_id", "left").join(seg, "book_id", "left")
        .fillna(0, ["lines", "segments"])
    )
    rows = tables.changed(rows, ["author_id"], ["work_id", "book_number", "book_id"], "work_id", "new_work")
    return rows


def forms_coverage(c: Corpus) -> DataFrame:
    """Per author: distinct words, those with a lemma or an entry of their own, the same in
    tokens, and percentages. One pass over the words; the two key sets join as flags."""
    mapped = c.lemmas.select("word_normalized").distinct().withColumn("mapped", F.lit(1))
    own = c.dictionary.select(F.col("headword_normalized").alias("word_normalized")).distinct().withColumn("own", F.lit(1))
    per_word = (
        c.words.where(F.col("book_id").isNotNull() & (F.col("word_normalized") != ""))
        .groupBy(F.split_part(F.col("book_id"), F.lit("."), F.lit(1)).alias("author_id"), "word_normalized")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    j = per_word.join(mapped, "word_normalized", "left").join(own, "word_normalized", "left")
    pct = lambda a, b: F.round(F.col(a) * 100.0 / F.col(b), 2)
    return (
        j.groupBy("author_id").agg(
            F.count(F.lit(1)).alias("unique_words"), F.count("mapped").alias("mapped_words"), F.count("own").alias("own_entries"),
            F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(F.col("mapped") == 1, F.col("n"))), F.lit(0)).alias("mapped_tokens"))
        .withColumn("word_pct", pct("mapped_words", "unique_words"))
        .withColumn("token_pct", pct("mapped_tokens", "tokens"))
    )


def word_frequency(c: Corpus, least: int = 2, prefix: str = "tlg") -> DataFrame:
    return (
        c.words.where(F.col("book_id").startswith(prefix)).groupBy("word_normalized")
        .agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least)
    )


def missing_words(c: Corpus, least: int = 2) -> DataFrame:
    """Frequent Greek words without lemma and without entry."""
    return (
        word_frequency(c, least).join(c.lemmas.select("word_normalized").distinct(), "word_normalized", "left_anti")
        .join(c.dictionary.select(F.col("headword_normalized").alias("word_normalized")).distinct(), "word_normalized", "left_anti")
    )


def top_missing(c: Corpus, n: int = 10) -> DataFrame:
    """Per author the most frequent words without a lemma."""
    per = (
        c.words.where(F.col("book_id").isNotNull())
        .groupBy(F.split_part(F.col("book_id"), F.lit("."), F.lit(1)).alias("author_id"), "word_normalized")
        .agg(F.count(F.lit(1)).alias("freq"))
        .join(c.lemmas.select("word_normalized").distinct(), "word_normalized", "left_anti")
    )
    return tables.top_per_group(per, ["author_id"], [F.desc("freq"), "word_normalized"], n)


def missing_lemmas(c: Corpus) -> DataFrame:
    """Lemmas of the map that no entry has, with the number of their forms."""
    return (
        c.lemmas.where(F.col("lemma").isNotNull())
        .join(c.dictionary.select(F.col("headword_normalized").alias("lemma")).distinct(), "lemma", "left_anti")
        .groupBy("lemma").agg(F.count(F.lit(1)).alias("forms"))
    )


def lemma_map_stats(c: Corpus) -> DataFrame:
    have = c.dictionary.select(F.col("headword_normalized").alias("lemma")).distinct().withColumn("e", F.lit(1))
    return c.lemmas.join(have, "lemma", "left").agg(
        F.count(F.lit(1)).alias("mappings"), F.sum(F.when(F.col("e").isNull(), 1).otherwise(0)).alias("without_entry"),
        F.count("morph_info").alias("with_morphology"),
        F.round(F.count("morph_info") * 100.0 / F.count(F.lit(1)), 1).alias("morphology_pct"))


def frequency_classes(freq: DataFrame) -> DataFrame:
    return freq.agg(
        F.sum(F.when(F.col("freq") == 1, 1).otherwise(0)).alias("once"),
        F.sum(F.when(F.col("freq") >= 10, 1).otherwise(0)).alias("ten_and_more"),
        F.sum(F.when(F.col("freq") >= 100, 1).otherwise(0)).alias("hundred_and_more"))


def probe_coverage(c: Corpus, probe: list[str]) -> DataFrame:
    """Which of a list of words have a lemma."""
    p = c.spark.createDataFrame([(w,) for w in probe], "word_normalized string")
    have = c.lemmas.join(F.broadcast(p), "word_normalized", "left_semi").groupBy("word_normalized").agg(F.count(F.lit(1)).alias("n"))
    return p.join(have, "word_normalized", "left").select("word_normalized", F.coalesce("n", F.lit(0)).alias("mappings"))


def with_translation_flag(c: Corpus) -> DataFrame:
    """Authors with has_translations as the update sets it."""
    have = c.segments.where(is_translation(F.col("translation_text"))).select(
        F.split_part(F.col("book_id"), F.lit("."), F.lit(1)).alias("id")).distinct().withColumn("t", F.lit(1))
    return c.authors.select("id", "language").join(have, "id", "left").select(
        "id", "language", F.coalesce("t", F.lit(0)).alias("has_translations"))


def quality_text(c: Corpus) -> DataFrame:
    """The quality report as ordered lines of text, headers where author or work change."""
    q = quality(c)
    body = F.format_string(
        "    %s: %d lines (%s-%s), %d segments (%s-%s)", "book_id", "lines", F.coalesce(F.col("first_line").cast("string"), F.lit("-")),
        F.coalesce(F.col("last_line").cast("string"), F.lit("-")), "segments",
        F.coalesce(F.col("first_segment").cast("string"), F.lit("-")), F.coalesce(F.col("last_segment").cast("string"), F.lit("-")))
    head = F.when(F.col("new_work"), F.concat(F.lit("  Work "), F.col("work_id")))
    rows = q.select("author_id", "work_id", "book_number", "book_id",
                    F.posexplode(F.array_compact(F.array(head, body))).alias("i", "line"))
    authors = q.select("author_id").distinct().select(
        "author_id", F.lit("").alias("work_id"), F.lit(0).alias("book_number"), F.lit("").alias("book_id"), F.lit(0).alias("i"),
        F.concat(F.lit("Author "), "author_id").alias("line"))
    return rows.unionByName(authors).orderBy("author_id", "work_id", "book_number", "book_id", "i")


def restrict_vocabulary(c: Corpus) -> DataFrame:
    """The lemma map without forms that no text has."""
    return c.lemmas.join(c.words.select("word_normalized").distinct(), "word_normalized", "left_semi")
