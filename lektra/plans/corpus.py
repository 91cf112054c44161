"""The corpus and what users ask of it: navigation, reading, dictionary, concordance.

Every lookup takes a table of keys, so that a single word and a whole vocabulary
run the same plan; the single-key forms below wrap them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lektra.functions import text
from lektra.operators import tables
from lektra.runtime import table

OCCURRENCES = 500


@dataclass(frozen=True)
class Corpus:
    """Tables of one database directory. Authors and works are read from the ids of
    the books where the directory has no tables of them."""

    spark: SparkSession
    path: str

    def get(self, name: str) -> DataFrame:
        return table(self.spark, self.path, name)

    @cached_property
    def books(self) -> DataFrame:
        """One row per book id: the row that was loaded last."""
        w = Window.partitionBy("id").orderBy(F.desc("ingested_at"))
        return self.get("books").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")

    @cached_property
    def lines(self) -> DataFrame:
        return self.get("text_lines")

    @cached_property
    def words(self) -> DataFrame:
        return self.get("word_forms")

    @cached_property
    def segments(self) -> DataFrame:
        return self.get("translation_segments")

    @cached_property
    def lookup(self) -> DataFrame:
        return self.get("translation_lookup").select("book_id", "line_number", "segment_id").distinct()

    @cached_property
    def dictionary(self) -> DataFrame:
        return self.get("dictionary_entries")

    @cached_property
    def lemmas(self) -> DataFrame:
        return self.get("lemma_map")

    @cached_property
    def works(self) -> DataFrame:
        return self.books.groupBy(F.col("work_id").alias("id")).agg(F.count(F.lit(1)).alias("book_count")).select(
            "id", F.split_part(F.col("id"), F.lit("."), F.lit(1)).alias("author_id"),
            F.col("id").alias("title"), "book_count")

    @cached_property
    def authors(self) -> DataFrame:
        return self.works.groupBy(F.col("author_id").alias("id")).agg(F.count(F.lit(1)).alias("work_count")).select(
            "id", F.col("id").alias("name"), text.language_of(F.col("id")).alias("language"), "work_count")


def is_translation(c: Column) -> Column:
    """Long enough to be a translation."""
    return c.isNotNull() & (F.length(F.trim(c)) > 10)


# --- navigation and reading

def authors(c: Corpus, language: str | None = None) -> DataFrame:
    out = c.authors if language is None else c.authors.where(F.col("language") == language)
    return out.orderBy("name")


def works(c: Corpus, author_id: str | None = None) -> DataFrame:
    """Works with whether any of their books has a translation."""
    have = c.segments.where(is_translation(F.col("translation_text"))).join(
        c.books.select(F.col("id").alias("book_id"), "work_id"), "book_id").select(F.col("work_id").alias("id")).distinct()
    w = c.works if author_id is None else c.works.where(F.col("author_id") == author_id)
    return w.join(have.withColumn("has_translation", F.lit(True)), "id", "left").withColumn(
        "has_translation", F.coalesce("has_translation", F.lit(False)))


def books(c: Corpus, work_id: str | None = None) -> DataFrame:
    b = c.books if work_id is None else c.books.where(F.col("work_id") == work_id)
    return b.select(
        "id", "work_id", "book_number", F.coalesce("label", F.concat(F.lit("Book "), "book_number")).alias("label"),
        F.coalesce("line_count", F.lit(0)).alias("line_count"))


def text_range(c: Corpus, start: int, end: int, book_id: str | None = None) -> DataFrame:
    rows = c.lines.where(F.col("line_number").between(start, end))
    return rows if book_id is None else rows.where(F.col("book_id") == book_id)


def translations(c: Corpus, start: int, end: int, book_id: str | None = None, translator: str | None = None) -> DataFrame:
    """Segments that meet the range, by their own numbers or by the lookup."""
    s = c.segments
    if book_id is not None:
        s = s.where(F.col("book_id") == book_id)
    if translator is not None:
        s = s.where(F.col("translator") == translator)
    linked = c.lookup.where(F.col("line_number").between(start, end)).select(
        F.col("segment_id").alias("id"), "book_id", F.lit(True).alias("linked")).distinct()
    return s.join(linked, ["id", "book_id"], "left").where(
        F.coalesce("linked", F.lit(False)) | tables.overlaps(F.col("start_line"), F.col("end_line"), start, end)
    ).drop("linked")


def translators(c: Corpus, book_id: str | None = None) -> DataFrame:
    s = c.segments.where(F.col("translator").isNotNull())
    if book_id is not None:
        s = s.where(F.col("book_id") == book_id)
    return s.select("book_id", "translator").distinct()


# --- dictionary

def _entry_text() -> Column:
    return F.coalesce("entry_html", "entry_plain", F.lit(""))


def best_lemma(c: Corpus, words: DataFrame) -> DataFrame:
    """For each ``word_normalized`` of ``words`` its lemma of highest confidence (ties by lemma)."""
    m = c.lemmas.join(words.select("word_normalized").distinct(), "word_normalized", "left_semi")
    # of equal confidence the smallest lemma; a null confidence ranks last
    w = Window.partitionBy("word_normalized").orderBy(F.desc_nulls_last("confidence"), "lemma", F.asc_nulls_last("morph_info"))
    return m.withColumn("n", F.row_number().over(w)).where("n = 1").select(
        "word_normalized", "lemma", "confidence", "morph_info")


def dictionary_entry(c: Corpus, words: DataFrame, language: str = "greek") -> DataFrame:
    """Direct entry, else (Greek) the entry of the best lemma."""
    w = words.select("word_normalized").distinct()
    first = Window.partitionBy("headword_normalized").orderBy("id")
    d = c.dictionary.where(F.col("language") == language).withColumn("n", F.row_number().over(first)).where("n = 1").select(
        F.col("headword_normalized").alias("lemma"), F.col("id").alias("entry_id"), _entry_text().alias("definition"))
    direct = w.join(d, F.col("word_normalized") == F.col("lemma")).select(
        "word_normalized", "lemma", "entry_id", "definition", F.lit(None).cast("string").alias("morph_info"),
        F.lit(True).alias("is_direct"))
    rest = w.join(direct.select("word_normalized"), "word_normalized", "left_anti")
    via = best_lemma(c, rest).join(d, "lemma").select(
        "word_normalized", "lemma", "entry_id", "definition", "morph_info", F.lit(False).alias("is_direct"))
    return direct.unionByName(via) if language == "greek" else direct


def all_entries(c: Corpus, words: DataFrame, language: str = "greek") -> DataFrame:
    """All entries of each word: its own, those of its lemmas (best mapping of each), and,
    for a genitive plural that maps only to itself, those of its nominative plural's
    lemmas at four fifths of their confidence. With the rank shown and the share of
    confidence among entries that are not direct."""
    w = words.select("word_normalized").where(F.col("word_normalized").isNotNull()).distinct()
    first = Window.partitionBy("headword_normalized").orderBy("id")
    d = c.dictionary.where(F.col("language") == language).withColumn("n", F.row_number().over(first)).where("n = 1").select(
        F.col("headword_normalized").alias("lemma"), F.col("id").alias("entry_id"))
    direct = w.join(d, F.col("word_normalized") == F.col("lemma")).select(
        "word_normalized", "lemma", "entry_id", F.lit(1.0).alias("confidence"), F.lit(0).alias("kind"))
    per_lemma = c.lemmas.groupBy("word_normalized", "lemma").agg(F.max("confidence").alias("confidence"))
    mapped = w.join(per_lemma, "word_normalized")
    via = mapped.where(F.col("lemma") != F.col("word_normalized")).join(d, "lemma").select(
        "word_normalized", "lemma", "entry_id", "confidence", F.lit(1).alias("kind"))
    # a word whose own mapping has no entry
    lost = mapped.where(F.col("lemma") == F.col("word_normalized")).join(
        d.select("lemma"), "lemma", "left_anti").select("word_normalized")
    related = lost.where(F.col("word_normalized").endswith("ων") & (F.length("word_normalized") >= 4)).select(
        "word_normalized",
        F.concat(F.left("word_normalized", F.length("word_normalized") - 2), F.lit("οι")).alias("related"))
    rescued = (
        related.join(per_lemma.withColumnRenamed("word_normalized", "related"), "related")
        .where(F.col("lemma") != F.col("related"))
        .join(mapped.select("word_normalized", "lemma"), ["word_normalized", "lemma"], "left_anti")
        .join(d, "lemma")
        .select("word_normalized", "lemma", "entry_id",
                (F.coalesce("confidence", F.lit(0.0)) * 0.8).alias("confidence"), F.lit(2).alias("kind"))
    )
    rows = direct.unionByName(via).unionByName(rescued)
    by_word = Window.partitionBy("word_normalized")
    order = by_word.orderBy((F.col("kind") != 0), F.desc(F.coalesce("confidence", F.lit(0.0))), "lemma", "kind")
    weight = F.when(F.col("kind") != 0, F.coalesce("confidence", F.lit(0.5)))
    return rows.withColumn("rank", F.row_number().over(order)).withColumn(
        "share_pct", F.round(weight / F.sum(weight).over(by_word) * 100, 1))


def web_dictionary(c: Corpus, words: DataFrame, language: str = "greek", n: int = 5) -> DataFrame:
    """At most n direct entries and n via lemmas, each entry once, direct first."""
    w = words.select("word_normalized").distinct()
    d = c.dictionary.where(F.col("language") == language).select("id", "headword", "headword_normalized")
    direct = tables.top_per_group(
        w.join(d, F.col("word_normalized") == F.col("headword_normalized")), ["word_normalized"], ["id"], n
    ).select("word_normalized", "id", "headword", F.lit(0).alias("src"))
    pairs = c.lemmas.select("word_normalized", F.col("lemma").alias("headword_normalized")).distinct()
    via = tables.top_per_group(
        w.join(pairs, "word_normalized").join(d, "headword_normalized"), ["word_normalized"], ["id"], n
    ).select("word_normalized", "id", "headword", F.lit(1).alias("src"))
    return tables.first_writer([direct, via], ["word_normalized", "id"], ["src"])


def search_entries(c: Corpus, pattern: str, language: str = "greek", n: int = 10) -> DataFrame:
    """LIKE as in a store that ignores the case of ASCII letters."""
    return c.dictionary.where((F.col("language") == language) & F.col("headword_normalized").ilike(pattern)).orderBy(
        "headword_normalized", "id").limit(n)


# --- concordance

def occurrences(c: Corpus, lemmas: DataFrame, cap: int = OCCURRENCES) -> DataFrame:
    """Lines in which forms of each ``lemma`` stand, with the matching words, first ``cap`` per lemma."""
    pairs = c.lemmas.join(lemmas.select("lemma").distinct(), "lemma", "left_semi").select("word_normalized", "lemma").distinct()
    hits = (
        c.words.where(F.col("book_id").isNotNull()).join(pairs, "word_normalized")
        .groupBy("lemma", "book_id", "line_number")
        .agg(F.sort_array(F.collect_set(F.struct("word_position", "word"))).alias("matches"))
    )
    top = tables.top_per_group(hits, ["lemma"], ["book_id", "line_number"], cap)
    b = c.books.select(F.col("id").alias("book_id"), "work_id", "book_number", "label")
    # a book that is not there keeps its line, under default names
    return top.join(b, "book_id", "left").select(
        "lemma", "book_id", "line_number",
        F.array_join(F.transform("matches", lambda m: F.concat(m["word"], F.lit(":"), m["word_position"])), ",").alias("matches"),
        F.coalesce(F.split_part(F.col("work_id"), F.lit("."), F.lit(1)), F.lit("Unknown Author")).alias("author"),
        F.coalesce("work_id", F.lit("Unknown Work")).alias("work"),
        F.coalesce("label", F.concat(F.lit("Book "), "book_number"), F.lit("Unknown Book")).alias("book"))


def count_occurrences(c: Corpus, lemmas: DataFrame) -> DataFrame:
    """Number of lines per lemma, not capped."""
    pairs = c.lemmas.join(lemmas.select("lemma").distinct(), "lemma", "left_semi").select("word_normalized", "lemma").distinct()
    return (
        c.words.where(F.col("book_id").isNotNull()).select("word_normalized", "book_id", "line_number").distinct()
        .join(pairs, "word_normalized").groupBy("lemma")
        .agg(F.count_distinct("book_id", "line_number").alias("lines"))
    )


def web_occurrences(c: Corpus, word: str, limit: int = 50, book_id: str | None = None) -> DataFrame:
    """Occurrences of all forms of a word: those mapped to it, itself, and their text."""
    forms = c.lemmas.where((F.col("lemma") == word) | (F.col("word_normalized") == word)).select("word_normalized")
    forms = forms.unionByName(c.spark.createDataFrame([(word,)], "word_normalized string")).distinct()
    w = c.words if book_id is None else c.words.where(F.col("book_id") == book_id)
    return (
        w.join(forms, "word_normalized", "left_semi")
        .join(c.lines.select("book_id", "line_number", "line_text"), ["book_id", "line_number"])
        .join(c.books.select(F.col("id").alias("book_id"), F.col("label").alias("book_label"), "work_id"), "book_id")
        .select("book_id", "line_number", "word", "word_position", "line_text", "book_label",
                F.col("work_id").alias("work_title"),
                F.split_part(F.col("work_id"), F.lit("."), F.lit(1)).alias("author_name"))
        .distinct().orderBy("book_id", "line_number", "word_position", "word", "line_text").limit(limit)
    )


def grouped_occurrences(found: DataFrame) -> DataFrame:
    """Web occurrences as nested groups by "author - work - label"."""
    return found.groupBy(F.concat_ws(" - ", "author_name", "work_title", "book_label").alias("place")).agg(
        F.sort_array(F.collect_list(F.struct("line_number", "word_position", "word", "line_text"))).alias("occurrences"))


def visible_segments(c: Corpus, start: int, end: int) -> DataFrame:
    """Segments with the lines of the page they cover; those with none are dropped."""
    page = c.lines.where(F.col("line_number").between(start, end)).select("book_id", "line_number").distinct()
    s = translations(c, start, end).select(F.col("id").alias("segment_id"), "book_id", "start_line", "end_line")
    hi = F.least(F.coalesce("end_line", F.lit(end)), F.lit(end))
    s = s.withColumn("lo", F.greatest("start_line", F.lit(start))).withColumn("hi", hi)
    return tables.band_join(page, s, ["book_id"], "line_number", "lo", "hi", 100).groupBy("segment_id", "book_id").agg(
        F.count(F.lit(1)).alias("visible_lines"), F.min("line_number").alias("first_visible"))


# --- all pages

PAGE = ["book_id", "range_start", "range_end"]


def pages(c: Corpus) -> DataFrame:
    """The page ranges of every book."""
    return tables.page_ranges(c.lines.groupBy("book_id").agg(F.max("line_number").alias("total")), "total")


def page_lines(c: Corpus) -> DataFrame:
    """Every line with the range of its page."""
    return tables.band_join(c.lines, pages(c).select(*PAGE), ["book_id"], "line_number", "range_start", "range_end", 100)


def page_translations(c: Corpus) -> DataFrame:
    """Segments that meet a page, by their own numbers or by the lookup, for every page."""
    s = c.segments.select("id", "book_id", "start_line", "end_line")
    total = c.lines.groupBy("book_id").agg(F.max("line_number").alias("total"))
    start, end = F.col("range_start"), F.least(F.col("range_start") + 99, F.col("total"))
    first, _ = tables.page_of(F.greatest("start_line", F.lit(1)))
    last, _ = tables.page_of(F.least(F.coalesce("end_line", "total"), F.col("total")))
    own = s.where("start_line IS NOT NULL").join(total, "book_id").where(first <= last).withColumn(
        "range_start", F.explode(F.sequence(first, last, F.lit(100)))).withColumn("range_end", end).where(
        tables.overlaps(F.col("start_line"), F.col("end_line"), start, F.col("range_end")))
    linked = tables.band_join(
        c.lookup, pages(c).select(*PAGE), ["book_id"], "line_number", "range_start", "range_end", 100
    ).select(F.col("segment_id").alias("id"), *PAGE).distinct()
    cols = ["id", "start_line", "end_line", *PAGE]
    return own.select(*cols).unionByName(s.join(linked, ["id", "book_id"]).select(*cols)).distinct()


def page_visible_segments(c: Corpus) -> DataFrame:
    """Segments with the lines of every page they cover; those with none are dropped."""
    lines = c.lines.select("book_id", "line_number").distinct()
    s = page_translations(c).withColumn("lo", F.greatest("start_line", "range_start")).withColumn(
        "hi", F.least(F.coalesce("end_line", "range_end"), F.col("range_end"))).withColumnRenamed("id", "segment_id")
    return tables.band_join(lines, s, ["book_id"], "line_number", "lo", "hi", 100).groupBy(
        "segment_id", "book_id", "range_start").agg(
        F.count(F.lit(1)).alias("visible_lines"), F.min("line_number").alias("first_visible"))


def page_neighbours(c: Corpus) -> DataFrame:
    """Ranges before and after every page, for the text (``translator`` null) and for every translator, null
    where there is none. Beyond the ends of a book a translator's page has a neighbour only if segments of
    the translator meet it."""
    p = pages(c)
    end = F.coalesce("end_line", F.lit(2**31 - 1))
    reach = c.segments.where("translator IS NOT NULL AND start_line IS NOT NULL").join(
        p.select("book_id", "total").distinct(), "book_id").groupBy("book_id", "translator").agg(
        F.max((F.col("start_line") <= 0) & (end >= 1)).alias("ahead"),
        F.max((F.col("start_line") <= F.col("total")) & (end > F.col("total"))).alias("beyond"))
    both = p.select(*PAGE, "total", F.lit(None).cast("string").alias("translator"), F.lit(False).alias("ahead"), F.lit(False).alias("beyond"))
    both = both.unionByName(p.select(*PAGE, "total").join(reach, "book_id"))
    start, to = F.col("range_start"), F.col("range_end")
    back, on = (start > 1) | F.col("ahead"), (to < F.col("total")) | F.col("beyond")
    return both.select(
        *PAGE, "translator", F.when(back, F.greatest(start - 100, F.lit(1))).alias("previous_start"),
        F.when(back, start - 1).alias("previous_end"), F.when(on, to + 1).alias("next_start"),
        F.when(on, F.least(F.col("total"), to + 100)).alias("next_end"))


def web_pages(c: Corpus, size: int = 30) -> DataFrame:
    """Pages of ``size`` lines that can be reached: the first with fewer rows is the last."""
    per = c.lines.where("line_number >= 1").groupBy(
        "book_id", (F.floor((F.col("line_number") - 1) / size) + 1).cast("int").alias("page")).agg(
        F.count(F.lit(1)).alias("line_rows"))
    top = per.groupBy("book_id").agg(F.max("page").alias("top"))
    full = top.select("book_id", F.explode(F.sequence(F.lit(1), F.col("top") + 1)).alias("page")).join(
        per, ["book_id", "page"], "left").fillna(0, ["line_rows"])
    last = full.where(F.col("line_rows") < size).groupBy("book_id").agg(F.min("page").alias("last"))
    return full.join(last, "book_id").where(F.col("page") <= F.col("last")).select(
        "book_id", "page", ((F.col("page") - 1) * size + 1).alias("first_line"), (F.col("page") * size).alias("last_line"),
        "line_rows", (F.col("page") == F.col("last")).alias("is_last"))
