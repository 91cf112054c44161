"""From rough numbering to a line lookup: sections to lines, segments to lines, coverage and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektra.operators import tables


def section_map(books: DataFrame) -> DataFrame:
    """Per book (book_id, max_line, max_section, segment_count): its sections with the lines they cover.

    Books whose sections are not clearly fewer than their lines have none."""
    m, s, n = F.col("max_line"), F.col("max_section"), F.col("segment_count")
    applies = ((n == s) & (s < m / 2)) | ((s < m / 3) & (s < 200))
    k = F.col("section")
    return (
        books.where((m > 0) & (s > 0) & applies)
        .withColumn("section", F.explode(F.sequence(F.lit(1), s)))
        .select(
            "book_id", "section",
            (F.floor((k - 1) * (m / s)) + 1).cast("int").alias("start_line"),
            F.least(F.floor(k * (m / s)), m.cast("bigint")).cast("int").alias("end_line"))
    )


def line_stats(lines: DataFrame) -> DataFrame:
    return lines.groupBy("book_id").agg(
        F.count_distinct("line_number").alias("line_count"),
        F.min("line_number").alias("min_line"), F.max("line_number").alias("max_line"))


def mapped_segments(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments with the lines they should cover: as numbered, or in proportion where
    the translation is numbered by sections. A segment without end covers its start."""
    seg = segments.select(
        "book_id", F.col("id").alias("segment_id"), "start_line",
        F.coalesce("end_line", "start_line").alias("end_line"))
    top = seg.groupBy("book_id").agg(F.max("end_line").alias("t"))
    # one row per book on both sides
    b = line_stats(lines).join(top, "book_id")
    t, lo, hi = F.col("t"), F.col("min_line"), F.col("max_line")
    scaled = ((t < hi / 2) | (t > hi * 2)) & (t > 0) & (t < 500)
    at = lambda x: F.floor(lo + x / t * (hi - lo)).cast("int")
    return seg.join(b, "book_id").select(
        "book_id", "segment_id", "start_line", "end_line", scaled.alias("scaled"),
        F.when(scaled, at(F.col("start_line") - 1)).otherwise(F.col("start_line")).alias("map_start"),
        F.when(scaled, at(F.col("end_line"))).otherwise(F.col("end_line")).alias("map_end"))


def lookup(lines: DataFrame, segments: DataFrame, within: int = 100, width: int = 100) -> DataFrame:
    """(book_id, line_number, segment_id, how): lines inside a segment, then for the rest
    the nearest segment by its own numbers, less than ``within`` lines away."""
    valid = lines.select("book_id", "line_number").distinct()
    seg = mapped_segments(lines, segments)
    inside = tables.band_join(valid, seg, ["book_id"], "line_number", "map_start", "map_end", width).select(
        "book_id", "line_number", "segment_id",
        F.when(F.col("scaled"), "proportional").otherwise("direct").alias("how")).distinct()
    rest = valid.join(inside.select("book_id", "line_number").distinct(), ["book_id", "line_number"], "left_anti")
    near = tables.nearest(
        rest, seg.select("book_id", "segment_id", "start_line", "end_line"), ["book_id"], "line_number",
        "start_line", "end_line", within, ["start_line", "segment_id"])
    return inside.unionByName(near.select("book_id", "line_number", "segment_id", F.lit("nearest").alias("how")))


def coverage(lines: DataFrame, look: DataFrame) -> DataFrame:
    """Share of the lines of a book that have a segment, in percent."""
    have = look.groupBy("book_id").agg(F.count_distinct("line_number").alias("mapped_lines"))
    return line_stats(lines).join(have, "book_id", "left").select(
        "book_id", "line_count", F.coalesce("mapped_lines", F.lit(0)).alias("mapped_lines"),
        F.round(F.coalesce("mapped_lines", F.lit(0)) * 100.0 / F.col("line_count"), 1).alias("coverage_pct"))


def status(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Alignment status of every book with translations, worst coverage first."""
    s = segments.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("segment_count"), F.count_distinct("start_line").alias("start_lines"),
        F.min("start_line").alias("first_line"), F.max(F.coalesce("end_line", "start_line")).alias("last_line"))
    n = F.col("line_count")
    return (
        line_stats(lines).join(s, "book_id")
        .withColumn("coverage_pct", F.round(F.col("start_lines") * 100.0 / n, 1))
        .withColumn("status", F.when(F.col("last_line") < n * 0.5, "SEVERELY_MISALIGNED")
                    .when(F.col("last_line") < n * 0.8, "MISALIGNED").otherwise("ALIGNED"))
        .select("book_id", "line_count", "segment_count", "first_line", "last_line", "coverage_pct", "status")
    )
