"""Bookmarks: one per (book_id, line_number), batch operations on snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektra.operators import tables

KEY = ["book_id", "line_number"]
SCHEMA = """id long, work_id string, book_id string, line_number int, author_name string, work_title string,
book_label string, line_text string, note string, created_at long, last_accessed long"""


def from_lines(lines: DataFrame) -> DataFrame:
    """Spoken lines as bookmarks, noted with the speaker."""
    work = F.concat_ws(".", F.split_part(F.col("book_id"), F.lit("."), F.lit(1)), F.split_part(F.col("book_id"), F.lit("."), F.lit(2)))
    at = F.unix_millis("ingested_at")
    return lines.where(F.col("speaker").isNotNull()).select(
        "id", work.alias("work_id"), "book_id", "line_number",
        F.split_part(F.col("book_id"), F.lit("."), F.lit(1)).alias("author_name"), work.alias("work_title"),
        F.col("book_id").alias("book_label"), "line_text", F.col("speaker").alias("note"),
        at.alias("created_at"), (at + F.col("id") % 7 * 1000).alias("last_accessed"))


def upsert(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Replace on conflict of the place; of several new rows the last id wins."""
    return tables.last_writer([new] if existing is None else [existing, new], KEY, ["id"])


def insert_ignore(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next snapshot, and the rows really inserted (their number is the count)."""
    added = tables.insert_ignore(existing, new, KEY, ["id"])
    return existing.unionByName(added), added


def delete(existing: DataFrame, places: DataFrame) -> DataFrame:
    return existing.join(places.select(*KEY), KEY, "left_anti")


def update_note(existing: DataFrame, bookmark_id: int, note: str | None) -> DataFrame:
    return existing.withColumn("note", F.when(F.col("id") == bookmark_id, F.lit(note)).otherwise(F.col("note")))


def touch(existing: DataFrame, bookmark_id: int, now_millis: int) -> DataFrame:
    """Set the time of last access; the time is a parameter."""
    return existing.withColumn(
        "last_accessed", F.when(F.col("id") == bookmark_id, F.lit(now_millis)).otherwise(F.col("last_accessed")))


def toggle(existing: DataFrame, place: DataFrame) -> DataFrame:
    return tables.toggle(existing, place, KEY)


def is_bookmarked(existing: DataFrame, places: DataFrame) -> DataFrame:
    """Places with a flag."""
    have = existing.select(*KEY).distinct().withColumn("b", F.lit(True))
    return places.join(have, KEY, "left").withColumn("bookmarked", F.coalesce("b", F.lit(False))).drop("b")


def recent(existing: DataFrame, n: int | None = None) -> DataFrame:
    out = existing.orderBy(F.desc("last_accessed"), "id")
    return out if n is None else out.limit(n)


def newest(existing: DataFrame) -> DataFrame:
    return existing.orderBy(F.desc("created_at"), "id")


def by_author(existing: DataFrame) -> DataFrame:
    return existing.orderBy("author_name", "work_title", "line_number")


def of_work(existing: DataFrame, work_id: str, with_note: bool = False) -> DataFrame:
    rows = existing.where(F.col("work_id") == work_id)
    return (noted(rows) if with_note else rows).orderBy("line_number")


def noted(existing: DataFrame) -> DataFrame:
    return existing.where(F.col("note").isNotNull() & (F.col("note") != ""))


def counts_by_work(existing: DataFrame) -> DataFrame:
    return existing.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("marks"),
        F.sum(F.when(F.col("note").isNotNull() & (F.col("note") != ""), 1).otherwise(0)).alias("noted"))
