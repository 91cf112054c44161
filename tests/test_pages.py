"""Operators over ranges run over all pages of every book."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def test_all_lines_are_on_a_page(spark):
    q = entry.queries()
    lines = spark.read.parquet(f"{SF}/text_lines.parquet")
    pages = {(r.book_id, r.range_start) for r in q["q19_page_ranges"](spark, SF).collect()}
    got = q["q08_text_pages"](spark, SF).collect()
    assert len(got) == lines.where("book_id IS NOT NULL AND line_number >= 1").count()
    assert {(r.book_id, r.range_start) for r in got} <= pages
    assert max(r.line_number for r in got) > 100


def test_segments_meet_pages_after_the_first(spark):
    q = entry.queries()
    over, seen = (q[n](spark, SF).collect() for n in ("q09_overlap_pages", "q09_visible_pages"))
    assert {(r.segment_id, r.range_start) for r in seen} <= {(r.id, r.range_start) for r in over}
    assert max(r.range_start for r in seen) > 100
