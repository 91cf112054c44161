import shutil

import pytest

from lektra.streaming import changes


def log(seq, op, line, note):
    return (seq, op, seq, "w", "b", line, "A", "W", None, "t", note, seq, seq)


def test_bookmark_log(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    stream = lambda: spark.readStream.schema(changes.CHANGES).parquet(src)
    spark.createDataFrame([log(1, "put", 1, "a"), log(2, "put", 2, "b"), log(3, "put", 1, "c")], changes.CHANGES).coalesce(1).write.parquet(src)
    changes.bookmark_stream(stream(), out, cp).awaitTermination(60)
    spark.createDataFrame([log(4, "delete", 2, None), log(5, "put", 3, "d")], changes.CHANGES).coalesce(1).write.mode("append").parquet(src)
    changes.bookmark_stream(stream(), out, cp).awaitTermination(60)
    got = {(r.line_number, r.note) for r in spark.read.parquet(f"{out}/v=1").collect()}
    assert got == {(1, "c"), (3, "d")}


def test_orphan_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "table_name string, side string, ref_key string, at string"
    rows = [
        [("t", "ref", "a", "2023-01-02"), ("t", "ref", "b", "2023-01-03"), ("t", "ref", None, "2023-01-03")],
        [("t", "parent", "a", "2023-02-01"), ("t", "parent", "b", "2022-12-01")],
        [("t", "removed", "b", "2023-03-01")],
    ]
    seen = []
    for i, r in enumerate(rows):
        spark.createDataFrame(r, schema).selectExpr("table_name", "side", "ref_key", "cast(at as timestamp) as at").coalesce(1).write.mode("append").parquet(src)
        ev = spark.readStream.schema("table_name string, side string, ref_key string, at timestamp").parquet(src)
        changes.orphan_stream(ev, out, cp).awaitTermination(60)
        s = changes.orphan_state(spark, out, i)
        seen.append({(x.ref_key, x.kind) for x in s.broken().collect()})
    assert seen == [{("a", "missing"), ("b", "missing")}, {("a", "late")}, {("a", "late"), ("b", "deleted")}]


def test_orphan_stream_merges_versions_and_fails_without_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "MERGE", 2)
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "table_name string, side string, ref_key string, at timestamp"
    ev = lambda: spark.readStream.schema(schema).parquet(src)
    rows = [("ref", "a"), ("ref", "b"), ("parent", "a"), ("parent", "b"), ("removed", "a"), ("parent", "c")]
    want = [{"a"}, {"a", "b"}, {"b"}, set(), {"a"}, {"a"}]
    for i, (side, key) in enumerate(rows):
        df = spark.sql(f"SELECT 't' AS table_name, '{side}' AS side, '{key}' AS ref_key, timestamp'2023-01-0{9 - i}' AS at")
        df.coalesce(1).write.mode("append").parquet(src)
        changes.orphan_stream(ev(), out, cp).awaitTermination(60)
        state = changes.orphan_state(spark, out, i)
        assert {r.ref_key for r in state.broken().where("kind <> 'late'").collect()} == want[i]
        assert sum(r.open_keys for r in state.snapshot("x").collect()) == len(want[i])
    shutil.rmtree(f"{out}/events/merged=6")
    df.coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception):
        changes.orphan_stream(ev(), out, cp).awaitTermination(60)
