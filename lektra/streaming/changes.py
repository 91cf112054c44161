"""Streams: a bookmark change log kept as snapshots, and orphan references kept as state.

Both run each micro-batch through the batch operators and write a new version of
their snapshot under the batch's number, so a batch that is run again after a
failure gives the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lektra.operators import orphans, tables
from lektra.plans.bookmarks import KEY, SCHEMA

CHANGES = "seq long, op string, " + SCHEMA.replace("\n", " ")


def _version(spark: SparkSession, path: str, n: int, schema) -> DataFrame | None:
    """The version before batch ``n``; only the first batch has none. A version that is missing or
    cannot be read fails the batch: state is never taken to be empty."""
    return None if n == 0 else spark.read.schema(schema).parquet(f"{path}/v={n - 1}")


def _drop(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def apply_changes(snapshot: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Latest state of each place: the change of highest ``seq`` wins; ``delete`` removes it."""
    last = tables.last_writer([changes], KEY, ["seq"])
    kept = last.where(F.col("op") != "delete").drop("seq", "op")
    if snapshot is None:
        return kept
    return snapshot.join(last.select(*KEY), KEY, "left_anti").select(*kept.columns).unionByName(kept)


def bookmark_stream(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run all available changes; version n of the snapshot is ``path/v=n``."""
    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        kept_schema = [f for f in batch.schema.fields if f.name not in ("seq", "op")]
        before = _version(spark, path, n, type(batch.schema)(kept_schema))
        apply_changes(before, batch).write.mode("overwrite").parquet(f"{path}/v={n}")
        # the last version stays for a batch that is run again
        _drop(spark, [f"{path}/v={n - 2}"] if n > 1 else [])

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def orphan_stream(
    events: DataFrame, path: str, checkpoint: str
) -> StreamingQuery:
    """Events (table_name, side, ref_key, at) with side ``ref``, ``parent`` or ``removed``.

    A batch appends its deltas (``path/events/v=n``) and what they change in the standing of
    references (``path/log/v=n``), both in buckets of keys, and reads the buckets it touches only.
    Every MERGE batches all versions are added up into one and the older ones dropped."""
    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = _bucketed(orphans.deltas(batch.withColumn("batch", F.lit(n))))
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/events/v={n}")
        new = _read(spark, path, "events", [n])
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        before = _read(spark, path, "events", _parts(n)).where(F.col("bucket").isin(touched))
        seen = before.unionByName(new).join(new.select(*orphans.KEY).distinct(), orphans.KEY, "left_semi")
        _bucketed(orphans.changes(seen, n)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/log/v={n}")
        if n % MERGE == MERGE - 1:
            _merge(spark, path, n)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


#: batches between two merges of the versions
MERGE = 16


def _parts(n: int) -> list[int]:
    """Versions that hold all batches before ``n``: the last merged one (negative) and those after it."""
    merged = n // MERGE * MERGE
    return [*([-merged] if merged else []), *range(merged, n)]


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*orphans.KEY), F.lit(orphans.BUCKETS)).cast("int"))


def _read(spark: SparkSession, path: str, kind: str, versions: list[int]) -> DataFrame:
    """Versions of the events or of the log; a missing one fails."""
    schema = (orphans.EVENTS if kind == "events" else orphans.LOG) + ", bucket int"
    out = spark.createDataFrame([], schema)
    for v in versions:
        out = out.unionByName(spark.read.schema(schema).parquet(f"{path}/{kind}/" + (f"v={v}" if v >= 0 else f"merged={-v}")))
    return out


def _merge(spark: SparkSession, path: str, n: int) -> None:
    now = _read(spark, path, "events", _parts(n) + [n])
    added = now.groupBy(*orphans.KEY, "load_month", (F.col("refs") > 0).alias("ref"), "bucket").agg(
        *[F.sum(c).alias(c) for c in ("refs", "arrived", "removed")], F.min("first_ref").alias("first_ref"),
        F.min("first_seen").alias("first_seen"), F.lit(n).alias("batch")).drop("ref")
    added.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/events/merged={n + 1}")
    log = _read(spark, path, "log", _parts(n) + [n])
    # the last standing of each, as one change from nothing
    last = log.groupBy(*orphans.KEY, "load_month", "bucket").agg(F.max(F.struct("batch", "kind", "refs")).alias("x")).select(
        *orphans.KEY, "load_month", "x.kind", F.lit(None).cast("string").alias("was"), "x.refs", F.lit(0).cast("long").alias("before"),
        "x.batch", "bucket").where(F.col("kind") != orphans.OK)
    last.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/log/merged={n + 1}")
    old = [v for v in _parts(n + 1 - MERGE)] + list(range(n + 1 - MERGE, n - 1))
    _drop(spark, [f"{path}/{k}/" + (f"v={v}" if v >= 0 else f"merged={-v}") for k in ("events", "log") for v in old])


def orphan_state(spark: SparkSession, path: str, n: int) -> orphans.OrphanState:
    """The state after batch ``n``."""
    read = lambda kind: _read(spark, path, kind, _parts(n + 1))
    return orphans.OrphanState(spark, read("events"), read("log"))
