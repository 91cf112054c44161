"""References to records that do not exist, kept as incremental state.

Everything that happens is an *event delta*: references per (table, key, month)
with their number and first time, parents per (table, key) with the rows that
arrived, the rows removed and the first arrival. Deltas are additive, so the
reference and the parent index of any moment are the sums of the deltas so far.

A batch touches only the keys it holds. Their deltas, old and new, are added up;
new references probe the parent index, arriving parents resolve the orphans that
wait for them, the removal of a key's last live parent opens its references again.
What changed its standing is appended to the *log* of waiting orphans: the pending
state is the last entry of each (table, key, month), and the counts of a snapshot
are sums over the log, which no batch has to take again from all references.

Null keys are no references. Repeated rows count as often as they come. Rows
without a time belong to the first batch. Empty tables give empty state. Columns
other than the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lektra.runtime import cut, shared_dir

KEY = ["table_name", "ref_key"]
EVENTS = """table_name string, ref_key string, load_month string, refs long, first_ref timestamp,
arrived long, removed long, first_seen timestamp, batch int"""
LOG = "table_name string, ref_key string, load_month string, kind string, was string, refs long, before long, batch int"
OK, LATE, DELETED, MISSING = "ok", "late", "deleted", "missing"
BUCKETS = 32


@dataclass(frozen=True)
class Reference:
    """``child`` rows refer with ``column`` to ``parent`` rows by ``key``."""

    name: str
    child: DataFrame
    column: str
    parent: DataFrame
    key: str


def month(c):
    """Month of a timestamp in UTC, whatever the session's time zone."""
    return F.date_format(_utc(c), "yyyy-MM")


def _utc(c: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))


def _batch_of(cuts: list[str] | None):
    """Batch of a time: the number of cuts passed, or the year in UTC; without a time the first."""
    if cuts is None:
        return lambda c: F.coalesce(F.year(_utc(c)), F.lit(-1))
    return lambda c: sum((F.coalesce((c >= F.to_timestamp(F.lit(x))).cast("int"), F.lit(0)) for x in cuts), F.lit(0))


def deltas(rows: DataFrame) -> DataFrame:
    """Rows (table_name, ref_key, side, at, batch), side ``ref``, ``parent`` or ``removed``, as
    event deltas; combined before the shuffle, so a hot key is one row per task and month."""
    side = F.col("side")
    of = lambda s: F.when(side == s, 1).otherwise(0)
    return (
        rows.where("ref_key IS NOT NULL")
        .groupBy(*KEY, (side == "ref").alias("ref"), F.when(side == "ref", month(F.col("at"))).alias("load_month"), "batch")
        .agg(
            F.sum(of("ref")).alias("refs"), F.min(F.when(side == "ref", F.col("at"))).alias("first_ref"),
            F.sum(of("parent")).alias("arrived"), F.sum(of("removed")).alias("removed"),
            F.min(F.when(side == "parent", F.col("at"))).alias("first_seen"))
        .select(*KEY, "load_month", "refs", "first_ref", "arrived", "removed", "first_seen", F.col("batch").cast("int"))
    )


def _rows(r: Reference, batch_of) -> DataFrame:
    name = F.lit(r.name).alias("table_name")
    row = lambda key, side, at: (
        name, F.col(key).cast("string").alias("ref_key"), F.lit(side).alias("side"), F.col(at).alias("at"),
        batch_of(F.col(at)).alias("batch"))
    return (
        r.child.select(*row(r.column, "ref", "ingested_at"))
        .unionByName(r.parent.select(*row(r.key, "parent", "ingested_at")))
        .unionByName(r.parent.where("removed_at IS NOT NULL").select(*row(r.key, "removed", "removed_at")))
    )


def _kind(arrived: Column, removed: Column, first_seen: Column, first_ref: Column) -> Column:
    return (
        F.when(F.coalesce(arrived, F.lit(0)) <= 0, MISSING).when(arrived - removed <= 0, DELETED)
        .when(first_seen > first_ref, LATE).otherwise(OK))


def changes(events: DataFrame, batch: int) -> DataFrame:
    """What batch ``batch`` changes in the standing of references. ``events`` are the deltas of the keys
    it touches, this batch's and all earlier ones."""
    old = F.col("batch") < batch
    key = Window.partitionBy(*KEY)
    added = events.groupBy(*KEY, (F.col("refs") > 0).alias("ref"), "load_month").agg(
        *[F.sum(c).alias(c) for c in ("refs", "arrived", "removed")], F.min("first_ref").alias("first_ref"),
        F.min("first_seen").alias("first_seen"),
        *[F.sum(F.when(old, F.col(c)).otherwise(0)).alias(f"old_{c}") for c in ("refs", "arrived", "removed")],
        F.min(F.when(old, F.col("first_ref"))).alias("old_first_ref"),
        F.min(F.when(old, F.col("first_seen"))).alias("old_first_seen"))
    both = added.select(
        *KEY, "ref", "load_month", F.col("refs").alias("n"), F.col("old_refs").alias("before"), *[
            x for pre in ("", "old_") for x in (
                F.col(f"{pre}first_ref").alias(f"{pre}ref_at"),
                F.sum(f"{pre}arrived").over(key).alias(f"{pre}a"), F.sum(f"{pre}removed").over(key).alias(f"{pre}d"),
                F.min(f"{pre}first_seen").over(key).alias(f"{pre}t"))])
    now, was = (_kind(*(F.col(f"{pre}{c}") for c in ("a", "d", "t", "ref_at"))) for pre in ("", "old_"))
    return (
        both.where("ref").select(
            *KEY, "load_month", now.alias("kind"), F.when(F.col("before") > 0, was).alias("was"),
            F.col("n").alias("refs"), "before", F.lit(batch).alias("batch"))
        .where(~F.col("kind").eqNullSafe(F.col("was")) | (F.col("kind") != OK) & (F.col("refs") != F.col("before")))
    )


@dataclass
class OrphanState:
    """The deltas so far and the log of waiting orphans (frames of EVENTS and LOG)."""

    spark: SparkSession
    events: DataFrame
    log: DataFrame

    @property
    def refs(self) -> DataFrame:
        """References per (table, key, month)."""
        return self.events.where("refs > 0").groupBy(*KEY, "load_month").agg(
            F.sum("refs").alias("refs"), F.min("first_ref").alias("first_ref"))

    def broken(self) -> DataFrame:
        """Waiting orphans: table, key, month, kind (``missing``, ``deleted``, ``late``) and number of references."""
        last = self.log.groupBy(*KEY, "load_month").agg(F.max(F.struct("batch", "kind", "refs")).alias("x"))
        return last.select(*KEY, "load_month", "x.kind", "x.refs").where(F.col("kind") != OK)

    def snapshot(self, as_of: str, batch: int | None = None) -> DataFrame:
        """Open orphans (no live parent) after ``batch``, per table and month of the reference."""
        log = self.log if batch is None else self.log.where(F.col("batch") <= batch)
        is_open = lambda c: F.coalesce(F.col(c).isin(MISSING, DELETED), F.lit(False)).cast("long")
        return (
            log.groupBy("table_name", "load_month")
            .agg(F.sum(is_open("kind") * F.col("refs") - is_open("was") * F.col("before")).alias("open_refs"),
                 F.sum(is_open("kind") - is_open("was")).alias("open_keys"))
            .where("open_keys > 0").withColumn("as_of", F.lit(as_of))
        )


def track(refs: list[Reference], with_snapshots: bool = False, cuts: list[str] | None = None):
    """Run the inputs through the state, one batch per period (years, or the given cuts) in order of time.

    The inputs are read once, into deltas kept by batch. Returns the last state and,
    if asked for, one snapshot frame per period."""
    spark = refs[0].child.sparkSession
    rows = None
    for r in refs:
        part = _rows(r, _batch_of(cuts))
        rows = part if rows is None else rows.unionByName(part)
    events = cut(deltas(rows))
    lo, hi = events.agg(F.min(F.when(F.col("batch") >= 0, F.col("batch"))), F.max("batch")).first()
    if cuts is not None:
        lo, hi, names = 0, len(cuts), [*cuts, "end"]
    else:
        lo, hi = (0, 0) if lo is None else (lo, hi)
        names = [*(f"{n}-01-01" for n in range(lo + 1, hi + 1)), "end"]
    # the first batch takes what has no time
    events = events.withColumn("batch", F.greatest("batch", F.lit(lo)))
    path = shared_dir(spark)
    for n in range(lo, hi + 1):
        so_far = events.where(F.col("batch") <= n)
        if n > lo:
            so_far = so_far.join(events.where(F.col("batch") == n).select(*KEY).distinct(), KEY, "left_semi")
        changes(so_far, n).write.mode("append").parquet(path)
    state = OrphanState(spark, events, spark.read.schema(LOG).parquet(path))
    snaps = [state.snapshot(name, n) for name, n in zip(names, range(lo, hi + 1))] if with_snapshots else []
    return state, snaps
