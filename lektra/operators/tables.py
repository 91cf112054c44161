"""Set operations with conflict rules, interval and ordered operators, as DataFrame algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- conflict rules

def first_writer(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union in which the first part that has a key keeps it; within a part, by ``order``."""
    tagged = [p.withColumn("__lk_part", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    w = Window.partitionBy(*keys).orderBy("__lk_part", *order)
    return rows.withColumn("__lk_n", F.row_number().over(w)).where(F.col("__lk_n") == 1).drop("__lk_n", "__lk_part")


def last_writer(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Replace on conflict: the last part, and in it the last row by ``order``."""
    tagged = [p.withColumn("__lk_part", F.lit(-i)) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    w = Window.partitionBy(*keys).orderBy("__lk_part", *[F.desc(c) for c in order])
    return rows.withColumn("__lk_n", F.row_number().over(w)).where(F.col("__lk_n") == 1).drop("__lk_n", "__lk_part")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that would really be inserted: absent keys, the first of each."""
    return first_writer([new.join(existing.select(*keys).distinct(), keys, "left_anti")], keys, order)


def fallback(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """``primary``, and ``secondary`` for keys it lacks."""
    rest = secondary.join(primary.select(*keys).distinct(), keys, "left_anti")
    return primary.unionByName(rest, allowMissingColumns=True)


def raise_confidence(existing: DataFrame, new: DataFrame, key: str, least: float = 0.9, to: float = 0.95) -> DataFrame:
    """Update rows of low confidence, insert keys that are absent, keep the rest."""
    n = new.groupBy(key).agg(F.max(F.struct(*[c for c in new.columns if c != key])).alias("n"))
    low = F.coalesce("confidence", F.lit(0.0)) < least
    take = F.col("n").isNotNull() & low
    updated = existing.join(n, key, "left").select(
        key,
        *[F.when(take, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c)
          if c in new.columns and c not in (key, "confidence") else
          F.when(take, F.lit(to)).otherwise(F.col(c)).alias(c) if c == "confidence" else F.col(c)
          for c in existing.columns if c != key])
    added = n.join(existing.select(key).distinct(), key, "left_anti").select(
        key, *[F.col(f"n.{c}").alias(c) for c in new.columns if c not in (key, "confidence")], F.lit(to).alias("confidence"))
    return updated.unionByName(added, allowMissingColumns=True)


def toggle(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are there go, rows that are not come."""
    return existing.join(wanted.select(*keys), keys, "left_anti").unionByName(
        wanted.join(existing.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def delete_where_no_child(parents: DataFrame, key: str, children: DataFrame, ref: str) -> DataFrame:
    return parents.join(children.select(F.col(ref).alias(key)).distinct(), key, "left_semi")


# --- intervals

def overlaps(start: Column, end: Column, lo, hi) -> Column:
    """Closed intervals that meet [lo, hi]; a null end is open."""
    return (start <= hi) & (end.isNull() | (end >= lo))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], point: str, lo: str, hi: str, width: int) -> DataFrame:
    """left.point between right.lo and right.hi, by equality on ``keys`` and buckets of ``width``.

    Both sides shuffle on (keys, bucket), so a hot key spreads over its buckets.
    Points or bounds that are null match nothing; an interval with hi < lo is empty."""
    b = "__lk_bucket"
    lo_b, hi_b = F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)
    r = right.where(F.col(lo) <= F.col(hi)).withColumn(b, F.explode(F.sequence(lo_b, hi_b)))
    l = left.withColumn(b, F.floor(F.col(point) / width))
    return l.join(r, [*keys, b]).where(F.col(point).between(F.col(lo), F.col(hi))).drop(b)


def nearest(
    points: DataFrame, intervals: DataFrame, keys: list[str], point: str, lo: str, hi: str,
    within: int, order: list[str],
) -> DataFrame:
    """For each point the interval whose nearer end is less than ``within`` away.

    Only buckets b-1, b and b+1 of width ``within`` can hold it, so the join has an
    equality on (keys, bucket). Ties go by ``order``. One row per point."""
    b, pid = "__lk_bucket", "__lk_pid"
    ends = intervals.withColumn("__lk_end", F.explode(F.array(F.col(lo), F.col(hi)))).withColumn(
        b, F.floor(F.col("__lk_end") / within))
    p = points.withColumn(pid, F.struct(*[F.col(c) for c in [*keys, point]])).withColumn(
        b, F.explode(F.array(*[F.floor(F.col(point) / within) + d for d in (-1, 0, 1)])))
    dist = F.abs(F.col(point) - F.col("__lk_end"))
    near = p.join(ends, [*keys, b]).withColumn("distance", dist).where(F.col("distance") < within)
    w = Window.partitionBy(pid).orderBy("distance", *order)
    return near.withColumn("__lk_n", F.row_number().over(w)).where(F.col("__lk_n") == 1).drop(
        "__lk_n", "__lk_end", b, pid)


# --- order

def numbered(df: DataFrame, by: list[str], order: list[str], out: str = "n") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def _block(order: list[str], size: int) -> Column:
    return F.floor(F.col(order[0]) / F.lit(size))


def carried(df: DataFrame, by: list[str], order: list[str], col: str, out: str, block: int | None = None) -> DataFrame:
    """The last non-null value up to here.

    With ``block`` (rows are scanned in blocks of that many units of the first, numeric
    order column) a group of any size is shared out: each block is scanned by itself, and
    only one row a block carries its last value on."""
    if block is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.last(col, ignorenulls=True).over(w))
    df = df.withColumn("__lk_b", _block(order, block))
    w = Window.partitionBy(*by, "__lk_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = df.where(F.col(col).isNotNull()).groupBy(*by, "__lk_b").agg(F.max_by(col, F.struct(*order)).alias("__lk_end"))
    before = Window.partitionBy(*by).orderBy("__lk_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.select(*by, "__lk_b").distinct().join(ends, [*by, "__lk_b"], "left").withColumn(
        "__lk_before", F.last("__lk_end", ignorenulls=True).over(before)).drop("__lk_end")
    return df.withColumn(out, F.last(col, ignorenulls=True).over(w)).join(blocks, [*by, "__lk_b"]).withColumn(
        out, F.coalesce(out, "__lk_before")).drop("__lk_b", "__lk_before")


def islands(
    df: DataFrame, by: list[str], order: list[str], starts: Column, out: str = "island", block: int | None = None
) -> DataFrame:
    """Number of the run a row belongs to; a run begins where ``starts`` holds (0: before the
    first). ``block``: as in ``carried``; a block passes on the number of its starts."""
    df = df.withColumn("__lk_s", F.when(starts, 1).otherwise(0))
    if block is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum("__lk_s").over(w)).drop("__lk_s")
    df = df.withColumn("__lk_b", _block(order, block))
    w = Window.partitionBy(*by, "__lk_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("__lk_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*by, "__lk_b").agg(F.sum("__lk_s").alias("__lk_n")).withColumn(
        "__lk_before", F.coalesce(F.sum("__lk_n").over(before), F.lit(0))).drop("__lk_n")
    return df.withColumn(out, F.sum("__lk_s").over(w)).join(blocks, [*by, "__lk_b"]).withColumn(
        out, F.col(out) + F.col("__lk_before")).drop("__lk_b", "__lk_before", "__lk_s")


def changed(
    df: DataFrame, by: list[str], order: list[str], col: str, out: str = "is_header", block: int | None = None
) -> DataFrame:
    """True on the first row of each run of equal values. ``block``: as in ``carried``; a
    block passes on its last value, null or not."""
    if block is None:
        w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(*order)
        return df.withColumn(out, ~F.col(col).eqNullSafe(F.lag(col).over(w)) | (F.row_number().over(w) == 1))
    df = df.withColumn("__lk_b", _block(order, block))
    w = Window.partitionBy(*by, "__lk_b").orderBy(*order)
    last = F.struct(F.col(col).alias("v"))
    blocks = df.groupBy(*by, "__lk_b").agg(F.max_by(last, F.struct(*order)).alias("__lk_end")).withColumn(
        "__lk_before", F.lag("__lk_end").over(Window.partitionBy(*by).orderBy("__lk_b"))).drop("__lk_end")
    rows = df.withColumn("__lk_prev", F.lag(last).over(w)).join(blocks, [*by, "__lk_b"])
    prev = F.coalesce("__lk_prev", "__lk_before")
    return rows.withColumn(out, prev.isNull() | ~F.col(col).eqNullSafe(prev["v"])).drop(
        "__lk_b", "__lk_prev", "__lk_before")


def top_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def page_ranges(df: DataFrame, total: str, size: int = 100) -> DataFrame:
    """Closed ranges 1..size, size+1..2*size, ... clipped at the total."""
    starts = F.when(F.col(total) >= 1, F.sequence(F.lit(1), F.col(total), F.lit(size)))
    return df.withColumn("range_start", F.explode(starts)).withColumn(
        "range_end", F.least(F.col("range_start") + size - 1, F.col(total)))


def page_of(line: Column, size: int = 100) -> tuple[Column, Column]:
    """First and last line of the page a line is on."""
    first = (F.floor((line - 1) / size) * size + 1).cast("int")
    return first, first + size - 1
