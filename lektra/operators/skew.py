"""Per-key work over keys of very unequal size.

A routing plan is made from the load of every key, estimated from a sample whose
size goes with the number of tasks (a smaller table is counted whole):

* light keys fall into hash buckets, whose loads are summed;
* keys above ``total / (2 * tasks)`` are *heavy* (so there are at most
  ``2 * tasks`` of them) and are cut into shards of at most half a task's share;
* buckets and shards are bin-packed (longest first) onto the tasks.

Rows then go straight to the task of their bucket or shard. The other side of a
join goes once to the task of a light key and, for a heavy key, only to the
tasks that hold its shards. What comes to the driver is one row per bucket plus
the heavy keys: bounded by ``tasks``, not by the data.

Null keys are ordinary rows of one (possibly heavy) key; empty tables give an
empty plan; repeated rows keep their number. Columns of the input may have any
name but those beginning with ``__lk_``.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lektra.runtime import task_count

BUCKETS_PER_TASK = 16
#: sampled rows a task that loads are estimated from; any estimate gives the same results
SAMPLE_PER_TASK = 20_000
_NULL = "\x00null"


def _text_key(key: str) -> Column:
    """Keys as text; null gets a text of its own."""
    return F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(_NULL))


@dataclass(frozen=True)
class LoadPlan:
    tasks: int
    buckets: int
    total: int
    #: key text -> task of each shard; at most 2 * tasks entries
    heavy: dict[str, list[int]]
    #: task of each light bucket
    bucket_task: list[int]
    #: planned rows per task
    load: list[int]

    def _heavy_frame(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([
            T.StructField("__lk_key", T.StringType()),
            T.StructField("__lk_shards", T.ArrayType(T.IntegerType())),
        ])
        return spark.createDataFrame(sorted(self.heavy.items()), schema)

    def _bucket_frame(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([
            T.StructField("__lk_bucket", T.IntegerType()),
            T.StructField("__lk_home", T.IntegerType()),
        ])
        return spark.createDataFrame(list(enumerate(self.bucket_task)), schema)

    def _routed(self, df: DataFrame, key: str) -> DataFrame:
        spark = df.sparkSession
        text = _text_key(key)
        return (
            df.withColumn("__lk_key", text)
            .withColumn("__lk_bucket", F.pmod(F.xxhash64(text), F.lit(self.buckets)).cast("int"))
            # both sides below are bounded by the plan (2 * tasks, 16 * tasks rows)
            .join(F.broadcast(self._heavy_frame(spark)), "__lk_key", "left")
            .join(F.broadcast(self._bucket_frame(spark)), "__lk_bucket", "left")
        )

    def fragment(self, df: DataFrame, key: str, spread: list[str] | None = None) -> DataFrame:
        """Send each row to its task. The hash of ``spread`` (default: all columns) picks the
        shard of a heavy key, so a task that runs again routes its rows as before."""
        by = [F.col(f"`{c}`") for c in spread or df.columns]
        routed = self._routed(df.withColumn("__lk_spread", F.xxhash64(*by)), key)
        shard = F.pmod(F.col("__lk_spread"), F.greatest(F.size("__lk_shards"), F.lit(1)).cast("long")).cast("int")
        task = F.coalesce(F.get(F.col("__lk_shards"), shard), F.col("__lk_home"), F.lit(0))
        return (
            routed.withColumn("__lk_task", task)
            .drop("__lk_spread", "__lk_shards", "__lk_home", "__lk_bucket", "__lk_key")
            .repartitionById(self.tasks, F.col("__lk_task"))
        )

    def replicate(self, df: DataFrame, key: str) -> DataFrame:
        """Send each row to every task that may hold rows of its key."""
        routed = self._routed(df, key)
        targets = F.coalesce(
            F.array_distinct("__lk_shards"), F.array(F.coalesce(F.col("__lk_home"), F.lit(0)))
        )
        return (
            routed.withColumn("__lk_task", F.explode(targets))
            .drop("__lk_shards", "__lk_home", "__lk_bucket", "__lk_key")
            .repartitionById(self.tasks, F.col("__lk_task"))
        )


def pack(items: list[tuple[int, object]], bins: int) -> tuple[list[tuple[object, int]], list[int]]:
    """Longest-first packing: (item, bin) pairs and the load of each bin."""
    heap = [(0, b) for b in range(bins)]
    placed, load = [], [0] * bins
    for size, item in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        now, b = heapq.heappop(heap)
        placed.append((item, b))
        load[b] = now + size
        heapq.heappush(heap, (now + size, b))
    return placed, load


def plan_load(df: DataFrame, key: str, tasks: int | None = None, sample_per_task: int = SAMPLE_PER_TASK) -> LoadPlan:
    """Estimate the load of every key from a sample of the rows (combined before the shuffle) and pack the loads.
    A key that the sample misses counts with its bucket; the total is exact."""
    spark = df.sparkSession
    tasks = tasks or task_count(spark)
    buckets = BUCKETS_PER_TASK * tasks
    total = df.count()
    threshold = max(total // (2 * tasks), 1)
    share = min(sample_per_task * tasks / max(total, 1), 1.0)
    part = df.select(key) if share == 1.0 else df.select(key).sample(share, seed=17)
    per_key = part.groupBy(_text_key(key).alias("k")).agg((F.count(F.lit(1)) / share).cast("long").alias("n"))
    is_heavy = F.col("n") > threshold
    rows = (
        per_key.groupBy(F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int").alias("b"))
        .agg(
            F.sum(F.when(is_heavy, F.lit(0)).otherwise(F.col("n"))).alias("light"),
            F.collect_list(F.when(is_heavy, F.struct("k", "n"))).alias("heavy"),
        )
        .collect()
    )
    light = [0] * buckets
    heavy: dict[str, int] = {}
    for r in rows:
        light[r["b"]] = int(r["light"])
        heavy |= {h["k"]: int(h["n"]) for h in r["heavy"]}
    items: list[tuple[int, object]] = [(n, b) for b, n in enumerate(light)]
    for k, n in heavy.items():
        shards = min(-(-n // threshold), tasks)
        items += [(-(-n // shards), (k, i)) for i in range(shards)]
    placed, load = pack(items, tasks)
    bucket_task = [0] * buckets
    shard_task: dict[str, list[int]] = {k: [] for k in heavy}
    for item, b in placed:
        if isinstance(item, tuple):
            shard_task[item[0]].append(b)
        else:
            bucket_task[item] = b
    return LoadPlan(tasks, buckets, total, shard_task, bucket_task, load)


def balanced_agg(
    df: DataFrame, key: str, distinct: dict[str, str] | None = None, plan: LoadPlan | None = None,
    spread: list[str] | None = None,
) -> DataFrame:
    """Row count per key and the number of distinct non-null values of some columns.

    ``distinct`` maps result column to input column. Every task first reduces
    its fragment to (key, value) pairs; only those partial results are merged.
    Columns: the key, ``row_count``, and one per entry of ``distinct``.
    """
    plan = plan or plan_load(df, key)
    distinct = distinct or {}
    cols = [c for c in dict.fromkeys(distinct.values()) if c != key]
    # all that is read is the key, the counted columns and those that spread a heavy key
    rows = plan.fragment(df.select(*dict.fromkeys([key, *cols, *(spread or df.columns)])), key, spread)
    partial = rows.groupBy(key, *cols).agg(F.count(F.lit(1)).alias("__lk_n"))
    return partial.groupBy(key).agg(
        F.sum("__lk_n").alias("row_count"),
        *[F.count_distinct(F.col(f"`{c}`")).alias(out) for out, c in distinct.items()],
    )


def balanced_join(
    left: DataFrame, right: DataFrame, key: str, plan: LoadPlan | None = None, spread: list[str] | None = None
) -> DataFrame:
    """Inner equi join, fragment-replicate: ``left`` is cut, ``right`` follows the shards.

    Null keys join nothing. Columns of ``right`` that clash with ``left`` keep
    their name with the suffix ``_right``.
    """
    left = left.where(F.col(f"`{key}`").isNotNull())
    right = right.where(F.col(f"`{key}`").isNotNull())
    clash = {c: f"{c}_right" for c in right.columns if c in left.columns and c != key}
    right = right.withColumnsRenamed(clash)
    plan = plan or plan_load(left, key)
    return (
        plan.fragment(left, key, spread)
        .join(plan.replicate(right, key), ["__lk_task", key])
        .drop("__lk_task")
    )


def heavy_keys(df: DataFrame, key: str, share: float = 0.02, spread: list[str] | None = None) -> DataFrame:
    """Non-empty keys that hold at least ``share`` of all rows, from balanced counts."""
    plan = plan_load(df, key)
    counts = balanced_agg(df, key, plan=plan, spread=spread)
    return counts.where((F.col("row_count") >= F.lit(share * plan.total)) & (F.col(key) != ""))
