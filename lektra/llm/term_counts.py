"""Frequency of every distinct term, by recursive radix partitioning.

1. A histogram of bytes over 16 hash bits of the term (65,536 counters at most) is
   taken in one pass, combined before the shuffle.
2. Starting with 4 bits, every partition above the budget is split by the next 4
   bits (neighbours that fit into one stay together), and so on. Cells still too large at 16 bits are counted again by 8 more
   bits, and at 24 by 8 more; only their rows are looked at, and there are at most
   as many of them as leaves. What is too large at 32 bits (one hot term) is split
   by the hash of the record instead, into as many shards as it needs: a row's
   duplicates and its record stay in one shard, so partial counts add up.
3. Rows go to their partition through the shuffle's files on disk; each
   partition is aggregated out-of-core by DuckDB, which reads a stream of Arrow
   batches under a memory limit and spills to the shared folder.
4. The partial counts of a term are added.

The budget is in bytes: enough partitions for all tasks, none of more than
``PARTITION`` bytes, and at most some ``LEAVES`` of them however large the input is
(DuckDB then spills more of each).

Null terms and rows whose record has a null part are left out by the caller's
definition (``p5_found`` counts rows with a book_id); exact duplicates count
once; the empty term is a term; an empty table gives no rows.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lektra.runtime import local_path, shared_dir, task_count

BITS, STEP = 16, 4
#: hash bits of every count: cells over the budget are counted again by the next
LEVELS = (16, 24, 32)
#: bytes of a partition: the most, and the fewest worth a task
PARTITION, LEAST = 256 << 20, 1 << 20
LEAVES = 4096
#: where DuckDB spills if the shared folder is no mounted file system
SPILL_DIR = "spark.lektra.spillDir"


def radix_leaves(histogram: dict[int, int], budget: int, bits: int = BITS) -> dict[int, tuple[int, int]]:
    """Histogram over codes of ``bits`` bits -> code: (first leaf number, record shards)."""
    out: dict[int, tuple[int, int]] = {}
    leaves = 0

    def split(codes: list[int], depth: int) -> None:
        nonlocal leaves
        load = sum(histogram[c] for c in codes)
        if load <= budget and depth > 0 or depth * STEP >= bits:
            shards = max(1, -(-load // budget))
            for c in codes:
                out[c] = (leaves, shards)
            leaves += shards
            return
        shift = bits - (depth + 1) * STEP
        parts: dict[int, list[int]] = {}
        for c in codes:
            parts.setdefault(c >> shift, []).append(c)
        # neighbours that fit together stay together
        together, held = [], 0
        for p in sorted(parts):
            size = sum(histogram[c] for c in parts[p])
            if together and held + size > budget:
                split(together, depth + 1)
                together, held = [], 0
            together, held = together + parts[p], held + size
        split(together, depth + 1)

    if histogram:
        split(sorted(histogram), 0)
    return out


def _aggregate(spill: str, memory: str, term: str, record: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches, None)
        if first is None:
            return

        def stream():
            yield first
            yield from batches

        con = duckdb.connect()
        con.execute(f"SET threads = 1; SET memory_limit = '{memory}'; SET preserve_insertion_order = false")
        folder = os.path.join(spill, uuid.uuid4().hex)
        os.makedirs(folder, exist_ok=True)
        con.execute(f"SET temp_directory = '{folder}'")
        con.register("rows_in", pa.RecordBatchReader.from_batches(first.schema, stream()))
        rec = ", ".join(f'"{c}"' for c in record)
        result = con.sql(
            f"""
            WITH d AS (SELECT DISTINCT * FROM rows_in),
                 r AS (SELECT "{term}" AS term, {rec}, count(*) AS n FROM d GROUP BY ALL)
            SELECT term, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS records FROM r GROUP BY term
            """
        )
        for b in result.to_arrow_reader(50_000):
            yield b.cast(pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())]))
        con.close()
        shutil.rmtree(folder, ignore_errors=True)

    return run


def _spill_dir(spark: SparkSession) -> str:
    """A folder that DuckDB can write to on every executor: below the shared one, or as set."""
    path = local_path(shared_dir(spark))
    if "://" in path:
        base = spark.conf.get(SPILL_DIR, None)
        if not base:
            raise ValueError(f"{path} is no mounted file system: set {SPILL_DIR} to a shared folder that is one")
        path = os.path.join(base, uuid.uuid4().hex)
    return path[len("file:"):] if path.startswith("file:") else path


def _bytes(df: DataFrame) -> Column:
    """Size of a row, about."""
    text = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.simpleString() == "string"]
    return sum(text, F.lit(8 * len(df.columns))).cast("long")


def plan_leaves(
    rows: DataFrame, term: str, budget: int | None = None
) -> tuple[list[tuple[int, dict[int, tuple[int, int]]]], int]:
    """Per level of bits its cells with (first leaf, record shards), and the number of leaves."""
    spark = rows.sparkSession
    sized = rows.select(F.xxhash64(term).alias("h"), _bytes(rows).alias("size"))
    out, leaves = [], 0
    for bits, deeper in zip(LEVELS, [*LEVELS[1:], None]):
        cell = F.shiftrightunsigned("h", 64 - bits)
        histogram = {r["c"]: r["n"] for r in sized.groupBy(cell.alias("c")).agg(F.sum("size").alias("n")).collect()}
        if budget is None:
            total = sum(histogram.values())
            budget = max(min(PARTITION, total // (2 * task_count(spark))), total // LEAVES, LEAST)
        cells = radix_leaves(histogram, budget, bits)
        over = [c for c, (_, n) in cells.items() if n > 1] if deeper else []
        kept = {c: x for c, x in cells.items() if c not in set(over)}
        number = {a: i for i, a in enumerate(sorted({a + k for a, n in kept.values() for k in range(n)}))}
        out.append((bits, {c: (leaves + number[a], n) for c, (a, n) in kept.items()}))
        leaves += len(number)
        if not over:
            break
        # at most as many as there are leaves
        sized = sized.join(
            F.broadcast(spark.createDataFrame([(c,) for c in over], "c long")), cell == F.col("c"), "left_semi")
    return out, max(leaves, 1)


def term_counts(
    df: DataFrame, term: str, record: list[str], budget: int | None = None, memory: str = "256MB"
) -> DataFrame:
    """``term``, ``occurrences`` (distinct rows) and ``records`` (distinct values of
    ``record``) of every non-null term.

    ``budget``: bytes of one partition, if not as above; ``memory``: DuckDB's limit in a task."""
    spark = df.sparkSession
    rows = df.where(F.col(term).isNotNull())
    plan, count = plan_leaves(rows, term, budget)
    routed, leaf, shards = rows.withColumn("__lk_h", F.xxhash64(term)), F.lit(None).cast("int"), F.lit(None).cast("int")
    for bits, cells in plan:
        # 65,536 routes at most on the first level, 256 a leaf on the others
        routes = spark.createDataFrame(
            [(c, a, n) for c, (a, n) in cells.items()], f"__lk_c{bits} long, __lk_a{bits} int, __lk_n{bits} int")
        routed = routed.join(
            F.broadcast(routes), F.shiftrightunsigned("__lk_h", 64 - bits) == F.col(f"__lk_c{bits}"), "left")
        leaf, shards = F.coalesce(leaf, F.col(f"__lk_a{bits}")), F.coalesce(shards, F.col(f"__lk_n{bits}"))
    routed = (
        routed.withColumn("__lk_part", leaf + F.pmod(F.xxhash64(*record), shards.cast("long")).cast("int"))
        .select(*rows.columns, "__lk_part").repartitionById(count, F.col("__lk_part"))
    )
    partial = routed.mapInArrow(
        _aggregate(_spill_dir(spark), memory, term, record), "term string, occurrences long, records long")
    return partial.groupBy("term").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marks(
    counts: DataFrame, total_records: int, reported: DataFrame,
    min_records: int = 3, max_share: float = 0.1,
) -> DataFrame:
    """``term``, ``mark``: rare, common, and misreported against ``reported(word, frequency)``."""
    rare = counts.where(F.col("records") < min_records).select("term", F.lit("rare").alias("mark"))
    common = counts.where(F.col("records") > F.lit(max_share * total_records)).select(
        "term", F.lit("common").alias("mark"))
    claims = reported.where(F.col("frequency").isNotNull() & F.col("word").isNotNull()).select(
        "word", "frequency").distinct()
    wrong = (
        claims.join(counts, claims["word"] == counts["term"], "left")
        .where(F.col("frequency") != F.coalesce("occurrences", F.lit(0)))
        .select(F.col("word").alias("term"), F.lit("misreported").alias("mark")).distinct()
    )
    return rare.unionByName(common).unionByName(wrong)
