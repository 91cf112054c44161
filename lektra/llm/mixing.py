"""Mixing sources to target shares of all tokens, with capped repetition.

Tokens are counted per document by a public tokenizer and summed per source.
The mix is the largest in which every listed source that has documents holds its
share (shares are scaled to the sources that have any) and none is repeated
above its cap: ``total = min(cap * tokens / share)``. A source's repetition rate
is ``share * total / tokens``; a document comes ``floor(rate)`` times and once
more with the probability of the fraction, drawn from a hash of id and seed.

Defined cases: documents of no or an unlisted source are left out; listed
sources without documents stay in the report with nothing; null and empty texts
have no tokens but may be drawn; a null or non-positive share or cap takes
nothing from the source; a source listed twice counts once, with its largest
share and cap; repeated documents are drawn alike.
"""

from __future__ import annotations

import base64
import os

from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lektra.llm.batches import expand

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-splitting pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``docs`` without the text, with ``tokens``; texts are encoded whole. The vocabulary file is read where
    the driver has it and goes to the executors with the job."""
    docs.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def make():
        enc = encoder(SparkFiles.get(name))
        return lambda texts: ([1] * len(texts), [[len(enc.encode_ordinary(t)) if t else 0 for t in texts]])

    keep = {c: c for c in docs.columns if c not in (text, "tokens")}
    return expand(docs, keep, text, [T.StructField("tokens", T.LongType())], make)


def rates(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: share, cap, documents, tokens and repetition rate."""
    have = counted.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    listed = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = listed.join(have, "source", "left").fillna(0, ["documents", "tokens"])
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    room = F.when(usable, F.col("max_repeats") * F.col("tokens") / F.col("target_share"))
    # the report has one row per listed source
    return t.withColumn("total", F.min(room).over(Window.partitionBy(F.lit(1)))).withColumn(
        "rate", F.when(usable, F.least(
            F.col("target_share") * F.col("total") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    ).drop("total")


def draw(counted: DataFrame, rate: DataFrame, seed: int = 17) -> DataFrame:
    """The chosen records: one row per copy (doc_id, source, copy_no, tokens)."""
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    whole = F.floor("rate")
    copies = (whole + F.when(chance < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return (
        # one row per listed source
        counted.join(F.broadcast(rate.select("source", "rate")), "source")
        .withColumn("copies", copies).where(F.col("copies") > 0)
        .select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "tokens")
    )


def report(drawn: DataFrame, rate: DataFrame) -> DataFrame:
    """Target and actual share of every listed source."""
    got = drawn.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), F.sum("tokens").alias("mixed_tokens"), F.max("copy_no").alias("most_copies"))
    t = rate.join(got, "source", "left").fillna(0, ["records", "mixed_tokens", "most_copies"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    return t.withColumn("all_tokens", whole).withColumn(
        "actual_share", F.coalesce(F.try_divide("mixed_tokens", "all_tokens"), F.lit(0.0))).drop("all_tokens")
