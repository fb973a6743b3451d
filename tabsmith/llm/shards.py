"""Rendezvous hashing of record keys over weighted shards.

Each (key, shard) pair has a score, -weight/ln(u) with u drawn by a hash from (0, 1); a record goes to
the shard with the highest. A new shard only adds a score, so records move into it and nowhere else.

Defined cases: a null key is a key like any other; rows with equal keys go to one shard and get slots of
their own; a null text has no bytes (size 1, checksum of the empty text); an empty table gives an empty
result; a text of any length only gives its length and checksum; other columns of the input are ignored. Slots go by a hash of
key, checksum and size, so that equal keys with other texts are numbered in parts; of rows equal in all three none is before another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import table


def rendezvous(key: Column, weights: Sequence[float], seed: int = 11) -> Column:
    """Shard number for a key, over shards 0, 1, ... with the given weights."""
    def score(j: int, w: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(j), key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((F.lit(-float(w)) / F.log(u)).alias("s"), F.lit(j).alias("j"))

    return F.array_max(F.array(*[score(j, w) for j, w in enumerate(weights)]))["j"]


def numbered(df: DataFrame, shard: str, order: list[str], *, parts: int = 1024, seed: int = 12) -> DataFrame:
    """Adds ``slot``: 0, 1, ... within each shard without a gap. A shard is cut by a hash of ``order`` into
    ``parts``; rows are numbered in each part and moved by the rows of the parts before, of which there
    are shards x parts counts at most."""
    x = df.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(parts)))
    counts = x.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    own = Window.partitionBy(shard, "_part").orderBy(*order)
    ranked = x.withColumn("_rank", F.row_number().over(own) - 1)
    return ranked.join(counts, [shard, "_part"]).withColumn("slot", F.col("_ahead") + F.col("_rank")).drop("_part", "_rank", "_ahead")


def assign_shards(docs: DataFrame, *, shards: int = 16, weights: Sequence[float] | None = None) -> DataFrame:
    """``doc_id, text`` → ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; equal weights unless given."""
    w = list(weights or [1.0] * shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), w).alias("shard"),
        rendezvous(F.col("doc_id"), [*w, 1.0]).alias("grown_shard"),
    )
    out = numbered(slim, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
