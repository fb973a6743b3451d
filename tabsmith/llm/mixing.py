"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

The mix is counted in blocks of ``block`` words. Sources get their whole number of blocks by the
highest quotients weight/(2k+1); the blocks of a source are divided the same way among its districts of ``DISTRICT`` shards, and
those of a district among its shards, so no list that is ranked grows with the data. Shards are
groups of documents chosen by a seeded hash of id and text, of bounded expected words and rows. In a shard the documents
stand end to end in seeded order, are cut in blocks, and blocks are taken in a seeded order until the
shard's quota of words is full; a quota above the shard's size takes every block once before any twice.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, ordered last;
repeated rows are documents of their own; an empty table gives an empty result; other columns of the
input are ignored; rows equal in id and text go to one shard; a text of any length is counted whole, and cut in blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import materialize, same, table, text_key

#: Shards of a district.
DISTRICT = 1 << 10
#: White space as the contract has it.
BLANKS = "\t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than the ASCII blanks."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, rank`` → also ``weight, target``. A source's target is its weight's part of
    ``share`` times all sizes, but at most ``most`` times its size; what is above goes to the others by
    weight. One row per source, so the windows without partition are over a list of sources only."""
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    by_cap = Window.orderBy("reach", "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("reach", "rank")
    zero = F.lit(0.0)
    x = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    x = x.withColumn("reach", F.col("cap") / F.col("weight"))
    x = x.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), zero)
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)
    # the level at which the sources from this one on would share what the ones before it leave
    x = x.withColumn("level", left / open_weight).withColumn("capped", F.col("reach") <= F.col("level"))
    level = F.min(F.when(~F.col("capped"), F.struct("reach", "rank", "level"))).over(whole)["level"]
    return x.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level)).drop("cap", "reach", "total", "level", "capped")


def sainte_lague(rows: DataFrame, group: list[str], order: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Adds to each row its number of seats: in each group, ``seats`` (the same for the whole group) go to
    the highest quotients weight/(2k+1), ties in ``order``.

    Sums of rounded shares differ from the exact sum by half a seat a row at most. So the seats that
    a divisor a little too large gives are certain, those beyond a divisor a little too small are not to
    be had, and only the few quotients between are made and ranked: about two a row, however many seats.
    """
    by = Window.partitionBy(*group) if group else Window.partitionBy()
    n, total = F.count(F.lit(1)).over(by), F.sum(weight).over(by)
    x = rows.withColumn("_n", n).withColumn("_w", total)
    sure = F.floor(F.col(weight) / F.col("_w") * F.greatest(F.col(seats) - F.col("_n") / 2 - 1, F.lit(0)) + 0.5)
    most = F.floor(F.col(weight) / F.col("_w") * (F.col(seats) + F.col("_n") / 2 + 1) + 1.5)
    x = x.withColumn("_low", F.when(F.col("_w") > 0, F.greatest(sure - 1, F.lit(0))).otherwise(0).cast("long"))
    x = x.withColumn("_high", F.when((F.col("_w") > 0) & (F.col(weight) > 0), most).otherwise(-1).cast("long"))
    x = x.withColumn("_free", F.col(seats) - F.sum("_low").over(by))
    tried = F.when(F.col("_high") >= F.col("_low"), F.sequence("_low", "_high")).otherwise(F.array().cast("array<long>"))
    each = x.withColumn("_k", F.explode_outer(tried)).withColumn("_q", F.col(weight) / (2 * F.col("_k") + 1))
    best = F.row_number().over((Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(F.col("_q").desc_nulls_last(), *order))
    won = F.sum(F.when(F.col("_q").isNotNull() & (F.col("_rank") <= F.col("_free")), 1).otherwise(0))
    kept = [F.col(c) for c in rows.columns]
    return each.withColumn("_rank", best).groupBy(*kept, "_low").agg(won.alias("_won")).withColumn(out, F.col("_low") + F.col("_won")).select(*rows.columns, out)


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 64,
    shard_words: int = 1 << 20,
    shard_rows: int = 1 << 18,
    seed: int = 7,
) -> DataFrame:
    """``doc_id, source, text`` → a row per document: ``doc_id, source, size, source_size, target, taken,
    blocks`` (the source's blocks)."""
    sized = materialize(docs.select("doc_id", "source", text_key(F.col("text")).alias("ver"), word_count(F.col("text")).alias("size")), "mix-sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = targets(per, weights, share, most)
    per = per.withColumn("all_blocks", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    per = sainte_lague(per, [], ["rank"], "target", "all_blocks", "blocks")
    per = per.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("source_rows") / shard_rows)))
    per = materialize(per.select("source", "source_size", "target", "blocks", "shards"), "mix-sources")

    dealt = sized.alias("d").join(per.select("source", "blocks", "shards").alias("s"), same(F.col("d.source"), F.col("s.source")))
    hashed = F.xxhash64(F.lit(seed), F.col("d.doc_id"), F.col("ver"))
    turn = F.xxhash64(F.lit(seed + 1), F.col("d.doc_id"), F.col("ver"))
    dealt = dealt.select("d.doc_id", "d.source", "size", "blocks", F.pmod(hashed, F.col("shards")).alias("shard"), turn.alias("turn"))
    shards = dealt.groupBy("source", "shard", "blocks").agg(F.sum("size").alias("words"))
    shards = materialize(shards.withColumn("district", F.floor(F.col("shard") / DISTRICT)), "mix-shards")
    districts = shards.groupBy("source", "district", "blocks").agg(F.sum("words").alias("words"))
    districts = sainte_lague(districts, ["source"], ["district"], "words", "blocks", "part").select("source", "district", "part")
    s, t = shards.alias("s"), districts.alias("t")
    shards = s.join(t, same(F.col("s.source"), F.col("t.source")) & (F.col("s.district") == F.col("t.district"))).select("s.*", "part")
    quotas = sainte_lague(shards, ["source", "district"], ["shard"], "words", "part", "quota").select("source", "shard", "words", "quota")

    laid = Window.partitionBy("source", "shard").orderBy("turn", "doc_id", "size")
    placed = dealt.withColumn("start", F.sum("size").over(laid.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    q = quotas.alias("q")
    placed = placed.alias("p").join(q, same(F.col("p.source"), F.col("q.source")) & (F.col("p.shard") == F.col("q.shard")))
    quota = F.least(F.col("q.quota") * block, F.lit(int(most)) * F.col("q.words"))
    rounds, rest = F.floor(quota / F.col("q.words")), quota - F.floor(quota / F.col("q.words")) * F.col("q.words")
    placed = placed.select("doc_id", F.col("p.source").alias("source"), F.col("p.shard").alias("shard"), "size", "start", F.col("q.words").alias("words"), F.when(F.col("q.words") > 0, rounds).otherwise(0).alias("rounds"), F.when(F.col("q.words") > 0, rest).otherwise(0).alias("rest"))

    # a piece: what a block holds of a document; a document of size 0 has none
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), last)).otherwise(F.array(F.lit(None).cast("long")))
    piece = placed.withColumn("b", F.explode(cut))
    at = F.col("b") * block
    piece = piece.withColumn("part", F.when(F.col("b").isNull(), 0).otherwise(F.least(at + block, F.col("start") + F.col("size")) - F.greatest(at, F.col("start"))))
    turn = F.when(F.col("b").isNotNull(), F.xxhash64(F.lit(seed + 2), F.col("b"), F.col("shard")))
    drawn = Window.partitionBy("source", "shard").orderBy(F.col("pick").asc_nulls_last(), "b", "start", "doc_id")
    piece = piece.withColumn("pick", turn)
    piece = piece.withColumn("before", F.sum("part").over(drawn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("part"))
    more = F.least(F.col("part"), F.greatest(F.col("rest") - F.col("before"), F.lit(0)))
    piece = piece.withColumn("got", F.col("rounds") * F.col("part") + more)
    taken = piece.groupBy("source", "shard", "doc_id", "size", "start").agg(F.sum("got").alias("taken"), F.count(F.lit(1)).alias("_copies"), F.max("b").isNull().alias("_none"))
    # documents of size 0 that share all of these stand in one group: give each its row again
    taken = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_none"), F.col("_copies")).otherwise(1))))
    t, s = taken.alias("t"), per.alias("s")
    joined = t.join(s, same(F.col("t.source"), F.col("s.source")))
    return joined.select("doc_id", F.col("t.source").alias("source"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "blocks")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "blocks")
