"""Connected components of an edge table, by alternating large and small stars.

Each round links every vertex's larger neighbours, then its smaller ones, to its least neighbour; a path
of n vertices shrinks to a star in about log n rounds. Rounds end when only stars are left. Each step groups by vertex
with partial minima and joins on it; the edges of a vertex that has a great part of them all are joined by broadcast
(see ``join_counted``), so no group is collected or dealt to one task. A written table after each round cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import discard, join_counted, materialize


def _stars_only(edges: DataFrame) -> bool:
    """Whether each ``u`` has one edge, to a ``v`` that has none."""
    per = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    return per.where("n > 1").isEmpty() and per.join(per.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each vertex sends its larger neighbours to its least; small: its smaller ones and itself."""
    both = edges.select("u", "v") if not large else edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).withColumn("m", F.least("u", "m"))
    near = join_counted(both, least, "u", edges.count() * (1 + large))
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """``u, v`` (orderable, not null) → a written table ``u, root`` for every vertex with an edge to another; the root is
    the least vertex of its component, and has no row of its own."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    for _ in range(rounds):
        if _stars_only(now):
            break
        wide = materialize(_star(now, True), "components-large")
        discard(now)
        now = materialize(_star(wide, False), "components")
        discard(wide)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = now.select("u", F.col("v").alias("root"))
    out.stored_at = now.stored_at
    return out
