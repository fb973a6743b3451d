"""A global position for rows without moving them to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.storage import stored


#: Bits of a row's place in the numbers that ``monotonically_increasing_id`` gives.
PLACE_BITS = 33


def sort_keys(order: Sequence[str | Column]) -> list[Column]:
    """Names sort ascending with nulls last."""
    return [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]


class Ordered:
    """Rows in ``order``, which must end in a unique key, over range partitions: running values without a task that sees all rows.

    The rows are range-partitioned on the order, sorted and written with their place in the partition, as the bounds come from a sample and may differ
    when computed anew. A running value is made within each partition, and what the partitions before it come to is added: one
    row a partition, which is broadcast. A position takes no more than that: nothing is shuffled or sorted again.
    """

    def __init__(self, df: DataFrame, order: Sequence[str | Column], *, parts: int | None = None) -> None:
        self.keys = sort_keys(order)
        n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # the number has the partition above bit 33, the row's place in it below
        dealt = df.repartitionByRange(n, *self.keys).sortWithinPartitions(*self.keys).withColumn("_place", F.monotonically_increasing_id())
        self.df = stored(dealt, "ordered").withColumn("_part", F.shiftright("_place", PLACE_BITS).cast("int"))

    def _with_carry(self, of_part: Column, over_parts: Column) -> DataFrame:
        """The rows with ``_carry``: ``over_parts`` of the values ``_of`` that the partitions before have."""
        per = self.df.groupBy("_part").agg(of_part.alias("_of")).select("_part", over_parts.over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
        return self.df.join(F.broadcast(per), "_part")

    def index(self, name: str, start: int = 0) -> Ordered:
        """Adds ``start``, ``start`` + 1, ..."""
        own = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
        x = self._with_carry(F.count(F.lit(1)), F.sum("_of"))
        self.df = x.withColumn(name, F.coalesce("_carry", F.lit(0)) + own + F.lit(start)).drop("_carry")
        return self

    def running(self, name: str, value: Column, how: str = "sum") -> Ordered:
        """Adds the ``sum``, ``min``, ``max`` or ``last`` (known one) of ``value`` over the rows up to each; null while there is none."""
        own = Window.partitionBy("_part").orderBy(*self.keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if how == "last":
            place = F.struct(*[F.row_number().over(Window.partitionBy("_part").orderBy(*self.keys)).alias("n")])
            self.df = self.df.withColumn("_value", value).withColumn("_at", place)
            x = self._with_carry(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))), F.last("_of", ignorenulls=True))
            out = F.coalesce(F.last("_value", ignorenulls=True).over(own), F.col("_carry"))
            self.df = x.withColumn(name, out).drop("_carry", "_value", "_at")
            return self
        fold, both = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "min": (F.min, F.least), "max": (F.max, F.greatest)}[how]
        self.df = self.df.withColumn("_value", value)
        x = self._with_carry(fold("_value"), fold("_of"))
        self.df = x.withColumn(name, both(fold("_value").over(own), F.col("_carry"))).drop("_carry", "_value")
        return self

    def previous(self, name: str, value: Column) -> Ordered:
        """Adds the ``value`` of the row before, in whatever partition it is; null for the first."""
        by = Window.partitionBy("_part").orderBy(*self.keys)
        self.df = self.df.withColumn("_value", F.struct(value.alias("v"))).withColumn("_at", F.row_number().over(by))
        x = self._with_carry(F.max_by("_value", "_at"), F.last("_of"))
        self.df = x.withColumn(name, F.coalesce(F.lag("_value").over(by), F.col("_carry"))["v"]).drop("_carry", "_value", "_at")
        return self

    def rows(self) -> DataFrame:
        return self.df.drop("_part", "_place")


def global_index(df: DataFrame, order: Sequence[str | Column], name: str = "row_ordinal", *, start: int = 0, parts: int | None = None) -> DataFrame:
    """Adds ``start``, ``start`` + 1, ... in ``order``, which must end in a unique key."""
    return Ordered(df, order, parts=parts).index(name, start).rows()


def index_within(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str, *, parts: int | None = None) -> DataFrame:
    """Adds 0, 1, ... in ``order`` within each group of equal ``group`` columns, however large a group is.

    Rows are range-partitioned by group and order and written; a partition numbers its own, and adds the rows that its first
    group has in the partitions before: no other group of it reaches back, so there is one such count a partition.
    """
    keys = [*sort_keys(group), *sort_keys(order)]
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "ordered")
    counts = dealt.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    back = counts.withColumn("_ahead", ahead).where("_ahead > 0").select("_part", "_ahead", F.struct(*group).alias("_group"))
    own = Window.partitionBy("_part", *group).orderBy(*sort_keys(order))
    ranked = dealt.withColumn("_rank", F.row_number().over(own) - 1).withColumn("_own", F.struct(*group))
    r, b = ranked.alias("r"), F.broadcast(back).alias("b")
    out = r.join(b, (F.col("r._part") == F.col("b._part")) & F.col("r._own").eqNullSafe(F.col("b._group")), "left")
    return out.select("r.*", (F.col("_rank") + F.coalesce("_ahead", F.lit(0))).alias(name)).drop("_part", "_rank", "_own")
