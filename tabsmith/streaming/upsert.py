"""A table of the newest row of each key, kept by micro-batches that may come twice.

Keys are dealt to buckets by hash. A batch writes anew only the buckets that hold its keys, as versions of its own number, from the last version before it; a
file made after that commits the batch. Readers take of each bucket the last committed version. A batch that is replayed is skipped if it was
committed, and else writes the same versions again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.storage import claim, file_names


def committed(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n) for n in file_names(spark, f"{root}/commits") if n.isdigit())


def _versions(spark: SparkSession, root: str, schema: T.StructType | None, below: int) -> DataFrame | None:
    """The rows of each bucket's last committed version before the batch ``below``."""
    done = [n for n in committed(spark, root) if n < below]
    if not done:
        return None
    try:
        df = spark.read.schema(T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType()), T.StructField("_batch", T.LongType())])).parquet(f"{root}/data") if schema else spark.read.parquet(f"{root}/data")
    except AnalysisException:
        return None
    df = df.where(F.col("_batch") <= done[-1])
    last = df.groupBy("_bucket").agg(F.max("_batch").alias("_batch"))  # of a row for each bucket
    return df.join(F.broadcast(last), ["_bucket", "_batch"])


def upsert_batch(batch: DataFrame, batch_id: int, root: str, keys: Sequence[str], newest: Sequence[str], *, buckets: int = 64) -> None:
    """Merges a batch into the table at ``root``: of rows with equal ``keys`` the one that is last by ``newest`` stays, of the batch and the table."""
    spark = batch.sparkSession
    if batch_id in committed(spark, root):
        return
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = batch.withColumn("_bucket", bucket)
    old = _versions(spark, root, batch.schema, batch_id)
    if old is not None:
        touched = F.broadcast(new.select("_bucket").distinct())  # at most ``buckets`` rows
        new = new.unionByName(old.join(touched, "_bucket", "left_semi").drop("_batch"))
    turn = Window.partitionBy("_bucket", *keys).orderBy(*[F.col(c).desc_nulls_last() for c in newest])
    out = new.withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn").withColumn("_batch", F.lit(batch_id).cast("long"))
    out.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_batch").parquet(f"{root}/data")
    claim(spark, f"{root}/commits/{batch_id}")


def upserter(root: str, keys: Sequence[str], newest: Sequence[str], *, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``."""
    return lambda batch, batch_id: upsert_batch(batch, batch_id, root, keys, newest, buckets=buckets)


def upserted(spark: SparkSession, root: str) -> DataFrame | None:
    """The table's rows, or None before the first batch."""
    found = _versions(spark, root, None, 1 << 62)
    return None if found is None else found.drop("_bucket", "_batch")
