"""What the corpus operators share: reading the test tables, written intermediate tables, record keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor can reach. Only a local master gets
    a temporary folder where it is unset; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tabsmith-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Spark's own setting by which a query's shuffle files go once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keys of more rows than this may be taken out of a shuffle (see ``join_counted``).
OFTEN = 256


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back: later steps start from
    the files, so a lost executor costs no recomputation, and Spark knows the table's size. The shuffle files of the
    write go with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that no frame which is still to be computed reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_counted(rows: DataFrame, per: DataFrame, key: str, total: int, *, most: int = 1024, written: bool = False) -> DataFrame:
    """Inner join of ``rows``, ``total`` in number, with ``per``: one row for each ``key`` with ``_n``, how many of ``rows`` have it.
    Keys with more than ``OFTEN`` rows and a ``most``-th of all, of which there are less than ``most``, are broadcast,
    so that the rows of such a key stay where they are; the others are joined by a shuffle. ``rows`` is read
    three times and should be a written table; if ``per`` is one too (``written``), it is first seen whether there are such keys."""
    limit = max(OFTEN, total // most)
    hubs = per.where(F.col("_n") > limit).drop("_n")
    if total <= limit or written and hubs.isEmpty():
        return rows.join(per.drop("_n"), key)
    rest = rows.join(F.broadcast(hubs.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hubs), key).unionByName(rest.join(per.where(F.col("_n") <= limit).drop("_n"), key))


def same(a: Column, b: Column) -> Column:
    """Equality under which null equals null; still an equi-join key."""
    return a.eqNullSafe(b)


def text_key(text: Column) -> Column:
    """64-bit content hash; joined together with the document id it tells versions of a document apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())
