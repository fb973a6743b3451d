"""Datasets with row identity, and their splits."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.errors import WorkbenchError
from tabsmith.operators.order import global_index
from tabsmith.operators.times import utc_wall
from tabsmith.plans.readonly import query

ROW_ID = "__row_id"
PREFIX = "__"
#: What names of columns that are no features hold, and names of time columns; ``ts`` is one of ours.
NOT_FEATURES = r"(?i)^id$|_id$|ordinal|timestamp|available_at"
TIME_NAMES = r"(?i)timestamp|target_time|event[_ ]?time|^time$|^date$|^ts$"
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def build_dataset(spark: SparkSession, sql: str, order: Sequence[str | Column] | None = None, name: str | None = None) -> DataFrame:
    """Runs ``sql`` once and gives its rows 1-based ids in ``order`` (all columns if none is given, as rows have
    no order of their own). The view ``name`` is replaced only if all went well."""
    df = query(spark, sql)
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise WorkbenchError("SCHEMA_MISMATCH", "column names repeat", columns=df.columns)
    if taken := [c for c in df.columns if c.startswith(PREFIX)]:
        raise WorkbenchError("SCHEMA_MISMATCH", f"names that start with {PREFIX} are reserved", columns=taken)
    if df.isEmpty():
        raise WorkbenchError("EMPTY_INPUT", "the dataset has no rows")
    out = global_index(df, order or df.columns, ROW_ID, start=1)
    if name:
        out.createOrReplaceTempView(name)
    return out


def ratio_split(df: DataFrame, order_by: str | None = None, row_id: str = ROW_ID, rank: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Train: rank <= floor(0.8 n) by (``order_by`` ascending, nulls last; row id); Test: the others."""
    order = [F.col(order_by).asc_nulls_last()] if order_by else []
    ranked = global_index(df, [*order, F.col(row_id).asc()], "_rank", start=1)
    most = ranked.count() * 4 // 5
    train, test = ranked.where(F.col("_rank") <= most), ranked.where(F.col("_rank") > most)
    return tuple(x.withColumnRenamed("_rank", rank) if rank else x.drop("_rank") for x in (train, test))


def time_split(df: DataFrame, column: str, cutoff: str | datetime) -> tuple[DataFrame, DataFrame]:
    """Train: before the cutoff; Test: from it on; rows without a time are in neither. Times are those of UTC: a cutoff without
    an offset is one of UTC, and so is a column without a zone."""
    if isinstance(cutoff, str):
        try:
            cutoff = datetime.fromisoformat(cutoff.replace("Z", "+00:00"))
        except ValueError:
            raise WorkbenchError("INVALID_DATA", "the cutoff is not a time", cutoff=cutoff) from None
    if cutoff.tzinfo:
        cutoff = cutoff.astimezone(timezone.utc).replace(tzinfo=None)
    at, edge = utc_wall(F.col(column), df.schema[column].dataType), F.lit(cutoff.isoformat(" ")).cast("timestamp_ntz")
    return df.where(at < edge), df.where(at >= edge)


def default_cutoff(df: DataFrame, column: str, row_id: str = ROW_ID) -> DataFrame:
    """One row: the non-null value at position min(n-1, floor(0.8 n)) in row order."""
    known = global_index(df.where(F.col(column).isNotNull()).select(column, row_id), [F.col(row_id).asc()], "_at")
    n = known.count()
    return known.where(F.col("_at") == min(n - 1, n * 4 // 5)).select(F.col(column).alias("cutoff"))


def split_overlap(train: DataFrame, test: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """One row: ``verifiable, overlap``, the distinct row ids that are in both."""
    if row_id not in train.columns or row_id not in test.columns:
        return train.sparkSession.range(1).select(F.lit(False).alias("verifiable"), F.lit(None).cast("long").alias("overlap"))
    both = train.select(row_id).intersect(test.select(row_id))
    return both.agg(F.lit(True).alias("verifiable"), F.count(F.lit(1)).alias("overlap"))


def leakage_check(train: DataFrame, predict: DataFrame, *, target: str, time: str, available: str) -> DataFrame:
    """One row with the three conditions and their conjunction ``ok``."""
    a = train.agg(F.max(time).alias("last"), F.coalesce(F.bool_and(F.col(available) <= F.col(time)), F.lit(True)).alias("a"))
    b = predict.agg(F.min(time).alias("first"), F.coalesce(F.bool_and(F.col(available) <= F.col(time)), F.lit(True)).alias("b"))
    out = a.crossJoin(b).select(  # one row each
        F.lit(target not in predict.columns).alias("target_absent"),
        (F.col("a") & F.col("b")).alias("available_in_time"),
        F.coalesce(F.col("last") < F.col("first"), F.lit(True)).alias("train_before_predict"),
    )
    return out.withColumn("ok", F.col("target_absent") & F.col("available_in_time") & F.col("train_before_predict"))


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of numbers with at least one; one scan for all."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    if not names:
        return []
    row = df.agg(*[F.count(c).alias(c) for c in names]).first()
    return [c for c in names if row[c] > 0]


def column_roles(train: DataFrame, test: DataFrame, target: str | None = None) -> dict[str, object]:
    """``features, target, time``: features by their names' patterns (see above); the target is kept if numeric, else the last
    numeric column; the first column named like a time."""
    mine, theirs = numeric_columns(train), set(numeric_columns(test))
    target = target if target in mine else (mine[-1] if mine else None)
    features = [c for c in mine if c in theirs and c != target and not re.search(NOT_FEATURES, c) and not c.startswith(PREFIX)]
    time = next((c for c in train.columns if re.search(TIME_NAMES, c)), None)
    return {"features": features, "target": target, "time": time}


def check_schema(df: DataFrame, names: Sequence[str], *, min_rows: int = 0, max_rows: int | None = None, max_features: int | None = None) -> int:
    """The row count; raises if names or order differ or a bound is crossed. No bound holds unless given."""
    if list(df.columns) != list(names):
        raise WorkbenchError("SCHEMA_MISMATCH", "columns differ", expected=list(names), found=df.columns)
    if max_features is not None and len(names) > max_features:
        raise WorkbenchError("INPUT_LIMIT", "too many features", most=max_features)
    n = df.count()
    if n < min_rows or max_rows is not None and n > max_rows:
        raise WorkbenchError("INPUT_LIMIT", "row count out of bounds", rows=n, least=min_rows, most=max_rows)
    return n


def validate_experiment(train: DataFrame, test: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """One row ``train_rows, test_rows, features``; raises if columns are missing or a side is empty."""
    if target not in train.columns:
        raise WorkbenchError("INVALID_TARGET", "the target is not in Train", target=target)
    for side, df in (("train", train), ("test", test)):
        if gone := [f for f in features if f not in df.columns]:
            raise WorkbenchError("FEATURE_MISMATCH", f"features missing in {side}", features=gone)
        if df.isEmpty():
            raise WorkbenchError("EMPTY_INPUT", f"{side} has no rows")
    a, b = train.agg(F.count(F.lit(1)).alias("train_rows")), test.agg(F.count(F.lit(1)).alias("test_rows"))
    return a.crossJoin(b).withColumn("features", F.lit(len(features)))  # one row each


