"""Frozen query results and matrices: immutable snapshots with the definition that made them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.errors import WorkbenchError
from tabsmith.operators.catalog import read_snapshot, save_snapshot
from tabsmith.operators.features import check_target, to_float32
from tabsmith.plans.readonly import query

PROVENANCE = "snapshot_id string, kind string, source_snapshot string, revision long, sql string, args string, keys array<string>, features array<string>, target string"


def _noted(spark: SparkSession, root: str, row: tuple) -> str:
    """Notes what made a snapshot, once."""
    new = spark.createDataFrame([row], PROVENANCE)
    if provenance(spark, root).intersect(new).isEmpty():
        new.coalesce(1).write.mode("append").parquet(f"{root}/provenance")
    return row[0]


def provenance(spark: SparkSession, root: str) -> DataFrame:
    """``PROVENANCE`` rows: equal content that several definitions gave is one snapshot with a row for each."""
    try:
        return spark.read.schema(PROVENANCE).parquet(f"{root}/provenance")
    except AnalysisException:
        return spark.createDataFrame([], PROVENANCE)


def freeze_query(spark: SparkSession, root: str, sql: str, args: Sequence[Any] = (), *, order: Sequence[str], source_snapshot: str, revision: int) -> str:
    """The id of a snapshot of a query's rows, in ``order``, with its definition: SQL, parameters, and the source snapshot and revision it is bound to."""
    if not source_snapshot.strip():
        raise WorkbenchError("INVALID_QUERY", "a source snapshot is required")
    if isinstance(revision, bool) or not isinstance(revision, int) or revision < 0:
        raise WorkbenchError("INVALID_QUERY", "the revision is a number from 0 on", revision=revision)
    sid = save_snapshot(query(spark, sql, args), root, f"query_{source_snapshot}", "query", order)
    return _noted(spark, root, (sid, "query", source_snapshot, revision, sql, json.dumps(list(args)), [], [], None))


def materialize_input(spark: SparkSession, root: str, sql: str, args: Sequence[Any], features: Sequence[str], target: str | None, keys: Sequence[str], order: Sequence[str]) -> str:
    """The id of a snapshot of a matrix: a query's rows in ``order`` as business keys, float32 features and, for training, the target, with what made it."""
    df = query(spark, sql, args)
    if target:
        check_target(df, target, features)
    kept = [c for c in dict.fromkeys([*keys, *order]) if c not in features and c != target]
    matrix = to_float32(df, [*features, *([target] if target else [])], keep=kept)
    sid = save_snapshot(matrix, root, "training" if target else "prediction", "matrix", order)
    return _noted(spark, root, (sid, "training" if target else "prediction", None, None, sql, json.dumps(list(args)), list(keys), list(features), target))


def input_rows(spark: SparkSession, root: str, sid: str, ordinal: str = "row_ordinal") -> DataFrame:
    """A frozen input's rows with their ordinals; raises if it is gone or is not what was written."""
    found = read_snapshot(spark, root, sid, verify=True)
    if found is None:
        raise WorkbenchError("SNAPSHOT_CORRUPT", "the snapshot is gone or has changed", snapshot_id=sid)
    return found.withColumn(ordinal, F.col("__ordinal")).drop("__ordinal")
