"""Float32 feature matrices: a DataFrame of float columns, missing as NaN, with checks in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.errors import WorkbenchError
from tabsmith.operators.dataset import NUMERIC

SAFE = 2**53 - 1
#: The range of each integer kind; 64-bit ones as far as a double is exact.
RANGES = {"int32": (-(2**31), 2**31 - 1), "uint32": (0, 2**32 - 1), "int64": (-SAFE, SAFE), "uint64": (0, SAFE)}
INF = float("inf")


def is_inf(c: Column) -> Column:
    return F.coalesce(F.abs(c) == F.lit(INF), F.lit(False))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & ~is_inf(c)


def finite_double(c: Column) -> Column:
    v = c.cast("double")
    return F.when(is_finite(v), v)


def as_double(c: str) -> Column:
    return F.col(c).cast("double")


def counted(checks: Sequence[Column]) -> Column:
    """Rows in which any of the conditions holds."""
    hit = checks[0]
    for x in checks[1:]:
        hit = hit | x
    return F.count_if(hit)


def overflow_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: for each column its finite values that float32 can't hold."""
    return df.agg(*[F.count_if(is_finite(as_double(c)) & is_inf(F.col(c).cast("float").cast("double"))).alias(c) for c in columns])


def range_counts(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One row: for each column its values outside its integer kind's range."""
    return df.agg(*[F.count_if(~F.col(c).between(F.lit(RANGES[k][0]), F.lit(RANGES[k][1]))).alias(c) for c, k in kinds.items()])


def infinity_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(is_inf(as_double(c))).alias(c) for c in columns])


def bad_targets(df: DataFrame, target: str) -> DataFrame:
    """One row: the target's missing and not finite values."""
    return df.agg(F.count_if(F.col(target).isNull()).alias("missing"), F.count_if(F.col(target).isNotNull() & ~is_finite(as_double(target))).alias("not_finite"))


def float_column(c: str) -> Column:
    """Rounded to float32, null as NaN."""
    return F.coalesce(F.col(c).cast("float"), F.lit(float("nan")).cast("float"))


def to_float32(df: DataFrame, columns: Sequence[str], *, allow_inf: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and the float32 ``columns``; raises on text, overflow, and infinities unless allowed."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if wrong := [c for c in columns if not isinstance(kinds.get(c), NUMERIC)]:
        raise WorkbenchError("FEATURE_MISMATCH", "not numeric", columns=wrong)
    checks = []
    for c in columns:
        checks.append(F.count_if(is_finite(as_double(c)) & is_inf(F.col(c).cast("float").cast("double"))).alias(f"o:{c}"))
        checks.append(F.count_if(is_inf(as_double(c))).alias(f"i:{c}"))
        if isinstance(kinds[c], T.LongType):
            checks.append(F.count_if(~F.col(c).between(-SAFE, SAFE)).alias(f"r:{c}"))
    row = df.agg(*checks).first().asDict()
    if over := [k[2:] for k, v in row.items() if v and k[0] in "or"]:
        raise WorkbenchError("NUMERIC_OVERFLOW", "values beyond float32 or exact integers", columns=over)
    if not allow_inf and (bad := [k[2:] for k, v in row.items() if v and k[0] == "i"]):
        raise WorkbenchError("INF_DISABLED", "infinite features", columns=bad)
    return df.select(*keep, *[float_column(c).alias(c) for c in columns])


def check_target(df: DataFrame, target: str, features: Sequence[str]) -> None:
    if target in features:
        raise WorkbenchError("INVALID_TARGET", "the target is a feature", target=target)
    if target not in df.columns:
        raise WorkbenchError("INVALID_TARGET", "the target is missing", target=target)
    row = bad_targets(df, target).first()
    if row["missing"] or row["not_finite"]:
        raise WorkbenchError("NONFINITE_TARGET", "the target has missing or infinite values", **row.asDict())


def row_slice(df: DataFrame, offset: int, length: int, ordinal: str = "row_ordinal") -> DataFrame:
    """Rows offset .. offset+length-1 by position."""
    return df.where(F.col(ordinal).between(offset, offset + length - 1))


@dataclass
class PredictionInput:
    train: DataFrame  # keep, features, target
    predict: DataFrame  # keep, features, truth
    features: list[str]
    target: str


def prepare_prediction_input(train: DataFrame, predict: DataFrame, target: str, features: Sequence[str], keep: Sequence[str] = ()) -> PredictionInput:
    """The train matrix with its target, and the matrix to predict with the truth where Test has a finite one."""
    if len(set(features)) < len(features) or not features:
        raise WorkbenchError("FEATURE_MISMATCH", "features repeat or are none", features=list(features))
    check_target(train, target, features)
    if gone := [f for f in features if f not in predict.columns or f not in train.columns]:
        raise WorkbenchError("FEATURE_MISMATCH", "features are missing", features=gone)
    a = to_float32(train, [*features, target], keep=keep)
    kind = dict(predict.dtypes).get(target)
    numeric = target in predict.columns and kind != "string"
    truth = F.when(is_finite(as_double(target)), as_double(target)) if numeric else F.lit(None).cast("double")
    b = to_float32(predict.withColumn("truth", truth), features, keep=[*keep, "truth"])
    return PredictionInput(a, b, list(features), target)
