"""Preprocessing fitted once by distributed aggregations and applied with constants.

The fitted state is a small plain object, as large as the number of features, that is saved as one row.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabsmith.errors import WorkbenchError
from tabsmith.operators.features import as_double, float_column, is_finite
from tabsmith.operators.order import index_within
from tabsmith.storage import stored

SIGMA, TINY, FINGERPRINT = 12.0, 1e-12, "__fingerprint"


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)


def _constants(columns: Sequence[str]) -> list[Column]:
    each = []
    for c in columns:
        v = as_double(c)
        known = F.when(~F.isnan(v), v)
        each.append(F.struct(F.min(known).alias("lo"), F.max(known).alias("hi"), F.count(known).alias("n"), F.count_if(v.isNull() | F.isnan(v)).alias("nans")).alias(c))
    return each


def _not_constant(row: Row, columns: Sequence[str]) -> list[str]:
    keep = [c for c in columns if row[c]["n"] and (row[c]["lo"] != row[c]["hi"] or row[c]["nans"])]
    if not keep:
        raise WorkbenchError("INVALID_DATA", "all features are constant", columns=list(columns))
    return keep


def constant_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with a struct for each column: ``lo, hi, n, nans`` over its numbers."""
    return df.agg(*_constants(columns))


def select_non_constant(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with a value that vary or have missing values."""
    return _not_constant(constant_stats(df, columns).first(), columns)


def _fingerprint(values: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Rows of float32 and a salt each → the last eight bytes of SHA-256, as a part of 2^64-1."""
    x = values.astype(np.float64)
    with np.errstate(invalid="ignore"):
        x = np.where(np.isinf(x), np.nan, np.round(x / TINY) * TINY)
    raw = np.ascontiguousarray(x.astype("<f4"))
    raw[np.isnan(raw)] = np.nan
    body = np.concatenate([raw.view(np.uint8), np.asarray(salt).astype("<i8")[:, None].view(np.uint8)], axis=1)
    size, body = body.shape[1], body.tobytes()
    tails = b"".join(hashlib.sha256(body[k : k + size]).digest()[-8:] for k in range(0, len(body), size))
    return (np.frombuffer(tails, ">u8").astype(np.float64) / (2**64 - 1)).astype(np.float32)


def row_fingerprint(df: DataFrame, columns: Sequence[str], salt: Column | int, name: str = FINGERPRINT) -> DataFrame:
    """Adds a number in [0, 1] that depends on the row's values and the salt."""
    names = list(columns)

    @F.pandas_udf("float")
    def digest(rows: pd.DataFrame, salts: pd.Series) -> pd.Series:
        return pd.Series(_fingerprint(rows[names].to_numpy(np.float64), salts.to_numpy()))

    at = F.lit(salt).cast("long") if isinstance(salt, int) else salt.cast("long")
    return df.withColumn(name, digest(F.struct(*[float_column(c).alias(c) for c in names]), at))


def row_fingerprint_distinct(df: DataFrame, columns: Sequence[str], salt: int, row_id: str, name: str = FINGERPRINT) -> DataFrame:
    """As above, but the k-th repeat of equal rows, in the order of ``row_id``, has salt + k."""
    same = [f"_f{k}" for k in range(len(columns))]
    x = df.withColumns({s: float_column(c) for s, c in zip(same, columns, strict=True)})
    x = index_within(x, same, [row_id], "_k").drop(*same)
    return row_fingerprint(x, columns, F.lit(salt) + F.col("_k"), name).drop("_k")


def _moments(columns: Sequence[str], within: dict[str, tuple[float, float]] | None = None) -> list[Column]:
    """Mean and sample deviation of each column's finite values, or of those within its bounds."""
    aggs = []
    for c in columns:
        v = finite_or_null(as_double(c))
        if within:
            v = F.when(v.between(*map(F.lit, within[c])), v)
        aggs += [F.avg(v).alias(f"m:{c}"), F.stddev_samp(v).alias(f"s:{c}")]
    return aggs


def _bounds(row: Row, columns: Sequence[str], sigma: float) -> dict[str, tuple[float, float]]:
    out = {}
    for c in columns:
        m, s = row[f"m:{c}"] or 0.0, row[f"s:{c}"]
        s = 0.0 if s is None or math.isnan(s) else s
        out[c] = (m - sigma * s, m + sigma * s)
    return out


def clip_bounds(df: DataFrame, columns: Sequence[str], sigma: float = SIGMA) -> dict[str, tuple[float, float]]:
    """mean ± sigma x sample deviation, twice: first over all finite values, then over those inside."""
    first = _bounds(df.agg(*_moments(columns)).first(), columns, sigma)
    return _bounds(df.agg(*_moments(columns, first)).first(), columns, sigma)


def soft_clip(c: Column, lower: float, upper: float) -> Column:
    """Values beyond a bound go on as its logarithm; what isn't finite stays."""
    a = F.greatest(F.lit(lower) - F.log1p(F.abs(c)), c)
    return F.when(is_finite(c), F.least(F.lit(upper) + F.log1p(F.abs(a)), a)).otherwise(c)


def _spread(columns: Sequence[str]) -> list[Column]:
    aggs = []
    for c in columns:
        v = finite_or_null(as_double(c))
        aggs += [F.avg(v).alias(f"m:{c}"), F.stddev_pop(v).alias(f"s:{c}"), F.count(v).alias(f"n:{c}")]
    return aggs


def _scales(row: Row, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    out = {}
    for c in columns:
        s = row[f"s:{c}"] or 0.0
        out[c] = (row[f"m:{c}"] or 0.0, 1.0 if s <= TINY or row[f"n:{c}"] <= 1 else s)
    return out


def standardizer(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation over finite values; a deviation of 0 (or one value) scales by 1."""
    return _scales(df.agg(*_spread(columns)).first(), columns)


def standardize(c: Column, mean: float, scale: float) -> Column:
    return (F.when(c.isNull() | F.isnan(c), F.lit(mean)).otherwise(c) - mean) / scale


def standardize_clamp(c: Column, mean: float, scale: float, low: float, high: float) -> Column:
    if low > high:
        raise WorkbenchError("INVALID_DATA", "bounds are reversed", low=low, high=high)
    return F.least(F.greatest((c - mean) / scale, F.lit(low)), F.lit(high))


def _target_aggs(target: str) -> list[Column]:
    return [F.avg(as_double(target)).alias("mean of target"), F.stddev_pop(as_double(target)).alias("spread of target")]


def _goal(row: Row) -> tuple[float, float]:
    scale = float(np.float32(row["spread of target"] or 0.0))
    return float(np.float32(row["mean of target"] or 0.0)), scale if scale > TINY else 1.0


def target_statistics(df: DataFrame, target: str) -> tuple[float, float]:
    return _goal(df.agg(*_target_aggs(target)).first())


def univariate_weights(df: DataFrame, columns: Sequence[str], target: str) -> dict[str, float]:
    """sum(x t) / sum(x x) for each column, NaN as 0."""
    def z(c: str) -> Column:
        v = as_double(c)
        return F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v)

    aggs = [a for c in columns for a in (F.sum(z(c) * z(target)).alias(f"t:{c}"), F.sum(z(c) * z(c)).alias(f"x:{c}"))]
    row = df.agg(*aggs).first()
    return {c: (row[f"t:{c}"] / row[f"x:{c}"] if row[f"x:{c}"] else 0.0) for c in columns}


def inverse_target(c: Column, mean: float, scale: float) -> Column:
    return (c * scale + mean).cast("float")


def permutation(names: Sequence[str], *, order: Sequence[int] | None = None, shift: int | None = None, seed: int | None = None) -> list[str]:
    """A supplied order, a rotation (i - shift) mod n, or a seeded shuffle."""
    n = len(names)
    if order is not None:
        if sorted(order) != list(range(n)):
            raise WorkbenchError("INVALID_DATA", "not a permutation", order=list(order))
        return [names[k] for k in order]
    if shift is not None:
        return [names[(k - shift) % n] for k in range(n)]
    if seed is not None:
        return [names[k] for k in np.random.default_rng(seed).permutation(n)]
    return list(names)


@dataclass
class Fitted:
    features: list[str]  # as they came
    used: list[str]  # not constant, with the fingerprint, permuted
    salt: int
    bounds: dict[str, tuple[float, float]]
    scales: dict[str, tuple[float, float]]
    weights: dict[str, float]
    target: tuple[float, float]
    fingerprint: bool = True
    context_id: str = ""
    extra: dict = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.context_id, json.dumps(asdict(self)))], "context_id string, state string").write.mode("append").partitionBy("context_id").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, context_id: str) -> Fitted | None:
        try:
            rows = spark.read.parquet(path).where(F.col("context_id") == context_id).select("state").head(1)
        except AnalysisException:
            return None
        return Fitted(**json.loads(rows[0]["state"])) if rows else None


def transform_features(df: DataFrame, state: Fitted, *, row_id: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Fingerprint, order, soft clip and standardise by the fitted state. With ``row_id`` the training variant,
    in which repeated rows have fingerprints of their own."""
    if gone := [f for f in state.features if f not in df.columns]:
        raise WorkbenchError("SCHEMA_MISMATCH", "features are missing", features=gone)
    plain = [c for c in state.features if c in state.used]  # in the order in which they were fingerprinted
    if state.fingerprint:
        df = row_fingerprint_distinct(df, plain, state.salt, row_id) if row_id else row_fingerprint(df, plain, state.salt)
    return df.select(*keep, *[standardize(soft_clip(as_double(c), *state.bounds[c]), *state.scales[c]).cast("float").alias(c) for c in state.used])


def fit_preprocessing(train: DataFrame, features: Sequence[str], target: str, row_id: str, *, fingerprint: bool = True, context_id: str = "", **order: object) -> Fitted:
    """Three aggregations over the training rows, whatever the number of features; with ``fingerprint`` the rows are written once with it,
    which needs one more. A weight is sum(x t) / sum(x x) of a clipped, standardised feature and the standardised target, from their
    covariance; values that aren't finite take no part in it."""
    features = list(features)
    row = train.agg(F.count(F.lit(1)).alias("count of rows"), *_constants(features), *_moments(features), *_target_aggs(target)).first()
    used, goal = _not_constant(row, features), _goal(row)
    salt = row["count of rows"] * len(used)
    first = _bounds(row, used, SIGMA)
    full, names = train, permutation([*used, FINGERPRINT] if fingerprint else used, **order)
    if fingerprint:
        full = stored(row_fingerprint_distinct(train.select(row_id, target, *used), used, salt, row_id), "fingerprinted")
        first |= _bounds(full.agg(*_moments([FINGERPRINT])).first(), [FINGERPRINT], SIGMA)
    bounds = _bounds(full.agg(*_moments(names, first)).first(), names, SIGMA)
    clipped = full.select(F.col(target), *[soft_clip(as_double(c), *bounds[c]).alias(c) for c in names])
    pairs = [a for c in names for v in [finite_or_null(F.col(c))] for a in (F.covar_pop(v, as_double(target)).alias(f"c:{c}"), F.var_pop(v).alias(f"v:{c}"))]
    row = clipped.agg(*_spread(names), *pairs).first()
    scales = _scales(row, names)
    weights = {c: (row[f"c:{c}"] or 0.0) / row[f"v:{c}"] * scales[c][1] / goal[1] if row[f"v:{c}"] else 0.0 for c in names}
    return Fitted(features, names, salt, bounds, scales, weights, goal, fingerprint, context_id)


def score_linear(matrix: DataFrame, state: Fitted, keep: Sequence[str] = (), name: str = "mean") -> DataFrame:
    """bias + sum of weight x feature over transformed features, in the target's units."""
    total = F.lit(0.0)
    for c in state.used:
        total = total + F.lit(state.weights[c]) * as_double(c)
    return matrix.select(*keep, inverse_target(total, *state.target).alias(name))


def context_id(model: str, version: str, training_digest: str, sql: str, args: Sequence[object], features: Sequence[str], target: str, config: dict) -> str:
    body = {"model": model, "version": version, "training": training_digest, "sql": sql, "args": list(args), "features": list(features), "target": target, "config": config}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def fit_or_reuse(spark: SparkSession, contexts: str, identity: str, fit: object) -> tuple[Fitted, bool]:
    """The stored state of ``identity`` under ``contexts``, or ``fit()``, which is stored; and whether it was reused."""
    if (found := Fitted.load(spark, contexts, identity)) is not None:
        return found, True
    made = fit()
    made.context_id = identity
    made.save(spark, contexts)
    return made, False

