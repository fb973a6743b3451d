"""Predictive distributions held as array columns: softmax, rebinning, mean and quantiles.

What is decoded may be probabilities or, with ``logits``, their logits. A batch's arrays are viewed as one matrix over the values of the Arrow list column;
borders and bucket means are sent once, as a broadcast. An array that is null, of another length, holds a null or what is no probability or logit, or has no
mass, gives null; ``require_distribution`` refuses such rows instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.errors import WorkbenchError

#: Mean of a half-normal with the scale that puts half of its mass within one unit: sqrt(2/pi) / 0.6744897501960817.
TAIL_MEAN = math.sqrt(2 / math.pi) / 0.6744897501960817


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, and not again wherever a lambda uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total_of(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of logits; -inf has none. Arrays with null, NaN, +inf or without mass give null."""

    def scaled(x: Column) -> Column:
        return let(F.array_max(x), lambda top: F.when(~F.isnan(top) & (F.abs(top) != float("inf")) & ~F.exists(x, lambda v: v.isNull()), raised(x, top)))

    def raised(x: Column, top: Column) -> Column:
        return let(F.transform(x, lambda v: F.exp(v - top)), lambda e: let(total_of(e), lambda s: F.transform(e, lambda v: v / s)))

    return let(F.transform(logits, lambda v: v.cast("double") / temperature), scaled)


def bucket_means(borders: Sequence[float], tails: bool = True) -> np.ndarray:
    """Midpoints; the two outer buckets have the mean of a half-normal that starts at their inner border."""
    b = np.asarray(borders, np.float64)
    mid = (b[:-1] + b[1:]) / 2
    if tails and len(mid) > 1:
        mid[0] = b[1] - (b[1] - b[0]) * TAIL_MEAN
        mid[-1] = b[-2] + (b[-1] - b[-2]) * TAIL_MEAN
    return mid


def check_borders(borders: Sequence[float], bins: int) -> None:
    b = np.asarray(borders, np.float64)
    if len(b) != bins + 1 or not np.isfinite(b).all() or not (np.diff(b) > 0).all():
        raise WorkbenchError("RESULT_INVALID", "borders are not bins + 1 rising finite numbers", bins=bins, borders=len(b))


def check_distribution(df: DataFrame, column: str, bins: int) -> DataFrame:
    """One row: rows, and those whose array is missing or of another length, holds what is no logit, or has no mass."""
    x = F.col(column)
    wrong = x.isNull() | (F.size(x) != bins)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (v == float("inf")))
    none = ~F.exists(x, lambda v: v > float("-inf"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(wrong).alias("wrong_length"), F.count_if(~wrong & odd).alias("not_logits"), F.count_if(~wrong & ~odd & none).alias("no_mass"))


def require_distribution(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``df``, if every row has the logits of a distribution."""
    row = check_distribution(df, column, bins).first().asDict()
    if faults := {k: v for k, v in row.items() if k != "rows" and v}:
        raise WorkbenchError("RESULT_INVALID", "not logits of a distribution", **faults)
    return df


def matrix_of(col: pa.ListArray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that have ``bins`` values, none of them null, and these as a matrix: a view where all rows are such."""
    offsets = col.offsets.to_numpy().astype(np.int64)
    good = (np.diff(offsets) == bins) & ~col.is_null().to_numpy(zero_copy_only=False)
    rows, values = np.flatnonzero(good), col.values
    flat = values.to_numpy(zero_copy_only=False)  # nulls become NaN
    if len(rows) == len(col):
        return rows, flat[offsets[0] : offsets[-1]].reshape(len(col), bins)
    return rows, flat[offsets[rows][:, None] + np.arange(bins)]


def probabilities(m: np.ndarray, logits: bool, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a matrix are distributions, and their probabilities; those of logits sum to 1."""
    with np.errstate(all="ignore"):
        x = m.astype(np.float64)
        if not logits:
            total = x.sum(1)
            good = np.isfinite(total) & (total > 0) & (x >= 0).all(1)
            return good, x[good]
        x = x / temperature
        top = x.max(1, initial=-np.inf)
        good = np.isfinite(top)  # NaN and +inf spoil the greatest, -inf is what a row without mass has
        e = np.exp(x[good] - top[good][:, None])
        return good, e / e.sum(1, keepdims=True)


def _decoder(values: Column, bins: int, kind: str, fixed: tuple[np.ndarray, ...], f: Callable[..., np.ndarray], logits: bool, temperature: float) -> Column:
    """``f(probabilities, *fixed)``, a number or a row of numbers for each distribution."""
    if not temperature > 0:
        raise WorkbenchError("RESULT_INVALID", "the temperature is not positive", temperature=temperature)
    sent = SparkSession.active().sparkContext.broadcast(fixed)

    def run(col: pa.Array) -> pa.Array:
        rows, m = matrix_of(col, bins)
        good, p = probabilities(m, logits, temperature)
        out = f(p, *sent.value) if len(p) else np.zeros((0, 1) if "array" in kind else 0)
        known = np.zeros(len(col), bool)
        known[rows[good]] = True
        if "array" in kind:
            width = out.shape[1] if len(out) else 0
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(known * width)]).astype(np.int32)), pa.array(out.reshape(-1)), mask=pa.array(~known))
        whole = np.zeros(len(col))
        whole[known] = out
        return pa.array(whole, mask=~known)

    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)(values)


def decode_mean(values: Column, means: Sequence[float], mean: float = 0.0, scale: float = 1.0, *, logits: bool = False, temperature: float = 1.0) -> Column:
    """Expected value in raw target units."""
    if not scale > 0:
        raise WorkbenchError("RESULT_INVALID", "the scale is not positive", scale=scale)
    return _decoder(values, len(means), "double", (np.asarray(means, np.float64),), lambda p, m: p @ m * scale + mean, logits, temperature)


def decode_quantile_mean(quantiles: Column, mean: float = 0.0, scale: float = 1.0) -> Column:
    total = F.aggregate(F.transform(quantiles, lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return total / F.size(quantiles) * scale + mean


def quantiles_of(probs: np.ndarray, borders: np.ndarray, q: Sequence[float]) -> np.ndarray:
    """rows x q: the inverse of the distribution function, linear inside every bucket."""
    cdf = np.cumsum(probs, axis=1)
    cdf /= cdf[:, -1:]
    out = np.empty((len(probs), len(q)))
    rows = np.arange(len(probs))
    for j, x in enumerate(q):
        k = np.minimum((cdf < x).sum(axis=1), probs.shape[1] - 1)
        below = np.where(k > 0, cdf[rows, np.maximum(k - 1, 0)], 0.0)
        mass = cdf[rows, k] - below
        part = np.where(mass > 0, (x - below) / np.where(mass > 0, mass, 1), 0.0)
        out[:, j] = borders[k] + np.clip(part, 0, 1) * (borders[k + 1] - borders[k])
    return out


def decode_quantiles(values: Column, borders: Sequence[float], q: Sequence[float] = (0.25, 0.75), mean: float = 0.0, scale: float = 1.0, *, logits: bool = False, temperature: float = 1.0) -> Column:
    """An array of the quantiles ``q`` in raw target units."""
    check_borders(borders, len(borders) - 1)
    qs = list(q)
    return _decoder(values, len(borders) - 1, "array<double>", (np.asarray(borders, np.float64),), lambda p, b: quantiles_of(p, b, qs) * scale + mean, logits, temperature)


def rebin_of(probs: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Mass moved to other borders through the distribution function; it is 0 at the first and 1 at the last."""
    cdf = np.concatenate([np.zeros((len(probs), 1)), np.cumsum(probs, axis=1)], axis=1)
    cdf /= cdf[:, -1:]
    k = np.clip(np.searchsorted(old, new, "right") - 1, 0, len(old) - 2)
    part = np.clip((new - old[k]) / (old[k + 1] - old[k]), 0, 1)
    at = cdf[:, k] + part * (cdf[:, k + 1] - cdf[:, k])
    at[:, 0], at[:, -1] = 0, 1
    return np.maximum(np.diff(at, axis=1), 0)


def rebin(values: Column, old: Sequence[float], new: Sequence[float], *, logits: bool = False, temperature: float = 1.0) -> Column:
    check_borders(old, len(old) - 1)
    check_borders(new, len(new) - 1)
    return _decoder(values, len(old) - 1, "array<double>", (np.asarray(old, np.float64), np.asarray(new, np.float64)), rebin_of, logits, temperature)


#: Control points of the default borders, as (place of 5000, border); those beyond the middle mirror them.
CONTROLS = ((0, -128.0), (5, -16.9), (20, -13.0), (100, -9.9), (200, -8.47), (500, -6.48), (1000, -4.4), (2500, 0.0))


def default_borders(bins: int, controls: Sequence[tuple[float, float]] = tuple((p / 5000, v) for p, v in CONTROLS)) -> np.ndarray:
    """bins + 1 borders interpolated over mirrored control points (position in 0..0.5, border)."""
    half = sorted(controls)
    x = [p for p, _ in half] + [1 - p for p, _ in reversed(half) if p < 0.5]
    y = [v for _, v in half] + [-v for p, v in reversed(half) if p < 0.5]
    return np.interp(np.linspace(0, 1, bins + 1), x, y)
