"""User-supplied predictors behind a fit and a predict step.

A model that is fitted here is a ``Model``: each partition folds its batches into a state of its own, states are merged in a tree, and the
last becomes the context that ``predict`` gets. Contexts are kept by their id, fitted once, exported and imported.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.errors import WorkbenchError
from tabsmith.operators.prep import Fitted, score_linear, transform_features
from tabsmith.operators.results import validate_results
from tabsmith.storage import stored

Predict = Callable[[object, np.ndarray], np.ndarray]
State = dict[str, np.ndarray]
PARTIAL = pa.schema([("node", pa.int64()), ("state", pa.binary())])


class Scorer:
    """``predict(state, matrix)`` returns a mean a row, or three columns mean, q25, q75."""

    def __init__(self, predict: Predict, state: object = None, *, kind: type = np.float32) -> None:
        self.predict, self.state, self.kind = predict, state, kind

    def score(self, matrix: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
        """``keep``, mean, q25 and q75 (null if the predictor gives none), by Arrow batches. A batch whose row count
        differs fails its task."""
        predict, state, kind, names, kept = self.predict, self.state, self.kind, list(features), list(keep)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                y = np.asarray(predict(state, pdf[names].to_numpy(kind)), np.float64)
                if len(y) != len(pdf) or y.ndim not in (1, 2) or y.ndim == 2 and y.shape[1] != 3:
                    raise ValueError(f"the predictor gave shape {y.shape} for {len(pdf)} rows")
                cols = [y, np.full(len(y), np.nan), np.full(len(y), np.nan)] if y.ndim == 1 else list(y.T)
                yield pdf[kept].assign(mean=cols[0], q25=cols[1], q75=cols[2])

        kinds = {f.name: f.dataType.simpleString() for f in matrix.schema.fields}
        schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in kept], "mean double, q25 double, q75 double"])
        out = matrix.select(*kept, *[c for c in names if c not in kept]).mapInPandas(run, schema)
        return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("q25", "q75")})


class Model(Protocol):
    """States are dicts of arrays or numbers whose size does not grow with the rows; ``merge`` must not depend on order but for rounding."""

    def start(self, features: int) -> State: ...

    def add(self, state: State, x: np.ndarray, y: np.ndarray) -> State: ...

    def merge(self, a: State, b: State) -> State: ...

    def finish(self, state: State) -> State: ...

    def predict(self, context: State, x: np.ndarray) -> np.ndarray: ...


def pack(state: State) -> bytes:
    out = io.BytesIO()
    np.savez(out, **state)
    return out.getvalue()


def unpack(raw: bytes) -> State:
    with np.load(io.BytesIO(raw), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}


def fit_model(model: Model, rows: DataFrame, features: Sequence[str], target: str, *, fan: int = 32) -> State:
    """The context of ``model`` over all rows with a known target. Partial states are merged ``fan`` at a time, level by level, by tasks; the driver gets
    the last one."""
    names = list(features)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state, n = model.start(len(names)), 0
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(np.float64)
            state, n = model.add(state, x, b.column(target).to_numpy(zero_copy_only=False).astype(np.float64)), n + b.num_rows
        if n:
            yield pa.RecordBatch.from_pylist([{"node": TaskContext.get().partitionId(), "state": pack(state)}], PARTIAL)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[int, State] = {}  # of the nodes of this task, sorted so that one is open at a time
        for b in batches:
            for node, raw in zip(b.column("node").to_pylist(), b.column("state").to_pylist(), strict=True):
                if now and node not in now:
                    yield pa.RecordBatch.from_pylist([{"node": k, "state": pack(s)} for k, s in now.items()], PARTIAL)
                    now = {}
                now[node] = model.merge(now[node], unpack(raw)) if node in now else unpack(raw)
        yield pa.RecordBatch.from_pylist([{"node": k, "state": pack(s)} for k, s in now.items()], PARTIAL)

    kinds = "node long, state binary"
    x = rows.where(F.col(target).isNotNull()).select(*names, target)
    level = stored(x.mapInArrow(fold, kinds), "states")
    while (n := level.count()) > 1:
        # nodes are numbered by partition, so a level has a ``fan``-th of the one below at least
        up = level.select(F.floor(F.col("node") / fan).alias("node"), "state")
        level = stored(up.repartition(max(1, n // fan), "node").sortWithinPartitions("node").mapInArrow(unite, kinds), "states")
    last = level.head(1)
    if not last:
        raise WorkbenchError("EMPTY_INPUT", "no row has a target")
    return model.finish(unpack(bytes(last[0]["state"])))


CONTEXTS = "context_id string, model string, features array<string>, context binary"


def export_context(spark: SparkSession, path: str, identity: str, model: str, features: Sequence[str], context: State) -> None:
    spark.createDataFrame([(identity, model, list(features), pack(context))], CONTEXTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/{identity}")


def import_context(spark: SparkSession, path: str, identity: str, model: str, features: Sequence[str]) -> State | None:
    """The context of that id, or None; raises if it is of another model or other features."""
    try:
        row = spark.read.schema(CONTEXTS).parquet(f"{path}/{identity}").first()
    except AnalysisException:
        return None
    if row is None or row["model"] != model or list(row["features"]) != list(features):
        raise WorkbenchError("CONTEXT_INCOMPATIBLE", "the context is of another model or schema", context_id=identity)
    return unpack(bytes(row["context"]))


def fit_context(spark: SparkSession, path: str, identity: str, name: str, model: Model, rows: DataFrame, features: Sequence[str], target: str) -> tuple[State, bool]:
    """The stored context of ``identity``, or one that is fitted now and stored; and whether it was reused."""
    if (found := import_context(spark, path, identity, name, features)) is not None:
        return found, True
    made = fit_model(model, rows, features, target)
    export_context(spark, path, identity, name, features, made)
    return made, False


@dataclass
class Ridge:
    """Least squares with a penalty on the slopes. A state is the count, means, and sums of products about the means."""

    penalty: float = 1.0

    def start(self, features: int) -> State:
        return {"n": np.zeros(()), "mean": np.zeros(features + 1), "product": np.zeros((features + 1, features + 1))}

    def add(self, state: State, x: np.ndarray, y: np.ndarray) -> State:
        z = np.column_stack([x, y])
        mean = z.mean(0) if len(z) else np.zeros(z.shape[1])
        return self.merge(state, {"n": np.array(float(len(z))), "mean": mean, "product": (z - mean).T @ (z - mean)})

    def merge(self, a: State, b: State) -> State:
        n = a["n"] + b["n"]
        gap = b["mean"] - a["mean"]
        part = b["n"] / n if n else 0.0
        return {"n": n, "mean": a["mean"] + gap * part, "product": a["product"] + b["product"] + np.outer(gap, gap) * a["n"] * part}

    def finish(self, state: State) -> State:
        product, mean = state["product"], state["mean"]
        slope = np.linalg.solve(product[:-1, :-1] + self.penalty * np.eye(len(mean) - 1), product[:-1, -1])
        return {"slope": slope, "bias": np.array(mean[-1] - slope @ mean[:-1])}

    def predict(self, context: State, x: np.ndarray) -> np.ndarray:
        return x @ context["slope"] + context["bias"]


_scorers: dict[str, Scorer] = {}


def register_scorer(name: str, predict: Predict, state: object = None) -> Scorer:
    _scorers[name] = Scorer(predict, state)
    return _scorers[name]


def scorer(name: str) -> Scorer:
    if name not in _scorers:
        raise WorkbenchError("CONTEXT_INCOMPATIBLE", "no scorer of that name", name=name)
    return _scorers[name]


def predict(rows: DataFrame, state: Fitted, *, ordinal: str = "row_ordinal", name: str | None = None, check: bool = True) -> DataFrame:
    """Transforms rows by the fitted state, scores them (linear, or a registered scorer) and gates the result."""
    matrix = transform_features(rows, state, keep=[ordinal])
    if name is None:
        none = F.lit(None).cast("double")
        out = score_linear(matrix, state, [ordinal]).select(ordinal, F.col("mean").cast("double").alias("mean"), none.alias("q25"), none.alias("q75"))
    else:
        out = scorer(name).score(matrix, state.used, [ordinal])
    if check:
        validate_results(out.withColumnRenamed(ordinal, "row_ordinal"), rows.count())
    return out
