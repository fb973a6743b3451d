"""Prediction results: the gate before publication, joins back to rows, runs and scenarios, chart series.

Runs live in an event table (``request_id, stream_id, generation, seq, kind, baseline, experiment``), with
kinds reserve, publish, cancel, fail, rollback and delete. States and pointers are derived from it (see ``runs``), never changed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.errors import WorkbenchError
from tabsmith.operators.features import is_finite
from tabsmith.operators.order import Ordered, global_index

RESULT_COLUMNS = ("request_id", "input_snapshot_id", "row_ordinal", "business_key", "scenario_id", "context_id", "mean", "q25", "q75")


def result_faults(results: DataFrame, n: int) -> DataFrame:
    """One row of counts; all but ``rows`` are 0 for a result of ``n`` rows that may be published."""
    o, m, a, b = F.col("row_ordinal"), F.col("mean"), F.col("q25"), F.col("q75")
    both = a.isNotNull() & b.isNotNull()
    return results.agg(
        F.count(F.lit(1)).alias("rows"),
        F.abs(F.count(F.lit(1)) - n).alias("row_difference"),
        (F.count(F.lit(1)) - F.countDistinct(o)).alias("repeated"),
        F.count_if(o.isNull() | ~o.between(0, n - 1)).alias("outside"),
        F.count_if(~is_finite(m.cast("double"))).alias("bad_mean"),
        F.count_if(a.isNull() != b.isNull()).alias("half_interval"),
        F.count_if(both & (~is_finite(a.cast("double")) | ~is_finite(b.cast("double")) | (a > b))).alias("bad_interval"),
    )


def validate_results(results: DataFrame, n: int) -> None:
    row = result_faults(results, n).first().asDict()
    if faults := {k: v for k, v in row.items() if k != "rows" and v}:
        raise WorkbenchError("RESULT_INVALID", "nothing is published", **faults)


def join_rows_by_ordinal(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """Input columns beside each result, by snapshot and ordinal, as keys may repeat."""
    return results.join(inputs, ["input_snapshot_id", "row_ordinal"], "left")


def unique_name(taken: Sequence[str], name: str) -> str:
    """``name``, else ``prediction_name``, else with the first free number from 2."""
    have = {t.lower() for t in taken}
    if name.lower() not in have:
        return name
    base, k = f"prediction_{name}", 2
    if base.lower() not in have:
        return base
    while f"{base}_{k}".lower() in have:
        k += 1
    return f"{base}_{k}"


def enrich_test_rows(test: DataFrame, predictions: DataFrame, on: str = "row_ordinal") -> DataFrame:
    """Test rows with mean, q25 and q75 under names that are free."""
    taken, out = list(test.columns), predictions
    for c in ("mean", "q25", "q75"):
        new = unique_name(taken, c)
        taken.append(new)
        out = out.withColumnRenamed(c, new)
    return test.join(out, on, "left")


def with_truth_and_ordinal(test: DataFrame, truth: DataFrame, on: str) -> DataFrame:
    """Test rows in order of their ordinal, with the truth, under free names."""
    name, ordinal = unique_name(test.columns, "truth"), unique_name(test.columns, "row_ordinal")
    out = test.join(truth.withColumnRenamed("truth", name), on, "left")
    return global_index(out, [F.col(on).asc()], ordinal).orderBy(ordinal)


def run_history(states: DataFrame, stream: str) -> DataFrame:
    return states.where((F.col("stream_id") == stream) & ~F.col("status").isin("deleted", "refused")).orderBy("seq")


def current_runs(states: DataFrame, heads: DataFrame) -> DataFrame:
    """The published run at each stream's head, the last of them if several have its generation; none while it is pending."""
    x = states.where("status = 'published'").join(heads.select("stream_id", F.col("head").alias("generation")), ["stream_id", "generation"])
    return x.groupBy("stream_id", "generation").agg(F.max_by("request_id", "seq").alias("request_id"))


def baseline_runs(heads: DataFrame) -> DataFrame:
    """The baseline that each stream points at."""
    return heads.where("baseline is not null").select("stream_id", F.col("baseline").alias("request_id"))


def last_good(states: DataFrame) -> DataFrame:
    """The highest published generation of each stream that is no experiment."""
    return states.where("status = 'published' and not experiment").groupBy("stream_id").agg(F.max("generation").alias("generation"))


def error_by_group(df: DataFrame, group: Column, actual: str, predicted: str) -> DataFrame:
    gap = F.col(actual) - F.col(predicted)
    return df.groupBy(group).agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def max_abs_error(a: DataFrame, b: DataFrame, value: str = "mean", ordinal: str = "row_ordinal") -> DataFrame:
    """One row: the largest difference by ordinal, and the first ordinal that has it."""
    x = a.select(ordinal, F.col(value).alias("_a")).join(b.select(ordinal, F.col(value).alias("_b")), ordinal)
    gap = F.abs(F.col("_a") - F.col("_b"))
    return x.agg(F.max(gap).alias("max_abs_error"), F.max_by(F.col(ordinal), F.struct(gap, -F.col(ordinal))).alias("at_ordinal"))


def derive_scenario(base: DataFrame, edits: Sequence[dict], ordinal: str = "row_ordinal") -> DataFrame:
    """A new input from a baseline: each edit has ``column``, ``kind`` (offset, factor, fixed), ``value`` and
    perhaps a range ``start..end`` of the column ``along`` (the ordinal unless given)."""
    out = base
    for e in edits:
        if e["kind"] not in ("offset", "factor", "fixed") or e["column"] not in base.columns:
            raise WorkbenchError("INVALID_DATA", "unknown edit", edit=str(e))
        c, along = F.col(e["column"]), F.col(e.get("along", ordinal))
        new = {"offset": c + F.lit(e["value"]), "factor": c * F.lit(e["value"]), "fixed": F.lit(e["value"])}[e["kind"]]
        inside = F.lit(True)
        if e.get("start") is not None:
            inside = inside & (along >= F.lit(e["start"]))
        if e.get("end") is not None:
            inside = inside & (along <= F.lit(e["end"]))
        out = out.withColumn(e["column"], F.when(inside, new).otherwise(c).cast(base.schema[e["column"]].dataType))
    return out


def scenario_lineage(spark_df: DataFrame, scenario_id: str, baseline_id: str, parent_id: str, edits: Sequence[dict]) -> DataFrame:
    """One row that describes a scenario; ``rows`` is counted from its input."""
    pairs = [x for k, e in enumerate(edits) for x in (F.lit(f"{k}:{e['column']}"), F.lit(f"{e['kind']} {e['value']}"))]
    changes = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return spark_df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(scenario_id).alias("scenario_id"), F.lit(baseline_id).alias("baseline_id"), F.lit(parent_id).alias("parent_id"), changes.alias("modifications"), "rows")


def ordinal_mapping(baseline: DataFrame, scenario: DataFrame, *, key: str = "business_key", ordinal: str = "row_ordinal") -> DataFrame:
    """``scenario_ordinal, baseline_ordinal, <key>`` of each row of a scenario. Keys may repeat: the k-th row of a key, by ordinal, stands for the k-th of it in the
    baseline; rows that the baseline lacks have none. Ordinals must be their side's own."""
    def turned(df: DataFrame, name: str) -> DataFrame:
        turn = F.row_number().over(Window.partitionBy(key).orderBy(ordinal))
        return df.select(key, F.col(ordinal).alias(name), turn.alias("_turn"))

    b, s = turned(baseline, "baseline_ordinal").alias("b"), turned(scenario, "scenario_ordinal").alias("s")
    equal = F.col(f"b.{key}").eqNullSafe(F.col(f"s.{key}")) & (F.col("b._turn") == F.col("s._turn"))
    return s.join(b, equal, "left").select("scenario_ordinal", "baseline_ordinal", f"s.{key}")


def experiment_runs(runs: DataFrame) -> DataFrame:
    """``experiment_id, request_id, input_snapshot_id`` → a row for each request of an experiment, once, with its snapshot and ``n_snapshots``, how many
    different ones the experiment used."""
    once = runs.groupBy("experiment_id", "request_id").agg(F.min("input_snapshot_id").alias("input_snapshot_id"))
    used = runs.groupBy("experiment_id").agg(F.countDistinct("input_snapshot_id").alias("n_snapshots"))
    return once.join(used, "experiment_id")


def experiment_snapshots(runs: DataFrame) -> DataFrame:
    """``experiment_id, input_snapshot_id, requests``: the snapshots that each experiment used, with the requests that did."""
    return runs.groupBy("experiment_id", "input_snapshot_id").agg(F.countDistinct("request_id").alias("requests"))


def axis_missing(column: str) -> Column:
    """Null, blank text, and numbers that are not finite."""
    c = F.col(column)
    text = F.trim(c.cast("string"))
    return c.isNull() | (text == "") | F.coalesce(~is_finite(c.try_cast("double")) & text.rlike("(?i)^[+-]?(nan|inf(inity)?)$"), F.lit(False))


def axis_kind(df: DataFrame, column: str) -> str:
    """number, time or text: the kind that all known values of the column have."""
    c = F.when(~axis_missing(column), F.trim(F.col(column).cast("string")))
    row = df.agg(F.count(c).alias("n"), F.count(c.try_cast("double")).alias("number"), F.count(c.try_cast("timestamp")).alias("time")).first()
    return "number" if row["number"] == row["n"] else "time" if row["time"] == row["n"] else "text"


def axis_order(df: DataFrame, column: str, ordinal: str = "row_ordinal", name: str = "position") -> DataFrame:
    """Positions by a column's values, missing last (null, blank, not finite), ties by row: numbers (also as text) by size, times by time."""
    kind, missing = axis_kind(df, column), axis_missing(column)
    c = F.when(~missing, F.trim(F.col(column).cast("string")) if kind != "text" else F.col(column).cast("string"))
    key = c.try_cast("double") if kind == "number" else c.try_cast("timestamp") if kind == "time" else c
    return global_index(df, [missing.asc(), key.asc_nulls_last(), F.col(ordinal).asc()], name)


def scope_window(df: DataFrame, start: float | None = None, end: float | None = None, position: str = "position") -> DataFrame:
    """Rows from start to end by position: both rounded, halves up, kept within the rows, and swapped if need be. What is not finite
    or not given is the first or the last row."""
    last = df.agg(F.max(position).alias("n")).first()["n"] or 0

    def place(x: float | None, other: int) -> int:
        return min(max(math.floor(x + 0.5), 0), last) if x is not None and math.isfinite(x) else other

    lo, hi = sorted((place(start, 0), place(end, last)))
    return df.where(F.col(position).between(lo, hi))


def series_bounds(df: DataFrame, x: str, pad: float = 0.12) -> DataFrame:
    """One row: the range of ``x`` and of the values of mean, q25, q75 and truth, the latter padded."""
    ys = [F.when(is_finite(F.col(c).cast("double")), F.col(c).cast("double")) for c in ("mean", "q25", "q75", "truth") if c in df.columns]
    low, high = (f(*ys) if len(ys) > 1 else ys[0] for f in (F.least, F.greatest))
    out = df.agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(low).alias("_lo"), F.max(high).alias("_hi"))
    room = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) * pad).otherwise(1.0)
    return out.select("x_min", "x_max", (F.col("_lo") - room).alias("y_min"), (F.col("_hi") + room).alias("y_max"))


def interval_available(df: DataFrame) -> DataFrame:
    """One row: whether every point has finite q25 and q75, and how many lack the truth."""
    both = is_finite(F.col("q25").cast("double")) & is_finite(F.col("q75").cast("double"))
    return df.agg(F.coalesce(F.bool_and(both), F.lit(False)).alias("available"), F.count_if(~is_finite(F.col("truth").cast("double"))).alias("gaps"))


def series_segments(df: DataFrame, order: Sequence[str | Column], value: str = "truth") -> DataFrame:
    """All rows with ``segment``, the number from 1 of the unbroken line that the point belongs to, null in a gap; ``gap``, the number of the gap, null on
    a line; and ``interval``, whether every point of the series has finite q25 and q75. A value that is not finite is a gap."""
    known = is_finite(F.col(value).cast("double"))
    x = Ordered(df.withColumn("_known", known), order).previous("_before", F.col("_known"))
    x.running("segment", (F.col("_known") & ~F.coalesce("_before", F.lit(False))).cast("long"))
    x.running("gap", (~F.col("_known") & F.coalesce("_before", F.lit(True))).cast("long"))
    out = x.rows().withColumns({"segment": F.when(F.col("_known"), F.col("segment")), "gap": F.when(~F.col("_known"), F.col("gap"))})
    whole = interval_available(df).select(F.col("available").alias("interval"))  # one row
    return out.drop("_known", "_before").crossJoin(F.broadcast(whole))
