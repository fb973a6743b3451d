"""Comparing tables: cell by cell with a tolerance, after normalising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.errors import WorkbenchError
from tabsmith.operators.times import TIMES, utc_text


def normalize_cells(df: DataFrame, digits: int = 6) -> DataFrame:
    """Times as UTC ISO text, floats rounded."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, TIMES):
            c = utc_text(c, f.dataType, 3)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), digits)
        out.append(c.alias(f.name))
    return df.select(*out)


EXACT = (T.IntegralType, T.DecimalType)


def _differs(kinds: tuple[T.DataType, T.DataType], a: Column, b: Column, tol: float) -> Column:
    """Integers and decimals are held against each other exactly, other numbers as doubles."""
    if all(isinstance(k, T.NumericType) for k in kinds):
        if all(isinstance(k, EXACT) for k in kinds):
            a, b = (x.cast("decimal(38,0)") if isinstance(k, T.IntegralType) else x for x, k in zip((a, b), kinds, strict=True))
            gap = F.abs(a - b).cast("double")
        else:
            gap = F.abs(a.cast("double") - b.cast("double"))
        return ~(a.eqNullSafe(b) | F.coalesce(gap <= tol, F.lit(False)))
    groups = (T.NumericType, T.BooleanType, T.StringType, T.BinaryType, (T.DateType, *TIMES))
    if any(isinstance(kinds[0], g) != isinstance(kinds[1], g) for g in groups):  # text that looks like a number is none
        return a.isNotNull() | b.isNotNull()
    return ~a.eqNullSafe(b)


def diff_tables(actual: DataFrame, expected: DataFrame, *, on: str = "row_ordinal", columns: Sequence[str] | None = None, tol: float = 1e-6) -> DataFrame:
    """``on, column, actual, expected`` for each cell that differs; a row on one side only differs as column ``<row>``.
    Cells of other kinds (text and a number) differ unless both are null. Raises if the columns differ, or if a position repeats. A join on the position and a long form of the mismatches only."""
    if sorted(actual.columns) != sorted(expected.columns):
        raise WorkbenchError("SCHEMA_MISMATCH", "columns differ", actual=actual.columns, expected=expected.columns)
    for side in (actual, expected):
        if bad := side.groupBy(on).count().where("count > 1").head(1):
            raise WorkbenchError("INVALID_DATA", "a position repeats", position=str(bad[0][on]), rows=bad[0]["count"])
    names = list(columns or [c for c in actual.columns if c != on])
    a, b = actual.select(on, F.struct(*names).alias("a")), expected.select(on, F.struct(*names).alias("b"))
    x = a.join(b, on, "full_outer")
    kinds = {f.name: (actual.schema[f.name].dataType, f.dataType) for f in expected.schema.fields}
    one = F.col("a").isNull() | F.col("b").isNull()
    cells = [F.when(one, F.when(F.lit(k == 0), F.struct(F.lit("<row>").alias("column"), F.when(F.col("a").isNull(), "missing").otherwise("extra").alias("actual"), F.lit(None).cast("string").alias("expected")))).when(_differs(kinds[c], F.col(f"a.{c}"), F.col(f"b.{c}"), tol), F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").cast("string").alias("actual"), F.col(f"b.{c}").cast("string").alias("expected"))) for k, c in enumerate(names)]
    return x.select(on, F.explode(F.array_compact(F.array(*cells))).alias("d")).select(on, "d.*")


def stats_check(measured: DataFrame, expected: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Differences of two statistics tables (see ``catalog.table_stats``) by column name."""
    return diff_tables(measured, expected, on="column_name", tol=tol)
