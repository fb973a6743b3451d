"""Typed import: CSV, JSON, Parquet and Arrow files with strict rules for nulls and types.

Null or empty: in CSV ``\\N`` and an unquoted empty cell are null, a quoted empty cell is an empty string.
Types are inferred over whole columns, in one aggregation for all; declared types win.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.errors import WorkbenchError
from tabsmith.operators.catalog import check_source_name, raw_digest
from tabsmith.operators.features import SAFE, is_inf
from tabsmith.sources import json_records
from tabsmith.sources.csv_records import records
from tabsmith.storage import fresh_path

CORRUPT = "__corrupt"
#: What counts as a number and as an ISO-8601 time.
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
TIME = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
INTEGER = r"^[+-]?\d+$"
DECLARED = {"string": "string", "number": "double", "boolean": "boolean", "timestamp": "timestamp"}


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The first line's names; raises where one is empty or repeats."""
    lines = spark.read.text(path).limit(1).collect()
    if not lines:
        raise WorkbenchError("EMPTY_INPUT", "the file has no line", path=path)
    return _names(lines[0]["value"].removeprefix("\ufeff"))


def _names(line: str) -> list[str]:
    names = [x.strip() for x in next(csv.reader(io.StringIO(line, newline="")))]
    if any(not n for n in names) or len({n.lower() for n in names}) < len(names):
        raise WorkbenchError("SCHEMA_MISMATCH", "column names are empty or repeat", columns=names)
    return names


def _csv_rows(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Column names and rows of text cells, with ``CORRUPT`` for the text of ragged ones. Where no cell has a line break Spark's own reader cuts the files."""
    found = records(spark, path)
    cell = {"nullValue": "\\N", "quote": '"', "escape": '"', "columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}
    if found is None:
        names = csv_header(spark, path)
        schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(CORRUPT, T.StringType())])
        return names, spark.read.csv(path, schema=schema, header=True, enforceSchema=False, **cell)
    heads = [r["value"] for r in found.where("first").select(F.ltrim("value", F.lit("\ufeff")).alias("value")).distinct().limit(2).collect()]
    names = _names(heads[0])
    if len(heads) > 1:
        raise WorkbenchError("SCHEMA_MISMATCH", "a file's header differs", expected=names)
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, CORRUPT])
    return names, found.where("not first").select(F.from_csv("value", ddl, cell).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, *, infer: bool = True, types: dict[str, str] | None = None) -> DataFrame:
    """Rows of CSV files with one header; cells may hold line breaks, and files are cut in parallel all the same (see ``csv_records``). Blank
    lines are dropped; ragged rows, open quotes and a file with other names or another order of them raise. The checks and
    the inference are one pass over the files, after one that counts quotes."""
    names, raw = _csv_rows(spark, path)
    quotes = F.length(F.col(CORRUPT)) - F.length(F.replace(F.col(CORRUPT), F.lit('"')))
    checks = [F.count_if(F.col(CORRUPT).isNotNull()).alias("ragged"), F.count_if(quotes % 2 == 1).alias("open"), F.first(CORRUPT, True).alias("sample")]
    df = raw.drop(CORRUPT)
    try:
        row = raw.agg(*checks, *inference_aggs(names)).first()
    except Exception as e:
        if "CSV header does not conform" in str(e):
            raise WorkbenchError("SCHEMA_MISMATCH", "a file's header differs", expected=names) from None
        raise
    if row["ragged"]:
        raise WorkbenchError("INVALID_FORMAT", "unterminated quote" if row["open"] else "rows of another length", rows=row["ragged"], sample=(row["sample"] or "")[:80])
    declared = types or {}
    if declared:
        df = cast_declared(df, declared)
    if infer:  # what was inferred holds for all values
        found = {c: inferred(row, k) for k, c in enumerate(names) if c not in declared}
        df = df.select(*[F.col(f"`{c}`").cast(DECLARED[found[c]]).alias(c) if found.get(c, "null") not in ("null", "string") else F.col(f"`{c}`") for c in names])
    return df


def read_json_rows(spark: SparkSession, path: str, where: str = "$", *, lines: bool = False, types: dict[str, str] | None = None) -> DataFrame:
    """An array of flat objects at ``$`` or a dotted path of a JSON document, of any size (see ``json_records``); with ``lines``, of one document a line, or
    lines that are objects."""
    if where != "$" and not re.fullmatch(r"\$(\.\w+)+", where):
        raise WorkbenchError("INVALID_FORMAT", "the path is $ or dotted names", path=where)
    if not lines:
        cut = fresh_path(spark, "json-rows")
        json_records.records(spark, path, where).write.text(cut)
        df = spark.read.json(cut)
        if not df.columns and spark.read.text(cut).isEmpty():
            raise WorkbenchError("EMPTY_INPUT", "the array is empty", path=path)
    else:
        df = spark.read.json(path)
        if where != "$":
            parts, kind = where.split(".")[1:], df.schema
            for p in parts:
                kind = kind[p].dataType if isinstance(kind, T.StructType) and p in kind.names else None
            if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
                raise WorkbenchError("INVALID_FORMAT", "there is no array of objects at the path", path=where)
            df = df.select(F.inline(F.col(".".join(f"`{p}`" for p in parts))))
    if "_corrupt_record" in df.columns or not df.columns:
        raise WorkbenchError("INVALID_FORMAT", "not JSON objects", path=path)
    reject_nested(df)
    return cast_declared(df, types) if types else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """All columns; days as ISO text; numbers that aren't finite raise. 64-bit integers stay what they are."""
    df = spark.read.parquet(path)
    reject_nested(df)
    check_lossless(df, integers=False)
    return df.select(*[F.date_format(f.name, "yyyy-MM-dd").alias(f.name) if isinstance(f.dataType, T.DateType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """Columns in the order in which they are first seen; missing ones are null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def inference_aggs(names: Sequence[str]) -> list[Column]:
    aggs = []
    for k, c in enumerate(names):
        v = F.trim(F.col(f"`{c}`"))
        unsafe = v.rlike(INTEGER) & F.coalesce(F.abs(v.try_cast("decimal(38,0)")) > SAFE, F.lit(True))
        finite = ~is_inf(v.try_cast("double"))
        aggs += [
            F.count(v).alias(f"n{k}"),
            F.bool_and(F.when(v.isNotNull(), v.rlike(NUMBER) & ~unsafe & finite)).alias(f"d{k}"),
            F.bool_and(F.lower(v).isin("true", "false")).alias(f"b{k}"),
            F.bool_and(F.when(v.isNotNull(), v.rlike(TIME) & v.try_cast("timestamp").isNotNull())).alias(f"t{k}"),
        ]
    return aggs


def inferred(row: Row, k: int) -> str:
    """The type of the ``k``-th column, from one row of ``inference_aggs``."""
    return "null" if not row[f"n{k}"] else "number" if row[f"d{k}"] else "boolean" if row[f"b{k}"] else "timestamp" if row[f"t{k}"] else "string"


def inference(df: DataFrame) -> DataFrame:
    """``column_name, type`` for columns of text: number, boolean, timestamp, null or string. Integers that a
    double can't hold make a column text."""
    row = df.agg(*inference_aggs(df.columns)).first()
    return df.sparkSession.createDataFrame([(c, inferred(row, k)) for k, c in enumerate(df.columns)], "column_name string, type string")


def import_types(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    found = {r["column_name"]: r["type"] for r in inference(df).collect()}
    found = {c: ("string" if t == "null" else t) for c, t in found.items()} | (types or {})
    return cast_declared(df, found)


def type_losses(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row: for each declared column the values that don't fit; finite numbers, exact integers."""
    def lost(c: str, t: str) -> Column:
        v = F.col(f"`{c}`")
        cast = v.try_cast(DECLARED[t])
        bad = v.isNotNull() & cast.isNull()
        if t == "number":
            text = v.cast("string")
            bad = bad | is_inf(cast) | F.coalesce(F.isnan(cast), F.lit(False)) | (text.rlike(INTEGER) & F.coalesce(F.abs(text.try_cast("decimal(38,0)")) > SAFE, F.lit(True)))
        return F.count_if(F.coalesce(bad, F.lit(False))).alias(c)

    return df.agg(*[lost(c, t) for c, t in types.items()])


def cast_declared(df: DataFrame, types: dict[str, str]) -> DataFrame:
    if unknown := {t for t in types.values() if t not in DECLARED}:
        raise WorkbenchError("SCHEMA_MISMATCH", "unknown types", types=sorted(unknown))
    if gone := [c for c in types if c not in df.columns]:
        raise WorkbenchError("SCHEMA_MISMATCH", "declared columns are missing", columns=gone)
    if types:
        row = type_losses(df, types).first().asDict()
        if bad := {c: n for c, n in row.items() if n}:
            c = next(iter(bad))
            sample = df.where(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(DECLARED[types[c]]).isNull()).select(f"`{c}`").head(1)
            raise WorkbenchError("TYPE_LOSS", "values do not fit the type", columns=bad, sample=str(sample[0][0])[:80] if sample else None)
    return df.select(*[F.col(f"`{c}`").cast(DECLARED[types[c]]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def reject_nested(df: DataFrame) -> None:
    if bad := [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]:
        raise WorkbenchError("TYPE_LOSS", "nested values", columns=bad)


def lossy_counts(df: DataFrame, *, integers: bool = True) -> DataFrame:
    """One row: for each numeric column its values that aren't finite or beyond exact integers."""
    aggs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            aggs.append(F.count_if(F.isnan(c) | is_inf(c)).alias(f.name))
        elif isinstance(f.dataType, T.LongType) and integers:
            aggs.append(F.count_if(~c.between(-SAFE, SAFE)).alias(f.name))
    return df.agg(*aggs) if aggs else df.agg(F.lit(0).alias("none"))


def check_lossless(df: DataFrame, *, integers: bool = True) -> None:
    bad = {k: v for k, v in lossy_counts(df, integers=integers).first().asDict().items() if v}
    if bad:
        raise WorkbenchError("TYPE_LOSS", "values that would be lost", columns=bad)


def reject_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise WorkbenchError("EMPTY_INPUT", "no rows")
    return df


def import_source(spark: SparkSession, df: DataFrame, name: str, *, replacing: bool = False) -> DataFrame:
    """Registers a view after all checks; a failed import leaves the old one."""
    check_source_name(name, [t.name for t in spark.catalog.listTables()], replacing=replacing)
    reject_empty(df).createOrReplaceTempView(name)
    return spark.table(name)


def synthetic_hourly(hours: DataFrame, index: str, origin: str = "2025-01-01 00:00:00") -> DataFrame:
    """Hourly weather and demand by modular arithmetic for each index in ``hours``. The constants of the fixture."""
    i = F.col(index)
    at = F.expr(f"timestampadd(HOUR, `{index}`, timestamp_ntz'{origin}')")
    hour = F.pmod(i, F.lit(24)).cast("int")
    digits = i.cast("string")
    out = hours.select(
        F.concat(F.lit("row-"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0"))).alias("source_row_id"),
        F.concat(F.lit("meter-"), F.lpad(F.pmod(i, F.lit(8)).cast("string"), 2, "0")).alias("business_key"),
        at.alias("timestamp_utc"),
        F.round(F.lit(7.5) + F.pmod(17 * i + 3, F.lit(181)) / 10, 6).alias("temperature_c"),
        F.round(F.pmod(29 * i + 7, F.lit(91)) / 10, 6).alias("wind_speed_ms"),
        F.round(F.greatest(F.lit(0.0), F.sin((hour - 6) * F.lit(3.141592653589793) / 12)) * (650 + F.pmod(11 * i, F.lit(120))), 6).alias("solar_wm2"),
        hour.alias("hour_utc"),
    )
    demand = 18 + 0.31 * F.col("temperature_c") + 0.52 * F.col("wind_speed_ms") + 0.006 * F.col("solar_wm2") + 0.17 * F.col("hour_utc")
    return out.withColumn("demand_mwh", F.round(demand, 6))


def audit_files(spark: SparkSession, path: str, manifest: DataFrame, *, max_bytes: int | None = None) -> DataFrame:
    """``name, fault`` (missing, extra, length, sha256) of the files below ``path`` against ``name, length, sha256``."""
    base = path.rstrip("/")
    found = raw_digest(spark, base, recursive=True)
    tail = F.element_at(F.split("path", F.lit(re.escape(base.split("://")[-1].rstrip("/")) + "/")), -1)
    found = found.select(tail.alias("name"), F.col("length").alias("l"), F.col("sha256").alias("h"))
    if max_bytes is not None and (found.agg(F.sum("l")).first()[0] or 0) > max_bytes:
        raise WorkbenchError("INPUT_LIMIT", "the files are larger than allowed", most=max_bytes)
    x = manifest.join(found, "name", "full_outer")
    fault = F.when(F.col("l").isNull(), "missing").when(F.col("length").isNull(), "extra").when(F.col("l") != F.col("length"), "length").when(F.col("h") != F.col("sha256"), "sha256")
    return x.select("name", fault.alias("fault")).where("fault is not null")


