"""Export: CSV, JSON, Parquet and Arrow, with metadata beside the data, and published result partitions."""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.errors import WorkbenchError
from tabsmith.operators.catalog import logical_digest
from tabsmith.operators.results import RESULT_COLUMNS, validate_results
from tabsmith.sources.arrow_ipc import read_arrow_ipc, write_arrow_ipc
from tabsmith.sources.readers import read_csv

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _columns(df: DataFrame) -> DataFrame:
    if not df.columns:
        raise WorkbenchError("EXPORT_FAILED", "no columns")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """Null as ``\\N``, empty text quoted."""
    _columns(df).write.option("timestampNTZFormat", STAMP).csv(path, header=True, nullValue="\\N", emptyValue='""', quote='"', escape='"', timestampFormat=STAMP, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv_quoted(df: DataFrame, path: str) -> None:
    """Every cell quoted, null as nothing."""
    _columns(df).write.csv(path, header=True, quoteAll=True, nullValue="", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, folder = pafs.FileSystem.from_uri(row["folder"])
            to, target = pafs.FileSystem.from_uri(row["file"])
            found = fs.get_file_info(pafs.FileSelector(folder))
            parts = sorted(f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")))
            to.create_dir(posixpath.dirname(target), recursive=True)
            temporary = posixpath.join(posixpath.dirname(target), f"_{uuid.uuid4().hex}")
            with to.open_output_stream(temporary) as out:
                for part in parts:
                    with fs.open_input_stream(part, compression=None) as f:
                        while piece := f.read(1 << 22):
                            out.write(piece)
            to.move(temporary, target)
            yield pa.RecordBatch.from_pylist([{"file": row["file"], "files": len(parts)}])


def join_files(spark: SparkSession, folders: dict[str, str]) -> None:
    """Puts the files of each folder one after the other, in the order of their names, into one file. Each is made by a task, which copies 4 MB at a time."""
    pairs = spark.createDataFrame(list(folders.items()), "folder string, file string")
    pairs.mapInArrow(_join, "file string, files long").collect()


def write_json(df: DataFrame, path: str) -> None:
    _columns(df).write.json(path, ignoreNullFields=False)


def write_parquet(df: DataFrame, path: str) -> None:
    _columns(df).write.parquet(path)


def export_metadata(df: DataFrame, **facts: object) -> dict:
    """What is needed to make the export again; ``aggregation`` tells whether its SQL groups rows."""
    sql = str(facts.get("sql") or "")
    low = sql.lower()
    return {"schema": [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema.fields], "aggregation": "group by" in low or any(f"{a}(" in low for a in ("count", "sum", "avg", "min", "max"))} | facts


def write_with_metadata(df: DataFrame, path: str, fmt: str, **facts: object) -> dict:
    """Data below ``data/``; then one JSON row below ``_metadata/``, which shows that the data is whole."""
    {"csv": write_csv, "json": write_json, "parquet": write_parquet, "arrow": write_arrow_ipc}[fmt](df, f"{path}/data")
    meta = export_metadata(df, format=fmt, **facts)
    df.sparkSession.range(1).select(F.lit(json.dumps(meta)).alias("value")).coalesce(1).write.text(f"{path}/_metadata")
    return meta


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/_metadata").first()["value"])


def view_name(request_id: str) -> str:
    return "predictions_" + re.sub(r"[^A-Za-z0-9_]", "_", request_id)


def register_results(results: DataFrame, root: str, request_id: str, rows: int) -> DataFrame:
    """Checks a request's results and replaces its partition below ``root``; the view ``view_name(request)``
    then shows it. Other requests' partitions are left alone."""
    validate_results(results, rows)
    spark = results.sparkSession
    out = results.withColumn("request_id", F.lit(request_id)).select(*RESULT_COLUMNS)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("request_id").parquet(root)
    view = query_results(spark, root, request_id)
    view.createOrReplaceTempView(view_name(request_id))
    return view


def all_results(spark: SparkSession, root: str) -> DataFrame:
    """Every request's rows; a request's id is text as it was given, also where it looks like a number."""
    found = spark.read.parquet(root).schema
    kinds = T.StructType([T.StructField(f.name, T.StringType() if f.name == "request_id" else f.dataType) for f in found.fields])
    return spark.read.schema(kinds).parquet(root)


def query_results(spark: SparkSession, root: str, request_id: str) -> DataFrame:
    return all_results(spark, root).where(F.col("request_id") == request_id).select(*RESULT_COLUMNS)


def round_trip(df: DataFrame, path: str) -> dict[str, DataFrame]:
    """``df`` as it is read back from each format that it is written in below ``path``."""
    spark, out = df.sparkSession, {}
    for fmt in ("csv", "parquet", "arrow"):
        write_with_metadata(df, f"{path}/{fmt}", fmt)
        if fmt == "csv":
            # a text column whose values all look like numbers would be read as numbers
            kinds = {f.name: "string" for f in df.schema.fields if f.dataType.simpleString() == "string"}
            out[fmt] = read_csv(spark, f"{path}/{fmt}/data", types=kinds)
        else:
            out[fmt] = spark.read.parquet(f"{path}/{fmt}/data") if fmt == "parquet" else read_arrow_ipc(spark, f"{path}/{fmt}/data")
    return out


def round_trip_check(df: DataFrame, path: str, order: Sequence[str]) -> DataFrame:
    """``format, same_digest, has_metadata``: written in each format, read again, and compared by digest."""
    want = logical_digest(df, order)
    rows = [(fmt, logical_digest(back, order) == want, len(read_metadata(df.sparkSession, f"{path}/{fmt}")["schema"]) == len(df.columns)) for fmt, back in round_trip(df, path).items()]
    return df.sparkSession.createDataFrame(rows, "format string, same_digest boolean, has_metadata boolean")
