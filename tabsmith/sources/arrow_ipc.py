"""Arrow IPC files as a Spark data source, in batches and as a stream.

Reading: a task for each group of record batches, found from the files' footers; only the columns asked for are read, and batches are skipped whose
stored least and greatest values show that the conditions given with the path keep none of their rows. (Spark's own pushdown into Python sources is not used: scans of
one DataFrame under different filters share a reader there, and would lose rows.) Writing: a file for each task, and
beside it a hidden one with the least and greatest values of its batches; files get their names on commit.
"""

from __future__ import annotations

import json
import math
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from tabsmith.errors import WorkbenchError

#: Rows of a batch that is written, batches of a task that reads, and letters of a text that is kept as least or greatest.
ROWS, BATCHES, LETTERS = 1 << 16, 8, 64
Bounds = dict[str, tuple[Any, Any]]
Condition = tuple[str, str, Any]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _infos(uri: str) -> list[pafs.FileInfo]:
    fs, root = _open(uri)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [info]
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.path.endswith(".arrow") and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


def _bounds_path(path: str) -> str:
    return posixpath.join(posixpath.dirname(path), f"_bounds-{posixpath.basename(path)}.json")


def bounds_of(batch: pa.RecordBatch) -> Bounds:
    """The least and greatest value of each column of numbers without NaN, or of short texts; and no entry for a column without a value."""
    out: Bounds = {}
    for name, col in zip(batch.schema.names, batch.columns, strict=True):
        if not (pa.types.is_integer(col.type) or pa.types.is_floating(col.type) or pa.types.is_string(col.type)) or col.null_count == len(col):
            continue
        lo, hi = (x.as_py() for x in pc.min_max(col).values())
        if isinstance(lo, str) and max(len(lo), len(hi)) > LETTERS or isinstance(lo, float) and (not math.isfinite(lo) or not math.isfinite(hi) or pc.any(pc.is_nan(col)).as_py()):
            continue
        out[name] = lo, hi
    return out


#: What a condition may ask of a column: a comparison with a value, one of a list (in), or any value (known).
OPERATORS = ("=", "<", "<=", ">", ">=", "in", "known")


def may_hold(bounds: Bounds, empty: Sequence[str], where: Sequence[Condition]) -> bool:
    """Whether a batch with these bounds can have a row that meets all conditions; ``empty``: columns known to hold nulls only."""
    for name, how, value in where:
        if name in empty:
            return False
        values = [v for v in (value if how == "in" else [value]) if v is not None]
        if name not in bounds or how == "known" or any(isinstance(v, bool) or isinstance(v, str) != isinstance(bounds[name][0], str) for v in values):
            continue
        lo, hi = bounds[name]
        fits = {"<": lambda v: lo < v, "<=": lambda v: lo <= v, ">": lambda v: hi > v, ">=": lambda v: hi >= v}.get(how, lambda v: lo <= v <= hi)
        if not any(map(fits, values)):
            return False
    return True


def as_filter(where: Sequence[Condition]) -> Column:
    """The conditions as Spark's filter, under which null meets none."""
    out = F.lit(True)
    for name, how, value in where:
        c = F.col(f"`{name}`")
        made = {"=": lambda: c == value, "<": lambda: c < value, "<=": lambda: c <= value, ">": lambda: c > value, ">=": lambda: c >= value, "in": lambda: c.isin(list(value)), "known": lambda: c.isNotNull()}
        out = out & made[how]()
    return out


@dataclass
class Batches(InputPartition):
    """Record batches of a file, by number."""

    path: str
    numbers: list[int]


def _partitions(uri: str, paths: Sequence[str], where: Sequence[Condition]) -> list[Batches]:
    fs, _ = _open(uri)
    out = []
    for path in paths:
        with fs.open_input_file(path) as f, pa.ipc.open_file(f) as r:
            numbers, names = list(range(r.num_record_batches)), r.schema.names
        if where and fs.get_file_info(_bounds_path(path)).is_file:
            with fs.open_input_stream(_bounds_path(path)) as f:
                known = [json.loads(line) for line in f.read().decode().splitlines()]
            if len(known) == len(numbers):
                numbers = [k for k in numbers if may_hold(known[k]["bounds"], [c for c in known[k]["empty"] if c in names], where)]
        out += [Batches(path, numbers[k : k + BATCHES]) for k in range(0, len(numbers), BATCHES)]
    return out


def _read(uri: str, schema: StructType, partition: Batches | None) -> Iterator[pa.RecordBatch]:
    if partition is None:  # Spark reads once where there is no partition
        return
    fs, _ = _open(uri)
    want = to_arrow_schema(schema)
    with fs.open_input_file(partition.path) as f:
        with pa.ipc.open_file(f) as r:
            fields = [r.schema.get_field_index(n) for n in want.names]
        f.seek(0)
        with pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=fields)) as r:
            for k in partition.numbers:
                yield from pa.Table.from_batches([r.get_batch(k)]).select(want.names).cast(want).to_batches()


class ArrowIpcReader(DataSourceReader):
    def __init__(self, uri: str, schema: StructType, where: Sequence[Condition]) -> None:
        self.uri, self.schema, self.where = uri, schema, where

    def partitions(self) -> list[Batches]:
        return _partitions(self.uri, [f.path for f in _infos(self.uri)], self.where)

    def read(self, partition: Batches | None) -> Iterator[pa.RecordBatch]:
        return _read(self.uri, self.schema, partition)


class ArrowIpcStreamReader(DataSourceStreamReader):
    """New files, in the order of their times and names. A file whose time is before one that was read is not seen."""

    def __init__(self, uri: str, schema: StructType) -> None:
        self.uri, self.schema = uri, schema

    def _files(self) -> list[tuple[int, str]]:
        return sorted((f.mtime_ns or 0, f.path) for f in _infos(self.uri))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self._files()
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Batches]:
        a, b = ((x["time"], x["path"]) for x in (start, end))
        return _partitions(self.uri, [f[1] for f in self._files() if a < f <= b], [])

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        return _read(self.uri, self.schema, partition)


@dataclass
class Wrote(WriterCommitMessage):
    temporary: str
    name: str
    bounds: list[str] = field(default_factory=list)


class ArrowIpcWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, schema: StructType, overwrite: bool, rows: int) -> None:
        self.uri, self.schema, self.overwrite, self.rows = uri, schema, overwrite, rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        from pyspark import TaskContext

        fs, root = _open(self.uri)
        fs.create_dir(posixpath.join(root, "_temporary"), recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.arrow"
        tmp = posixpath.join(root, "_temporary", name)
        want, bounds = to_arrow_schema(self.schema), []
        with fs.open_output_stream(tmp) as f, pa.ipc.new_file(f, want) as w:
            for b in iterator:
                for part in pa.Table.from_batches([b]).cast(want).to_batches(max_chunksize=self.rows):
                    w.write_batch(part)
                    empty = [n for n, c in zip(part.schema.names, part.columns, strict=True) if c.null_count == len(c)]
                    bounds.append(json.dumps({"bounds": bounds_of(part), "empty": empty}))
        with fs.open_output_stream(_bounds_path(tmp)) as f:
            f.write("\n".join(bounds).encode())
        return Wrote(tmp, posixpath.join(root, name))

    def commit(self, messages: list[Wrote | None]) -> None:
        fs, root = _open(self.uri)
        if self.overwrite:
            for old in _infos(self.uri):
                fs.delete_file(old.path)
        for m in messages:
            if m:
                fs.move(_bounds_path(m.temporary), _bounds_path(m.name))
                fs.move(m.temporary, m.name)
        fs.delete_dir(posixpath.join(root, "_temporary"))
        fs.open_output_stream(posixpath.join(root, "_SUCCESS")).close()

    def abort(self, messages: list[Wrote | None]) -> None:
        fs, root = _open(self.uri)
        fs.delete_dir(posixpath.join(root, "_temporary"))


class ArrowIpcSource(DataSource):
    """Options: ``columns``, a JSON list of those to read; ``where``, one of conditions by which batches are skipped; ``rows``, of a batch that is written."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        fs, _ = _open(self.options["path"])
        with fs.open_input_file(_infos(self.options["path"])[0].path) as f, pa.ipc.open_file(f) as r:
            found = from_arrow_schema(r.schema)
        wanted = json.loads(self.options.get("columns", "null"))
        return found if wanted is None else StructType([found[c] for c in wanted])

    def reader(self, schema: StructType) -> ArrowIpcReader:
        return ArrowIpcReader(self.options["path"], schema, json.loads(self.options.get("where", "[]")))

    def streamReader(self, schema: StructType) -> ArrowIpcStreamReader:
        return ArrowIpcStreamReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArrowIpcWriter:
        return ArrowIpcWriter(self.options["path"], schema, overwrite, int(self.options.get("rows", ROWS)))


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ArrowIpcSource)
    return spark


def read_arrow_ipc(spark: SparkSession, path: str, *, columns: Sequence[str] | None = None, where: Sequence[Condition] = ()) -> DataFrame:
    """All columns, or only those named, the others are not decoded; all rows, or those that meet the conditions ``(column, operator, value)``, of columns that are read
    (see ``OPERATORS``)."""
    if bad := [w for w in where if w[1] not in OPERATORS]:
        raise WorkbenchError("INVALID_QUERY", "no such operator", operators=[w[1] for w in bad])
    options = {"where": json.dumps([list(w) for w in where])} | ({} if columns is None else {"columns": json.dumps(list(columns))})
    df = _registered(spark).read.format("arrow_ipc").options(**options).load(path)
    return df.where(as_filter(where)) if where else df


def stream_arrow_ipc(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of files as they arrive."""
    return _registered(spark).readStream.format("arrow_ipc").schema(schema).load(path)


def write_arrow_ipc(df: DataFrame, path: str, *, rows: int = ROWS) -> None:
    _registered(df.sparkSession)
    df.write.format("arrow_ipc").option("rows", rows).mode("append").save(path)
