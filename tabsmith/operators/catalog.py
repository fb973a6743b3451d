"""Statistics, digests, snapshots and versions."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.errors import WorkbenchError
from tabsmith.operators.dataset import NUMERIC
from tabsmith.operators.features import SAFE, finite_double
from tabsmith.operators.order import global_index
from tabsmith.operators.recon import diff_tables
from tabsmith.operators.times import TIMES, utc_text
from tabsmith.storage import claim, stored

#: Parts of names that tell of a secret.
SECRET = r"(?i)password|token|secret|authorization|credential"
#: The folder of a snapshot's rows, and how many of them are named in a filter.
SEGMENT, SEGMENTS = "__segment", 1000
#: Folders of a snapshot, at most: in a longer one a folder has as many whole segments as it takes.
FOLDERS = 1024
REGISTRY = "snapshot_id string, source string, format string, raw_digest string, logical_digest string, rows long, path string, version int"


def table_stats(df: DataFrame) -> DataFrame:
    """A row per column: ``column_name, type, row_count, nulls, nullable, min, max, mean`` over finite numbers.
    One aggregation for all columns."""
    aggs, kinds = [F.count(F.lit(1)).alias("n")], []
    for k, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"u{k}"))
        numeric = isinstance(f.dataType, NUMERIC)
        kinds.append((f.name, f.dataType.simpleString(), numeric))
        if numeric:
            v = finite_double(c)
            aggs += [F.min(v).alias(f"a{k}"), F.max(v).alias(f"b{k}"), F.avg(v).alias(f"m{k}")]
    none = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("type"),
            F.col("n").alias("row_count"),
            F.col(f"u{k}").alias("nulls"),
            (F.col(f"u{k}") > 0).alias("nullable"),
            (F.col(f"a{k}") if numeric else none).alias("min"),
            (F.col(f"b{k}") if numeric else none).alias("max"),
            (F.col(f"m{k}") if numeric else none).alias("mean"),
        )
        for k, (name, kind, numeric) in enumerate(kinds)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def key_set(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct().orderBy(*keys)


def number_text(c: Column, kind: T.DataType) -> Column:
    """A number as text, the same for equal numbers of any type; integers and decimals lose no digit."""
    if isinstance(kind, T.IntegralType):
        return c.cast("string")
    if isinstance(kind, T.DecimalType):
        plain = c.cast("string")
        short = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        v = c.cast("double")
        return F.when(v.cast(kind) == c, number_text(v, T.DoubleType())).otherwise(short)
    v = c.cast("double")
    whole = (F.abs(v) <= SAFE) & (F.floor(v) == v)
    plain = F.when(F.coalesce(whole, F.lit(False)), v.cast("long").cast("string")).otherwise(v.cast("string"))
    return F.when((v == 0) & (v.cast("string") == "-0.0"), F.lit("-0")).otherwise(plain)


def canonical_row(df: DataFrame) -> Column:
    """A row as JSON, the same whatever format it came from: numbers and times (of UTC) as text."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, NUMERIC):
            c = number_text(c, f.dataType)
        elif isinstance(f.dataType, TIMES):
            c = utc_text(c, f.dataType)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        cells.append(c.alias(f.name))
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


def block_digests(df: DataFrame, order: Sequence[str | Column] | None = None, *, ordinal: str | None = None, block: int = 4096) -> DataFrame:
    """``block, digest``: SHA-256 of the row digests of ``block`` consecutive rows. The rows are numbered by
    ``ordinal`` or, without one, in ``order``."""
    body = canonical_row(df.drop(ordinal) if ordinal else df)
    at = df if ordinal else global_index(df, order or df.columns, "__ordinal")
    place = F.col(ordinal or "__ordinal")
    rows = at.select(F.floor(place / block).alias("block"), place.alias("p"), F.sha2(body, 256).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "")
    return rows.groupBy("block").agg(F.sha2(joined, 256).alias("digest"))


def digest_tree(df: DataFrame, order: Sequence[str | Column] | None = None, *, ordinal: str | None = None, block: int = 4096, fan: int = 4096) -> DataFrame:
    """``level, block, digest``: level 0 has the digests of blocks of rows, each level above those of ``fan`` digests of the one below, until
    at most ``fan`` are left. A written table."""
    now = stored(block_digests(df, order, ordinal=ordinal, block=block).withColumn("level", F.lit(0)), "digests")
    tree, n, level = now, now.count(), 0
    while n > fan:
        level += 1
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"]), "")
        now = stored(now.groupBy(F.floor(F.col("block") / fan).alias("up")).agg(F.sha2(joined, 256).alias("digest")).select(F.col("up").alias("block"), "digest", F.lit(level).alias("level")), "digests")
        tree, n = tree.unionByName(now), -(-n // fan)
    return tree.select("level", "block", "digest")


def root_digest(tree: DataFrame, names: Sequence[str]) -> str:
    """SHA-256 of column names and the digests of the highest level."""
    top = tree.agg(F.max("level")).first()[0] or 0
    parts = [r["digest"] for r in tree.where(F.col("level") == top).orderBy("block").collect()]  # at most ``fan``
    return hashlib.sha256((json.dumps(list(names)) + "".join(parts)).encode()).hexdigest()


def logical_digest(df: DataFrame, order: Sequence[str | Column] | None = None, *, ordinal: str | None = None, block: int = 4096, fan: int = 4096) -> str:
    """SHA-256 of column names and rows in order: digests of blocks, then of blocks of digests, until few are left."""
    return root_digest(digest_tree(df, order, ordinal=ordinal, block=block, fan=fan), [c for c in df.columns if c != ordinal])


def changed_blocks(found: DataFrame, want: DataFrame, *, fan: int = 4096) -> DataFrame:
    """``block, fault`` (changed, missing, extra) of the blocks whose digests differ between two trees. Levels are compared from the top, and only
    blocks below one that differs are looked at."""
    tops = [t.agg(F.max("level")).first()[0] or 0 for t in (found, want)]
    above = None
    for level in range(min(tops), -1, -1):  # trees of another height differ above that
        a, b = (t.where(F.col("level") == level) for t in (found, want))
        if above is not None:
            a, b = (t.join(above, F.floor(F.col("block") / fan) == F.col("up"), "left_semi") for t in (a, b))
        above = _faults(a, b)
        if level:
            above = stored(above.select(F.col("block").alias("up")), "differing")
    return above


def _faults(found: DataFrame, want: DataFrame) -> DataFrame:
    x = want.select("block", F.col("digest").alias("want")).join(found.select("block", F.col("digest").alias("found")), "block", "full_outer")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("found") != F.col("want"), "changed")
    return x.select("block", fault.alias("fault")).where("fault is not null")


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = pafs.FileSystem.from_uri(row["path"])
            h = hashlib.sha256()
            with fs.open_input_stream(path, compression=None) as f:
                while part := f.read(1 << 22):
                    h.update(part)
            yield pa.RecordBatch.from_pylist([row | {"sha256": h.hexdigest()}])


def raw_digest(spark: SparkSession, path: str, *, whole: int = 1 << 28, recursive: bool = False) -> DataFrame:
    """``path, length, sha256`` of each file. Files of up to ``whole`` bytes are read as one value each, larger ones in pieces."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    small = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", "length").repartition("path")
    return small.union(large.mapInArrow(_hash_files, "path string, length long, sha256 string"))


def snapshot_id(source_format: str, digest: str, types: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps({"format": source_format, "digest": digest, "types": types}, sort_keys=True).encode()).hexdigest()


def _registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    return _registry(spark, f"{root}/registry", REGISTRY)


def check_source_name(name: str, taken: Sequence[str], *, replacing: bool = False) -> None:
    if not name or not name.replace("_", "a").isalnum() or name[0].isdigit() or name.startswith("__"):
        raise WorkbenchError("NAME_CONFLICT", "not a usable table name", name=name)
    if not replacing and name.lower() in {t.lower() for t in taken}:
        raise WorkbenchError("NAME_CONFLICT", "the name is taken", name=name)


def save_snapshot(df: DataFrame, root: str, source: str, source_format: str, order: Sequence[str | Column] | None = None, *, snapshot: str | None = None, block: int = 4096, segment: int = 1 << 20) -> str:
    """Writes an immutable snapshot and registers it as the source's next version. Equal content under the same id is
    a no-op, other content an error. It can be seen once its registry row is written, after the data and its digest tree. A version is
    claimed by a file that only one writer can make. The rows are kept in folders of ``segment`` consecutive ones, or of a multiple where that makes more than
    ``FOLDERS``, so that a part can be read."""
    spark = df.sparkSession
    if df.isEmpty():
        raise WorkbenchError("EMPTY_INPUT", "the source has no rows", source=source)
    numbered = global_index(df, order or df.columns, "__ordinal")
    tree = digest_tree(numbered, ordinal="__ordinal", block=block)
    digest = root_digest(tree, df.columns)
    sid = snapshot or snapshot_id(source_format, digest, dict(df.dtypes))
    known = snapshots(spark, root)
    same = known.where(F.col("snapshot_id") == sid).select("logical_digest").head(1)
    if same:
        if same[0]["logical_digest"] != digest:
            raise WorkbenchError("SNAPSHOT_CORRUPT", "a snapshot of that id has other content", snapshot_id=sid)
        return sid
    path = f"{root}/data/snapshot_id={sid}"
    rows = numbered.count()
    segment *= -(-rows // (segment * FOLDERS))
    numbered.withColumn(SEGMENT, F.floor(F.col("__ordinal") / segment)).write.mode("overwrite").partitionBy(SEGMENT).parquet(path)
    tree.withColumns({"rows": F.lit(block), "segment": F.lit(segment)}).write.mode("overwrite").parquet(f"{root}/trees/snapshot_id={sid}")
    version = (known.where(F.col("source") == source).agg(F.max("version").alias("v")).first()["v"] or 0) + 1
    while not claim(spark, f"{root}/claims/{source}/{version}"):
        version += 1
    row = [(sid, source, source_format, None, digest, rows, path, version)]
    spark.createDataFrame(row, REGISTRY).coalesce(1).write.mode("append").parquet(f"{root}/registry")
    return sid


def snapshot_tree(spark: SparkSession, root: str, sid: str) -> DataFrame:
    """``level, block, digest, rows, segment``: the tree that was written with a snapshot, and its rows a block and a segment."""
    return spark.read.parquet(f"{root}/trees/snapshot_id={sid}")


def verify_blocks(spark: SparkSession, root: str, sid: str) -> DataFrame:
    """``block, fault`` of the blocks whose rows are not what was written."""
    want = snapshot_tree(spark, root, sid)
    size = want.select("rows").first()["rows"]
    rows = spark.read.parquet(f"{root}/data/snapshot_id={sid}").drop(SEGMENT)
    return changed_blocks(digest_tree(rows, ordinal="__ordinal", block=size), want)


def snapshot_blocks(spark: SparkSession, root: str, sid: str, blocks: DataFrame) -> DataFrame:
    """The rows of the given ``block`` numbers; only the segments that hold one are read."""
    shape = snapshot_tree(spark, root, sid).select("rows", "segment").first()
    df = spark.read.parquet(f"{root}/data/snapshot_id={sid}")
    segments = blocks.select(F.floor(F.col("block") * shape["rows"] / shape["segment"]).alias(SEGMENT)).distinct()
    few = [r[0] for r in segments.limit(SEGMENTS + 1).collect()]  # folders are pruned by their numbers; more of them are pruned by a join
    df = df.where(F.col(SEGMENT).isin(few)) if len(few) <= SEGMENTS else df.join(F.broadcast(segments), SEGMENT, "left_semi")
    return df.join(blocks, F.floor(F.col("__ordinal") / shape["rows"]) == F.col("block"), "left_semi").drop(SEGMENT)


def diff_snapshots(spark: SparkSession, root: str, a: str, b: str, *, tol: float = 1e-6) -> DataFrame:
    """``__ordinal, column, actual, expected`` of the cells in which two snapshots differ, by position. Their trees tell the blocks that differ, and only those are read."""
    trees = [snapshot_tree(spark, root, s) for s in (a, b)]
    sizes = [t.select("rows").first() for t in trees]
    if sizes[0] != sizes[1]:
        raise WorkbenchError("SCHEMA_MISMATCH", "the snapshots have blocks of another size")
    blocks = stored(changed_blocks(*trees).select("block"), "differing")
    return diff_tables(*(snapshot_blocks(spark, root, s, blocks) for s in (a, b)), on="__ordinal", tol=tol)


def read_snapshot(spark: SparkSession, root: str, sid: str, *, verify: bool = False) -> DataFrame | None:
    """The snapshot's rows with their ordinal, or None if it is unknown or, when verified, not what was written."""
    row = snapshots(spark, root).where(F.col("snapshot_id") == sid).head(1)
    if not row:
        return None
    try:
        df = spark.read.parquet(row[0]["path"]).drop(SEGMENT)
    except AnalysisException:
        return None
    if verify and (df.count() != row[0]["rows"] or not verify_blocks(spark, root, sid).isEmpty()):
        return None
    return df


def list_versions(registry: DataFrame) -> DataFrame:
    return registry.orderBy("source", "version")


def next_versions(registry: DataFrame, new: DataFrame) -> DataFrame:
    """``source, snapshot_id`` (``new``, one a source) with the version each is registered as."""
    last = registry.groupBy("source").agg(F.max("version").alias("v"))
    return new.join(last, "source", "left").withColumn("version", F.coalesce("v", F.lit(0)) + 1).drop("v")


def reference_counts(*users: DataFrame) -> DataFrame:
    """``snapshot_id, references`` over tables of users, a row for each use."""
    x = users[0].select("snapshot_id")
    for u in users[1:]:
        x = x.union(u.select("snapshot_id"))
    return x.where("snapshot_id is not null").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("references"))


def collect_unreferenced(registry: DataFrame, references: DataFrame) -> DataFrame:
    """Versions that nothing refers to and that aren't their source's latest."""
    last = registry.groupBy("source").agg(F.max("version").alias("version"))
    return registry.join(references.where("references > 0"), "snapshot_id", "left_anti").join(last, ["source", "version"], "left_anti")


def save_experiments(known: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (``id, revision, body``) to append; raises if one is known with another body."""
    both = new.join(known.select("id", "revision", F.col("body").alias("_body")), ["id", "revision"], "left")
    if bad := both.where("_body is not null and _body <> body").head(1):
        raise WorkbenchError("SNAPSHOT_CORRUPT", "the revision is known with another content", id=bad[0]["id"], revision=bad[0]["revision"])
    return both.where("_body is null").drop("_body")


def latest_revisions(experiments: DataFrame) -> DataFrame:
    return experiments.groupBy("id").agg(F.max("revision").alias("revision"), F.max_by("body", "revision").alias("body"))


def strip_credentials(params: Column, kind: T.DataType | None = None) -> Column:
    """Parameters without the keys that name secrets. ``kind`` is their type, a flat map unless given; maps, structs and lists
    inside are stripped as well."""
    if kind is None:
        return F.map_filter(params, lambda k, v: ~k.rlike(SECRET))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.map_filter(params, lambda k, v: ~k.rlike(SECRET)), lambda k, v: strip_credentials(v, kind.valueType))
    if isinstance(kind, T.ArrayType):
        return F.transform(params, lambda v: strip_credentials(v, kind.elementType))
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if not re.search(SECRET, f.name)]
        return F.when(params.isNotNull(), F.struct(*[strip_credentials(params[f.name], f.dataType).alias(f.name) for f in kept]))
    return params


def restore_check(experiments: DataFrame, registry: DataFrame, corrupt: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``id, snapshots`` (array, the first of them the dataset's), known snapshots, and ids of corrupt ones → ``id, status, missing``. A corrupt snapshot is
    as good as gone. needs-data: one that the experiment names is gone, and ``missing`` names it; corrupt: it names none; else restored. Of
    the ids in ``wanted`` (all that are known, unless given) those that no experiment has are missing."""
    there = registry.select("snapshot_id").distinct().join(corrupt.select("snapshot_id"), "snapshot_id", "left_anti").withColumn("there", F.lit(True))
    each = experiments.select("id", F.explode_outer("snapshots").alias("snapshot_id"))
    x = each.join(there, "snapshot_id", "left")
    gone = F.col("snapshot_id").isNotNull() & F.col("there").isNull()
    out = x.groupBy("id").agg(F.count("snapshot_id").alias("n"), F.array_sort(F.collect_set(F.when(gone, F.col("snapshot_id")))).alias("missing"))
    status = F.when(F.size("missing") > 0, "needs-data").when(F.col("n") == 0, "corrupt").otherwise("restored")
    out = out.select("id", status.alias("status"), "missing")
    if wanted is None:
        return out
    none = F.array().cast("array<string>")
    return wanted.select("id").distinct().join(out, "id", "left").select("id", F.coalesce("status", F.lit("missing")).alias("status"), F.coalesce("missing", none).alias("missing"))
