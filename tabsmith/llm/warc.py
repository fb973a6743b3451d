"""Deterministic sharded WARC writer, and a reader.

Pages are cut in shards of about ``shard_bytes`` payload, at most ``MOST_SHARDS``, by their place in the order of page_id, digest
and url: the rows' keys and sizes are range-partitioned and written, and summed exactly over the rows before, so equal tables have equal
shards however they are stored, and neither an outlying id nor an id with many rows makes a shard larger. The shards' first keys, as many as there
are shards, go to all tasks; each shard is a partition of its own, sorted, and written as
gzip members, one a record; a file is closed when it has ``roll_bytes`` or more. Headers and digests are made
anew from the rows. A task writes under temporary names; the list of finished files is written as a table,
the listed files are moved to their names, and the manifest table, written last, commits the archive: a lost
task or executor leaves files that no list names.

Of pages with equal payloads of ``least`` bytes or more that with the smallest page_id is a response; the
others are revisits that keep the HTTP head and refer to it.

Defined cases: a null html is an empty payload; a null url gives the target urn:page:<id>; rows that share a
page_id are records of their own, all responses if their id is the smallest; a null page_id is a response in
the first shard; rows equal in id, digest and url stand side by side; a page of any length is one record, held whole by its task with its
compressed form; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import discard, join_counted, materialize, shared_dir, table

MOST_SHARDS = 1 << 14
DATE = "2000-01-01T00:00:00Z"
FILES = "shard int, seq int, temporary string, name string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit's block ends with the HTTP head, whose Content-Length is the payload's."""
    digest = base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join(url.split()) if url and url.strip() else f"urn:page:{page_id}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        fields.append(("X-Page", str(page_id)))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class _File:
    def __init__(self, out: str, shard: int, seq: int) -> None:
        self.shard, self.seq = shard, seq
        self.name = f"pages-{shard:05d}-{seq:05d}.warc.gz"
        self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
        self.fs, root = pafs.FileSystem.from_uri(out)
        self.fs.create_dir(posixpath.join(root, "_temporary"), recursive=True)
        self.sink = self.fs.open_output_stream(posixpath.join(root, self.temporary))
        self.bytes, self.records, self.sha = 0, 0, hashlib.sha256()

    def add(self, raw: bytes) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        self.sink.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> tuple:
        self.sink.close()
        return self.shard, self.seq, self.temporary, self.name, self.records, self.bytes, self.sha.hexdigest()


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in FILES.split(", ")]
    types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _writer(out: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _File | None = None
        for batch in batches:
            cols = [batch.column(c) for c in ("shard", "page_id", "url", "html", "refers_to")]
            for shard, page, url, html, refers in zip(*cols, strict=True):
                shard = shard.as_py()
                if now is None or now.shard != shard or now.bytes >= roll_bytes:
                    seq = now.seq + 1 if now is not None and now.shard == shard else 0
                    if now is not None:
                        yield _as_batch([now.close()])
                    now = _File(out, shard, seq)
                now.add(record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py()))
        if now is not None:
            yield _as_batch([now.close()])

    return run


def _mover(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for row in batch.to_pylist():
                a, b = posixpath.join(root, row["temporary"]), posixpath.join(root, row["name"])
                if fs.get_file_info(a).type != pafs.FileType.NotFound:  # a task that is run again finds it moved
                    fs.move(a, b)
                elif fs.get_file_info(b).size != row["bytes"]:
                    raise FileNotFoundError(a)
            yield batch

    return run


KEY = ["page_id", "sha", "u"]


def shard_keys(slim: DataFrame, shard_bytes: int) -> list[tuple]:
    """The first key of each shard but the first; nulls are the least page_id."""
    parts = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in KEY]
    dealt = materialize(slim.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "warc-ordered")
    counts = dealt.groupBy("_part").agg(F.sum("n").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_ahead", ahead)
    whole = counts.agg(F.sum("_n")).first()[0] or 0
    size = max(shard_bytes, -(-whole // MOST_SHARDS))
    own = Window.partitionBy("_part").orderBy(*order)
    before = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a partition
    at = dealt.withColumn("_own", before).join(F.broadcast(counts), "_part").select(*KEY, F.floor((F.col("_ahead") + F.col("_own")) / size).alias("shard"))
    least = at.groupBy("shard").agg(F.min(F.struct(*KEY)).alias("k")).orderBy("k").collect()  # at most ``MOST_SHARDS``
    discard(dealt)
    return [_comparable(*r["k"]) for r in least[1:]]


def _comparable(page_id: int | None, sha: str, u: int) -> tuple:
    return page_id is not None, page_id or 0, sha, u


def shard_of(firsts: list[tuple]) -> Callable[..., Column]:
    """The shard of a row by its key's columns; only these go to Python."""

    @F.arrow_udf("int")
    def deal(page_id: pa.Array, sha: pa.Array, u: pa.Array) -> pa.Array:
        keys = zip(page_id.to_pylist(), sha.to_pylist(), u.to_pylist(), strict=True)
        return pa.array([bisect.bisect_right(firsts, _comparable(*k)) for k in keys], pa.int32())

    return deal


def write_warc(pages: DataFrame, out: str, *, least: int = 0, shard_bytes: int = 1 << 25, roll_bytes: int = 1 << 24) -> DataFrame:
    """``page_id, url, html`` → files under the URI ``out`` and their manifest, which is returned."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = [F.col("page_id"), F.sha1(F.col("html").cast("binary")).alias("sha"), F.xxhash64(F.coalesce("url", F.lit("")), F.col("url").isNull()).alias("u")]
    slim = materialize(base.select(*keyed, F.octet_length("html").cast("long").alias("payload"), (F.octet_length("html") + 1).cast("long").alias("n")), "warc-digests")
    firsts = shard_keys(slim, shard_bytes)

    first = slim.where(F.col("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("to"), F.max("page_id").alias("hi"), F.count(F.lit(1)).alias("_n")).where("hi > to")
    refs = join_counted(slim.select(*KEY), first.drop("hi"), "sha", slim.count()).where("page_id > to").distinct()
    empty = F.lit(None).cast("string")
    both = base.select(*keyed, "url", "html", F.lit(None).cast("long").alias("to"), F.lit(True).alias("page"))
    both = both.union(refs.select(*KEY, empty, empty, "to", F.lit(False)))
    dealt = both.withColumn("shard", shard_of(firsts)(*KEY)).repartitionById(len(firsts) + 1, "shard")
    beside = Window.partitionBy("shard", *KEY)
    dealt = dealt.withColumn("refers_to", F.max("to").over(beside)).where("page")
    dealt = dealt.sortWithinPartitions("shard", *KEY).select("shard", "page_id", "url", "html", "refers_to")
    made = materialize(dealt.mapInArrow(_writer(out, roll_bytes), FILES), "warc-files")
    made.mapInArrow(_mover(out), FILES).write.parquet(f"{out}/_manifest")
    discard(slim, made)
    fs, root = pafs.FileSystem.from_uri(out)
    if fs.get_file_info(posixpath.join(root, "_temporary")).type != pafs.FileType.NotFound:
        fs.delete_dir(posixpath.join(root, "_temporary"))
    return pages.sparkSession.read.parquet(f"{out}/_manifest")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def members(f: pa.NativeFile, chunk: int = 1 << 15) -> Iterator[bytes]:
    """The gzip members of a stream, which is read in chunks: what is left after a member is copied for each."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while data := data or f.read(chunk):
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []


def _row(raw: bytes, file: str) -> tuple:
    fields, block = parse(raw)
    head, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        size, digest = len(payload), base32_sha1(payload)
        if digest != stated:
            raise ValueError(f"{file}: payload of {fields['WARC-Record-ID']} does not have its digest")
    else:
        http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        size, digest = int(http["Content-Length"]), stated
    page, to = fields.get("X-Page"), fields.get("X-Refers-To-Page")
    return int(page) if page else None, fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], int(to) if to else None, file


def _reader(out: str):
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with fs.open_input_stream(posixpath.join(root, name), compression=None) as f:
                    rows = [_row(raw, name) for raw in members(f)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return run


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """The records of the files that the manifest under ``out`` names, one task a file."""
    files = spark.read.parquet(f"{out}/_manifest").select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("at"))  # a row a file
    return files.repartitionById(max(1, files.count()), F.col("at").cast("int")).mapInArrow(_reader(out), RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: The contract's columns, with the digest's hex digits made base32, twenty bits at a time.
OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT h, min(page_id) AS least FROM p GROUP BY h
)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > least THEN least END AS refers_to,
  CASE WHEN trim(coalesce(url, '')) = '' THEN 'urn:page:' || page_id ELSE regexp_replace(trim(url), '\s+', ' ', 'g') END AS url
FROM p JOIN f USING (h)
"""
