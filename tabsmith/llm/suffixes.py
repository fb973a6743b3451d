"""Removal of long byte strings that also start anywhere else, by sharded suffix sorting.

A string of ``least`` bytes has an anchor: of its 32-byte grams the one whose hash is least, the first of equal ones. Equal strings have
equal anchors at the same place, so they meet in one shard if shards are dealt by anchor.

1. Consecutive strings with one anchor are a fragment. The texts are read once for the fragments' anchors and content hashes; fragments whose
   anchor occurs nowhere else are dropped, which leaves little but what is repeated.
2. Fragments with equal content are a class. Where each class of an anchor has copies, all their strings are repeated, and
   nothing is left to sort. Of the other anchors one fragment a class is fetched from its text and goes to the shard of its anchor.
3. A shard's suffixes are ordered, with common prefixes, by external induced sorting (see ``induced``): memory is bounded, whatever
   the shard's size. A start of ``least`` bytes is repeated if a neighbour in that order shares them, or if the class has copies.
4. An anchor with more than ``wide_bytes`` of different fragments (the edges of a passage that has many contexts) would make one shard too
   large for one task. For these anchors the strings themselves are hashed, to 128 bits, and counted.
5. The repeated strings go back to all fragments of their class; each document's are merged to spans and cut out.

Defined cases: a null text is empty; rows equal in doc_id and text are two documents, each repeated by the other; rows of one doc_id with other texts
are documents of their own; texts shorter than ``least`` bytes keep all; a string may repeat within one document and overlap itself; an empty table
gives an empty result; other columns are ignored. Spans are bytes, so a cut may fall inside a character: what is kept is binary. A
text of any length is one row; beside it a task holds its fragments' places.

The queues' files are in the folder where Spark spills (``SPARK_LOCAL_DIRS``), are read by their task only and end with it.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.common import discard, join_counted, materialize, same, table, text_key
from tabsmith.llm.induced import Log, shared_starts
from tabsmith.llm.numtext import U64, byte_pieces, column_bytes, list_array, mix64

GRAM, WINDOWS = 32, 1 << 15
#: Bits of a sliding key that hold the gram's place.
PLACE = U64(17)
PLACED = U64((1 << 17) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
ANCHORS = "doc_id long, ver long, a long, c long, n int, start int"
FRAGMENT = "a long, c long, n int, copies long, bytes binary"
FOUND = "a long, c long, n int, copies long, starts array<int>, ends array<int>"
KEY = ("a", "c", "n")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(n - 1, base, U64), out=out[1:])
    return out


class Sums:
    """Hashes of any stretch of bytes, as differences of one running sum of byte values times powers."""

    def __init__(self, size: int, seed: int = 1) -> None:
        self.value = mix64(np.arange(256, dtype=U64) + U64(seed * 1000 + 1))
        self.power = _powers(BASE, size + 1)
        self.inverse = _powers(pow(BASE, -1, 1 << 64), size + 1)

    def of(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(self.value[data] * self.power[: len(data)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((sums[b] - sums[a]) * self.inverse[a])

    def grams(self, sums: np.ndarray, size: int) -> np.ndarray:
        n = len(sums) - size
        with np.errstate(over="ignore"):
            return mix64((sums[size:] - sums[:n]) * self.inverse[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def fragments(data: np.ndarray, offsets: np.ndarray, least: int, sums: Sums) -> Iterator[tuple[np.ndarray, ...]]:
    """In slices: each fragment's row, anchor, content hash, number of strings, and first byte in the row."""
    first = np.arange(len(offsets) - 1)[np.diff(offsets) >= least]
    if not len(first):
        return
    for k in range(0, int(offsets[-1]) - least + 1, WINDOWS):
        m = min(k + WINDOWS, int(offsets[-1]) - least + 1)
        have = sums.of(data[k : m + least - 1])
        grams = sums.grams(have, GRAM)
        key = (grams >> PLACE << PLACE) | np.arange(len(grams), dtype=U64)
        at = (sliding_least(key, least - GRAM + 1) & PLACED).astype(np.int64)  # of each string that starts in k..m
        row = np.searchsorted(offsets, np.arange(k, m), "right") - 1
        whole = np.arange(k, m) + least <= offsets[row + 1]
        new = np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1]))
        a = np.flatnonzero(new)
        b = np.append(a[1:], m - k)
        a, b = a[whole[a]], b[whole[a]]
        with np.errstate(over="ignore"):
            content = mix64(sums.between(have, a, b + least - 1) + (b - a).astype(U64))
        yield row[a], grams[at[a]].view(np.int64), content.view(np.int64), (b - a).astype(np.int32), (k + a - offsets[row[a]]).astype(np.int32)


def _anchors(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(WINDOWS + least)
        for batch in batches:
            for k, m, data, offsets in byte_pieces(batch):
                part = batch.slice(k, m - k)
                for row, a, c, n, start in fragments(data, offsets, least, sums):
                    ids = part.select(["doc_id", "ver"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(a), pa.array(c), pa.array(n), pa.array(start)], [x.split()[0] for x in ANCHORS.split(", ")])

    return run


def _cut(least: int):
    """Rows of a text and ``parts`` of it → a row for each part, with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            parts = batch.column("parts")
            off = parts.offsets.to_numpy()
            flat = parts.values.slice(off[0], off[-1] - off[0])
            begin = offsets[np.repeat(np.arange(batch.num_rows), np.diff(off))] + flat.field("start").to_numpy()
            size = flat.field("n").to_numpy().astype(np.int64) + least - 1
            for k in range(0, len(size), 8192):
                s = size[k : k + 8192]
                ends = np.cumsum(s)
                at = np.arange(ends[-1]) + np.repeat(begin[k : k + 8192] - (ends - s), s)
                bytes_ = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes())])
                piece = flat.slice(k, len(s))
                yield pa.RecordBatch.from_arrays([*[piece.field(c) for c in ("a", "c", "n", "copies")], bytes_], ["a", "c", "n", "copies", "bytes"])

    return run


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
    return edge[0::2], edge[1::2]


def _repeated(least: int, memory: int):
    """A shard's fragments → of each with repeated strings where these start, as runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as folder:
            text, held, size = Log(folder, np.uint8, memory), [Log(folder, k, memory) for k in (np.int64, np.int64, np.int32, np.int64, np.int64)], 0
            for batch in batches:
                col = batch.column("bytes").cast(pa.large_binary())
                off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
                data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]]
                off = off - off[0]
                # one byte between fragments: 255 less a byte that no UTF-8 text has
                text.add(np.insert(np.uint8(255) - data, off[1:], 0))
                for log, c in zip(held, ("a", "c", "n", "copies"), strict=False):
                    log.add(batch.column(c).to_numpy())
                held[4].add(size + off[:-1] + np.arange(len(off) - 1))
                size += int(off[-1]) + len(off) - 1
            text.add(np.zeros(8, np.uint8))
            whole = text.array()
            a, c, n, copies, start = (log.array() for log in held)
            flag = shared_starts(whole, least, folder, memory)
            for k in range(0, len(start), 1 << 16):
                s, m = start[k : k + (1 << 16)], n[k : k + (1 << 16)].astype(np.int64)
                here = np.zeros(int(s[-1] + m[-1] - s[0]), bool)
                ends = np.cumsum(m)
                own = np.arange(ends[-1]) + np.repeat(s - s[0] - (ends - m), m)
                here[own] = flag[own + s[0]] | np.repeat(copies[k : k + (1 << 16)] > 1, m)
                lo, hi = _runs(here)
                row = np.searchsorted(s - s[0], lo, "right") - 1
                some, count = np.unique(row, return_counts=True)
                offsets = np.concatenate([[0], np.cumsum(count)])
                lists = [list_array((x - (s - s[0])[row]).astype(np.int32), offsets, pa.int32()) for x in (lo, hi)]
                yield pa.RecordBatch.from_arrays([*[pa.array(x[k + some]) for x in (a, c, n, copies)], *lists], [x.split()[0] for x in FOUND.split(", ")])

    return run


def _strings(least: int):
    """Two hashes of each string of the fragments, with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [Sums(2 * least, seed) for seed in (1, 2)]
        for batch in batches:
            for k in range(batch.num_rows):
                data = np.frombuffer(batch.column("bytes")[k].as_buffer(), np.uint8)
                n = batch.column("n")[k].as_py()
                h = [pa.array(s.grams(s.of(data), least).view(np.int64)) for s in both]
                fixed = [pa.array([batch.column(c)[k].as_py()] * n, t) for c, t in (("a", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("copies", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.arange(n, dtype=np.int32)), *h], ["a", "c", "n", "copies", "at", "h1", "h2"])

    return run


def _by_strings(parts: DataFrame, least: int) -> DataFrame:
    each = materialize(parts.mapInArrow(_strings(least), "a long, c long, n int, copies long, at int, h1 long, h2 long").select(F.struct("h1", "h2").alias("key"), *KEY, "copies", "at"), "suffix-strings")
    per = each.groupBy("key").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("_n")).where("total > 1").select("key", "_n")
    per = materialize(per, "suffix-repeated")
    hit = join_counted(each, per, "key", each.count(), written=True).groupBy(*KEY, "copies").agg(F.collect_set("at").alias("starts"))
    return hit.withColumn("ends", F.transform("starts", lambda x: x + 1))


def repeated_spans(docs: DataFrame, *, least: int = 200, shard_bytes: int = 6 << 20, wide_bytes: int = 2 << 20, memory: int = 1 << 22) -> DataFrame:
    """``doc_id, ver, text`` → ``doc_id, ver, spans`` (array of starts and lengths of strings' runs, not merged) of the documents that have any.
    ``memory``: entries of a queue, or of stars that are sorted in memory, before files and deeper recursion are used."""
    found_in = materialize(docs.mapInArrow(_anchors(least), ANCHORS), "suffix-anchors")
    per = materialize(found_in.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "suffix-shared")
    hit = materialize(join_counted(found_in, per, "a", found_in.count(), written=True).withColumn("key", F.struct(*KEY)), "suffix-hits")
    discard(found_in, per)
    classes = hit.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "ver", "start")).alias("rep"))
    classes = materialize(classes.select(*KEY, "copies", "rep.doc_id", "rep.ver", "rep.start"), "suffix-classes")
    by_anchor = classes.groupBy("a").agg(F.sum(F.col("n") + F.lit(least)).alias("size"), F.count(F.lit(1)).alias("_n"), F.min("copies").alias("fewest"))
    by_anchor = materialize(by_anchor, "suffix-by-anchor")
    # a string's equals are in fragments of its anchor; where all of these have copies, each string is repeated
    dealt = materialize(join_counted(classes, by_anchor.select("a", "_n", "fewest"), "a", classes.count(), written=True), "suffix-dealt")
    discard(classes)
    settled = dealt.where("fewest > 1").withColumns({"starts": F.array(F.lit(0)), "ends": F.array("n")}).select(*KEY, "copies", "starts", "ends")
    classes, left = dealt.where("fewest = 1"), by_anchor.where("fewest = 1")
    total, widest = left.agg(F.sum("size"), F.max("size")).first()

    own = classes.groupBy("doc_id", "ver").agg(F.collect_list(F.struct("a", "c", "n", "copies", "start")).alias("parts"))
    d, o = docs.alias("d"), own.alias("o")
    cut = d.join(o, same(F.col("d.doc_id"), F.col("o.doc_id")) & (F.col("d.ver") == F.col("o.ver"))).select("text", "parts").mapInArrow(_cut(least), FRAGMENT)
    cut = materialize(cut, "suffix-fragments")
    narrow, found = cut, None
    if (widest or 0) > wide_bytes:
        wide = materialize(left.where(F.col("size") > wide_bytes).select("a", "_n"), "suffix-wide")
        found = _by_strings(join_counted(cut, wide, "a", classes.count(), written=True), least)
        narrow = cut.join(wide.select("a"), "a", "left_anti")
    shards = max(1, -(-(total or 0) // shard_bytes))
    sorted_ = narrow.repartition(int(shards), "a").mapInArrow(_repeated(least, memory), FOUND)
    found = settled.unionByName(sorted_ if found is None else sorted_.unionByName(found))
    found = materialize(found.withColumn("key", F.struct(*KEY)).select("key", F.col("copies").alias("_n"), "starts", "ends"), "suffix-found")
    discard(cut, dealt, by_anchor)

    back = join_counted(hit, found.dropDuplicates(["key"]), "key", hit.count())
    runs = F.transform("starts", lambda s, i: F.struct((F.col("start") + s).alias("from"), (F.col("start") + F.get("ends", i) + F.lit(least - 1)).alias("to")))
    return back.withColumn("runs", runs).groupBy("doc_id", "ver").agg(F.flatten(F.collect_list("runs")).alias("spans"))


KEPT = "doc_id long, n_bytes long, spans array<struct<from:int,to:int>>, kept binary"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([pa.field("from", pa.int32()), pa.field("to", pa.int32())])
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        lists = batch.column("spans").fill_null([]) if batch.column("spans").null_count else batch.column("spans")
        off = lists.offsets.to_numpy()
        lo, hi = (lists.values.field(c).to_numpy().astype(np.int64) for c in ("from", "to"))
        spans, kept = [], []
        for k in range(batch.num_rows):
            text = data[offsets[k] : offsets[k + 1]]
            if off[k] == off[k + 1]:
                spans.append([])
                kept.append(text.tobytes())
                continue
            change = np.zeros(len(text) + 1, np.int32)
            np.add.at(change, lo[off[k] : off[k + 1]], 1)
            np.add.at(change, hi[off[k] : off[k + 1]], -1)
            gone = np.cumsum(change[:-1]) > 0
            a, b = _runs(gone)
            spans.append([{"from": x, "to": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            kept.append(text[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(spans, pa.list_(kind)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def cut_repeated(docs: DataFrame, *, least: int = 200, shard_bytes: int = 6 << 20, wide_bytes: int = 2 << 20, memory: int = 1 << 22) -> DataFrame:
    """``doc_id, text`` → ``doc_id, n_bytes, spans`` (the removed ones, ends exclusive), ``kept`` (the other bytes), a row for each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("ver"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(docs, least=least, shard_bytes=shard_bytes, wide_bytes=wide_bytes, memory=memory)
    d, s = docs.alias("d"), spans.alias("s")
    both = d.join(s, same(F.col("d.doc_id"), F.col("s.doc_id")) & (F.col("d.ver") == F.col("s.ver")), "left")
    return both.select("d.doc_id", "text", "spans").mapInArrow(_kept, KEPT)


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeated(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["to"] - s["from"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, x, unnest(range(0, greatest(len(x) // 2 - 199, 0))) AS i FROM h)
), r AS (
  SELECT k FROM w GROUP BY k HAVING count(*) > 1
), c AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM w JOIN r USING (k)
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM c) GROUP BY doc_id, g
), p AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s
), g AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head, max(b) AS last
  FROM p JOIN h USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN g USING (doc_id)
"""
