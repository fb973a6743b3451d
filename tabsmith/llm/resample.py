"""Importance resampling towards a target distribution, over hashed word n-grams.

Features are all runs of 1 to ``longest`` consecutive words, joined by one space; a feature's bucket is the CRC-32 of its
bytes modulo ``buckets``. A document's weight is the mean, over its features, of how much likelier their buckets are in the target
than in the corpus; a seeded Gumbel number is added to it, and the documents with the highest sums are a draw without replacement by weight.

The CRC-32 of a feature is the XOR of a part for each byte, which depends on the byte and its distance from the feature's end only, and of a
constant for the length. The parts stand in a table of ``DEPTH`` distances: a whole batch of features is looked up at once and
folded with ``bitwise_xor.reduceat`` over their spans. Longer spans are cut in blocks of ``DEPTH`` bytes from the end; the register of the blocks so
far is moved on by ``DEPTH`` bytes with four lookups in the same table.

The texts are read twice: once to count buckets, which are ``buckets`` sums whatever the input, once to weigh. Only one row of
numbers a document is sorted and ranked: by ranges of score, each range by itself, with the rows before it added.

Defined cases: null, empty and wordless texts have no feature and weight 0; an empty target gives all buckets t = 0; repeated rows are documents of their
own, and of equal scores the smaller doc_id is drawn first (null before all; then by number of features: rows that are equal in these are
equal in all). A null doc_id is hashed as ``<seed>:``. Of documents with too few words none is drawn. An empty table gives an empty result; other columns
are ignored. A text of any length is one row; beside it a task holds its words' places and works in slabs of ``SLAB`` bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import discard, materialize, table
from tabsmith.llm.numtext import _LOWER, byte_pieces, word_spans

#: Distances in the table, and bytes of spans that are looked up at a time.
DEPTH, SLAB = 512, 1 << 16
#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)


def position_table(depth: int = DEPTH) -> np.ndarray:
    """depth x 256: what a byte adds to the register that starts from zero, by its distance from the end."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = row >> np.uint32(1) ^ np.where(row & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    out = np.empty((depth, 256), np.uint32)
    out[0] = row
    for d in range(1, depth):
        out[d] = out[d - 1] >> np.uint32(8) ^ row[out[d - 1] & np.uint32(0xFF)]
    return out


PARTS = position_table()


def _moved(register: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Registers after as many zero bytes as the table is deep: their four bytes are the first of that many."""
    depth = len(parts)
    return parts[depth - 1, register & 0xFF] ^ parts[depth - 2, register >> 8 & 0xFF] ^ parts[depth - 3, register >> 16 & 0xFF] ^ parts[depth - 4, register >> 24]


def length_constants(parts: np.ndarray) -> np.ndarray:
    """For 0 to depth bytes, what becomes of the register's initial ones."""
    out = np.empty(len(parts) + 1, np.uint32)
    out[0] = ONES
    for n in range(1, len(out)):
        out[n] = out[n - 1] >> np.uint32(8) ^ parts[0, out[n - 1] & np.uint32(0xFF)]
    return out


CONSTANTS = length_constants(PARTS)


def _block_registers(data: np.ndarray, start: np.ndarray, size: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The XOR of the parts of the bytes of each block, of 1 to depth bytes, a slab of blocks at a time."""
    out = np.empty(len(start), np.uint32)
    flat, ends = parts.reshape(-1), np.cumsum(size)
    k = 0
    while k < len(start):
        m = max(int(np.searchsorted(ends, (ends[k - 1] if k else 0) + SLAB, "right")), k + 1)
        n, own = size[k:m], ends[k:m] - (ends[k - 1] if k else 0)
        step = np.arange(own[-1], dtype=np.int64)
        distance = np.repeat(own - 1, n) - step
        at = step + np.repeat(start[k:m] - (own - n), n)
        out[k:m] = np.bitwise_xor.reduceat(flat[distance << 8 | data[at]], own - n)
        k = m
    return out


def span_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, parts: np.ndarray = PARTS, constants: np.ndarray = CONSTANTS) -> np.ndarray:
    """CRC-32 of ``data[start[i]:end[i]]``; spans may overlap and be empty."""
    depth, size = len(parts), end - start
    out = np.zeros(len(start), np.uint32)
    some = np.flatnonzero(size > 0)
    start, size = start[some], size[some]
    blocks = -(-size // depth)
    if not len(some) or blocks.max() == 1:
        out[some] = _block_registers(data, start, size, parts) ^ constants[size] ^ ONES if len(some) else 0
        return out
    first = np.cumsum(blocks) - blocks
    own = np.repeat(np.arange(len(start)), blocks)
    number = np.arange(len(own)) - first[own]
    head = size - (blocks - 1) * depth  # bytes of the first block; the others are full
    begin = start[own] + np.where(number > 0, head[own] + (number - 1) * depth, 0)
    part = _block_registers(data, begin, np.where(number > 0, depth, head[own]), parts)
    register = part[first] ^ constants[head]
    left, k = np.flatnonzero(blocks > 1), 1
    while len(left):
        register[left] = _moved(register[left], parts) ^ part[first[left] + k]
        k += 1
        left = left[blocks[left] > k]
    out[some] = register ^ ONES
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For the rows of a batch piece: the rows' numbers of words once, then slabs of (row, bucket) of all features."""
    data = _LOWER[data]
    start, end, first = word_spans(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    size = end - start + 1  # with the blank that follows
    ends = np.cumsum(size)
    k, n = 0, len(start)
    while k < n:
        m = max(int(np.searchsorted(ends, (ends[k - 1] if k else 0) + SLAB // 4, "right")), k + 1)
        top = min(m + longest - 1, n)  # words that only end features of this slab
        stop = ends[k:top] - (ends[k - 1] if k else 0)
        begin = stop - size[k:top]
        joined = np.full(stop[-1], 32, np.uint8)
        if m - k == 1 and size[k] > SLAB:  # a very long word is copied as it is
            joined[: size[k] - 1] = data[start[k] : end[k]]
            for j in range(1, top - k):
                joined[begin[j] : stop[j] - 1] = data[start[k + j] : end[k + j]]
        else:
            at = np.arange(stop[-1]) + np.repeat(start[k:top] - begin, size[k:top])
            joined = data[np.minimum(at, len(data) - 1)]
            joined[stop - 1] = 32
        for g in range(longest):
            a = np.arange(0, min(m, n - g) - k)
            a = a[row[k + a] == row[k + a + g]]
            yield row[k + a], (span_crcs(joined, begin[a], stop[a + g] - 1) % np.uint32(buckets)).astype(np.int64), g
        k = m


def bucket_counts(docs: DataFrame, *, longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """``bucket, n``: the features of all texts in each bucket; at most ``buckets`` rows a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in byte_pieces(batch):
                for _, bucket, _ in features(data, offsets, longest, buckets):
                    have += np.bincount(bucket, minlength=buckets)
        k = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(have[k], pa.int64())], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """For each bucket floor(1000 ln of how much likelier it is in the target), with one added to every count."""
    S, T = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * S / ((corpus.get(b, 0) + 1) * T))) for b in range(buckets)], np.int64)


WEIGHED = "doc_id long, n_words long, n_features long, weight long"


def weigh(docs: DataFrame, gain: np.ndarray, *, longest: int = 2) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, count, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for k, m, data, offsets in byte_pieces(batch):
                for row, bucket, g in features(data, offsets, longest, len(gain)):
                    if not len(row):
                        continue
                    at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    n = np.diff(np.append(at, len(row)))
                    total[k + row[at]] += np.add.reduceat(gain[bucket], at)
                    count[k + row[at]] += n
                    if g == 0:
                        words[k + row[at]] += n
            weight = total // np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (words, count, weight)]], [c.split()[0] for c in WEIGHED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, WEIGHED)


def gumbel(doc_id: Column, seed: int = 7) -> Column:
    """floor(-1000 ln(-ln u)) for a number u in (0, 1) that seed and id give."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, *, longest: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """``doc_id, text`` and the target's ``text`` → ``doc_id, n_features, weight, score, rank``: ranks 1, 2, ... by score for
    the ``percent`` of the documents of at least ``least_words`` words, null for the others. ``buckets`` bounds what goes
    through the driver and to the tasks: a number a bucket."""
    corpus = {r["bucket"]: r["n"] for r in bucket_counts(docs, longest=longest, buckets=buckets).collect()}
    wanted = {r["bucket"]: r["n"] for r in bucket_counts(target, longest=longest, buckets=buckets).collect()}
    # written, as the range bounds below take a first reading of it
    weighed = materialize(weigh(docs, gains(corpus, wanted, buckets), longest=longest), "resample-weights")
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))

    keys = [F.col("_small"), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("n_words")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored.withColumn("_small", F.col("n_words") < least_words).repartitionByRange(parts, *keys)
    # written, as range bounds come from a sample and differ when a lost task is run again
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()), "resample-scores")
    discard(weighed)
    per = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("_small")).alias("_large"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    total = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    drawn = F.floor(F.sum("_large").over(total) * percent / 100)
    per = per.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), drawn.alias("_drawn"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) + F.col("_ahead")
    out = dealt.join(F.broadcast(per), "_part").withColumn("_place", place)
    rank = F.when(~F.col("_small") & (F.col("_place") <= F.col("_drawn")), F.col("_place"))
    return out.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"), "n_words")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH bit0 AS (SELECT CAST(b AS BIGINT) AS b, CAST(b AS BIGINT) AS v FROM range(256) t(b)
), bits AS (
  SELECT list(list_reduce([v, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY b) AS t FROM bit0
), low AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), word AS (
  SELECT kind, id, unnest(ws) AS a, unnest(ws[2:]) AS b FROM low
), gram AS (
  SELECT kind, id, a AS f FROM word UNION ALL SELECT kind, id, a || ' ' || b FROM word WHERE b IS NOT NULL
), feature AS (
  SELECT kind, id, f, count(*) AS n FROM gram GROUP BY kind, id, f
), crc AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(len(hex(encode(f))) // 2), lambda i: CAST(('0x' || substr(hex(encode(f)), 2 * i + 1, 2)) AS BIGINT))), lambda c, x: xor(c >> 8, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM feature), bits
), bucketed AS (
  SELECT kind, id, n, bucket FROM feature JOIN crc USING (f)
), counted AS (
  SELECT bucket, CAST(sum(n) FILTER (WHERE kind = 0) AS BIGINT) AS s, CAST(sum(n) FILTER (WHERE kind = 1) AS BIGINT) AS t FROM bucketed GROUP BY bucket
), whole AS (
  SELECT coalesce(sum(s), 0) + 10000 AS s_all, coalesce(sum(t), 0) + 10000 AS t_all FROM counted
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * s_all AS DOUBLE) / CAST((coalesce(s, 0) + 1) * t_all AS DOUBLE))) AS BIGINT) AS g FROM counted, whole
), own AS (
  SELECT id AS doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS total FROM bucketed JOIN gain USING (bucket) WHERE kind = 0 GROUP BY id
), size AS (
  SELECT id AS doc_id, len(ws) AS n_words FROM low WHERE kind = 0
), scored AS (
  SELECT doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(CAST(floor(CAST(total AS DOUBLE) / n_features) AS BIGINT), 0) AS weight,
         CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM size LEFT JOIN own USING (doc_id)
), drawn AS (
  SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS many FROM drawn
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * many // 100 THEN CAST(place AS BIGINT) END AS rank, CAST(n_words AS BIGINT) AS n_words FROM placed
"""
