"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Documents with one and the same shingle set are one class; all that follows is on classes.
2. MinHash signatures are banded, 32 bands of 8 rows: a pair at 0.8 shares a band with probability
   1-(1-0.8^8)^32 = 0.997, at 0.85 with 0.99996. Classes are shuffled on band keys, and in each bucket
   held against its least class by one-bit signatures: similar ones are linked, very similar ones leave, and
   what is left gets another leader (see ``candidate_links``), so that buckets of unlike texts don't join.
3. Components of these links are candidate groups. Each goes to one task with its full shingle sets, in
   which all pairs are compared; a group above ``BLOCK`` classes or ``BLOCK_SHINGLES`` shingles is dealt
   over blocks, and each pair of blocks is a task of its own.
4. Tasks return the number of similar documents of each class and a spanning forest, not pairs. The
   number of compared pairs of different texts in a group still grows with its square: counting links needs it.

Classes are numbered, so that all that follows compares and hashes longs. Buckets, stars, groups and classes with a
great part of all rows are joined by broadcast of their one row (see ``common.join_counted``).

Defined cases: null texts and texts without words are similar to nothing; texts below five words have
all their words as one shingle; a text of any length is one row and must fit a task's memory about forty times; rows with the
same doc_id are documents of their own; ties go to the least id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.common import OFTEN, discard, join_counted, materialize, same, table, text_key
from tabsmith.llm.components import components
from tabsmith.llm.numtext import U64, band_keys, list_array, minhash, mix64, pieces, seeds, shingles

SIZE, SIMILAR, BANDS, ROWS = 5, 0.8, 32, 8
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Estimates (of a deviation of 0.04 to 0.05) at which classes are linked and leave a bucket. One that leaves is within
#: 0.28 of the leader but for two deviations, so what is within 0.2 of it has 0.52 or more, two above the first.
LINK, DONE = 0.4, 0.8
SKETCHED = "doc_id long, ver long, cls binary, n_shingles int, bits array<long>, bands array<long>"


def set_keys(values: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """16 bytes for each row's set of values; None for an empty set."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    key = np.zeros((len(offsets) - 1, 2), ">u8")
    if len(full):
        at = offsets[:-1][full]
        with np.errstate(over="ignore"):
            key[full, 0] = np.add.reduceat(mix64(values + U64(1)), at)
            key[full, 1] = np.bitwise_xor.reduceat(mix64(values ^ U64(0x5851F42D4C957F2D)), at)
    raw = key.tobytes()
    has = np.diff(offsets) > 0
    return [raw[16 * i : 16 * i + 16] if has[i] else None for i in range(len(has))]


def one_bit(signature: np.ndarray) -> np.ndarray:
    """A bit of each of up to 256 minima, in four words."""
    bit = (mix64(signature) >> U64(63)).astype(np.uint8)
    bit = np.pad(bit, ((0, 0), (0, 256 - bit.shape[1])))
    return np.packbits(bit, axis=1).view("<u8")


def sketcher(size: int, bands: int, rows: int):
    sown = seeds(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in pieces(batch):
                value, off = shingles(w, size)
                sig = minhash(value, off, sown)
                n = len(off) - 1
                key, bit = band_keys(sig, bands, rows), one_bit(sig)
                cols = [
                    part.column("doc_id"),
                    part.column("ver"),
                    pa.array(set_keys(value, off), pa.binary()),
                    pa.array(np.diff(off), pa.int32()),
                    list_array(bit.reshape(-1).view(np.int64), np.arange(n + 1) * 4, pa.int64()),
                    list_array(key.reshape(-1).view(np.int64), np.arange(n + 1) * bands, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ver", "cls", "n_shingles", "bits", "bands"])

    return run


def lowered(docs: DataFrame) -> DataFrame:
    """``doc_id, ver`` (a hash of the text, which tells rows of one id apart) and the text in lower case."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("ver"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def numbered(classes: DataFrame) -> DataFrame:
    """With ``no``, a number for each row, in the order of ``cls`` within a partition; to be written before it is used."""
    return classes.sortWithinPartitions("cls").withColumn("no", F.monotonically_increasing_id())


def bit_estimate(a: Column, b: Column) -> Column:
    """Jaccard similarity as 256 one-bit signatures have it: equal bits are (1 + similarity) / 2 of all."""
    apart = F.lit(0)
    for k in range(4):
        apart = apart + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
    return 1 - apart / 128


def set_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``no, key`` sorted by key those whose key another has. The last row of a batch waits for the next."""
    key, no, known = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        key, no = (np.concatenate([old, batch.column(c).to_numpy()]) for old, c in ((key, "key"), (no, "no")))
        if not len(key):
            continue
        equal = key[1:] == key[:-1]
        hit = np.zeros(len(key), bool)
        hit[1:] = equal
        hit[:-1] |= equal
        hit[0] |= known
        keep = np.flatnonzero(hit[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(no[keep]), pa.array(key[keep])], ["no", "key"])
        key, no, known = key[-1:], no[-1:], bool(hit[-1])
    if known:
        yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(key)], ["no", "key"])


def _often(keys: DataFrame, total: int, *, sample: int = 1 << 20, most: int = 1024) -> list[int]:
    """Up to ``most`` keys that a great part of the documents have, from about ``sample`` of the ``total`` keys, those of documents
    drawn by their number; they only go another way, and each occurs more than once."""
    part = min(1.0, sample / max(total, 1))
    drawn = keys.where(F.pmod(F.xxhash64(F.lit(3), F.col("no")), F.lit(1 << 20)) < F.lit(int(part * (1 << 20)))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    least = max(OFTEN * part, part * total / most, 2)
    return [r["key"] for r in drawn.where(F.col("n") > least).orderBy(F.col("n").desc(), "key").limit(most).select("key").collect()]


def shared_keys(keys: DataFrame, total: int) -> DataFrame:
    """Of rows ``no, key`` (``total`` in number, from a written table) those whose key another row has, by one shuffle: equal keys stand
    side by side. Rows of keys that a great part of all have stay where they are."""
    often = _often(keys, total)
    rest = (keys.where(~F.col("key").isin(often)) if often else keys).repartition("key").sortWithinPartitions("key")
    shared = rest.mapInArrow(_beside, "no long, key long")
    return shared.union(keys.where(F.col("key").isin(often))) if often else shared


def candidate_links(classes: DataFrame, payload: str, similarity: Callable[[Column, Column], Column], *, link: float, done: float, rounds: int = 4) -> DataFrame:
    """``no, bands`` and a ``payload`` (a written table) → a written table of links ``u, v`` such that classes that share a
    band and are at a distance of 0.2 at most are connected.

    In each bucket all are held against its least class. Those similar to ``link`` are linked to it; those similar
    to ``done`` leave the bucket, with it. As distances add up, whatever is near a class that leaves is linked to
    the same leader if link <= done - 0.2, with room for errors of the estimate. What is left after ``rounds`` is linked as it is.
    """
    rows = classes.select("no", F.explode("bands").alias("key"))
    shared = shared_keys(rows, classes.agg(F.sum(F.size("bands"))).first()[0] or 0)
    left = materialize(shared.join(classes.select("no", payload), "no").select("key", "no", payload), "near-buckets")
    tables, found = [left], None
    count = left.count()
    for turn in range(rounds + 1):
        lead = left.groupBy("key").agg(F.min(F.struct("no", payload)).alias("lead"), F.count(F.lit(1)).alias("_n"))
        tried = join_counted(left, lead, "key", count).where(F.col("no") != F.col("lead.no"))
        alike = similarity(F.col(payload), F.col(f"lead.{payload}")) if turn < rounds else F.lit(1.0)
        tried = materialize(tried.select("key", "no", payload, F.col("lead.no").alias("to"), alike.alias("alike")), "near-tried")
        tables.append(tried)
        links = tried.where(F.col("alike") >= link).select(F.col("no").alias("u"), F.col("to").alias("v"))
        found = links if found is None else found.union(links)
        left = tried.where(F.col("alike") < done).select("key", "no", payload)
        count = left.count()
        if not count:
            break
    out = materialize(found.distinct(), "near-links")
    discard(*tables)
    return out


def _similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """left x right: whether the sets' Jaccard similarity reaches ``least``."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(left) * len(right) <= 4:
        inter = np.array([[len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for b in right] for a in left])
    else:
        who = np.repeat(np.arange(len(sets)), sizes)
        value, col = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.bincount(col) > 1
        number = np.cumsum(often) - 1
        keep = often[col]
        who, col = who[keep], number[col[keep]]
        order = np.argsort(col, kind="stable")
        who, col = who[order], col[order]
        inter = np.zeros((len(left), len(right)), np.int64)
        place = np.full((2, len(sets)), -1)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        step = 2048
        for c in range(0, int(often.sum()), step):
            lo, hi = np.searchsorted(col, [c, c + step])
            m = np.zeros((len(sets), step), np.float32)
            m[who[lo:hi], col[lo:hi] - c] = 1
            inter += (m[left] @ m[right].T).astype(np.int64)
    both = sizes[left][:, None] + sizes[right][None, :] - inter
    return inter >= least * both - 1e-9


def compare_group(cls: np.ndarray, weight: np.ndarray, side: np.ndarray, sets: list[np.ndarray], pair: tuple[int, int], least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each class of a task: the documents similar to it among the other side's (or all), and the
    least class it is connected with here."""
    left, right = np.flatnonzero(side == pair[0]), np.flatnonzero(side == pair[1])
    links, label = np.zeros(len(cls), np.int64), np.arange(len(cls))
    if not len(left) or not len(right):
        return links, cls
    near = _similar(sets, left, right, least)
    if pair[0] == pair[1]:
        np.fill_diagonal(near, False)
    links[left] += near @ weight[right]
    if pair[0] != pair[1]:
        links[right] += near.T @ weight[left]
    while True:
        old = label.copy()
        for k in np.flatnonzero(near.any(axis=1)):
            others = right[near[k]]
            low = min(label[left[k]], label[others].min())
            label[left[k]] = low
            label[others] = np.minimum(label[others], low)
        if (old == label).all():
            return links, cls[label]


def _comparer(least: float):
    """Rows sorted by (root, i, j) → one row per class and task."""

    def flush(key: tuple, rows: list[tuple]) -> pa.RecordBatch | None:
        seen = {r[0]: r for r in reversed(rows)}
        rows = [seen[c] for c in sorted(seen)]
        if len(rows) < 2:
            return None
        cls = np.array([r[0] for r in rows], np.int64)
        links, low = compare_group(cls, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows]), [r[3] for r in rows], key[1:], least)
        keep = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays([pa.array(cls[keep]), pa.array(links[keep], pa.int64()), pa.array(low[keep])], ["no", "links", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            col = [batch.column(c) for c in ("root", "i", "j", "no", "weight", "side")]
            root, i, j, cls, weight, side = (c.to_pylist() for c in col)
            sets = batch.column("shingles")
            off = sets.offsets.to_numpy()
            value = sets.values.to_numpy()
            for k in range(batch.num_rows):
                if (now := (root[k], i[k], j[k])) != key:
                    if rows and (out := flush(key, rows)) is not None:
                        yield out
                    key, rows = now, []
                rows.append((cls[k], weight[k], side[k], value[off[k] : off[k + 1]].copy()))
        if rows and (out := flush(key, rows)) is not None:
            yield out

    return run


def compare(items: DataFrame, *, least: float = SIMILAR) -> DataFrame:
    """``root, no, weight, n_shingles, shingles`` (groups by root; a written table) → ``no, links, low``: by task, the number of
    similar documents of other classes and a class that it is connected with."""
    sizes = items.groupBy("root").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_s"))
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK), F.ceil(F.col("_s") / BLOCK_SHINGLES)).cast("int")
    x = join_counted(items, sizes.select("root", "_n", blocks.alias("_b")), "root", items.count())
    x = x.withColumn("side", F.pmod(F.xxhash64("no"), F.col("_b")).cast("int"))
    x = x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    x = x.select("root", F.least("side", "_o").alias("i"), F.greatest("side", "_o").alias("j"), "no", "weight", "side", "shingles")
    dealt = x.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInArrow(_comparer(least), "no long, links long, low long")


def _shingler(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in pieces(batch):
                value, off = shingles(w, size)
                mine = pa.array(set_keys(value, off), pa.binary())
                n = pa.array(np.diff(off), pa.int32())
                out = pa.RecordBatch.from_arrays([part.column("root"), part.column("no"), part.column("weight"), n, list_array(value.view(np.int64), off, pa.int64())], ["root", "no", "weight", "n_shingles", "shingles"])
                yield out.filter(pa.array([a == b for a, b in zip(mine.to_pylist(), part.column("cls").to_pylist(), strict=True)]))

    return run


def near_duplicates(docs: DataFrame, *, size: int = SIZE, least: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, text`` → a row per document: ``doc_id, class_id`` (least doc_id of those connected with it by
    similar pairs), ``copy_id`` (least doc_id of equal shingle sets), ``copies``, ``links`` (documents similar to it)."""
    low = lowered(docs)
    sketch = materialize(low.mapInArrow(sketcher(size, bands, rows), SKETCHED), "near-sketch")
    worded = sketch.where("cls is not null")
    classes = worded.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "ver")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    classes = materialize(numbered(classes).select("no", "cls", F.col("rep.doc_id").alias("copy_id"), "rep.ver", "copies", "bits", "bands"), "near-classes")
    edges = candidate_links(classes, "bits", bit_estimate, link=LINK, done=DONE)
    groups = components(edges)
    discard(edges)
    member = groups.union(groups.select(F.col("root").alias("u"), "root").distinct()).withColumnRenamed("u", "no")
    member = member.join(classes.select("no", "cls", "copy_id", "ver", F.col("copies").alias("weight")), "no")
    m, d = member.alias("m"), low.alias("d")
    texts = m.join(d, same(F.col("m.copy_id"), F.col("d.doc_id")) & (F.col("m.ver") == F.col("d.ver"))).select("root", "no", "cls", "weight", "text")
    items = materialize(texts.mapInArrow(_shingler(size), "root long, no long, weight long, n_shingles int, shingles array<long>"), "near-sets")
    found = materialize(compare(items, least=least), "near-found")
    discard(items, groups)
    links = found.groupBy("no").agg(F.sum("links").alias("others"))
    joined = components(found.select(F.col("no").alias("u"), F.col("low").alias("v")))
    slim = classes.select("no", "cls", "copy_id", "copies").join(links, "no", "left").join(joined.withColumnRenamed("u", "no"), "no", "left")
    slim = materialize(slim.withColumn("root", F.coalesce("root", "no")), "near-slim")
    discard(found, joined)
    ids = slim.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.count(F.lit(1)).alias("_n"))
    slim = join_counted(slim, ids, "root", slim.count())
    # equal texts may be a great part of all
    per = slim.select("cls", "class_id", "copy_id", "copies", "others", F.col("copies").alias("_n"))
    slim_docs = sketch.select("doc_id", "cls")
    some = join_counted(slim_docs.where("cls is not null"), per, "cls", sketch.count())
    out = some.unionByName(slim_docs.where("cls is null"), allowMissingColumns=True)
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).alias("links"),
    )


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Brute force over all pairs of classes that share a shingle.
OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0
), sets AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS k FROM s GROUP BY doc_id
), cls AS (
  SELECT k, min(doc_id) AS copy_id, count(*) AS copies, any_value(n) AS n FROM sets GROUP BY k
), cs AS (
  SELECT copy_id, n, g FROM cls JOIN s ON s.doc_id = copy_id
), half AS (
  SELECT a.copy_id AS a, b.copy_id AS b FROM cs a JOIN cs b ON a.g = b.g AND a.copy_id < b.copy_id
  GROUP BY a.copy_id, b.copy_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
), e AS (
  SELECT a, b FROM half UNION ALL SELECT b, a FROM half
), links AS (
  SELECT a, CAST(sum(copies) AS BIGINT) AS others FROM e JOIN cls ON copy_id = b GROUP BY a
), r AS (
  SELECT copy_id AS v, copy_id AS c FROM cls UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v
), least AS (
  SELECT v, min(c) AS class_id FROM r GROUP BY v
)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(copy_id, d.doc_id) AS copy_id, coalesce(copies, 1) AS copies, coalesce(copies, 1) - 1 + coalesce(others, 0) AS links
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN cls ON sets.k = cls.k LEFT JOIN links ON a = copy_id LEFT JOIN least ON v = copy_id
"""
