"""Ranked lexical search: the documents of highest impact score for each item, by length-ordered impact vectors.

A document is a vector over the items' terms: sqrt(w) times its impact for the term, where w is the term's weight, which comes from how
many documents hold it, and the impact grows with the term's occurrences against the document's length. An item is one
too: sqrt(w) times the term's occurrences in it. The score is their product, which in exact integers is the sum of w times impact over the item's terms.

1. The corpus is read once for the number of documents with a term, of all terms, and of the documents that hold each of the items' terms.
2. It is read again to search. A task orders the vectors of a window of documents by length and cuts them in buckets of ``BUCKET``. For each
   item it keeps the best ``k`` so far; the least of them is the item's threshold. By Cauchy-Schwarz no document of a bucket reaches it if the item's length
   times the bucket's greatest length doesn't: then the bucket is not opened for the item. Else the item's ``FOCUS`` largest coordinates are
   looked up in the bucket: with what they give, and the product of the lengths of all other coordinates, each document has a
   bound, and only documents whose bound reaches the threshold are scored, exactly, in integers. Bounds are in doubles and are widened by
   more than their rounding, so nothing is lost.
3. A task gives at most ``k`` documents an item, so what is shuffled doesn't grow with the texts; they are ranked by item.

Items go to the tasks in parts of about ``part_items``, as term hashes; there are as many parts as it takes, each with two readings.

Defined cases: null and wordless texts have no term and are in no result, items without terms have none; repeated items are ranked each for itself
(``query`` tells them apart), repeated documents each count and take a rank each; a null doc_id comes after all others of its score; an empty corpus
or benchmark gives an empty result; other columns are ignored. A text of any length is one row, and must fit a task's memory about thirty times.
Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import table
from tabsmith.llm.numtext import U64, Words, list_array, pieces

#: Documents of a bucket, entries of a window, and an item's coordinates that are looked up for the bound.
BUCKET, WINDOW, FOCUS = 1024, 1 << 21, 6
FOUND = "query long, item_id long, doc_id long, score long"
ITEM = "item_id long, terms array<long>, times array<long>"
#: By how much a bound is widened for the rounding of its sums.
SLACK = 1 + 1e-9


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each item, as hashes, and how often it has them."""
    for batch in batches:
        for part, w in pieces(batch):
            order = np.lexsort((w.hash, row := w.row))
            h, r = w.hash[order], row[order]
            new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(h) else np.zeros(0, np.int64)
            off = np.searchsorted(r[new], np.arange(part.num_rows + 1))
            times = np.diff(np.append(new, len(h)))
            yield pa.RecordBatch.from_arrays([part.column("item_id"), list_array(h[new].view(np.int64), off, pa.int64()), list_array(times, off, pa.int64())], ["item_id", "terms", "times"])


@dataclass
class Queries:
    """Items as rows of (term, times): ``off`` bounds the rows, ``term`` is a place in ``vocabulary``, the sorted hashes."""

    number: np.ndarray
    item: list[int | None]
    vocabulary: np.ndarray
    off: np.ndarray
    term: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list, start: int) -> Queries:
        off = np.concatenate([[0], np.cumsum([len(r["terms"]) for r in rows])]).astype(np.int64)
        terms = np.array([t for r in rows for t in r["terms"]], np.int64).view(U64)
        vocabulary, term = np.unique(terms, return_inverse=True)
        return cls(np.arange(start, start + len(rows)), [r["item_id"] for r in rows], vocabulary, off, term.astype(np.int64), np.array([t for r in rows for t in r["times"]], np.int64))


def term_counts(w: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms of the vocabulary and their occurrences in the row, in the order of rows and terms."""
    at = np.searchsorted(vocabulary, w.hash)
    at[at == len(vocabulary)] = 0
    hit = np.flatnonzero(vocabulary[at] == w.hash) if len(vocabulary) else np.zeros(0, np.int64)
    key, times = np.unique(w.row[hit] * max(len(vocabulary), 1) + at[hit], return_counts=True)
    return key // max(len(vocabulary), 1), key % max(len(vocabulary), 1), times


def _statistics(vocabulary: np.ndarray):
    """For each term the documents that hold it; at -1 the documents with a term, at -2 all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for _, w in pieces(batch):
                _, term, _ = term_counts(w, vocabulary)
                have += np.bincount(term, minlength=len(vocabulary))
                n += int((np.diff(w.first) > 0).sum())
                total += len(w.hash)
        k = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, [-1, -2]), pa.int64()), pa.array(np.append(have[k], [n, total]), pa.int64())], ["term", "n"])

    return run


def impacts(times: np.ndarray, size: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The integer impact of terms that occur ``times`` in documents of ``size`` terms."""
    if len(size) and 25 * int(size.max()) * documents >= 1 << 63:
        m = np.array([75 + 25 * int(s) * documents // total for s in size], np.int64)
    else:
        m = 75 + 25 * size.astype(np.int64) * documents // max(total, 1)
    return 1_000_000_000 * times // (1000 * times + 12 * m)


@dataclass
class Search:
    """The best ``k`` of the documents seen so far for each query; ``opened`` and ``scored`` count (query, bucket) and (query, document) pairs."""

    q: Queries
    weight: np.ndarray
    k: int
    opened: int = 0
    scored: int = 0
    seen: int = 0
    best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(init=False)

    def __post_init__(self) -> None:
        q, n = self.q, len(self.q.item)
        root = np.sqrt(self.weight.astype(float))
        value = root[q.term] * q.times
        row = np.repeat(np.arange(n), np.diff(q.off))
        self.root, self.exact = root, self.weight[q.term] * q.times
        self.length = np.sqrt(np.bincount(row, value * value, n))
        order = np.lexsort((-value, row))  # each query's coordinates, the largest first
        place = np.arange(len(order)) - q.off[:-1][row]
        head = place < FOCUS
        self.focus = np.full((n, FOCUS), -1, np.int64)
        self.focus_value = np.zeros((n, FOCUS))
        self.focus[row[head], place[head]] = q.term[order[head]]
        self.focus_value[row[head], place[head]] = value[order[head]]
        self.rest = np.sqrt(np.maximum(self.length**2 - (self.focus_value**2).sum(1), 0))
        self.least = np.zeros(n, np.int64)
        none = np.zeros(0, np.int64)
        self.best = [(none, none, none)] * n
        self.dense = np.zeros(len(self.weight), np.int64)

    def add(self, doc: np.ndarray, null: np.ndarray, off: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """A window of documents, as rows of terms and impacts; no row is empty."""
        if not len(doc):
            return
        value = self.root[term] * impact
        length = np.sqrt(np.add.reduceat(value * value, off[:-1]))
        order = np.argsort(-length, kind="stable")
        size = np.diff(off)[order]
        new = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(new[-1]) + np.repeat(off[:-1][order] - new[:-1], size)
        doc, null, length, term, impact, value = doc[order], null[order], length[order], term[at], impact[at], value[at]
        for a in range(0, len(doc), BUCKET):
            b = min(a + BUCKET, len(doc))
            lo, hi = new[a], new[b]
            self._bucket(doc[a:b], null[a:b], length[a:b], new[a : b + 1] - lo, term[lo:hi], impact[lo:hi], value[lo:hi])

    def _bucket(self, doc: np.ndarray, null: np.ndarray, length: np.ndarray, off: np.ndarray, term: np.ndarray, impact: np.ndarray, value: np.ndarray) -> None:
        reach = self.length * length[0] * SLACK
        open_ = np.flatnonzero((reach > 0) & (reach >= self.least))
        self.seen += len(self.length)
        self.opened += len(open_)
        if not len(open_):
            return
        row = np.repeat(np.arange(len(doc)), np.diff(off))
        by = np.argsort(term, kind="stable")
        sorted_, where, x = term[by], row[by], value[by]
        square = x * x
        lo, hi = np.searchsorted(sorted_, self.focus[open_], "left"), np.searchsorted(sorted_, self.focus[open_], "right")
        whole = length * length
        for j, k in enumerate(open_.tolist()):
            given, used = np.zeros(len(doc)), np.zeros(len(doc))
            for f in range(FOCUS):
                a, b = lo[j, f], hi[j, f]
                if a < b:
                    at = where[a:b]
                    given[at] += self.focus_value[k, f] * x[a:b]
                    used[at] += square[a:b]
            bound = (given + self.rest[k] * np.sqrt(np.maximum(whole - used, 0) + 1e-9 * whole)) * SLACK
            left = np.flatnonzero((bound > 0) & (bound >= self.least[k]))
            if len(left):
                self._score(k, left, doc, null, off, term, impact)

    def _score(self, k: int, left: np.ndarray, doc: np.ndarray, null: np.ndarray, off: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        self.scored += len(left)
        own = slice(self.q.off[k], self.q.off[k + 1])
        self.dense[self.q.term[own]] = self.exact[own]
        size = off[left + 1] - off[left]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(off[left] - (ends - size), size)
        score = np.add.reduceat(self.dense[term[at]] * impact[at], ends - size)
        self.dense[self.q.term[own]] = 0
        good = np.flatnonzero((score > 0) & (score >= self.least[k]))
        if not len(good):
            return
        s, n, d = (np.concatenate([old, new]) for old, new in zip(self.best[k], (score[good], null[left[good]], doc[left[good]]), strict=True))
        order = np.lexsort((d, n, -s))[: self.k]
        self.best[k] = s[order], n[order], d[order]
        if len(order) == self.k:
            self.least[k] = s[order[-1]]

    def rows(self) -> pa.RecordBatch:
        size = [len(s) for s, _, _ in self.best]
        s, n, d = (np.concatenate([b[c] for b in self.best]) if self.best else np.zeros(0, np.int64) for c in range(3))
        item = [i for i, m in zip(self.q.item, size, strict=True) for _ in range(m)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.q.number, size), pa.int64()), pa.array(item, pa.int64()), pa.array(d, pa.int64(), mask=n.astype(bool)), pa.array(s, pa.int64())], ["query", "item_id", "doc_id", "score"])


def _searcher(q, weight: np.ndarray, documents: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, held, entries = Search(q.value, weight, k), [], 0

        def work() -> None:
            doc, null, size, term, impact = (np.concatenate(x) for x in zip(*held, strict=True))
            search.add(doc, null, np.concatenate([[0], np.cumsum(size)]), term, impact)
            held.clear()

        for batch in batches:
            for part, w in pieces(batch):
                row, term, times = term_counts(w, q.value.vocabulary)
                if not len(row):
                    continue
                impact = impacts(times, np.diff(w.first)[row], documents, total)
                some, size = np.unique(row, return_counts=True)
                ids = part.column("doc_id")
                null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((ids.fill_null(0).to_numpy()[some], null[some], size, term, impact))
                entries += len(term)
                if entries >= WINDOW:
                    work()
                    entries = 0
        if held:
            work()
        yield search.rows()

    return run


def ranked(docs: DataFrame, items: DataFrame, *, k: int = 20, part_items: int = 25_000) -> DataFrame:
    """``doc_id, text`` and ``item_id, text`` → ``item_id, rank, doc_id, score``: each item's ``k`` documents of highest score above 0, equal scores
    by doc_id; with ``query``, a number for each row of items."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = max(1, -(-items.count() // part_items))
    terms = items.withColumn("_part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    out, start = None, 0
    for p in range(parts):
        rows = terms.where(F.col("_part") == p).select("item_id", "text").mapInArrow(_item_terms, ITEM).collect()  # hashes of one part of the items
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["terms"]))
        q = Queries.of(rows, start)
        start += len(rows)
        have = {r["term"]: r["n"] for r in docs.mapInArrow(_statistics(q.vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, total = have.get(-1, 0), have.get(-2, 0)
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * have.get(t, 0) + 1))) for t in range(len(q.vocabulary))], np.int64)
        found = docs.mapInArrow(_searcher(spark.sparkContext.broadcast(q), weight, n, total, k), FOUND)
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score", "query")


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL
), sized AS (
  SELECT doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM words WHERE len(ws) > 0
), total AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized
), tf AS (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(ws) AS t FROM sized) GROUP BY doc_id, n, t
), df AS (
  SELECT t, count(*) AS df FROM tf GROUP BY t
), weight AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total
), item AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY item_id, t
), scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM item JOIN weight USING (t) JOIN tf USING (t), total GROUP BY item_id, doc_id
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""
