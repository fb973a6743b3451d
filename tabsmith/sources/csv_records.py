"""Records of CSV files whose cells may hold line breaks, found in parallel by the parity of quotes.

Every quote opens or closes quoting (a doubled one does both), so a line break ends a record where an even number of quotes stands
before it in its file. The files are read in byte ranges, as Spark cuts them. A first reading counts the quotes of each range; their sums over
the ranges before tell whether a range begins inside a cell. In the second each range cuts its own records; what it has of a
record that another range began or ends is a piece, and the pieces of a record, one a range, are put together by file and order.

The driver gets a 64-bit number for each range that begins inside a cell: some megabytes for a petabyte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.errors import WorkbenchError

QUOTE, LF, CR = 34, 10, 13
#: Bytes of text that are worked on at once, as some arrays of that size are made of them.
PIECE = 1 << 20
CUT = "value string, first boolean, file string, start long, opens boolean"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, start``: lines with the file and the first byte of the range they begin in, ranges in order."""
    return spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, quotes, odd_lines, inside``: of each range the quotes, the lines with an odd number of them or with commas only, and whether it begins inside a cell."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    per = lines(spark, path).groupBy("file", "start").agg(F.sum(quotes).alias("quotes"), F.count_if((quotes % 2 == 1) | F.col("value").rlike("^,+\r?$")).alias("odd_lines"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)


class _Range:
    """The records of one range, from its lines in order."""

    def __init__(self, inside: bool, start: int) -> None:
        self.parity, self.head, self.first = int(inside), inside, start == 0
        self.held: list[bytes] = []  # of the record that has begun

    def add(self, text: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """The whole records that end in ``text``, and the end of a record of the range before."""
        parity = (np.cumsum(text == QUOTE, dtype=np.uint8) + np.uint8(self.parity)) & 1
        ends = np.flatnonzero(((text == LF) | (text == CR)) & (parity == 0))
        raw = text.tobytes()
        if not len(ends):
            self.held.append(raw)
            self.parity = int(parity[-1]) if len(parity) else self.parity
            return [], []
        cut = ends.tolist()
        found = [raw[a + 1 : b] for a, b in zip([-1, *cut[:-1]], cut, strict=True)]
        found[0] = b"".join([*self.held, found[0]])
        self.held, self.parity = [raw[cut[-1] + 1 :]], int(parity[-1])
        end = [found.pop(0)] if self.head else []
        self.head = False
        return [x for x in found if x.strip(b",")], end


def _parts(data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """The text of lines that end at ``ends``, with their line breaks, at most ``PIECE`` bytes and these at a time."""
    for lo in range(0, max(len(data), 1), PIECE):
        hi = lo + PIECE
        mine = ends[np.searchsorted(ends, lo, "right" if lo else "left") : np.searchsorted(ends, hi, "right")]
        yield np.insert(data[lo:hi], mine - lo, LF)


def _cutter(inside: np.ndarray):
    def rows(values: list[bytes], first: bool, file: str | None = None, start: int | None = None, opens: bool | None = None) -> pa.RecordBatch:
        n = len(values)
        flags = np.zeros(n, bool)
        flags[:1] = first
        fixed = [pa.array([x] * n, t) for x, t in ((file, pa.string()), (start, pa.int64()), (opens, pa.bool_()))]
        return pa.RecordBatch.from_arrays([pa.array(values, pa.binary()).cast(pa.string()), pa.array(flags), *fixed], ["value", "first", "file", "start", "opens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, None

        def end() -> Iterator[pa.RecordBatch]:
            left = b"".join(now.held) if now else b""
            if left and (now.head or now.parity):  # a range that has no end of a record goes on with one, else it opens one
                yield rows([left], now.first and not now.head, *at, not now.head)

        for batch in batches:
            ids, first_of = batch.column("id").to_numpy(), np.append(True, np.zeros(max(batch.num_rows - 1, 0), bool))
            if not batch.num_rows:
                continue
            first_of[1:] = ids[1:] != ids[:-1]
            cut = np.append(np.flatnonzero(first_of), batch.num_rows)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                where = (batch.column("file")[a].as_py(), batch.column("start")[a].as_py())
                if where != at:
                    yield from end()
                    k = int(np.searchsorted(inside, ids[a]))
                    now, at = _Range(k < len(inside) and inside[k] == ids[a], where[1]), where
                col = batch.column("value").slice(a, b - a).cast(pa.large_string())
                off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
                data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
                for text in _parts(data, off[1:] - off[0]):
                    found, tail = now.add(text)
                    if tail:
                        yield rows(tail, False, *at, False)
                    if found:
                        yield rows(found, now.first)
                        now.first = False
        yield from end()

    return run


def records(spark: SparkSession, path: str) -> DataFrame | None:
    """``value, first``: the text of each record that is not blank, and whether it is the first of its file; None where no line has an odd number of quotes, so that
    every line is a record, and none has only empty cells, which is blank too. Raises where a file ends inside a cell."""
    found = ranges(spark, path)
    per = found.groupBy("file").agg(F.sum("quotes").alias("quotes"), F.sum("odd_lines").alias("odd"))
    total = per.agg(F.sum("odd").alias("odd"), F.count_if(F.col("quotes") % 2 == 1).alias("open"), F.min(F.when(F.col("quotes") % 2 == 1, F.col("file"))).alias("sample")).first()
    if total["open"]:
        raise WorkbenchError("INVALID_FORMAT", "unterminated quote", files=total["open"], sample=total["sample"])
    if not total["odd"]:
        return None
    name = F.xxhash64("file", "start")
    inside = np.sort(np.array([r["id"] for r in found.where("inside").select(name.alias("id")).collect()], np.int64))
    cut = lines(spark, path).withColumn("id", name).mapInArrow(_cutter(inside), CUT)
    whole = cut.where("file is null").select("value", "first")
    if not len(inside):
        return whole
    along = Window.partitionBy("file").orderBy("start", "opens")
    pieces = cut.where("file is not null").withColumn("no", F.sum(F.col("opens").cast("int")).over(along))
    parts = F.array_sort(F.collect_list(F.struct("start", "opens", "value")))
    joined = pieces.groupBy("file", "no").agg(F.concat_ws("", F.transform(parts, lambda p: p["value"])).alias("value"), F.bool_or("first").alias("first"))
    return whole.unionByName(joined.select("value", "first"))
