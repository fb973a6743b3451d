"""Records of JSON documents of any size, cut in parallel by a structural index.

The array of records stands at a dotted path of the document. The text is read in byte ranges, cut at closing braces. A first reading gives, for
each range, the parity of its quotes and how it changes the depth, once if it begins inside a string and once if not; sums over the ranges
before tell where each begins. What stands above the array (keys and brackets of at most its depth, without what is inside it) is the document's skeleton; it is
read by one task a document and tells where the array begins and ends. In the last reading each range cuts its own records; what it has of a record
that another range began or ended is a piece, and pieces are put together by document and order.

The driver gets two 64-bit numbers a range and two places a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.errors import WorkbenchError
from tabsmith.storage import stored

QUOTE, SLASH, OPEN, CLOSE = 34, 92, (123, 91), (125, 93)
BLANK = np.isin(np.arange(256), [9, 10, 13, 32])
SUMMARY = "file string, start long, quotes long, outside long, inside long, bytes long, size long"
SKELETON = "file string, start long, at long, sign string, key string, depth long"
PIECES = "value string, file string, start long, opens boolean, bad boolean"


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, start, size``: text up to each closing brace, in order within the range that begins at ``start``."""
    return spark.read.text(path, lineSep="}").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, np.ndarray, bool]]:
    """File, start, size, bytes (braces put back) and whether the range begins here, of the parts of ranges that batches hold."""
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start, size = batch.column("file"), batch.column("start").to_numpy(), batch.column("size")
        name = file.dictionary_encode().indices.to_numpy()
        cut = np.concatenate([[0], np.flatnonzero((start[1:] != start[:-1]) | (name[1:] != name[:-1])) + 1, [batch.num_rows]]).tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            col = batch.column("value").slice(a, b - a).cast(pa.large_string())
            off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
            data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
            where = (file[a].as_py(), int(start[a]))
            yield (*where, size[a].as_py(), np.insert(data, off[1:] - off[0], CLOSE[0]), where != at)
            at = where


def _quoted(text: np.ndarray) -> np.ndarray:
    """The parity of quotes up to and with each byte, those after an odd number of backslashes left out. A part begins after a brace, so no backslash stands before it."""
    quotes = np.flatnonzero(text == QUOTE)
    plain = np.flatnonzero(text != SLASH)
    if len(quotes):
        before = np.searchsorted(plain, quotes) - 1  # the last byte before that is no backslash
        last = np.where(before >= 0, plain[np.maximum(before, 0)], -1)
        quotes = quotes[(quotes - last - 1) % 2 == 0]
    marks = np.zeros(len(text), np.int64)
    marks[quotes] = 1
    return np.cumsum(marks) & 1


def _steps(text: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """+1 at opening and -1 at closing brackets outside strings."""
    return (np.isin(text, OPEN).astype(np.int64) - np.isin(text, CLOSE)) * outside


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: list | None = None
    for file, start, size, text, first in _texts(batches):
        if first:
            if now:
                yield _rows([now], SUMMARY)
            now = [file, start, 0, 0, 0, 0, size]
        parity = _quoted(text) ^ (now[2] & 1)
        now[2] += int(parity[-1] != (now[2] & 1)) if len(parity) else 0
        now[3] += int(_steps(text, parity == 0).sum())
        now[4] += int(_steps(text, parity == 1).sum())
        now[5] += len(text)
    if now:
        yield _rows([now], SUMMARY)


def _rows(rows: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


@dataclass
class Begin:
    """For ranges, by file and start: whether each begins in a string, and its depth."""

    inside: dict[tuple[str, int], bool]
    depth: dict[tuple[str, int], int]


def _skeleton(begin: Begin, depth: int):
    """Brackets outside strings that lead to at most ``depth`` levels, with the key before an opening one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parity, level, done, tail = 0, 0, 0, b""
        for file, start, _, text, first in _texts(batches):
            if first:
                parity, level, done, tail = int(begin.inside[file, start]), begin.depth[file, start], 0, b""
            odd = _quoted(text) ^ parity
            step = _steps(text, odd == 0)
            after = level + np.cumsum(step)
            at = np.flatnonzero((step != 0) & (np.where(step > 0, after, after + 1) <= depth))
            raw, rows = text.tobytes(), []
            for k in at.tolist():
                key = None
                if step[k] > 0:
                    head = (tail + raw[max(0, k - 4096) : k]).rstrip()
                    if head.endswith(b":"):
                        head = head[:-1].rstrip()
                        quote = head.rfind(b'"', 0, len(head) - 1)
                        key = head[quote + 1 : -1].decode(errors="replace")
                rows.append([file, start, done + k, chr(text[k]), key, int(after[k])])
            if rows:
                yield _rows(rows, SKELETON)
            parity, level, done, tail = int(odd[-1]), int(after[-1]), done + len(text), (tail + raw)[-4096:] if len(raw) < 4096 else raw[-4096:]

    return run


def _spans(parts: list[str]):
    """Of a document's skeleton, in order, where the array at the path begins and ends."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        stack: list[tuple[str, str | None]] = []
        found, out = None, []
        for r in frame.sort_values(["start", "at"]).itertuples(index=False):
            if r.sign in "{[":
                stack.append((r.sign, r.key))
                whole = [k for _, k in stack[1:]] == parts and all(s == "{" for s, _ in stack[:-1])
                if whole and r.sign == "[" and found is None:
                    found = (r.file, r.start, r.at)
            elif stack:
                if found and not out and len(stack) == len(parts) + 1:
                    out = [(*found, r.start, r.at)]
                stack.pop()
        return pd.DataFrame(out, columns=["file", "start", "at", "end_start", "end_at"])

    return run


def _cutter(begin: Begin, spans: dict[str, tuple[int, int, int, int]], depth: int):
    """Records, as text in one line; pieces of those that reach over ranges; and whether anything but objects stands in the array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def end() -> Iterator[pa.RecordBatch]:
            if state.get("held"):
                yield _rows([[_line(state["held"]), state["file"], state["start"], not state["head"], False]], PIECES)

        for file, start, _, text, first in _texts(batches):
            if first:
                yield from end()
                level, span = begin.depth[file, start], spans[file]
                amid = level > depth and span[0] < start <= span[2]  # in a record that another range began
                state = {"file": file, "start": start, "parity": int(begin.inside[file, start]), "level": level, "done": 0, "held": b"", "open": amid, "head": amid}
            odd = _quoted(text) ^ state["parity"]
            step = _steps(text, odd == 0)
            after = state["level"] + np.cumsum(step)
            place = state["done"] + np.arange(len(text))
            a, b = spans[file][:2], spans[file][2:]
            low = 0 if a[0] < start else len(text) if a[0] > start else int(np.searchsorted(place, a[1], "right"))
            high = len(text) if b[0] > start else 0 if b[0] < start else int(np.searchsorted(place, b[1]))
            inside = np.zeros(len(text), bool)
            inside[low:high] = True
            opens = np.flatnonzero(inside & (step > 0) & (after == depth + 1) & (text == OPEN[0]))
            closes = np.flatnonzero(inside & (step < 0) & (after == depth) & (text == CLOSE[0]))
            # at the array's own level only blanks and commas may stand
            loose = inside & (after == depth) & (step == 0) & ~BLANK[text] & (text != 44)
            other = inside & (((step > 0) & (after == depth + 1) & (text != OPEN[0])) | ((step < 0) & (after < depth)))
            if loose.any() or other.any():
                yield _rows([[None, None, None, None, True]], PIECES)
            raw, found = text.tobytes(), []
            if inside.any() or state["open"]:
                marks = [*closes.tolist()]
                firsts = opens.tolist()
                from_ = low if state["open"] else None
                for k in marks:
                    if from_ is None:
                        from_ = firsts.pop(0)
                    piece = state["held"] + raw[from_ : k + 1]
                    if state["head"]:
                        yield _rows([[_line(piece), file, start, False, False]], PIECES)
                    else:
                        found.append(_line(piece))
                    state["held"], state["open"], state["head"], from_ = b"", False, False, None
                if from_ is not None or firsts:  # goes on in the next part
                    state["held"] += raw[firsts[0] if from_ is None else from_ : high]
                    state["open"] = True
            if found:
                yield _rows([[x, None, None, None, False] for x in found], PIECES)
            state |= {"parity": int(odd[-1]), "level": int(after[-1]), "done": state["done"] + len(text)}
        yield from end()

    return run


def _line(raw: bytes) -> str:
    """A line break can stand between tokens only."""
    return raw.decode().replace("\n", " ").replace("\r", " ")


def records(spark: SparkSession, path: str, where: str = "$") -> DataFrame:
    """``value``: the text of each object of the array at ``where``, in each document below ``path``, a line each. A written table. Raises where a document has no such array, where it holds anything but
    objects, or where brackets or quotes don't match."""
    parts = where.split(".")[1:]
    per = stored(chunks(spark, path).mapInArrow(_summaries, SUMMARY), "json-ranges")
    along = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("odd", F.coalesce(F.sum("quotes").over(along), F.lit(0)) % 2 == 1)
    change = F.when(F.col("odd"), F.col("inside")).otherwise(F.col("outside"))
    per = per.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(along), F.lit(0)))
    # a brace was put at the end of each part, one too many where a file doesn't end with one
    whole = per.groupBy("file").agg(F.sum("quotes").alias("quotes"), (F.sum("change") + F.sum("bytes") - F.first("size")).alias("left"))
    if bad := whole.where("quotes % 2 = 1 or left <> 0").head(1):
        raise WorkbenchError("INVALID_FORMAT", "not a JSON document: quotes or brackets do not match", path=bad[0]["file"])
    ranges = per.select("file", "start", "odd", "depth").collect()  # two numbers a range
    begin = Begin({(r["file"], r["start"]): r["odd"] for r in ranges}, {(r["file"], r["start"]): r["depth"] for r in ranges})
    skeleton = chunks(spark, path).mapInArrow(_skeleton(begin, len(parts) + 1), SKELETON)
    places = skeleton.groupBy("file").applyInPandas(_spans(parts), "file string, start long, at long, end_start long, end_at long").collect()  # one a document
    spans = {r["file"]: (r["start"], r["at"], r["end_start"], r["end_at"]) for r in places}
    if gone := {r["file"] for r in ranges} - set(spans):
        raise WorkbenchError("INVALID_FORMAT", "there is no array of objects at the path", path=where, file=min(gone))
    cut = stored(chunks(spark, path).mapInArrow(_cutter(begin, spans, len(parts) + 1), PIECES), "json-pieces")
    if not cut.where("bad").isEmpty():
        raise WorkbenchError("INVALID_FORMAT", "the array holds what is no object", path=where)
    out = cut.where("file is null and not bad").select("value")
    pieces = cut.where("file is not null")
    along = Window.partitionBy("file").orderBy("start", "opens")
    pieces = pieces.withColumn("no", F.sum(F.col("opens").cast("int")).over(along))
    joined = pieces.groupBy("file", "no").agg(F.array_sort(F.collect_list(F.struct("start", "opens", "value"))).alias("parts"))
    return out.unionByName(joined.select(F.concat_ws("", F.transform("parts", lambda p: p["value"])).alias("value")))
