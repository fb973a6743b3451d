"""Streams of prediction requests, and scoring of arriving rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tabsmith.operators.prep import Fitted, score_linear, transform_features
from tabsmith.operators.runs import CHANGES, HashedPages, Heap, Pages, Run, Stream, changes_of, frame

#: The state store in which a map's entries are read and written one by one.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _load(state: Any) -> Callable[[int], dict]:
    return lambda number: {key: value for key, value in json.loads(state.getValue((number,))[0])}


def _write(pages: dict[int, dict], state: Any, n: int) -> None:
    """Writes pages, but removes those from the n-th on."""
    for number, page in pages.items():
        if number < n:
            state.updateValue((number,), (json.dumps(list(page.items())),))
        elif state.containsKey((number,)):
            state.removeKey((number,))


class RunStates(StatefulProcessor):
    """The rules of ``operators.runs`` over keyed state: a value for a stream's head, baseline and sizes, and maps of its known runs and of
    the cells of its two heaps, by pages. A batch reads and writes each page that its events touch once, as a call of the store costs more than a page."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "head long, base string, pending long, published long, pages long, runs long")
        self.runs, self.pending, self.published = (handle.getMapState(f"{name}_pages", "number long", "entries string") for name in ("runs", "pending", "published"))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        head, base, pending, published, pages, known = self.top.get() or (None, None, 0, 0, 0, 0)
        runs = HashedPages(_load(self.runs), Run._make, pages, known)
        heaps = [Heap(Pages(_load(m), tuple, -(-n // Pages.SIZE)), n) for m, n in ((self.pending, pending), (self.published, published))]
        stream = Stream(head, base, runs, *heaps)
        # the rows of one micro-batch
        out = changes_of(key[0], stream, pd.concat(list(rows)).sort_values("seq"))
        _write(runs.written(), self.runs, runs.n)
        for heap, m in ((stream.pending, self.pending), (stream.published, self.published)):
            _write(heap.cells.written(), m, -(-heap.size // Pages.SIZE))
        self.top.update((stream.head, stream.base, stream.pending.size, stream.published.size, runs.n, runs.entries))
        yield frame(out)

    def close(self) -> None:
        pass


def run_state(events: DataFrame) -> DataFrame:
    """Changes of state, as ``CHANGES``, of a stream of run events by the rules of ``operators.runs``. Events must arrive in the order of
    ``seq``, but for those of one micro-batch. The session's state store must be that of ``PROVIDER``."""
    return events.groupBy("stream_id").transformWithStateInPandas(RunStates(), CHANGES, "Append", "none")


def score_stream(rows: DataFrame, state: Fitted, root: str, checkpoint: str, *, keep: tuple[str, ...] = ("row_ordinal",), request_id: str = "stream") -> StreamingQuery:
    """Scores arriving rows with a fitted state, without fitting anew, and appends them to ``root`` by request."""
    out = score_linear(transform_features(rows, state, keep=keep), state, keep).withColumn("request_id", F.lit(request_id))
    return out.writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint).partitionBy("request_id").trigger(availableNow=True).start()
