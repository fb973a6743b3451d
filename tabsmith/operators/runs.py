"""Runs of prediction requests, derived from their events in the order of ``seq``, stream by stream.

A reservation is refused if its request is known, whatever became of it, or if it is neither baseline nor experiment and
not newer than the stream's head. Else it is pending; unless it is an experiment, or a baseline where there is a head, the
head moves to its generation, and pending runs of older generations that are no baseline are superseded. A pending
run is published, unless it is neither baseline nor experiment and the head has moved: then it is superseded. A run that
fails, or is rolled back once published, sends the head back to the highest published generation that is no
experiment, or to none. Cancelling and deleting leave the head. Any known run can be deleted, and its request is then unknown. A published
baseline becomes the stream's; if it is rolled back, the one before it is again, if still published; if it is deleted,
none. Generation 0 is a baseline in all but being superseded.

A stream's state is its head and baseline, its known runs by request, and two heaps, of pending and published generations, so that an
event touches the runs that it changes and a few cells of a heap, not the stream's history. The rules work over maps: dictionaries
in a batch, pages of keyed state in a stream.

A batch need not begin at the beginning: ``settled`` makes a table of states from changes, and ``advanced`` goes on from it over later
events. A stream's events pass through one task in order, as each depends on all before it, but are not gathered; with states
stored now and then no step works on more than the events since, the live runs, and the closed ones that these events name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.storage import fresh_path, stored

CHANGES = "stream_id string, request_id string, generation long, baseline boolean, experiment boolean, seq long, status string, before string, at long"
NAMES = [c.split()[0] for c in CHANGES.split(", ")]
EVENT = ("request_id", "generation", "seq", "kind", "baseline", "experiment")


class Run(NamedTuple):
    request: str
    generation: int
    baseline: bool
    experiment: bool
    seq: int
    status: str = "pending"
    before: str | None = None

    @property
    def base(self) -> bool:
        return self.baseline or self.generation == 0


class Cells:
    """A map; None stands for what is not there."""

    def __init__(self) -> None:
        self.have: dict = {}

    def get(self, key: Any) -> Any:
        return self.have.get(key)

    def put(self, key: Any, value: Any) -> None:
        if value is None:
            self.have.pop(key, None)
        else:
            self.have[key] = value


class Pages(Cells):
    """A map kept elsewhere in ``n`` pages of some 256 entries, of which ``load`` gives one by its number and ``made`` makes a value of what was
    written. A page is read when an entry of it is asked for; ``written`` gives the pages that change, once all is put."""

    SIZE = 256

    def __init__(self, load: Callable[[int], dict], made: Callable[[Any], Any], n: int = 0) -> None:
        super().__init__()
        self.load, self.made, self.n, self.pages, self.changed = load, made, n, {}, set()

    def page_of(self, key: Any) -> int:
        return key // self.SIZE

    def page(self, number: int) -> dict:
        if number not in self.pages:
            self.pages[number] = self.load(number) if number < self.n else {}
        return self.pages[number]

    def get(self, key: Any) -> Any:
        if key not in self.have:
            value = self.page(self.page_of(key)).get(key)
            self.have[key] = None if value is None else self.made(value)
        return self.have[key]

    def put(self, key: Any, value: Any) -> None:
        self.have[key] = value
        self.changed.add(key)

    def written(self) -> dict[int, dict]:
        out = {}
        for key in self.changed:
            number = self.page_of(key)
            out[number] = self.page(number)
            if self.have[key] is None:
                out[number].pop(key, None)
            else:
                out[number][key] = self.have[key]
        self.changed = set()
        return out


class HashedPages(Pages):
    """Pages of keys that are text, dealt by a hash. There is one more for every 256 entries, which takes its own from one other page, so that a
    page stays small however many ``entries`` there are."""

    def __init__(self, load: Callable[[int], dict], made: Callable[[Any], Any], n: int = 0, entries: int = 0) -> None:
        super().__init__(load, made, n)
        self.entries = entries

    def page_of(self, key: str | None) -> int:
        if self.n < 2:
            return 0
        whole = 1 << (self.n - 1).bit_length()
        k = zlib.crc32((key or "").encode("utf-8", "surrogatepass")) % whole
        return k if k < self.n else k - whole // 2

    def written(self) -> dict[int, dict]:
        self.entries += sum((self.have[key] is not None) - (key in self.page(self.page_of(key))) for key in self.changed)
        out = {}
        while self.entries > self.n * self.SIZE:
            out |= self._one_more()
        return out | super().written()

    def _one_more(self) -> dict[int, dict]:
        new = self.n
        old, taken = new - (1 << new.bit_length() - 1) if new else 0, {}
        rows = self.page(old)
        self.n, self.pages[new] = new + 1, taken if new else rows
        for key in [key for key in rows if self.page_of(key) != old]:
            taken[key] = rows.pop(key)
        return {old: rows, new: self.pages[new]}


@dataclass
class Heap:
    """The least of (order, seq, request) first, in cells 0 to size - 1."""

    cells: Cells = field(default_factory=Cells)
    size: int = 0

    def push(self, entry: tuple[int, int, str]) -> None:
        k = self.size
        self.size += 1
        while k and entry < self.cells.get((k - 1) // 2):
            self.cells.put(k, self.cells.get((k - 1) // 2))
            k = (k - 1) // 2
        self.cells.put(k, entry)

    def top(self) -> tuple[int, int, str] | None:
        return self.cells.get(0) if self.size else None

    def pop(self) -> None:
        self.size -= 1
        entry, k = self.cells.get(self.size), 0
        self.cells.put(self.size, None)
        while self.size and (least := min((c for c in (2 * k + 1, 2 * k + 2) if c < self.size), key=self.cells.get, default=None)) is not None and self.cells.get(least) < entry:
            self.cells.put(k, self.cells.get(least))
            k = least
        if self.size:
            self.cells.put(k, entry)


@dataclass
class Stream:
    """``runs``: the known ones by request. The heaps may also name runs that are closed by now."""

    head: int | None = None
    base: str | None = None
    runs: Cells = field(default_factory=Cells)
    pending: Heap = field(default_factory=Heap)
    published: Heap = field(default_factory=Heap)

    def _live(self, entry: tuple[int, int, str], status: str) -> Run | None:
        run = self.runs.get(entry[2])
        return run if run and run.status == status and run.seq == entry[1] else None

    def hold(self, run: Run) -> Run:
        """Takes up a run in its state."""
        self.runs.put(run.request, run)
        if run.status == "pending" and not run.baseline:
            self.pending.push((run.generation, run.seq, run.request))
        if run.status == "published" and not run.experiment:
            self.published.push((-run.generation, run.seq, run.request))
        return run

    def _close(self, run: Run, status: str) -> Run:
        run = run._replace(status=status)
        self.runs.put(run.request, None if status == "deleted" else run)
        return run

    def _reserve(self, run: Run) -> list[Run]:
        late = not run.experiment and not run.base and self.head is not None and run.generation <= self.head
        if late or self.runs.get(run.request):
            return [run._replace(status="refused")]
        out = []
        if not run.experiment and (not run.base or self.head is None):
            self.head = run.generation
            while (first := self.pending.top()) and first[0] < run.generation:
                self.pending.pop()
                if old := self._live(first, "pending"):
                    out.append(self._close(old, "superseded"))
        return [*out, self.hold(run)]

    def _back(self) -> None:
        while (first := self.published.top()) and not self._live(first, "published"):
            self.published.pop()
        self.head = -first[0] if first else None

    def step(self, request: str, generation: int, seq: int, kind: str, baseline: bool, experiment: bool) -> list[Run]:
        """The runs that the event changes."""
        if kind == "reserve":
            return self._reserve(Run(request, generation, bool(baseline), bool(experiment), seq))
        run = self.runs.get(request)
        if run is None:
            return []
        if kind == "delete":
            self.base = None if self.base == request else self.base
            return [self._close(run, "deleted")]
        if kind == "rollback" and run.status == "published":
            run = self._close(run, "failed")
            self._back()
            if self.base == request:
                last = self.runs.get(run.before) if run.before is not None else None
                self.base = run.before if last and last.status == "published" else None
            return [run]
        if kind == "rollback" or run.status != "pending":
            return []
        if kind == "publish":
            if not run.experiment and not run.base and self.head is not None and self.head != run.generation:
                return [self._close(run, "superseded")]
            run = run._replace(status="published", before=self.base if run.base else None)
            self.base = request if run.base else self.base
            return [self.hold(run)]
        if kind == "cancel":
            return [self._close(run, "cancelled")]
        if kind == "fail":
            run = self._close(run, "failed")
            self._back()
            return [run]
        return []


def changes_of(stream_id: str, stream: Stream, events: pd.DataFrame) -> list[tuple]:
    """A row of ``CHANGES`` for each run that an event changes."""
    out = []
    for e in events[list(EVENT)].itertuples(index=False, name=None):
        out += [(stream_id, r.request, r.generation, r.baseline, r.experiment, r.seq, r.status, r.before, e[2]) for r in stream.step(*e)]
    return out


def frame(rows: Sequence[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES).astype({"generation": "Int64", "seq": "Int64", "at": "Int64"})


def _replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by stream, what is held first, then events by seq; at a stream's end its head and baseline, as a run of its own kind."""
    now, stream = None, Stream()

    def end() -> list[tuple]:
        return [] if now is None else [(now, stream.base, stream.head, False, False, None, "head", None, None)]

    def take_up(part: pd.DataFrame) -> None:
        for r in part.itertuples(index=False):
            if r.held == "head":
                stream.head, stream.base = (None if pd.isna(r.generation) else int(r.generation)), r.request_id
            else:
                stream.hold(Run(r.request_id, int(r.generation), bool(r.baseline), bool(r.experiment), int(r.seq), r.held, r.before))

    for part_of in frames:
        rows = []
        for name, part in part_of.groupby("stream_id", sort=False):
            if name != now:
                rows += end()
                now, stream = name, Stream()
            held = part["held"].notna()
            take_up(part[held])
            rows += changes_of(name, stream, part[~held])
        yield frame(rows)
    yield frame(end())


def _as_events(events: DataFrame) -> DataFrame:
    x = events.where("stream_id is not null")
    cols = [F.col(c).cast("long").alias(c) if c in ("generation", "seq") else F.col(c) for c in EVENT]
    return x.select("stream_id", *cols, F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("held"))


def _replayed(rows: DataFrame) -> DataFrame:
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", F.col("held").isNull(), "seq").mapInPandas(_replay, CHANGES)


def replayed(events: DataFrame) -> DataFrame:
    """A row of ``CHANGES`` for each change of a run, and one with status ``head`` for each stream: its head as
    ``generation``, its baseline as ``request_id``. Events without a stream are left out."""
    return _replayed(_as_events(events))


def settled(changes: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The state after ``changes``, on top of the ``state`` from which they were advanced: a row of ``CHANGES`` for each known run, and
    one with status ``head`` for each stream."""
    last = changes.where("status <> 'head'").groupBy("stream_id", "request_id", "seq").agg(F.max_by(F.struct("generation", "baseline", "experiment", "status", "before", "at"), "at").alias("l"))
    last = last.where("l.status <> 'refused'").select("stream_id", "request_id", "l.generation", "l.baseline", "l.experiment", "seq", "l.status", "l.before", "l.at")
    heads = changes.where("status = 'head'").select(*NAMES)
    new = last.where("status <> 'deleted'").select(*NAMES).unionByName(heads)
    if state is None:
        return new
    kept = state.where("status <> 'head'").join(last.select("stream_id", "request_id", "seq"), ["stream_id", "request_id", "seq"], "left_anti").select(*NAMES)
    same = state.where("status = 'head'").join(heads.select("stream_id"), "stream_id", "left_anti").select(*NAMES)
    return new.unionByName(kept).unionByName(same)


def advanced(state: DataFrame, events: DataFrame) -> DataFrame:
    """As ``replayed``, for the events since ``state``. Only streams that have some are worked on, and of their closed runs only those that the events name."""
    new = _as_events(events)
    touched = state.join(new.select("stream_id").distinct(), "stream_id", "left_semi")
    live = touched.where(F.col("status").isin("head", "pending", "published"))
    named = touched.where(~F.col("status").isin("head", "pending", "published")).join(new.select("stream_id", "request_id").distinct(), ["stream_id", "request_id"], "left_semi")
    held = live.unionByName(named).select("stream_id", "request_id", "generation", "seq", F.lit("held").alias("kind"), "baseline", "experiment", "before", F.col("status").alias("held"))
    return _replayed(held.unionByName(new))


def in_steps(events: DataFrame, ends: Sequence[int]) -> list[DataFrame]:
    """The events up to each seq of ``ends``, and those after the last. They are made and written once, and a step reads its own; those without a seq are in the first."""
    path, step = fresh_path(events.sparkSession, "run-events"), F.lit(0)
    for end in ends:
        step = step + F.when(F.col("seq") > end, 1).otherwise(0)
    events.withColumn("step", step).write.partitionBy("step").parquet(path)
    rows = events.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in events.schema)}, step int").parquet(path)
    return [rows.where(F.col("step") == k).drop("step") for k in range(len(ends) + 1)]


def replayed_in_steps(events: DataFrame, ends: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Changes and last state of events that are worked on up to each seq of ``ends``, then to the last, with the states and changes of each step written: no task
    works on more events of a stream than a step has."""
    state, out = None, None
    for part in in_steps(events, ends):
        changes = stored(replayed(part) if state is None else advanced(state, part), "run-changes")
        state = stored(settled(changes, state), "run-states")
        made = changes.where("status <> 'head'")
        out = made if out is None else out.unionByName(made)
    return out, state


def run_states(changes: DataFrame) -> DataFrame:
    """A row per reservation: ``request_id, stream_id, generation, baseline, experiment, seq, status``, which is pending, published,
    cancelled, superseded, failed, deleted or refused."""
    x = changes.where("status <> 'head'")
    return x.groupBy("request_id", "stream_id", "generation", "baseline", "experiment", "seq").agg(F.max_by("status", "at").alias("status"))


def stream_heads(changes: DataFrame) -> DataFrame:
    """``stream_id, head, baseline`` from changes or a state; null where there is none."""
    return changes.where("status = 'head'").select("stream_id", F.col("generation").alias("head"), F.col("request_id").alias("baseline"))
