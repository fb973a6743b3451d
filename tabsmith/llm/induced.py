"""External induced sorting of suffixes, with common prefixes up to a cap.

A suffix is of type L if it is greater than the one after it, else S; an S suffix after an L one is a star. The order of the stars gives that of
all: scanned in ascending order each suffix hands the one before it, if of type L, to the queue of its first symbol; then the same in
descending order for type S. Entries leave a queue by symbol and within it as they came, which is their order. An entry carries
its position and the prefix that it has in common with the entry before it: one more than the least common prefix that was scanned since.

The stars are first ordered up to the next star, by the same two scans from stars ordered by their first symbol; they get names by that
order, and where names repeat, the string of names is sorted likewise, one level deeper, until it fits in memory (then by doubling) or all names differ.

What grows with the text (queues, scanned suffixes, stars, names) is kept in memory up to ``memory`` entries each and in files
of ``folder`` beyond; the text and other files are memory-mapped. A step works on all entries of one symbol, in slices.
"""

from __future__ import annotations

import heapq
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np

#: Entries worked on at a time.
SLICE = 1 << 18
Part = tuple[np.ndarray, np.ndarray]


class Log:
    """A growing array: in memory up to ``memory`` entries, then in a file."""

    def __init__(self, folder: str, kind: np.dtype | type, memory: int) -> None:
        self.path, self.kind, self.memory = os.path.join(folder, uuid.uuid4().hex), np.dtype(kind), memory
        self.held: list[np.ndarray] = []
        self.size = self.written = 0

    def add(self, x: np.ndarray) -> None:
        self.held.append(np.asarray(x, self.kind))
        self.size += len(x)
        if self.size - self.written > self.memory:
            self._write()

    def _write(self) -> None:
        with open(self.path, "ab") as f:
            for x in self.held:
                f.write(np.ascontiguousarray(x).tobytes())
        self.held, self.written = [], self.size

    def array(self) -> np.ndarray:
        if self.written:
            self._write()
            return np.asarray(np.memmap(self.path, self.kind, "r+"))
        self.held = [np.concatenate([np.zeros(0, self.kind), *self.held])]
        return self.held[0]

    def close(self) -> None:
        self.held = []
        if self.written:
            os.remove(self.path)


class _Run:
    """Entries in a file, sorted by key."""

    def __init__(self, folder: str, key: np.ndarray, part: Part) -> None:
        self.logs = [Log(folder, x.dtype, 0) for x in (key, *part)]
        for log, x in zip(self.logs, (key, *part), strict=True):
            log.add(x)
        self.key, self.position, self.prefix = (log.array() for log in self.logs)
        self.at = 0

    @property
    def least(self) -> int | None:
        return int(self.key[self.at]) if self.at < len(self.key) else None

    def take(self, key: int) -> Part:
        ahead = self.key[self.at : self.at + SLICE]
        a, self.at = self.at, self.at + int(np.searchsorted(ahead, key, "right"))
        return np.array(self.position[a : self.at]), np.array(self.prefix[a : self.at])

    def close(self) -> None:
        for log in self.logs:
            log.close()


class SymbolQueue:
    """A priority queue of (key, position, common prefix) that leave by key, and by age among equal keys. Keys that are
    pushed are never below the one that is taken."""

    def __init__(self, folder: str, memory: int) -> None:
        self.folder, self.memory, self.held = folder, memory, 0
        self.new: dict[int, list[Part]] = {}
        self.keys: list[int] = []
        self.runs: list[_Run] = []

    def push(self, key: np.ndarray, position: np.ndarray, prefix: np.ndarray) -> None:
        """Entries in the order of their keys."""
        if not len(key):
            return
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
            k = int(key[a])
            if k not in self.new:
                self.new[k] = []
                heapq.heappush(self.keys, k)
            self.new[k].append((position[a:b], prefix[a:b]))
        self.held += len(key)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        keys = sorted(self.new)
        size = [sum(len(p) for p, _ in self.new[k]) for k in keys]
        part = tuple(np.concatenate([x[c] for k in keys for x in self.new[k]]) for c in range(2))
        self.runs.append(_Run(self.folder, np.repeat(np.array(keys, np.int64), size), part))
        self.new, self.keys, self.held = {}, [], 0

    def least(self) -> int | None:
        found = [x for x in (r.least for r in self.runs) if x is not None]
        return min([*found, *self.keys[:1]], default=None)

    def take(self, key: int) -> Iterator[Part]:
        """The entries of the least key, also those that are pushed meanwhile."""
        while True:
            run = next((r for r in self.runs if r.least == key), None)
            if run:
                yield run.take(key)
            elif self.keys and self.keys[0] == key:
                heapq.heappop(self.keys)
                parts = self.new.pop(key)
                self.held -= sum(len(p) for p, _ in parts)
                for p, x in parts if len(parts[0][0]) > SLICE else [tuple(np.concatenate([y[c] for y in parts]) for c in range(2))]:
                    for k in range(0, len(p), SLICE):
                        yield p[k : k + SLICE], x[k : k + SLICE]
            else:
                return

    def close(self) -> None:
        for r in self.runs:
            r.close()


class Carry:
    """The least common prefix scanned since each symbol's last push; -1 before its first. Symbols are 0 to 255."""

    def __init__(self, cap: int) -> None:
        self.cap, self.since = cap, np.full(256, -1, np.int16)

    def prefixes(self, scanned: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Of the items ``at`` of a slice, sorted by symbol, pushed to the queues of their symbols: the prefix in common with the push before."""
        n = len(scanned)
        first = np.append(True, symbol[1:] != symbol[:-1])
        lo = np.where(first, 0, np.append(0, at[:-1] + 1))
        out = least_between(scanned, lo, at)
        out[first] = np.minimum(out[first], self.since[symbol[first]])
        after = np.append(np.minimum.accumulate(scanned[::-1])[::-1], np.int16(self.cap))
        self.since = np.minimum(self.since, after[0])
        last = np.append(symbol[1:] != symbol[:-1], True)
        self.since[symbol[last]] = after[np.minimum(at[last] + 1, n)]
        return np.minimum(out + np.int16(1), self.cap).astype(np.int16)

    def passed(self, scanned: np.ndarray) -> None:
        self.since = np.minimum(self.since, scanned.min())


def least_between(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo..hi]) for each pair, by minima over powers of two."""
    out = np.empty(len(lo), x.dtype)
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    now, k = x, 0
    top = int(level.max()) if len(level) else -1
    by = np.argsort(level, kind="stable")
    ends = np.searchsorted(level[by], np.arange(top + 2))
    while k <= top:
        own = by[ends[k] : ends[k + 1]]
        out[own] = np.minimum(now[lo[own]], now[hi[own] - (1 << k) + 1])
        now = np.minimum(now[: len(now) - (1 << k)], now[1 << k :]) if k < top else now
        k += 1
    return out


def flags(n: int, folder: str, memory: int) -> np.ndarray:
    return np.zeros(n, bool) if n <= memory else np.asarray(np.memmap(os.path.join(folder, uuid.uuid4().hex), bool, "w+", shape=(n,)))


def stars(text: np.ndarray, log: Log) -> None:
    """Positions of the stars: where a fall's last symbol runs on until a rise."""
    fell = -1  # the position after the last change, if that was a fall
    for k in range(0, len(text) - 1, SLICE):
        here = text[k : k + SLICE + 1]
        change = np.flatnonzero(here[1:] != here[:-1])
        rise = here[change + 1] > here[change]
        after = np.append(fell, np.where(rise, -1, k + change + 1))
        log.add(after[:-1][rise & (after[:-1] >= 0)])
        fell = int(after[-1])


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Equal symbols from ``a`` and ``b`` on, up to ``cap`` and the text's end; the text has eight zero bytes beyond its end."""
    n = len(text) - 8
    word = np.ndarray(n + 1, "<u8", text, 0, (1,))
    most = np.minimum(cap, n - np.maximum(a, b))
    out = most.copy()
    left, done = np.flatnonzero(most > 0), 0
    while len(left):
        x = word[a[left] + done] ^ word[b[left] + done]
        differ = x != 0
        low = x[differ] & -x[differ]
        out[left[differ]] = np.minimum(done + (np.frexp(low.astype(float))[1] - 1) // 8, most[left[differ]])
        done += 8
        left = left[~differ & (most[left] > done)]
    return out


def induce(text: np.ndarray, n: int, seeds: SymbolQueue, folder: str, memory: int, emit: Callable[[np.ndarray, np.ndarray], None], cap: int = 0) -> None:
    """Calls ``emit(positions, prefixes)`` with all suffixes of ``text[:n]`` in descending order, from the stars in ascending order.
    A prefix is what a suffix has in common with the one emitted before it (0 between symbols); with ``cap`` 0 none is known."""
    kind = np.int32 if n < 1 << 31 else np.int64
    queue, scanned = SymbolQueue(folder, memory), [Log(folder, k, memory) for k in (kind, np.int16)]
    carry = Carry(cap) if cap else None
    nothing = np.zeros(0, np.int16)

    def scan(to: SymbolQueue, symbol: int, position: np.ndarray, prefix: np.ndarray, sign: int, strict: bool) -> None:
        """Pushes the suffixes before ``position`` whose first symbol is not less (sign 1) or not greater (sign -1) than this one's."""
        before = text[np.maximum(position - 1, 0)]
        good = (before > symbol if sign > 0 else before < symbol) if strict else (before >= symbol if sign > 0 else before <= symbol)
        at = np.flatnonzero(good & (position > 0))
        if not len(at):
            if carry:
                carry.passed(prefix)
            return
        t = before[at]
        by = np.argsort(t, kind="stable") if sign > 0 else np.argsort(np.iinfo(t.dtype).max - t, kind="stable")
        at, t = at[by], t[by]
        value = carry.prefixes(prefix, at, t) if carry else nothing
        to.push(sign * t.astype(np.int64), position[at] - 1, value if carry else np.zeros(len(at), np.int16))

    end = np.array([n - 1], kind)
    if carry:
        carry.since[text[n - 1]] = cap
    queue.push(text[end].astype(np.int64), end, np.zeros(1, np.int16))
    while (symbol := min([x for x in (queue.least(), seeds.least()) if x is not None], default=None)) is not None:
        last = None
        for position, prefix in queue.take(symbol):
            for log, x in zip(scanned, (position, prefix), strict=True):
                log.add(x)
            scan(queue, symbol, position, prefix, 1, False)
            last = position[-1:]
        for position, prefix in seeds.take(symbol):
            if last is not None and cap:
                prefix[0] = common_prefix(text, last, position[:1], cap)[0]
            last = None
            scan(queue, symbol, position, prefix, 1, False)
    queue.close()

    carry = Carry(cap) if cap else None
    queue = SymbolQueue(folder, memory)
    large, shared = (log.array() for log in scanned)
    top = len(large)
    while top or queue.least() is not None:
        symbol = max(-queue.least() if queue.least() is not None else -1, int(text[large[top - 1]]) if top else -1)
        last = None
        if queue.least() == -symbol:
            for position, prefix in queue.take(-symbol):
                emit(position, prefix)
                scan(queue, symbol, position, prefix, -1, False)
                last = position[-1:]
        edge = np.zeros(1, np.int16)
        first = True
        while top and text[large[top - 1]] == symbol:
            a = max(top - SLICE, 0)
            a += int(np.searchsorted(text[large[a:top]], symbol, "left"))
            position = large[a:top][::-1].copy()
            if first and last is not None and cap:
                edge = common_prefix(text, last, position[:1], cap).astype(np.int16)
            prefix, first = np.append(edge, shared[a + 1 : top][::-1]), False
            edge, top = shared[a : a + 1].copy(), a
            emit(position, prefix)
            scan(queue, symbol, position, prefix, -1, True)
    queue.close()
    for log in scanned:
        log.close()


def doubling(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of an array in memory: groups of equal rank are split by the rank 1, 2, 4, ... places on."""
    n, step = len(names), 1
    order = np.argsort(names, kind="stable")
    value = names[order]
    while True:
        new = np.append(True, value[1:] != value[:-1])
        if step == 1:
            rank, slots, start = np.empty(n, np.int64), np.arange(n), 0
        place = np.maximum.accumulate(np.where(new, slots, 0))
        rank[order[slots]] = place
        alone = new & np.append(new[1:], True)
        slots, place = slots[~alone], place[~alone]
        if not len(slots):
            return order
        act = order[slots]
        ahead = np.where(act + step < n, rank[np.minimum(act + step, n - 1)] + 1, 0)
        key = place * (n + 1) + ahead
        by = np.argsort(key, kind="stable")
        order[slots], value = act[by], key[by]
        step *= 2


def star_order(text: np.ndarray, n: int, folder: str, memory: int) -> Log:
    """The stars of ``text[:n]`` in ascending order of their suffixes."""
    kind = np.int32 if n < 1 << 31 else np.int64
    place = Log(folder, kind, memory)
    stars(text[:n], place)
    start = place.array()
    m = len(start)
    seeds = SymbolQueue(folder, memory)
    for k in range(0, m, SLICE):
        p = np.array(start[k : k + SLICE])
        t = text[p].astype(np.int64)
        by = np.argsort(t, kind="stable")
        seeds.push(t[by], p[by], np.zeros(len(p), np.int16))
    down = Log(folder, kind, memory)
    starred = flags(n, folder, memory)
    starred[start] = True

    def keep(position: np.ndarray, _: np.ndarray) -> None:
        down.add(position[starred[position]])

    if m:
        induce(text, n, seeds, folder, memory, keep)
    seeds.close()
    part = down.array()  # descending, by substrings only
    names = Log(folder, np.int64, memory)
    fresh, last = 0, None
    for k in range(0, m, SLICE):
        p = np.array(part[::-1][k : k + SLICE]).astype(np.int64)
        at = np.searchsorted(start, p)
        size = np.append(start, n + 1)[at + 1] - p if m <= SLICE else np.where(at + 1 < m, start[np.minimum(at + 1, m - 1)], n + 1) - p
        a, s = (np.append(x[:0] if last is None else [last[i]], x[:-1]).astype(np.int64) for i, x in enumerate((p, size)))
        head = last is None
        equal = (s == size[head:]) & (a + s < n) & (p[head:] + size[head:] < n)
        left = np.flatnonzero(equal)
        d = 0
        while len(left):
            differ = text[a[left] + d] != text[p[head:][left] + d]
            equal[left[differ]] = False
            d += 1
            left = left[~differ]
            left = left[s[left] >= d]
        step = np.append(np.zeros(int(head), np.int64), ~equal).astype(np.int64)
        names.add(fresh + np.cumsum(step))
        fresh, last = int(fresh + step.sum()), (p[-1], size[-1])
    if m and fresh + 1 < m:  # some names repeat
        by_name = names.array()
        string = Log(folder, np.int64, memory)
        for k in range(0, m, SLICE):
            string.add(np.zeros(min(SLICE, m - k)))
        reduced = string.array()
        for k in range(0, m, SLICE):
            reduced[np.searchsorted(start, part[::-1][k : k + SLICE])] = by_name[k : k + SLICE]
        out = Log(folder, kind, memory)
        if m <= memory:
            out.add(start[doubling(reduced)])
        else:
            order = suffix_order(reduced, folder, memory)
            whole = order.array()
            for k in range(0, m, SLICE):
                out.add(start[whole[k : k + SLICE]])
            order.close()
        string.close()
        down.close()
    else:
        out = Log(folder, kind, memory)
        for k in range(0, m, SLICE):
            out.add(part[::-1][k : k + SLICE])
        down.close()
    names.close()
    place.close()
    return out


def _ordered_seeds(text: np.ndarray, order: np.ndarray, folder: str, memory: int, cap: int) -> SymbolQueue:
    seeds = SymbolQueue(folder, memory)
    for k in range(0, len(order), SLICE):
        p = np.array(order[k : k + SLICE])
        prefix = np.zeros(len(p), np.int16)
        if cap:
            a = np.append(order[k - 1 : k], p[:-1]) if k else p[:-1]
            prefix[len(p) - len(a) :] = common_prefix(text, a, p[len(p) - len(a) :], cap)
        seeds.push(text[p].astype(np.int64), p, prefix)
    return seeds


def suffix_order(text: np.ndarray, folder: str, memory: int) -> Log:
    """The suffixes of an array of symbols from 0 on in ascending order."""
    n = len(text)
    stars_ = star_order(text, n, folder, memory)
    seeds = _ordered_seeds(text, stars_.array(), folder, memory, 0)
    down = Log(folder, np.int64, memory)
    if n:
        induce(text, n, seeds, folder, memory, lambda p, _: down.add(p))
    seeds.close()
    stars_.close()
    out, x = Log(folder, np.int64, memory), down.array()
    for k in range(0, n, SLICE):
        out.add(x[::-1][k : k + SLICE])
    down.close()
    return out


def shared_starts(text: np.ndarray, least: int, folder: str, memory: int) -> np.ndarray:
    """For each place of ``text``, bytes with eight zero bytes beyond their end, whether ``least`` bytes from there also start anywhere else."""
    n = len(text) - 8
    flag = flags(n, folder, memory)
    if not n:
        return flag
    order = star_order(text, n, folder, memory)
    seeds = _ordered_seeds(text, order.array(), folder, memory, least)
    last = np.zeros(0, np.int64)

    def mark(position: np.ndarray, prefix: np.ndarray) -> None:
        nonlocal last
        hit = np.flatnonzero(prefix >= least)
        flag[position[hit]] = True
        flag[position[hit[hit > 0] - 1]] = True
        if len(hit) and hit[0] == 0:
            flag[last] = True
        last = position[-1:]

    induce(text, n, seeds, folder, memory, mark, least)
    seeds.close()
    order.close()
    return flag
