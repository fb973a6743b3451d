"""Words, word hashes and shingles of a whole Arrow string column at a time, in numpy.

A word is a maximal run of bytes other than ASCII blanks, controls and punctuation, with ASCII letters
lower-cased (callers lower other letters with Spark's ``lower`` first). Words are hashed eight bytes at a time, all words
at once; only words above ``LONG`` bytes, of which a text has few for its size, are hashed one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at a time; a longer document makes a piece of its own.
PIECE = 1 << 18
#: Rows of a piece, so that a row number and a shingle's 48 bits fit one sortable word.
MOST_ROWS = 1 << 15
KEPT = U64((1 << 48) - 1)

_KIND = np.ones(256, bool)
_KIND[:128] = [chr(c).isalnum() for c in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: For 0 to 8 bytes of a little-endian word, the bits they have.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
LONG = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


@dataclass
class Words:
    """``start, end``: byte positions in ``data``; ``hash``; ``first``: index of each row's first word, and the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    breaks: np.ndarray | None = None

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null rows are empty."""
    col = col.cast(pa.large_string()) if col.type != pa.large_string() else col
    col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word of the rows ``data[offsets[i]:offsets[i+1]]``, and the index of each row's first word, and the
    end; no word spans two rows."""
    n = len(data)
    kind = np.zeros(n + 2, bool)
    kind[1 : n + 1] = _KIND[data]
    change = kind[1:] != kind[:-1]  # at i: byte i starts a word, or ends one that came before
    inner = offsets[1:-1]
    cut = inner[(inner > 0) & (inner < n)]
    cut = np.unique(cut[kind[cut] & kind[cut + 1]])
    at = np.flatnonzero(change)
    if len(cut):  # a row ends inside a run: end the word and start another
        at = np.sort(np.concatenate([at, cut, cut]))
    return at[0::2], at[1::2], np.searchsorted(at[0::2], offsets, "left")


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the rows ``data[offsets[i]:offsets[i+1]]``, with their hashes."""
    start, end, first = word_spans(data, offsets)
    return Words(data, start, end, word_hashes(data, start, end), first)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, ASCII letters taken as lower-case."""
    low = data.tobytes().translate(_LOWER.tobytes()) + bytes(8)
    eight = np.ndarray(len(data) + 1, "<u8", low, 0, (1,))  # the eight bytes from each byte on
    size = end - start
    value = mix64((eight[start] & _BYTES[np.minimum(size, 8)]) ^ size.astype(U64) * U64(0x9E3779B97F4A7C15))
    left = np.flatnonzero((size > 8) & (size <= LONG))
    done = 8
    while len(left):
        more = eight[start[left] + done] & _BYTES[np.minimum(size[left] - done, 8)]
        value[left] = mix64(value[left] * U64(0x100000001B3) ^ more)
        done += 8
        left = left[size[left] > done]
    for k in np.flatnonzero(size > LONG).tolist():
        value[k] = int.from_bytes(hashlib.blake2b(low[start[k] : end[k]], digest_size=8).digest(), "little")
    return value


def pieces(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of a batch of about ``PIECE`` bytes, each with its words."""
    data, offsets = column_bytes(batch.column(text))
    k, n = 0, batch.num_rows
    while k < n:
        m = min(max(int(np.searchsorted(offsets, offsets[k] + PIECE, "right")) - 1, k + 1), k + MOST_ROWS, n)
        yield batch.slice(k, m - k), words(data[offsets[k] : offsets[m]], offsets[k : m + 1] - offsets[k])
        k = m


def byte_pieces(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows k to m of a batch, of about ``PIECE`` bytes, with their bytes and offsets."""
    data, offsets = column_bytes(batch.column(text))
    k, n = 0, batch.num_rows
    while k < n:
        m = min(max(int(np.searchsorted(offsets, offsets[k] + PIECE, "right")) - 1, k + 1), n)
        yield k, m, data[offsets[k] : offsets[m]], offsets[k : m + 1] - offsets[k]
        k = m


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit shingle hashes of each row, one row after another, and each row's offset. A row of
    fewer words than ``size`` (but at least one) has all its words as the single shingle."""
    count = np.diff(w.first)
    n = len(w.hash)
    with np.errstate(over="ignore"):
        acc = np.zeros(n, U64)
        for k in range(size):  # words beyond a row's end are left out
            moved = np.zeros(n, U64)
            moved[: max(n - k, 0)] = w.hash[k:] * U64(2 * k + 3) ^ (w.hash[k:] >> U64(k + 7))
            acc = acc * U64(0x100000001B3) + moved
    row = w.row
    place = np.arange(n) - w.first[:-1][row]
    keep = place <= count[row] - size
    short = np.flatnonzero((count > 0) & (count < size))
    acc = mix64(acc)
    if len(short):
        lone = np.flatnonzero((count < size)[row])
        with np.errstate(over="ignore"):
            each = w.hash[lone] * (2 * place[lone].astype(U64) + U64(3))
            acc[w.first[:-1][short]] = mix64(np.add.reduceat(each, np.flatnonzero(place[lone] == 0)))
        keep[w.first[:-1][short]] = True
    row, value = row[keep], acc[keep]
    if len(count) > MOST_ROWS:
        raise ValueError("too many rows in a piece")
    packed = np.sort(row.astype(U64) << U64(48) | value & KEPT)
    fresh = np.ones(len(packed), bool)
    fresh[1:] = packed[1:] != packed[:-1]
    packed = packed[fresh]
    return packed & KEPT, np.searchsorted(packed, np.arange(len(count) + 1, dtype=U64) << U64(48), "left")


def minhash(values: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """rows x seeds: the least of the row's values under each seeded hash; rows without values get the greatest value."""
    out = np.full((len(offsets) - 1, len(seeds)), np.iinfo(np.uint64).max, U64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        with np.errstate(over="ignore"):
            for j, s in enumerate(seeds):
                out[full, j] = np.minimum.reduceat((values ^ s) * (s | U64(1)), offsets[:-1][full])
    return out


def seeds(n: int, seed: int = 1) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """rows x bands: a 64-bit key for each band of ``rows`` consecutive minima; bands don't share keys."""
    with np.errstate(over="ignore"):
        out = np.empty((len(signature), bands), U64)
        for b in range(bands):
            acc = np.full(len(signature), U64(b + 1))
            for r in range(rows):
                acc = mix64(acc ^ signature[:, b * rows + r]) + U64(r)
            out[:, b] = mix64(acc)
    return out


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
